"""Swellcast: find what is rising in ranked lists and text, then score the picks in hindsight.

Every operator is a function from DataFrames to DataFrames (or from Columns to
Columns); actions happen only in sinks and streaming queries.
"""

__version__ = "0.1.0"
