"""Small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(*names: str):
    """Columns rounded to 6 digits under their own name."""
    cols = [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]
    return cols if len(cols) > 1 else cols[0]


def joined(name: str, sep: str = ",") -> Column:
    return F.array_join(name, sep).alias(name)
