"""Readers, sinks, payload parsing and the bindings of the test tables."""
