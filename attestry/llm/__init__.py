"""Operators of a training-data pipeline. Nothing outside this package imports it; the registered queries are in `queries`."""
