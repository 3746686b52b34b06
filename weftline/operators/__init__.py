"""Operators: functions from DataFrames (or keyed operands) to DataFrames, registered by name."""

from weftline.operators import aggregate, filters, keyed, nested, order, shape, stats, text

__all__ = ["aggregate", "filters", "keyed", "nested", "order", "shape", "stats", "text"]
