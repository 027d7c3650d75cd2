"""Comparison of results that come in any order."""

import datetime
import decimal
import math

#: The tables at the smallest scale.
DATA = "/root/testdata/sf0.001"


def plain(value):
    """A value as text, alike for both engines."""
    if value is None or type(value).__name__ == "NAType" or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
            value = datetime.datetime(value.year, value.month, value.day)
        return value.isoformat()[:26]
    if isinstance(value, (int, float, decimal.Decimal)) or type(value).__module__ == "numpy" and not isinstance(value, str):
        return str(value) if str(value) in ("True", "False") else f"{float(value):.9g}" if math.isfinite(float(value)) else str(float(value))
    return str(value)


def rows(frame, columns=None):
    columns = sorted(frame.columns) if columns is None else columns
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))
