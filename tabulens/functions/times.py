"""Parsing of times in text, with the best format per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import q

#: Formats tried on text, most general first; None is Spark's own ISO parser, for text that begins with a year.
FORMATS = (None, "MM/dd/yyyy", "dd.MM.yyyy", "dd/MM/yyyy", "yyyyMMdd", "MM/dd/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss")


def parse(c: Column, fmt: str | None) -> Column:
    """A timestamp or null; bare times of day and numbers are no dates."""
    if fmt is None:
        return F.when(c.rlike(r"^\d{4}-\d{1,2}"), F.try_to_timestamp(c))
    return F.try_to_timestamp(c, F.lit(fmt))


def best_formats(df: DataFrame, columns: list[str]) -> dict[str, tuple[str | None, float]]:
    """column: (format that parses most values, its share of all rows), from one aggregation."""
    if not columns:
        return {}
    n = F.count(F.lit(1))
    shares = [F.coalesce(F.try_divide(F.count(parse(q(c), f)).cast("double"), n), F.lit(0.0)) for c in columns for f in FORMATS]
    row = df.agg(F.array(*shares)).first()[0]
    out = {}
    for i, c in enumerate(columns):
        own = row[i * len(FORMATS) : (i + 1) * len(FORMATS)]
        out[c] = max(zip(FORMATS, own, strict=True), key=lambda x: x[1])
    return out
