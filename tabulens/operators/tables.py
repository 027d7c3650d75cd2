"""Views of the rows themselves: head, preview, page and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import q


def head(df: DataFrame, n: int = 5, order_by: list[str | Column] | None = None) -> DataFrame:
    """The first rows; tables have no order of their own, so give one where it matters."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def preview(df: DataFrame, rows: int = 4, columns: int = 6, order_by: list[str | Column] | None = None) -> DataFrame:
    """The first rows of the first columns."""
    return head(df, rows, order_by).select(*[q(c) for c in df.columns[:columns]])


def page(df: DataFrame, order_by: list[str | Column], n: int = 10, number: int = 0) -> DataFrame:
    """Page ``number`` (from 0) of the sorted table."""
    return df.orderBy(*order_by).offset(number * n).limit(n)


def search_rows(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which every word of ``text`` occurs somewhere, upper and lower case alike."""
    row = F.lower(F.concat_ws(" ", *[q(c).cast("string") for c in (df.columns if columns is None else columns)]))
    hit = F.lit(True)
    for word in text.lower().split():
        hit &= row.contains(word)
    return df.where(hit)
