"""Key figures, partly chosen by the names of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import nan_to_null, numeric_columns, per_column
from tabulens.functions.names import IDENTITY, MONEY, RATING, TIME, name_matches
from tabulens.operators.profile import distinct_counts, gauge_band, missing_total, uniqueness
from tabulens.operators.timeseries import date_range


def named_means(df: DataFrame, words: tuple[str, ...] = MONEY, match: str = "substring") -> DataFrame:
    """position, column, mean of each numeric column with such a name."""
    df = nan_to_null(df)
    columns = [c for c in numeric_columns(df) if name_matches(c, words, match)]
    if not columns:
        return df.sparkSession.createDataFrame([], "position int, column string, mean double")
    return per_column(df, columns, lambda c: {"mean": F.avg(c.cast("double"))})


def rating_means(df: DataFrame, match: str = "substring") -> DataFrame:
    return named_means(df, RATING, match)


def id_counts(df: DataFrame, match: str = "substring", approx: bool = False) -> DataFrame:
    """position, column, n_unique of columns named like ids."""
    return distinct_counts(df, approx, [c for c in df.columns if name_matches(c, IDENTITY, match)])


def date_ranges(df: DataFrame, match: str = "substring") -> DataFrame:
    return date_range(df, [c for c in df.columns if name_matches(c, TIME, match)])


def first_means(df: DataFrame, first: int = 3, least: int = 5) -> DataFrame:
    """position, column, mean of the first numeric columns that have some values."""
    df = nan_to_null(df)
    found = per_column(df, numeric_columns(df)[:first], lambda c: {"mean": F.avg(c.cast("double")), "n": F.count(c)})
    return found.where(F.col("n") >= least).drop("n")


def gauges(df: DataFrame) -> DataFrame:
    """gauge, percent, band: filled cells, and distinct values of the first column."""
    filled = missing_total(df).select(F.lit("filled").alias("gauge"), F.col("filled").alias("percent"))
    unique = uniqueness(df).select(F.lit("unique").alias("gauge"), "percent")
    return filled.union(unique).withColumn("band", gauge_band(F.col("percent")))


def key_figures(df: DataFrame, match: str = "substring") -> DataFrame:
    """kpi, column, value, text: all figures in one long table, numbers kept and formatted last."""
    none = F.lit(None).cast("double")
    row = lambda d, kpi, value, text: d.select(F.lit(kpi).alias("kpi"), F.col("column"), value.alias("value"), text.alias("text"))
    first = gauges(df).withColumn("column", F.lit(df.columns[0]))
    out = first.select(F.col("gauge").alias("kpi"), F.when(F.col("gauge") == "unique", F.col("column")).alias("column"), F.col("percent").alias("value"), F.format_string("%.1f%%", "percent").alias("text"))
    out = out.union(row(named_means(df, MONEY, match), "mean", F.col("mean"), F.format_number("mean", 2)))
    out = out.union(row(rating_means(df, match), "mean rating", F.col("mean"), F.format_number("mean", 2)))
    out = out.union(row(id_counts(df, match), "distinct ids", F.col("n_unique").cast("double"), F.col("n_unique").cast("string")))
    return out.union(row(date_ranges(df, match), "date range", none, F.concat_ws(" - ", "first", "last")))
