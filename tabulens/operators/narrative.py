"""Short texts made of the profile's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import nan_to_null, per_column
from tabulens.operators.categorical import category_samples
from tabulens.operators.profile import dtype_histogram, missing_total, missing_values, missing_worst, numeric_stats


def missing_comment(df: DataFrame) -> DataFrame:
    """comment: the column with most missing values, or that there is none."""
    some = F.format_string("%s has most missing values (%s%%); %d columns have any", "column", F.col("percent").cast("string"), "affected")
    return missing_worst(df).select(F.when(F.col("column").isNotNull(), some).otherwise("no missing values").alias("comment"))


def distribution_comments(df: DataFrame, columns: list[str] | None = None, approx: bool = False, found: DataFrame | None = None) -> DataFrame:
    """column, comment: median and extremes. ``found``: the columns' five numbers, if they are known."""
    stats = numeric_stats(df, columns, approx, found)
    return stats.select("column", F.format_string("median %.2f, from %.2f to %.2f", "median", "min", "max").alias("comment"))


def trend_comments(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, comment: the range of the value over the time shown."""
    ends = per_column(nan_to_null(df), columns, lambda c: {"min": F.min(c.cast("double")), "max": F.max(c.cast("double"))})
    return ends.select("column", F.format_string("from %.2f to %.2f", "min", "max").alias("comment"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """line, topic, text: size, columns with missing values, types and samples of categories."""
    size = missing_total(df).select(F.lit(1).alias("line"), F.lit("size").alias("topic"), F.format_string("%d rows, %d columns", "rows", "columns").alias("text"))
    missing = missing_values(df).agg(F.count(F.lit(1)).alias("n")).select(F.lit(2), F.lit("missing"), F.format_string("%d columns with missing values", "n"))
    kinds = dtype_histogram(df).agg(F.sort_array(F.collect_list(F.format_string("%s: %d", "dtype", "columns"))).alias("t")).select(F.lit(3), F.lit("types"), F.array_join("t", ", "))
    samples = category_samples(df).select((F.lit(4) + F.col("position")).cast("int"), F.lit("category"), F.format_string("%s (%d values): %s", "column", "n_unique", "sample"))
    return size.union(missing).union(kinds).union(samples)
