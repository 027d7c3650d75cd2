"""Expressions used by the profile: null rules, moments, ANSI-safe ratios, and choice of columns by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in order; booleans are not numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def time_typed_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Both NaN and NULL mean missing: keep NULL only."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(q(c)), q(c)) for c in floats}) if floats else df


def percent(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole, null for an empty whole."""
    return F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), digits)


def adjusted_skew(c: Column) -> Column:
    """Sample skewness G1: null under three values, 0 for a constant."""
    n = F.count(c).cast("double")
    g1 = F.coalesce(F.skewness(c), F.lit(0.0))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


#: Upper bounds of the labels, exclusive; the last label has none.
SKEW_LABELS = ((-1.0, "strongly left"), (-0.5, "slightly left"), (0.5, "symmetric"), (1.0, "slightly right"))


def skew_label(skew: Column) -> Column:
    label = F.when(skew.isNull(), "undefined")
    for bound, name in SKEW_LABELS:
        label = label.when(skew < bound, name)
    return label.otherwise("strongly right")


def pairwise_correlation(a: Column, b: Column) -> Column:
    """Pearson over rows where both are present; null where a side is constant. F.corr would fail there."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def per_column(df: DataFrame, columns: list[str], measures) -> DataFrame:
    """One row per column from one aggregation: ``measures(column)`` gives named aggregates. No rows without columns."""
    if not columns:
        none = {n: v.alias(n) for n, v in measures(F.lit(None).cast("double")).items()}
        return df.agg(F.lit(0).alias("position"), F.lit("").alias("column"), *none.values()).where(F.lit(False))
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), *[v.alias(n) for n, v in measures(q(c)).items()]) for i, c in enumerate(columns)]
    return df.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))


def long_values(df: DataFrame, columns: list[str], value=lambda c: c.cast("string")) -> DataFrame:
    """(position, column, value) rows of the given columns, by one pass without a shuffle."""
    if not columns:
        return df.select(F.lit(0).alias("position"), F.lit("").alias("column"), value(F.lit(None).cast("string")).alias("value")).where(F.lit(False))
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), value(q(c)).alias("value")) for i, c in enumerate(columns)]
    return df.select(F.inline(F.array(*structs)))
