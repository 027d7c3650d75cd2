"""The column profile: types, missing and distinct values, basic statistics, and columns chosen by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import long_values, nan_to_null, numeric_columns, per_column, percent, q, string_columns
from tabulens.operators.quantiles import quantiles


FIVE = [0.0, 0.25, 0.5, 0.75, 1.0]


def quartiles(df: DataFrame, columns: list[str], approx: bool = False, found: DataFrame | None = None) -> DataFrame:
    """position, column, n, q: the FIVE quantiles, for all sections that need any of them; ``found`` if they are known."""
    return quantiles(nan_to_null(df), columns, FIVE, approx) if found is None else found


def numeric_stats(df: DataFrame, columns: list[str] | None = None, approx: bool = False, found: DataFrame | None = None) -> DataFrame:
    """position, column, n, mean, median, std, min, max of numeric columns, missing values left out."""
    df = nan_to_null(df)
    columns = numeric_columns(df) if columns is None else columns
    moments = per_column(
        df, columns,
        lambda c: {"mean": F.avg(c.cast("double")), "std": F.stddev_samp(c.cast("double")), "min": F.min(c.cast("double")), "max": F.max(c.cast("double"))},
    )
    if found is None:
        middle = quantiles(df, columns, [0.5], approx).select("position", "n", F.get("q", F.lit(0)).alias("median"))
    else:
        middle = found.select("position", "n", F.get("q", F.lit(2)).alias("median"))
    return moments.join(middle, "position").select("position", "column", "n", "mean", "median", "std", "min", "max")


def missing_values(df: DataFrame, digits: int = 2, every: bool = False) -> DataFrame:
    """position, column, missing, percent of rows; columns without missing values only with ``every``."""
    df = nan_to_null(df)
    n = F.count(F.lit(1))
    out = per_column(df, df.columns, lambda c: {"missing": n - F.count(c), "percent": percent(n - F.count(c), n, digits)})
    return out if every else out.where("missing > 0")


def missing_table(df: DataFrame) -> DataFrame:
    """column, missing, percent (one digit), most first; a single row with column null if all is filled."""
    found = missing_values(df, 1, every=True)
    any_missing = F.sum("missing").over(Window.partitionBy())
    shown = found.withColumn("total", any_missing).where("missing > 0 or (total = 0 and position = 0)")
    return shown.select(F.when(F.col("total") > 0, F.col("column")).alias("column"), "missing", "percent").orderBy(F.desc("missing"), "column")


def missing_worst(df: DataFrame) -> DataFrame:
    """The column with most missing values (the first of equals), its percent, and how many columns have any."""
    found = missing_values(df, 1)
    first = F.max_by(F.struct("column", "missing", "percent"), F.struct("missing", -F.col("position")))
    return found.agg(first.alias("w"), F.count(F.lit(1)).alias("affected")).select("w.column", "w.missing", "w.percent", "affected")


def missing_total(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells and percent of cells that are filled."""
    df = nan_to_null(df)
    n = F.count(F.lit(1))
    empty = sum((n - F.count(q(c)) for c in df.columns), F.lit(0).cast("long"))
    cells = n * F.lit(len(df.columns))
    return df.agg(n.alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), empty.alias("missing"), percent(cells - empty, cells, 1).alias("filled"))


def _countable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def distinct_counts(df: DataFrame, approx: bool = False, columns: list[str] | None = None) -> DataFrame:
    """position, column, n_unique: distinct values that are not missing; null for maps.

    Values of all columns are reduced to 128-bit hashes and counted by one aggregation, instead
    of an expansion of the table for each column; long texts so shuffle 16 bytes each.
    """
    df = nan_to_null(df)
    columns = df.columns if columns is None else columns
    can = [c for c in columns if c in _countable(df)]
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(columns)), "position int, column string")
    if not can:
        return names.withColumn("n_unique", F.lit(None).cast("long"))
    if approx:
        found = per_column(df, can, lambda c: {"n_unique": F.approx_count_distinct(c, 0.02)}).select("column", "n_unique")
    else:
        hashed = long_values(df, can, lambda c: F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))))
        found = hashed.where("value is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    zero = F.when(F.col("column").isin(can), F.lit(0)).cast("long")
    return names.join(F.broadcast(found), "column", "left").select("position", "column", F.coalesce("n_unique", zero).alias("n_unique"))


def column_types(df: DataFrame, approx: bool = False) -> DataFrame:
    """position, column, dtype, n_unique."""
    types = df.sparkSession.createDataFrame([(c, t) for c, t in df.dtypes], "column string, dtype string")
    return distinct_counts(df, approx).join(F.broadcast(types), "column").select("position", "column", "dtype", "n_unique")


def dtype_histogram(df: DataFrame) -> DataFrame:
    """dtype, columns of that type and values present in them."""
    types = df.sparkSession.createDataFrame([(c, t) for c, t in df.dtypes], "column string, dtype string")
    present = per_column(nan_to_null(df), df.columns, lambda c: {"present": F.count(c)})
    return present.join(F.broadcast(types), "column").groupBy("dtype").agg(F.count(F.lit(1)).alias("columns"), F.sum("present").alias("present"))


def categorical_columns(df: DataFrame, max_unique: int = 15) -> DataFrame:
    """Strings of any cardinality, and other columns of few values."""
    return column_types(df).where((F.col("dtype") == "string") | (F.col("n_unique") <= max_unique))


def low_cardinality_strings(df: DataFrame, max_unique: int = 20) -> DataFrame:
    return column_types(df).where((F.col("dtype") == "string") & (F.col("n_unique") <= max_unique))


def target_columns(df: DataFrame, min_unique: int = 2) -> DataFrame:
    """Columns with enough different values to be predicted."""
    return column_types(df).where(F.col("n_unique") >= min_unique)


def uniqueness(df: DataFrame, column: str | None = None) -> DataFrame:
    """column, n, n_unique, percent of distinct among present values (0 if none), of the first column by default."""
    df = nan_to_null(df)
    column = df.columns[0] if column is None else column
    # One row per distinct value, then two sums: no single task sees the values.
    values = df.select(q(column).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    out = values.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_unique"))
    return out.select(F.lit(column).alias("column"), "n", "n_unique", F.coalesce(percent(F.col("n_unique"), F.col("n"), 1), F.lit(0.0)).alias("percent"))


def gauge_band(value):
    """low under 50, medium under 75, else high."""
    return F.when(value < 50, "low").when(value < 75, "medium").when(value.isNotNull(), "high")


def dense_columns(df: DataFrame, share: float = 0.9) -> list[str]:
    """Columns with values in at least ``share`` of the rows."""
    rows = missing_values(df, every=True).collect()  # a row per column
    n = df.count()
    return [r.column for r in sorted(rows, key=lambda r: r.position) if n - r.missing >= share * n]


def model_features(df: DataFrame, target: str) -> list[str]:
    """Numeric and string columns but the target."""
    usable = set(numeric_columns(df)) | set(string_columns(df))
    return [c for c in df.columns if c in usable and c != target]
