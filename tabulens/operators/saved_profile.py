"""A column profile that can be added to: states of each file, merged when the profile is asked for.

A file's state has a row per column: rows, present values, mean and squares about it, least and largest value, and two sketches, of
quantiles (KLL) and of distinct values (HyperLogLog). States merge without the data, so a table that grows by a file costs one file. A
file that has changed since has a new state, and its old one no longer counts.

Stated errors: counts, means, deviations, least and largest values are those of all rows (up to rounding); quantiles are off by up to 1 % of
the rows in rank; distinct counts by about 3 %. However files are added, at once or one by one, these bounds hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import nan_to_null, numeric_columns, q

#: Sizes of the sketches.
KLL_K, HLL_LG = 1000, 14
STATE = "file string, modified timestamp, position int, column string, dtype string, rows long, n long, mean double, m2 double, min double, max double, quantiles binary, distinct binary"


def _plain(file: Column) -> Column:
    """A file's name without an empty authority: Spark writes it either way."""
    return F.regexp_replace(file, r"^([A-Za-z][\w+.-]*):///", "$1:/")


def _of_row() -> Column:
    """The file of a row, as a listing names it."""
    return _plain(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


class SavedProfile:
    """The states at ``path`` of the files of a Parquet table.

    Defined results: NaN counts as missing; columns that are not numbers have no mean, deviation, bounds or quantiles, maps no distinct count; a
    file without rows says nothing; columns are those that any file has, in the order of the first; an empty profile has no rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], STATE).write.mode("ignore").parquet(f"{self.path}/states")

    @classmethod
    def of(cls, spark: SparkSession, table: str, path: str) -> SavedProfile:
        out = cls(spark, path)
        out.add(table)
        return out

    def states(self) -> DataFrame:
        """The latest state of each file."""
        every = self.spark.read.schema(STATE).parquet(f"{self.path}/states")
        latest = every.groupBy("file").agg(F.max("modified").alias("modified"))
        # A file given twice at once has the same state twice.
        return every.join(latest, ["file", "modified"]).dropDuplicates(["file", "column"])

    def add(self, table: str) -> int:
        """States of those files of ``table`` (a file, folder or glob) that are new or have changed; how many these are. Files' names come to the driver."""
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(table)
        files = listed.select(_plain(F.col("path")).alias("file"), F.col("modificationTime").alias("modified"))
        known = self.spark.read.schema(STATE).parquet(f"{self.path}/states").select("file", "modified").distinct()
        new = [r.file for r in files.join(known, ["file", "modified"], "left_anti").collect()]
        if new:
            df = self.spark.read.parquet(table)
            self._states(df.where(_of_row().isin(new))).write.mode("append").parquet(f"{self.path}/states")
        return len(new)

    def _states(self, df: DataFrame) -> DataFrame:
        numbers, types, columns = set(numeric_columns(df)), dict(df.dtypes), df.columns
        placed = df.select(_of_row().alias("__file"), F.col("_metadata.file_modification_time").alias("__modified"), *[q(c) for c in columns])
        cells = []
        for i, c in enumerate(columns):
            x = q(c).cast("double") if c in numbers else F.lit(None).cast("double")
            countable = not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))
            sketch = F.call_function("hll_sketch_agg", F.when(q(c).isNotNull(), F.xxhash64(q(c))), F.lit(HLL_LG)) if countable else F.lit(None).cast("binary")
            n = F.count(q(c))
            cells.append(
                F.struct(
                    F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.count(F.lit(1)).alias("rows"), n.alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * n).alias("m2"),
                    F.min(x).alias("min"), F.max(x).alias("max"), (F.kll_sketch_agg_double(x, KLL_K) if c in numbers else F.lit(None).cast("binary")).alias("quantiles"), sketch.alias("distinct"),
                )
            )
        return nan_to_null(placed).groupBy(F.col("__file").alias("file"), F.col("__modified").alias("modified")).agg(F.array(*cells).alias("cells")).select("file", "modified", F.inline("cells"))

    def result(self) -> DataFrame:
        """position, column, dtype, rows, n, missing, n_unique, mean, std, min, q1, median, q3, max over all files."""
        states = self.states()
        totals = states.groupBy(F.col("column").alias("of")).agg((F.sum(F.col("mean") * F.col("n")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("all_mean"))
        spread = states.join(totals, F.col("column") == F.col("of")).withColumn("m2_all", F.col("m2") + F.col("n") * (F.col("mean") - F.col("all_mean")) ** 2)
        merged = spread.groupBy("column").agg(
            F.min("position").alias("position"), F.min("dtype").alias("dtype"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.first("all_mean").alias("mean"), F.sum("m2_all").alias("m2"),
            F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double(F.when(F.col("mean").isNotNull(), F.col("quantiles"))).alias("kll"), F.hll_union_agg("distinct").alias("hll"),
        )
        at = lambda p: F.when(F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("kll", F.lit(p)))
        # A column that some file lacks is missing there.
        every = states.groupBy("file").agg(F.max("rows").alias("r")).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("all_rows"))
        std = F.when((F.col("n") > 1) & F.col("mean").isNotNull(), F.sqrt(F.col("m2") / (F.col("n") - 1)))
        return merged.join(F.broadcast(every)).select(
            "position", "column", "dtype", F.col("all_rows").alias("rows"), "n", (F.col("all_rows") - F.col("n")).alias("missing"), F.hll_sketch_estimate("hll").alias("n_unique"),
            "mean", std.alias("std"), "min", at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), "max",
        )
