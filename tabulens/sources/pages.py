"""A stored order of a table, for pages at any depth.

The rows are ranged by the order and written once, in files of at most ``most`` rows whose places are kept in a small index. A page reads
the one or two files that hold it, whatever its number.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.columns import q

#: Rows of a file.
MOST = 100_000


class PageIndex:
    """The pages of a table that ``build`` has stored at ``path``.

    Defined results: null keys come where Spark sorts them; rows of equal keys keep one order, that of the build; a page
    beyond the end has no rows; an empty table has none at all. What comes to the driver is a number for each file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.read.parquet(f"{self.path}/rows").schema
        found = spark.read.parquet(f"{self.path}/files").orderBy("part", "piece").collect()
        self.files, self.starts, self.rows = [], [], 0
        for r in found:
            self.files.append(r.file)
            self.starts.append(self.rows)
            self.rows += r.n

    @classmethod
    def build(cls, df: DataFrame, order_by: list[str | Column], path: str, most: int = MOST) -> PageIndex:
        spark, path = df.sparkSession, path.rstrip("/")
        ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
        ranged.write.option("maxRecordsPerFile", most).parquet(f"{path}/rows")
        name = F.col("_metadata.file_name")
        counted = spark.read.parquet(f"{path}/rows").groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("n"))
        # A file is named by its task and its number within it.
        number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
        placed = counted.select("file", "n", number(r"^part-(\d+)").alias("part"), number(r"-c(\d+)\.").alias("piece"))
        placed.coalesce(1).write.parquet(f"{path}/files")
        return cls(spark, path)

    def _read(self, i: int, first: int, last: int) -> DataFrame:
        """Rows first to last of the file ``i``, with their places."""
        row = F.col("_metadata.row_index")
        read = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{_literal(self.files[i])}")
        return read.select("*", (row + self.starts[i]).alias("__place")).where((row >= first) & (row < last))

    def page(self, n: int = 10, number: int = 0) -> DataFrame:
        """Page ``number`` (from 0) of ``n`` rows, in order."""
        begin, end = number * n, min((number + 1) * n, self.rows)
        parts, i = [], max(0, bisect_right(self.starts, begin) - 1)
        while begin < end and i < len(self.files) and self.starts[i] < end:
            parts.append(self._read(i, max(begin - self.starts[i], 0), end - self.starts[i]))
            i += 1
        columns = [q(f.name) for f in self.schema]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out.orderBy("__place").select(*columns)


def _literal(name: str) -> str:
    """A file's name where Spark reads patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)
