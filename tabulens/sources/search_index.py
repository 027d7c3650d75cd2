"""A filter for each file of a table, by which a search skips files that cannot hold its words.

A file's filter is the set of five-letter sequences in its lower-cased rows, each as a place among BITS (a Bloom filter of one
hash). A word can only occur where all its sequences do. Filters are kept as (file, number, 64 bits), so a search reads the few numbers that
it asks for. Words of under five letters, and files that came after the index was made, are looked for everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.columns import q
from tabulens.operators.tables import search_rows

#: Places of a filter: 512 KB a file at most.
BITS = 1 << 22
LETTERS = 5


def _row_text(columns: list[str]) -> Column:
    return F.lower(F.concat_ws(" ", *[q(c).cast("string") for c in columns]))


def _place(sequence: Column) -> Column:
    return F.pmod(F.xxhash64(sequence), F.lit(BITS)).cast("int")


def _sequences(text: Column) -> Column:
    """Every sequence of letters that are not white space, at each place by a look ahead: one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?=(\S{{{LETTERS}}}))"), F.lit(1)))


class SearchIndex:
    """The filters stored at ``path`` of the Parquet table at ``table``."""

    def __init__(self, spark: SparkSession, table: str, path: str):
        self.spark, self.table, self.path = spark, table, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.columns = list(about.columns)

    @classmethod
    def build(cls, spark: SparkSession, table: str, path: str, columns: list[str] | None = None) -> SearchIndex:
        index = spark.createDataFrame([(columns or spark.read.parquet(table).columns,)], "columns array<string>")
        index.coalesce(1).write.parquet(f"{path.rstrip('/')}/about")
        out = cls(spark, table, path)
        out._write(spark.read.parquet(table))
        return out

    def _write(self, df: DataFrame) -> None:
        text = df.select(F.col("_metadata.file_path").alias("file"), _row_text(self.columns).alias("text"))
        # A file without a full sequence still has a row, so that it is known.
        places = text.select("file", F.explode_outer(_sequences(F.col("text"))).alias("s")).select("file", F.coalesce(_place(F.col("s")), F.lit(-1)).alias("place"))
        number, bit = F.floor(F.col("place") / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("place"), F.lit(64)))
        bits = places.groupBy("file", number.alias("number")).agg(F.bit_or(bit).alias("bits"))
        bits.repartitionByRange("number", "file").sortWithinPartitions("number", "file").write.mode("append").parquet(f"{self.path}/filters")

    def known(self) -> DataFrame:
        return self.spark.read.schema("file string, number int, bits long").parquet(f"{self.path}/filters")

    def refresh(self) -> int:
        """Add filters of files that have none yet; their number."""
        df, known = self.spark.read.parquet(self.table), self.known().select("file").distinct()
        files = df.select(F.col("_metadata.file_path").alias("file")).distinct().join(known, "file", "left_anti")
        new = [r.file for r in files.collect()]
        if new:
            self._write(df.where(F.col("_metadata.file_path").isin(new)))
        return len(new)

    def candidates(self, text: str) -> list[str] | None:
        """Files that may hold all words of ``text``, None where the filters say nothing. Names only come to the driver."""
        wanted = sorted({w[i : i + LETTERS] for w in text.lower().split() for i in range(len(w) - LETTERS + 1)})
        if not wanted:
            return None
        asked = self.spark.createDataFrame([(s,) for s in wanted], "s string").select(_place(F.col("s")).alias("place")).distinct().collect()
        masks: dict[int, int] = {}
        for r in asked:
            masks[r.place // 64] = masks.get(r.place // 64, 0) | 1 << r.place % 64
        signed = {k: m - (1 << 64) if m >> 63 else m for k, m in masks.items()}
        has = F.lit(False)
        for number, mask in signed.items():
            has |= (F.col("number") == number) & (F.col("bits").bitwiseAND(F.lit(mask)) == mask)
        found = self.known().where(F.col("number").isin(list(signed)) & has).groupBy("file").agg(F.count_distinct("number").alias("k")).where(F.col("k") == len(signed))
        return sorted(r.file for r in found.collect())

    def search(self, text: str) -> DataFrame:
        """The rows that ``search_rows`` finds in the whole table."""
        df = self.spark.read.parquet(self.table)
        may = self.candidates(text)
        if may is not None:
            # Files without a filter are read.
            file, known = F.col("_metadata.file_path"), [r.file for r in self.known().select("file").distinct().collect()]
            skipped = sorted(set(known) - set(may))
            df = df.where(~file.isin(skipped)) if skipped else df
        return search_rows(df, text, self.columns)
