"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. Documents come to it in batches, by ranges of doc_id. A batch is first
reduced to one row per digest (partial aggregation, so a digest that holds a third of the rows shuffles a row per
task), then sort-merge anti-joined with the index, and what is new is appended; the index side of that join is
not exchanged. Which document stays of each digest is then read back from the index, in a join of the same kind.

Each row of the index has the name of the batch that brought it. A batch that failed half way, or whose
result was lost, is given again under its name: its own digests count as new then, so the answer
is the same, and only those that are not yet there are appended.

Defined results: a null text counts as empty; texts are equal when they agree after each run of
ASCII white space is one space; of equal texts the smallest doc_id stays, null ids last, and of
repeated rows with one id exactly one; an empty table gives no rows. Only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulens.llm.common import SPACE, join_groups, scratch_path, store, text_or_empty

#: Batches in which documents come to the index.
BATCHES = 3


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes of SHA-256 over the normalised text), row (a number per row)."""
    normal = F.regexp_replace(text_or_empty(), SPACE, " ")
    return docs.select("doc_id", F.unhex(F.sha2(normal, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))


class DigestIndex:
    """A digest table at ``path``: created if missing, reopened if there. ``buckets`` is kept beside it; to reopen
    an index with another number is an error, as its files could not be read rightly. Files outlive the object;
    its entry in the catalog goes with ``close``, at the end of a ``with`` block, or with the object."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.buckets = spark, buckets
        about = f"{path.rstrip('/')}-buckets"
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("ignore").parquet(about)
        there = spark.read.schema("buckets int").parquet(about).first().buckets
        if there != buckets:
            raise ValueError(f"the index at {path} has {there} buckets, not {buckets}")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        quoted = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, n BIGINT, batch STRING) USING parquet "
            f"OPTIONS (path '{quoted}') CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )
        self.close = weakref.finalize(self, spark.sql, f"DROP TABLE IF EXISTS {self.name}")
        self.close.atexit = False

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, groups: DataFrame) -> DataFrame:
        return groups.join(self.rows().hint("merge"), "digest", "left_anti")

    def found(self, groups: DataFrame) -> DataFrame:
        """``groups`` (distinct digests) with what the index has of them: index_id, index_n, index_batch."""
        own = self.rows().select("digest", F.col("keep_id").alias("index_id"), F.col("n").alias("index_n"), F.col("batch").alias("index_batch"))
        return groups.join(own.hint("merge"), "digest")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the digests of ``groups`` (digest, keep_id, n), a stored table, that the index lacks."""
        fresh = self.missing(groups)
        fresh.select("digest", "keep_id", "n", F.lit(batch).alias("batch")).write.insertInto(self.name)


def _batch_number(rows: DataFrame, batches: int):
    """Which batch a row comes in: ranges of doc_id of about equal size, in order; null ids come in the last."""
    shares = [k / batches for k in range(1, batches)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares)).first()[0] if shares else None
    number = F.lit(0)
    for cut in sorted(set(cuts or [])):
        number += (F.col("doc_id") > cut).cast("int")
    return F.coalesce(number, F.lit(batches - 1))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Without ``index`` a new one is made in the shared scratch folder. Documents whose digest an earlier call
    brought are not kept, and group_size then counts that call. ``batch``: a name for these documents,
    the same one when they are given again; without it each call has a name of its own.
    """
    spark, batch = docs.sparkSession, batch or uuid.uuid4().hex
    if index is None:
        with DigestIndex(spark, scratch_path(spark, "index"), int(spark.conf.get("spark.sql.shuffle.partitions"))) as own:
            return exact_duplicates(docs, own, batch, batches)
    rows = store(with_digest(docs), "digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = rows.groupBy("digest", _batch_number(rows, batches).alias("number")).agg(first.alias("f"), F.count(F.lit(1)).alias("own_n"))
    # A digest has a row a batch at most; its number of documents is that of all batches.
    total = F.sum("own_n").over(Window.partitionBy("digest"))
    # Stored, as else the anti-join would be pushed below the aggregation and deal out every row.
    groups = store(groups.select("digest", "number", F.col("f.doc_id").alias("keep_id"), F.col("f.row").alias("keep_row"), total.alias("n")), "groups")
    for k in range(batches):
        index.append(groups.where(F.col("number") == k), batch)
    each = groups.groupBy("digest").agg(F.first("n").alias("n"), F.min(F.struct("number", "keep_row")).alias("f"))
    found = index.found(each.select("digest", "n", F.col("f.keep_row").alias("keep_row"))).withColumn("old", F.col("index_batch") != batch)
    size = F.when(F.col("old"), F.col("index_n")).otherwise(F.col("n"))
    found = store(found.select("digest", "n", "keep_row", "old", F.col("index_id").alias("keep_id"), size.alias("size")), "found")
    return join_groups(rows, found, "digest", "n").select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), ((F.col("row") == F.col("keep_row")) & ~F.col("old")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
