"""Mixing sources to target weights.

Tokens per source are summed, each source gets a target and so a repetition rate, and each
document is emitted floor(rate) times plus once more with probability rate - floor(rate). The
draw is a hash of the doc_id and a seed, so a rerun, or a task run again, takes the same copies.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
documents with one id share their draw (a null id draws as the empty string); a source of size 0
has target 0 and rate 0; an empty table gives no rows. Columns beside doc_id, text and source
are passed through by ``mix`` under any name and not read by ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import WORD, bounded_join, keyed, packed, store, text_or_empty, unpacked

#: Shares of sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this part of all words, and a source at most CAP times its own.
SHARE, CAP = 1.5, 2.0


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def running(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Stored ``df`` with, for each new column of ``sums``, the sum of a column over the rows before it in ``order``.
    Rows are sorted in ranges; only the ranges' own sums are added up one after the other."""
    place = F.monotonically_increasing_id()
    ranged = store(df.orderBy(*order).withColumn("__at", place), name).withColumn("__part", F.shiftright("__at", 33))
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    # As many rows as there are partitions.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    out = ranged.join(F.broadcast(parts), F.col("__part") == F.col("__p"))
    out = out.withColumns({k: F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"__{k}") for k, c in sums.items()})
    return out.drop("__at", "__part", "__p", *[f"__{k}" for k in sums])


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A stored table: source, documents, source_size, target from (source, size) rows.

    Resharing the excess by weight until no source is above its cap ends at min(cap * size,
    level * weight) for one level. With sources in order of cap * size / weight, those before
    some place are capped and the level follows from the rest, so running sums find it.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"), F.lit(1).alias("one"))
    placed = running(sources, [F.col("source").asc_nulls_last()], {"place": "one"}, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumns({"full": F.col("source_size") * F.lit(cap), "weight": weight}).withColumn("full_at", F.col("full") / F.col("weight"))
    capped = running(placed, [F.col("full_at"), F.col("place")], {"full_before": "full", "weight_before": "weight"}, "capped")
    budget, weight_in_all = capped.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share), F.sum("weight")).first()
    own_level = F.try_divide(F.lit(float(budget)) - F.col("full_before"), F.lit(weight_in_all) - F.col("weight_before"))
    # The level is that of the first source which stays under its cap.
    level = capped.where(own_level < F.col("full_at")).agg(F.min_by(own_level, F.struct("full_at", "place"))).first()[0]
    target = F.col("full") if level is None else F.least("full", F.lit(level) * F.col("weight"))
    return store(capped.select("source", "documents", "source_size", target.alias("target")), "targets")


def _with_copies(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``docs`` (source, doc_id and others) with source_size, target and copies."""
    known = targets.select(keyed(F.col("source")).alias("key"), "documents", "source_size", "target")
    joined = bounded_join(docs.withColumn("key", keyed(F.col("source"))), known, "key", "documents")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", copies)


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    sizes = store(docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in(text_or_empty()).alias("size")), "sizes")
    out = _with_copies(sizes, source_targets(sizes, weights, share, cap), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of ``docs``."""
    sizes = docs.select(F.col("source").cast("string").alias("source"), words_in(text_or_empty()).alias("size"))
    targets = source_targets(sizes, weights, share, cap)
    carried = packed(docs, "doc_id", "source").withColumn("source", F.col("source").cast("string"))
    out = _with_copies(carried, targets, seed).where("copies > 0")
    return unpacked(out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs.columns)


OP1_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight
  FROM sizes GROUP BY source
),
rounds AS (
  SELECT 0 AS round, source, source_size, weight, false AS capped,
         1.5 * sum(source_size) OVER () * weight / sum(weight) OVER () AS target
  FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight, capped OR target >= 2.0 * source_size,
         CASE WHEN capped OR target >= 2.0 * source_size THEN 2.0 * source_size
              ELSE (1.5 * sum(source_size) OVER ()
                    - sum(CASE WHEN capped OR target >= 2.0 * source_size THEN 2.0 * source_size ELSE 0 END) OVER ())
                   * weight / sum(CASE WHEN capped OR target >= 2.0 * source_size THEN 0 ELSE weight END) OVER () END
  FROM rounds WHERE round < (SELECT count(*) FROM sources)
),
targets AS (SELECT source, source_size, target FROM rounds WHERE round = (SELECT count(*) FROM sources)),
rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
         CAST(CAST('0x' || substr(md5('0:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM rates
"""
