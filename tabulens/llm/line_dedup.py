"""Boilerplate lines by their frequency within a site.

Pages are grouped by host. For each line the different pages of the host that contain it are counted
and divided by the host's different pages; lines over RATIO are boilerplate there and are taken out of
all its pages, however much of a page they are. A page has each line once in the counts, however often
it repeats it, and pages with the same text are one page, so that copies of a page do not make its lines
boilerplate. The ratio decides at every host size; a line that is on one page alone (LEAST) is not
repeated, whatever part of a small host that page is.

Lines and pages are told apart by 128-bit hashes; counts are aggregated first by line and page, so a line
that is on every page is dealt out by its pages, then partially by line. A host can have only
(lines a page) / RATIO boilerplate lines; they are joined to its pages as one array.

Lines are compared with outer white space taken off; blank lines are never boilerplate. A page is
reported as spared if it keeps lines that would be over the ratio with each copy counted; such copies
are left to deduplication.

Defined results: a null text stays null and counts as an empty page; a null host is a host
of its own; repeated rows are one page; an empty table gives no rows. Other columns pass
through ``drop_boilerplate`` under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import bounded_join, keyed, named, packed, store, text_or_empty, unpacked

RATIO = 0.1
#: Different pages that hold a line for it to be repeated at all.
LEAST = 2
BLANKS = " \t\n\x0b\f\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO) -> DataFrame:
    """A stored table with a row per host that has any: host (as keyed()), all_rows, the hashes of its
    boilerplate lines and of lines over the ratio by copies alone."""
    pages = docs.select(keyed(named(host)).alias("host"), text_or_empty().alias("text"))
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: x != ""))
    each = pages.select("host", _hash(F.col("text")).alias("p"), F.explode(lines).alias("line")).select("host", "p", _hash(F.col("line")).alias("h"))
    # One row per line and different page, with the page's copies.
    counts = each.groupBy("host", "h", "p").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("rows")).where(F.col("rows") >= LEAST)
    counts = store(counts, "lines")
    sizes = pages.groupBy("host", _hash(F.col("text")).alias("p")).agg(F.count(F.lit(1)).alias("m"))
    sizes = store(sizes.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("m").alias("all_rows")), "hosts")
    often = (F.col("n") >= LEAST) & (F.col("n") > F.col("pages") * F.lit(ratio))
    copied = ~often & (F.col("rows") > F.col("all_rows") * F.lit(ratio))
    found = bounded_join(counts, sizes, "host", "all_rows", "inner").where(often | copied)
    lines = F.collect_list(F.when(often, F.col("h"))).alias("lines"), F.collect_list(F.when(copied, F.col("h"))).alias("copied")
    return store(found.groupBy("host").agg(F.first("all_rows").alias("all_rows"), *lines), "boilerplate")


def _split(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``pages`` (host as keyed(), text and others) with kept_text (null where the text is), dropped (lines) and
    spared (a page with lines that copies alone bring over the ratio)."""
    joined = bounded_join(pages, known, "host", "all_rows", weight=64 + 32 * (F.size("lines") + F.size("copied")))
    split = joined.withColumn("split", F.split(text_or_empty(), "\n"))
    # The page's lines that may be among the host's, by one hash set a page; what is found is compared whole.
    firsts = lambda found: F.array_intersect(F.transform("split", lambda x: F.xxhash64(_bare(x))), F.transform(found, lambda h: h["a"]))
    among = lambda x, some, found: F.array_contains(some, F.xxhash64(_bare(x))) & F.array_contains(found, _hash(_bare(x)))
    split = split.withColumns({f"{c}_here": F.when(F.size(c) > 0, firsts(c)) for c in ("lines", "copied")})
    kept = F.filter("split", lambda x: ~among(x, F.col("lines_here"), F.col("lines")))
    split = split.withColumn("rest", F.when(F.size("lines_here") > 0, kept).otherwise(F.col("split")))
    gone = F.size("split") - F.size("rest")
    only_copied = F.exists("split", lambda x: among(x, F.col("copied_here"), F.col("copied")))
    spared = F.when(F.size("copied_here") > 0, only_copied).otherwise(F.lit(False))
    text = F.when(F.col("text").isNull() | (gone == 0), F.col("text")).otherwise(F.array_join("rest", "\n"))
    return split.withColumns({"kept_text": text, "dropped": gone, "spared": spared})


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO) -> DataFrame:
    """``docs`` without boilerplate lines; n_chars, if there, follows the text."""
    carried = packed(docs, "text").withColumn("host", keyed(F.col(f"__doc.c{docs.columns.index(host)}")))
    out = _split(carried, boilerplate(docs, host, ratio))
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        own = F.col(f"__doc.c{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(F.col("dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(own)
    return unpacked(out, docs.columns, **new)


def lines_report(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, n_lines, dropped_lines, spared and the text that is left, one row per document."""
    pages = docs.select("doc_id", "text", keyed(named(host)).alias("host"))
    return _split(pages, boilerplate(docs, host)).select(
        "doc_id", F.size("split").cast("long").alias("n_lines"), F.col("dropped").cast("long").alias("dropped_lines"), "spared", F.col("kept_text").alias("text")
    )


OP6_SQL = r"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (
  SELECT page, source, body, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT page, source, body, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM pages)
),
counts AS (SELECT source, bare, count(DISTINCT body) AS n, count(DISTINCT page) AS rows FROM each WHERE bare <> '' GROUP BY source, bare),
sites AS (SELECT source, count(DISTINCT body) AS total, count(*) AS all_rows FROM pages GROUP BY source),
often AS (
  SELECT c.source, c.bare, n >= 2 AND n > total * 0.1 AS over FROM counts c JOIN sites s ON c.source IS NOT DISTINCT FROM s.source
  WHERE (n >= 2 AND n > total * 0.1) OR (rows >= 2 AND rows > all_rows * 0.1)
),
marked AS (
  SELECT e.*, coalesce(o.over, false) AS gone, o.over IS NOT NULL AND NOT o.over AS copied
  FROM each e LEFT JOIN often o ON e.source IS NOT DISTINCT FROM o.source AND e.bare = o.bare
),
rest AS (
  SELECT page, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS gone, bool_or(copied) AS spared, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY page
)
SELECT doc_id, n_lines, gone AS dropped_lines, spared, CASE WHEN text IS NULL OR gone = 0 THEN text ELSE coalesce(kept, '') END AS text
FROM pages JOIN rest USING (page)
"""
