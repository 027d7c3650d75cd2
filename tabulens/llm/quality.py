"""Quality rules with thresholds that adapt to language and source.

Counts per document are expressions on its own row. Rates derived from them go into one quantile
sketch per (lang, source) and rate: counts in bins whose width is a fixed part of the value. Such
sketches merge by adding counts, without chance, so reruns agree, and a source with a third of all rows
is summed up where its rows lie: each task shuffles the bins it has met. Adding up a language's sources gives the
sketches of languages. Fences come from the quartiles, and documents are filtered by a join with the fences.

A group's quartiles lean towards those of its language by the weight of PRIOR documents, so that a
group of a few documents, whose quartiles are its own extremes, is judged by its language. And no fence
lies over FAR spreads beyond the language's quartiles, so that a group that is junk for the most part
does not make its own junk usual. The same rule holds at every size. The fence on repeated words is at
least 3 * 0.07 = 0.21, so the base rule, which stops at MAX_REPEATED percent, decides on them alone.

Defined results: a null or blank text has no words, fails the base rule and is not kept; null
lang or source form groups of their own; repeated rows count each; an empty table gives no
rows. A quartile is the middle of its bin, so within 1/2 BINS of the exact one. Columns beside text, lang and
source are passed through by ``keep_good`` under any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import SPACE, bounded_join, keyed, packed, store, text_or_empty, unpacked

SYMBOLS = r"[#*$%&|<>]"
#: Words in a window that counts as repeated.
WINDOW = 5
#: Base rule: at least so many words, and at most this percentage of them in repeated windows.
MIN_WORDS, MAX_REPEATED = 10, 20
#: Bins of a sketch for a factor of e.
BINS = 128
#: A rate is out when it lies over SPREADS spreads beyond a quartile. The spread is the distance
#: of the quartiles, at least the rate's own least spread: groups of very even documents have
#: quartiles close together, and there small differences mean nothing.
SPREADS, FAR = 3.0, 6.0
#: Documents that the language's quartiles count for beside a group's own.
PRIOR = 20
#: rate: (its SQL over the counts, least spread, whether low values are out as well)
RATES = {
    "symbol_rate": ("n_symbols / word_chars", 0.02, False),
    "dup_line_rate": ("n_dup_lines / n_lines", 0.1, False),
    "repeat_rate": ("n_repeat_words / n_words", 0.07, False),
    "word_length": ("word_chars / n_words", 0.75, True),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found at least twice. ``words`` should be a plain column."""

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeats(order: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        hits = F.filter(order, lambda x, i: same(x, F.get(order, i - 1)) | same(x, F.get(order, i + 1)))
        return let(F.sort_array(F.transform(hits, lambda x: x["i"])), covered)

    def counted(windows: Column) -> Column:
        order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(order, repeats))

    def by_hash(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])), counted)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, by_hash)).cast("long")


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    split = docs.select(*keep, text_or_empty().alias("__text")).select("*", words_of(F.col("__text")).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = split.withColumn("__lines", lines)
    return lines.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        (F.char_length("__text") - F.regexp_count("__text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )


def rates() -> dict[str, Column]:
    """Null for documents without words."""
    return {r: F.expr(f"try_divide(cast({how.split(' / ')[0]} as double), {how.split(' / ')[1]})") for r, (how, _, _) in RATES.items()}


def quartiles(sketches: DataFrame, own: list[str]) -> DataFrame:
    """own, rate, n, q1, q3 from a sketch's rows: own, rate, bin (null for the value 0), n."""
    upto = Window.partitionBy(*own, "rate").orderBy(F.col("bin").asc_nulls_first())
    ranked = sketches.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*own, "rate"))})
    middle = F.coalesce(F.exp((F.col("bin") + 0.5) / BINS), F.lit(0.0))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), middle))
    return ranked.groupBy(*own, "rate").agg(F.max("all").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(counted: DataFrame) -> DataFrame:
    """A stored table: key (of lang and source), rows and for each rate its fence(s), from documents with a
    word in ``counted``, a stored table with lang, source and the counts."""
    values = F.array(*[F.struct(F.lit(r).alias("rate"), v.alias("v")) for r, v in rates().items()])
    each = counted.where("n_words > 0").select(keyed(F.col("lang")).alias("lang"), keyed(F.col("lang"), F.col("source")).alias("key"), F.explode(values).alias("x"))
    place = F.when(F.col("x.v") > 0, F.floor(F.log("x.v") * BINS))
    sketches = each.groupBy("lang", "key", F.col("x.rate").alias("rate"), place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    sketches = store(sketches, "sketches")
    own = quartiles(sketches, ["lang", "key"])
    # A row per language and rate.
    above = quartiles(sketches.groupBy("lang", "rate", "bin").agg(F.sum("n").alias("n")), ["lang"]).select("lang", "rate", F.col("q1").alias("p1"), F.col("q3").alias("p3"))
    part = F.col("n") / (F.col("n") + PRIOR)
    both = own.join(above, ["lang", "rate"]).withColumns({q: part * F.col(q) + (1 - part) * F.col(p) for q, p in (("q1", "p1"), ("q3", "p3"))})
    out = []
    for r, (_, least, two_sided) in RATES.items():
        of = lambda v, r=r: F.max(F.when(F.col("rate") == r, v))
        spread, far = (F.greatest(F.col(hi) - F.col(lo), F.lit(least)) for hi, lo in (("q3", "q1"), ("p3", "p1")))
        out.append(of(F.least(F.col("q3") + spread * SPREADS, F.col("p3") + far * FAR)).alias(f"{r}_high"))
        if two_sided:
            out.append(of(F.greatest(F.col("q1") - spread * SPREADS, F.col("p1") - far * FAR)).alias(f"{r}_low"))
    return store(both.groupBy("key").agg(F.max("n").alias("rows"), *out), "fences")


def verdicts(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` with base_failed and kept; ``limits``: a result of fences()."""
    joined = bounded_join(counted.withColumn("key", keyed(F.col("lang"), F.col("source"))), limits, "key", "rows")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    inside = F.lit(True)
    for r, rate in rates().items():
        inside &= rate <= F.col(f"{r}_high")
        if RATES[r][2]:
            inside &= rate >= F.col(f"{r}_low")
    return joined.withColumn("base_failed", base).withColumn("kept", F.coalesce(~F.col("base_failed") & inside, F.lit(False)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept, one row per document."""
    counted = store(counts(docs, ["doc_id", "lang", "source"]), "quality")
    out = verdicts(counted, fences(counted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all columns of ``docs``. They are stored once with their counts:
    making the counts a second time for the verdict would take more."""
    counted = store(counts(packed(docs, "text", "lang", "source"), ["__doc", "lang", "source"]), "quality")
    return unpacked(verdicts(counted, fences(counted)).where("kept"), docs.columns)


OP4_SQL = r"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
),
windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM parts)
),
hits AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM hits) GROUP BY doc_id
),
counted AS (
  SELECT p.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM parts p LEFT JOIN repeats r ON p.doc_id IS NOT DISTINCT FROM r.doc_id
),
rates AS (
  SELECT *, n_symbols::DOUBLE / word_chars AS symbol_rate, n_dup_lines::DOUBLE / n_lines AS dup_line_rate,
         n_repeat_words::DOUBLE / n_words AS repeat_rate, word_chars::DOUBLE / n_words AS word_length
  FROM counted WHERE n_words > 0
),
long AS (UNPIVOT rates ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME rate VALUE v),
binned AS (SELECT lang, source, rate, CASE WHEN v > 0 THEN exp((floor(ln(v) * 128) + 0.5) / 128) ELSE 0 END AS m FROM long),
ranked AS (
  SELECT lang, source, rate, m, row_number() OVER (PARTITION BY lang, source, rate ORDER BY m) AS k,
         count(*) OVER (PARTITION BY lang, source, rate) AS n,
         row_number() OVER (PARTITION BY lang, rate ORDER BY m) AS kp, count(*) OVER (PARTITION BY lang, rate) AS np FROM binned
),
languages AS (
  SELECT lang, rate, min(m) FILTER (WHERE kp >= 0.25 * np) AS p1, min(m) FILTER (WHERE kp >= 0.75 * np) AS p3 FROM ranked GROUP BY ALL
),
quartiles AS (
  SELECT lang, source, rate, max(n) AS n, min(m) FILTER (WHERE k >= 0.25 * n) AS q1, min(m) FILTER (WHERE k >= 0.75 * n) AS q3
  FROM ranked GROUP BY ALL
),
leaning AS (
  SELECT q.lang, source, q.rate, p1, p3, n / (n + 20.0) * q1 + (1 - n / (n + 20.0)) * p1 AS q1, n / (n + 20.0) * q3 + (1 - n / (n + 20.0)) * p3 AS q3,
         CASE q.rate WHEN 'symbol_rate' THEN 0.02 WHEN 'dup_line_rate' THEN 0.1 WHEN 'repeat_rate' THEN 0.07 ELSE 0.75 END AS least
  FROM quartiles q JOIN languages l ON q.rate = l.rate AND q.lang IS NOT DISTINCT FROM l.lang
),
fences AS (
  SELECT lang, source, rate, least(q3 + 3.0 * greatest(q3 - q1, least), p3 + 6.0 * greatest(p3 - p1, least)) AS high,
         CASE WHEN rate = 'word_length' THEN greatest(q1 - 3.0 * greatest(q3 - q1, least), p1 - 6.0 * greatest(p3 - p1, least)) END AS low
  FROM leaning
),
inside AS (
  SELECT l.doc_id, bool_and(l.v <= f.high AND (f.low IS NULL OR l.v >= f.low)) AS ok
  FROM long l JOIN fences f ON l.rate = f.rate AND l.lang IS NOT DISTINCT FROM f.lang AND l.source IS NOT DISTINCT FROM f.source
  GROUP BY l.doc_id
)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(ok, false) AS kept
FROM counted c LEFT JOIN inside i ON c.doc_id = i.doc_id
"""
