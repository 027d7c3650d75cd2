"""Frequencies of the values of categorical columns.

Most frequent values are found without shuffling values. One pass gives each column a frequent-items sketch
(the Misra-Gries family) of 64-bit hashes. Where the sketch names the winners for certain, a second pass counts its
candidates exactly; columns of few values, and those where no value stands out, are counted in full. Either way rows are keyed by
16 bytes of hash and a prefix of bounded length, and only the winners' texts are fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.columns import long_values, nan_to_null, percent, q, string_columns
from tabulens.operators.profile import low_cardinality_strings

#: Values that a sketch tracks and lists; a column of up to FEW values is counted in full at once.
TRACKED, LISTED, FEW = 4096, 200, 50_000
#: Characters of a value that go with its hash; winners up to this length need no fetching.
PREFIX = 32
#: Winners (with ties) that come to the driver; more are joined in a shuffle.
WINNERS = 10_000


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """position, column, value, n of every present value of the (string) columns: one aggregation for all."""
    df = nan_to_null(df)
    columns = string_columns(df) if columns is None else columns
    return long_values(df, columns).where("value is not null").groupBy("position", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def _hash(c: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), c)


def _counted(df: DataFrame, columns: list[str], full: list[int], candidates: dict[int, list[int]]) -> DataFrame:
    """position, a, b (hash), prefix, n of all values of the columns ``full`` and of those of the others whose hash is a candidate."""
    text = lambda i: q(columns[i]).cast("string")
    cells = []
    for i in [*full, *candidates]:
        value = F.struct(F.lit(i).alias("position"), _hash(text(i), 0).alias("a"), _hash(text(i), 1).alias("b"), F.substring(text(i), 1, PREFIX).alias("prefix"))
        wanted = text(i).isNotNull()
        cells.append(F.when(wanted if i in full else wanted & _hash(text(i), 0).isin(candidates[i]), value))
    rows = df.select(F.explode(F.array(*cells)).alias("x")).where("x is not null").select("x.*")
    return rows.groupBy("position", "a", "b").agg(F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("n"))


def _certain(n: int, total: int, counts: list[int], listed: list[tuple[int, int]]) -> bool:
    """Whether no value outside ``listed`` (hash, estimate) can be among the first ``n``, given the exact counts of these.
    The sketch names every value of more than twice its error, which is at most 3.5 / TRACKED of all rows."""
    if sum(counts) == total:
        return True
    if len(counts) < n:
        return False
    least = sorted(counts, reverse=True)[n - 1]
    return least > 7 * total / TRACKED and (len(listed) < LISTED or least > listed[-1][1])


def _winners(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """position, value, n, total: the ``n`` most frequent values of each column, equals in value order, and its present values."""
    spark = df.sparkSession
    none = spark.createDataFrame([], "position int, value string, n long, total long")
    text = [q(c).cast("string") for c in columns]
    if not columns:
        return none
    sketch = lambda i: F.call_function("approx_top_k", _hash(text[i], 0), F.lit(LISTED), F.lit(TRACKED))
    cell = lambda i: F.struct(F.count(text[i]).alias("total"), F.approx_count_distinct(text[i], 0.05).alias("unique"), F.max(F.length(text[i])).alias("longest"), sketch(i).alias("top"))
    # A row per column, each with at most LISTED hashes.
    about = df.agg(F.array(*[cell(i) for i in range(len(columns))]).alias("cells")).first().cells
    listed = {i: sorted(((t["item"], t["count"]) for t in x.top if t["item"] is not None), key=lambda t: -t[1]) for i, x in enumerate(about)}
    tried = {i: [h for h, _ in listed[i]] for i, x in enumerate(about) if x.unique > FEW and len(listed[i]) >= n}
    full = [i for i, x in enumerate(about) if x.total and i not in tried]
    if tried:
        counted = _counted(df, columns, [], tried).groupBy("position").agg(F.collect_list("n").alias("counts")).collect()
        by_position = {r.position: r.counts for r in counted}
        unsure = [i for i in tried if not _certain(n, about[i].total, by_position.get(i, []), listed[i])]
        full += unsure
        tried = {i: x for i, x in tried.items() if i not in unsure}
    if not full and not tried:
        return none
    # By rank, not row number: values that begin alike may change places when seen whole.
    order = Window.partitionBy("position").orderBy(F.desc("n"), "prefix")
    tops = _counted(df, columns, full, tried).withColumn("rank", F.rank().over(order)).where(F.col("rank") <= n).drop("rank")
    found = tops.limit(WINNERS + 1).collect()
    few = len(found) <= WINNERS
    tops = spark.createDataFrame(found, "position int, a long, b long, prefix string, n long") if few else tops
    long = [i for i in [*full, *tried] if about[i].longest > PREFIX]
    whole = F.col("prefix")
    if long:
        value = lambda i: F.struct(F.lit(i).alias("position"), _hash(text[i], 0).alias("a"), _hash(text[i], 1).alias("b"), text[i].alias("value"))
        values = df.select(F.explode(F.array(*[value(i) for i in long])).alias("x")).select("x.*").where("value is not null")
        wanted = tops.select("position", "a", "b").where(F.length("prefix") == PREFIX)
        texts = values.join(F.broadcast(wanted) if few else wanted, ["position", "a", "b"]).groupBy("position", "a", "b").agg(F.first("value").alias("value"))
        tops, whole = tops.join(texts, ["position", "a", "b"], "left"), F.coalesce("value", "prefix")
    totals = spark.createDataFrame([(i, x.total) for i, x in enumerate(about)], "position int, total long")
    last = Window.partitionBy("position").orderBy(F.desc("n"), "value")
    named = tops.select("position", whole.alias("value"), "n").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n)
    return named.join(F.broadcast(totals), "position").select("position", "value", "n", "total")


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.join(F.broadcast(df.sparkSession.createDataFrame(list(enumerate(columns)), "position int, column string")), "position")


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = 5) -> DataFrame:
    """position, column, rank, value, n: the most frequent values, equals in value order. Values are counted when this is called."""
    df = nan_to_null(df)
    columns = string_columns(df) if columns is None else columns
    order = Window.partitionBy("position").orderBy(F.desc("n"), "value")
    found = _winners(df, columns, n).withColumn("rank", F.row_number().over(order))
    return _named(found, columns).select("position", "column", "rank", "value", "n") if columns else found.select("position", F.lit("").alias("column"), "rank", "value", "n")


def frequency_tables(df: DataFrame, max_unique: int = 20, first: int = 2) -> DataFrame:
    """All values of the first few low-cardinality string columns, with their rank."""
    columns = [r.column for r in low_cardinality_strings(df, max_unique).orderBy("position").limit(first).collect()]  # at most ``first`` names
    return top_values(df, columns, max_unique)


def mode_share(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """position, column, value, n, percent of present values that are the most frequent one."""
    df = nan_to_null(df)
    columns = string_columns(df) if columns is None else columns
    found = _winners(df, columns, 1)
    found = _named(found, columns) if columns else found.withColumn("column", F.lit(""))
    return found.select("position", "column", "value", "n", percent(F.col("n"), F.col("total"), 1).alias("percent"))


def category_samples(df: DataFrame, max_unique: int = 20, first: int = 3, values: int = 5) -> DataFrame:
    """position, column, n_unique, sample (most frequent values) of the first low-cardinality string columns."""
    chosen = low_cardinality_strings(df, max_unique).orderBy("position").limit(first)
    names = [r.column for r in chosen.collect()]
    tops = top_values(df, names, values).groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample"))
    return chosen.join(F.broadcast(tops), "column").select("position", "column", "n_unique", F.array_join("sample", ", ").alias("sample"))
