"""Exact quantiles of many columns without sorting or gathering a column.

A first pass brackets each wanted quantile between two approximate ones. A second counts the values
below and inside each bracket (a few parts in ten thousand of the rows). Brackets that hold more than INSIDE
values are narrowed by counting passes over BINS parts of them, and the values in what is left are
counted; the order statistics follow from running counts over those. All passes serve all columns, and
the driver sees a row per column and quantile.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.columns import per_column, q

ACCURACY = 10_000
#: Values of a bracket that one task may put in order, and parts in which a larger one is counted.
INSIDE, BINS = 10_000, 1000


@dataclass(frozen=True)
class _Bracket:
    """Column ``at``, quantile ``i``: the values of ranks a and b lie in [low, high]; ``below`` are smaller than low."""

    at: int
    i: int
    low: float
    high: float
    below: int
    inside: int
    a: int
    b: int
    part: float


def _number(c: Column) -> Column:
    return c.cast("double")


def _inside(df: DataFrame, columns: list[str], brackets: list[_Bracket]) -> DataFrame:
    """at, i, v, low, high, below, a, b, part: the values in each bracket, one row each."""
    hits = []
    for c in sorted({x.at for x in brackets}):
        v = _number(q(columns[c]))
        hit = F.lit(False)
        for low, high in sorted({(x.low, x.high) for x in brackets if x.at == c}):
            hit |= v.between(low, high)
        hits.append(F.when(hit, F.struct(F.lit(c).alias("at"), v.alias("v"))))
    values = df.select(F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull()))).groupBy("at", "v").agg(F.count(F.lit(1)).alias("k"))
    rows = [(x.at, x.i, float(x.low), float(x.high), x.below, x.a, x.b, float(x.part)) for x in brackets]
    found = df.sparkSession.createDataFrame(rows, "at int, i int, low double, high double, below long, a long, b long, part double")
    return values.join(F.broadcast(found), "at").where(F.col("v").between(F.col("low"), F.col("high")))


def _narrowed(df: DataFrame, columns: list[str], brackets: list[_Bracket]) -> list[_Bracket]:
    """The brackets cut down to the part that holds their ranks, or to the two values if these end and begin parts."""
    width = F.col("high") - F.col("low")
    part = F.least(F.floor((F.col("v") - F.col("low")) / width * BINS), F.lit(BINS - 1))
    counted = _inside(df, columns, brackets).groupBy("at", "i", "below", "a", "b", part.alias("bin")).agg(F.sum("k").alias("n"), F.min("v").alias("lo"), F.max(F.struct("v", "k")).alias("top"))
    upto = Window.partitionBy("at", "i").orderBy("bin")  # at most BINS rows
    ranked = counted.withColumn("last", F.col("below") + F.sum("n").over(upto) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    holds = lambda rank: (F.col("first") <= F.col(rank)) & (F.col("last") >= F.col(rank))
    of = lambda rank: F.max(F.when(holds(rank), F.struct("bin", "lo", F.col("top.v").alias("hi"), F.col("top.k").alias("ties"), "first", "n"))).alias(f"of_{rank}")
    found = {(r["at"], r.i): r for r in ranked.groupBy("at", "i").agg(of("a"), of("b")).collect()}
    out = []
    for x in brackets:
        a, b = found[x.at, x.i].of_a, found[x.at, x.i].of_b
        if a.bin == b.bin:
            out.append(replace(x, low=a.lo, high=a.hi, below=a.first, inside=a.n))
        else:
            # Rank a is the last of its part, and all of a.ties values end there.
            out.append(replace(x, low=a.hi, high=b.lo, below=x.a + 1 - a.ties, inside=0))
    return out


def quantiles(df: DataFrame, columns: list[str], probs: list[float], approx: bool = False) -> DataFrame:
    """position, column, n, q (array of values in the order of ``probs``); linear interpolation.

    With ``approx`` one pass gives values whose rank is off by at most one in ACCURACY. A column
    without values gets n = 0 and a null q.
    """
    spark = df.sparkSession
    wanted = probs if approx else [min(1.0, max(0.0, p + d)) for p in probs for d in (-2 / ACCURACY, 2 / ACCURACY)]
    first = per_column(df, columns, lambda c: {"n": F.count(c), "q": F.percentile_approx(_number(c), wanted, ACCURACY), "lo": F.min(_number(c)), "hi": F.max(_number(c))})
    if approx:
        return first.drop("lo", "hi")
    rows = {r.position: r for r in first.collect()}  # a row per column
    # A bracket for each quantile between the extremes; these are known.
    ends = []
    for r in rows.values():
        for i, p in enumerate(probs):
            if r.n and 0 < p < 1:
                low = r.lo if p <= 2 / ACCURACY else r.q[2 * i]
                high = r.hi if p >= 1 - 2 / ACCURACY else r.q[2 * i + 1]
                ends.append((r.position, i, low, high, p * (r.n - 1)))
    if ends:
        v = lambda c: _number(q(columns[c]))
        counts = df.agg(F.array(*[F.count_if(v(c) < low) for c, _, low, _, _ in ends]), F.array(*[F.count_if(v(c).between(low, high)) for c, _, low, high, _ in ends])).first()
        brackets = [_Bracket(c, i, low, high, k, n, int(at), int(at) + (at > int(at)), at - int(at)) for (c, i, low, high, at), k, n in zip(ends, *counts, strict=True)]
        wide = lambda x: x.inside > INSIDE and 0 < x.high - x.low < float("inf")
        while large := [x for x in brackets if wide(x)]:
            narrow = {(x.at, x.i): x for x in _narrowed(df, columns, large)}
            brackets = [narrow.get((x.at, x.i), x) for x in brackets]
        held = _inside(df, columns, brackets)
        upto = Window.partitionBy("at", "i").orderBy("v")
        ranked = held.withColumn("last", F.col("below") + F.sum("k").over(upto) - 1)
        pick = lambda rank: F.min(F.when(F.col("last") >= F.col(rank), F.col("v")))
        found = ranked.groupBy("at", "i").agg(pick("a").alias("x"), pick("b").alias("y"), F.first("part").alias("part"))
        between = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("x") + (F.col("y") - F.col("x")) * F.col("part"))
        found = found.groupBy(F.col("at").alias("position")).agg(F.map_from_entries(F.collect_list(F.struct("i", between.alias("x")))).alias("m"))
    else:
        found = spark.createDataFrame([], "position int, m map<int,double>")
    known = [(r.position, r.column, r.n, r.lo, r.hi) for r in rows.values()]
    sizes = spark.createDataFrame(known, "position int, column string, n long, lo double, hi double").join(found, "position", "left")
    value = [F.col("lo") if p <= 0 else F.col("hi") if p >= 1 else F.try_element_at("m", F.lit(i)) for i, p in enumerate(probs)]
    return sizes.select("position", "column", "n", F.when(F.col("n") > 0, F.array(*value)).alias("q"))
