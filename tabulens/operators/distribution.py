"""Shape of numeric columns: skew, outliers, histograms, density."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import adjusted_skew, long_values, nan_to_null, numeric_columns, per_column, percent, q, skew_label
from tabulens.operators.profile import numeric_stats, quartiles
from tabulens.operators.quantiles import quantiles


def _chosen(df: DataFrame, columns: list[str] | None) -> list[str]:
    return numeric_columns(df) if columns is None else columns


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_values(df, columns, lambda c: c.cast("double")).where("value is not null")


def sigma_outliers(df: DataFrame, columns: list[str] | None = None, sigmas: float = 3.0) -> DataFrame:
    """position, column, outliers: values strictly outside mean +- sigmas * std. The statistics are a row per column, so they are broadcast."""
    df = nan_to_null(df)
    columns = _chosen(df, columns)
    stats = per_column(df, columns, lambda c: {"mean": F.avg(c.cast("double")), "std": F.stddev_samp(c.cast("double"))})
    far = F.abs(F.col("value") - F.col("mean")) > F.lit(sigmas) * F.col("std")
    hits = _values(df, columns).join(F.broadcast(stats.drop("column")), "position").where(far)
    found = hits.groupBy("position").agg(F.count(F.lit(1)).alias("outliers"))
    return stats.select("position", "column").join(F.broadcast(found), "position", "left").na.fill(0, ["outliers"])


def describe_distribution(df: DataFrame, columns: list[str] | None = None, approx: bool = False, found: DataFrame | None = None) -> DataFrame:
    """position, column, n, mean, median, std, min, max, skew, label, outliers (three sigmas)."""
    df = nan_to_null(df)
    columns = _chosen(df, columns)
    skews = per_column(df, columns, lambda c: {"skew": adjusted_skew(c.cast("double"))}).drop("column")
    out = numeric_stats(df, columns, approx, found).join(skews, "position").join(sigma_outliers(df, columns).drop("column"), "position")
    return out.withColumn("label", skew_label(F.col("skew")))


def fences(df: DataFrame, columns: list[str], factor: float = 1.5, approx: bool = False, found: DataFrame | None = None) -> DataFrame:
    """position, column, q1, q3, low, high."""
    first, third = (1, 3) if found is not None else (0, 1)
    found = quantiles(nan_to_null(df), columns, [0.25, 0.75], approx) if found is None else found
    found = found.select("position", "column", F.get("q", F.lit(first)).alias("q1"), F.get("q", F.lit(third)).alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * factor
    return found.withColumns({"low": F.col("q1") - spread, "high": F.col("q3") + spread})


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5, approx: bool = False, found: DataFrame | None = None) -> DataFrame:
    """position, column, q1, q3, low, high, outliers, percent of all rows; columns without outliers are left out."""
    df = nan_to_null(df)
    columns = _chosen(df, columns)
    limits = fences(df, columns, factor, approx, found)
    out = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    hits = _values(df, columns).join(F.broadcast(limits.drop("column")), "position").where(out)
    hits = hits.groupBy("position").agg(F.count(F.lit(1)).alias("outliers"))
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return limits.join(F.broadcast(hits), "position").crossJoin(F.broadcast(rows)).withColumn("percent", percent(F.col("outliers"), F.col("rows"), 2)).drop("rows")


def outlier_rows(df: DataFrame, column: str, factor: float = 1.5, approx: bool = False) -> DataFrame:
    """The rows of ``df`` whose value lies outside the column's fences."""
    limits = fences(df, [column], factor, approx).select(F.col("low").alias("__low"), F.col("high").alias("__high"))
    v = nan_value(column)
    return df.crossJoin(F.broadcast(limits)).where((v < F.col("__low")) | (v > F.col("__high"))).drop("__low", "__high")


def nan_value(column: str):
    v = q(column).cast("double")
    return F.when(~F.isnan(v), v)


def five_numbers(df: DataFrame, columns: list[str] | None = None, approx: bool = False, found: DataFrame | None = None) -> DataFrame:
    """position, column, min, q1, median, q3, max."""
    found = quartiles(df, _chosen(df, columns), approx, found)
    return found.select("position", "column", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])


def _binned(df: DataFrame, columns: list[str], plan: DataFrame) -> DataFrame:
    """position, column, bin (from 0), low, high, n for ``plan`` rows position, column, lo, hi, bins; empty bins are left out."""
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / width), F.col("bins") - 1)).otherwise(F.lit(0))
    placed = _values(df, columns).drop("column").join(F.broadcast(plan), "position").withColumn("bin", place.cast("int"))
    counted = placed.groupBy("position", "column", "bin", "lo", "hi", "bins").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("position", "column", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


#: Columns of more values than this by estimate are taken to have more than a histogram's bins; the estimate is off by 5 %.
MANY_VALUES = 50


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int | str = 10, approx: bool = False, found: DataFrame | None = None) -> DataFrame:
    """Equal-width bins between a column's extremes, the last one closed.

    ``bins``: at most so many, and no more than the column has different values (a missing value
    counts as one); or 'fd': by Freedman and Diaconis, or Sturges where that gives more bins or the quartiles are equal.
    """
    df = nan_to_null(df)
    columns = _chosen(df, columns)
    if bins == "fd":
        found = quartiles(df, columns, approx, found)
        at = lambda i: F.get("q", F.lit((0, 1, 3, 4)[i]))
        sturges = F.ceil(F.log2(F.col("n")) + 1)
        step = 2 * (at(2) - at(1)) / F.cbrt(F.col("n"))
        fd = F.when(step > 0, F.ceil((at(3) - at(0)) / step))
        number = F.when(at(3) == at(0), F.lit(1)).otherwise(F.greatest(sturges, F.coalesce(fd, F.lit(1))))
        plan = found.where("n > 0").select("position", "column", at(0).alias("lo"), at(3).alias("hi"), number.alias("bins"))
    else:
        plan = per_column(df, columns, lambda c: {"lo": F.min(c.cast("double")), "hi": F.max(c.cast("double")), "gaps": F.count_if(c.isNull()), "about": F.approx_count_distinct(c.cast("double"), 0.05)})
        rows = plan.where("lo is not null").collect()  # a row per column
        # Only columns of few values have them counted, so no column's values are all shuffled.
        some = [r.position for r in rows if r.about <= max(MANY_VALUES, 2 * bins)]
        exact = {}
        if some:
            values = _values(df, [columns[i] for i in some]).select("position", "value").distinct()
            exact = {some[r.position]: r.d for r in values.groupBy("position").agg(F.count(F.lit(1)).alias("d")).collect()}
        known = [(r.position, r.column, r.lo, r.hi, min(bins, exact.get(r.position, bins) + (r.gaps > 0))) for r in rows]
        plan = df.sparkSession.createDataFrame(known, "position int, column string, lo double, hi double, bins int")
    return _binned(df, columns, plan)


def density(df: DataFrame, column: str, points: int = 200, fine: int = 2000) -> DataFrame:
    """point, x, density: a Gaussian kernel density by Scott's rule on a grid between the extremes.

    Values are first counted in ``fine`` narrow bins, so the work on the grid is points * fine
    whatever the number of rows.
    """
    df = nan_to_null(df)
    v = q(column).cast("double")
    stats = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))
    stats = stats.withColumn("h", F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).where("h > 0")
    width = (F.col("hi") - F.col("lo")) / F.lit(fine)
    place = F.least(F.floor((v - F.col("lo")) / width), F.lit(fine - 1))
    binned = df.where(v.isNotNull()).crossJoin(F.broadcast(stats)).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("w"))
    # Both sides are bounded: fine bins and grid points.
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point")).crossJoin(stats)
    grid = grid.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1))
    centre = F.col("lo") + (F.col("b") + 0.5) * width
    u = (F.col("x") - centre) / F.col("h")
    scale = F.lit(math.sqrt(2 * math.pi)) * F.col("h") * F.col("n")
    return grid.crossJoin(F.broadcast(binned)).groupBy("point", "x").agg((F.sum(F.col("w") * F.exp(-u * u / 2)) / F.first(scale)).alias("density"))
