"""Time columns, trends and bounded series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import nan_to_null, numeric_columns, per_column, q, string_columns, time_typed_columns
from tabulens.functions.names import TIME_TO_CONVERT, name_matches
from tabulens.functions.times import best_formats, parse
from tabulens.operators.quantiles import quantiles


def time_columns(df: DataFrame, share: float = 0.7, median_length: int = 4) -> DataFrame:
    """position, column, share: columns of a time type, and text of some length most of which parses."""
    texts = string_columns(df)
    formats = best_formats(df, texts)
    found = [c for c in texts if formats[c][1] > share]
    if found:
        lengths = df.select(*[F.char_length(q(c)).alias(c) for c in found])
        long = {r.column for r in quantiles(lengths, found, [0.5]).collect() if (r.q or [0])[0] >= median_length}
        found = [c for c in found if c in long]
    typed = time_typed_columns(df)
    present = per_column(df, typed, lambda c: {"share": F.try_divide(F.count(c).cast("double"), F.count(F.lit(1)))}).collect() if typed else []
    shares = {c: formats[c][1] for c in found} | {r.column: r.share for r in present if (r.share or 0) > share}
    rows = [(i, c, float(shares[c])) for i, c in enumerate(df.columns) if c in shares]
    return df.sparkSession.createDataFrame(rows, "position int, column string, share double")


def dashboard_time_columns(df: DataFrame, share: float = 0.5, instants: int = 3) -> DataFrame:
    """position, column, share, distinct: text or time-named columns of which enough parses to more than a few instants."""
    named = [c for c in df.columns if name_matches(c, ("date", "time")) and c in time_typed_columns(df)]
    texts = string_columns(df)
    formats = best_formats(df, texts)
    columns = [c for c in df.columns if c in named or c in texts]
    if not columns:
        return df.sparkSession.createDataFrame([], "position int, column string, share double, distinct long")
    parsed = df.select(*[(parse(q(c), formats[c][0]) if c in formats else q(c).cast("timestamp")).alias(c) for c in columns])
    found = per_column(parsed, columns, lambda c: {"share": F.try_divide(F.count(c).cast("double"), F.count(F.lit(1))), "distinct": F.approx_count_distinct(c)})
    places = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "column string, place int")
    out = found.where((F.col("share") > share) & (F.col("distinct") > instants)).join(F.broadcast(places), "column")
    return out.select(F.col("place").alias("position"), "column", "share", "distinct")


def convert_time_columns(df: DataFrame, words: tuple[str, ...] = TIME_TO_CONVERT) -> tuple[DataFrame, list[str]]:
    """``df`` with time-named columns as timestamps, and their names. Text takes the format that parses
    most of it; whole numbers from 1900 to 2100 become the first of that year; other numbers stay."""
    named = [c for c in df.columns if name_matches(c, words)]
    texts = [c for c in named if c in string_columns(df)]
    years = [f.name for f in df.schema if f.name in named and isinstance(f.dataType, T.IntegralType)]
    if years:
        in_range = df.agg(*[F.coalesce(F.min(q(c).between(1900, 2100)), F.lit(False)).alias(str(i)) for i, c in enumerate(years)]).first()
        years = [c for i, c in enumerate(years) if in_range[i]]
    formats = best_formats(df, texts)
    new = {c: parse(q(c), formats[c][0]) for c in texts} | {c: F.make_date(q(c).cast("int"), F.lit(1), F.lit(1)).cast("timestamp") for c in years}
    done = [c for c in named if c in new or c in time_typed_columns(df)]
    return (df.withColumns(new) if new else df), done


def time_axis(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """``df`` with the column as whole years or as times, and which: numbers under 2100 are years."""
    if column in numeric_columns(df):
        top = nan_to_null(df).agg(F.max(q(column))).first()[0]
        if top is None or top < 2100:
            return df.withColumn(column, q(column).cast("int")), "year"
        return df.withColumn(column, F.timestamp_seconds(q(column))), "time"
    if column in string_columns(df):
        return df.withColumn(column, parse(q(column), best_formats(df, [column])[column][0])), "time"
    return df, "time"


def trend_count(df: DataFrame, column: str, unit: str | None = None) -> DataFrame:
    """time, n: rows per instant, or per unit (day, month, ...), ascending; missing times left out."""
    df, kind = time_axis(df, column)
    at = F.date_trunc(unit, q(column)) if unit and kind == "time" else q(column)
    return df.where(q(column).isNotNull()).groupBy(at.alias("time")).agg(F.count(F.lit(1)).alias("n")).orderBy("time")


def trend_mean(df: DataFrame, column: str, value: str, unit: str | None = None) -> DataFrame:
    """time, mean of a value per instant or unit, ascending."""
    df, kind = time_axis(nan_to_null(df), column)
    at = F.date_trunc(unit, q(column)) if unit and kind == "time" else q(column)
    return df.where(q(column).isNotNull()).groupBy(at.alias("time")).agg(F.avg(q(value).cast("double")).alias("mean")).orderBy("time")


def trend_points(df: DataFrame, column: str, value: str, key: Column, max_points: int | None = 10_000) -> DataFrame:
    """time, value points; of more than ``max_points`` those whose key hashes lowest, the same ones each time. All points for None."""
    points = nan_to_null(df).where(q(column).isNotNull() & q(value).isNotNull()).select(q(column).alias("time"), q(value).alias("value"), F.xxhash64(key).alias("h"))
    if max_points is None:
        return points.select("time", "value")
    return points.orderBy("h", "time", "value").limit(max_points).select("time", "value")


def sparkline(df: DataFrame, column: str, order_by: str, points: int = 100, least: int = 5) -> DataFrame:
    """bucket, mean: at most ``points`` means along an order column, from equal parts of its range; nothing under ``least`` values."""
    df = nan_to_null(df)
    numeric = order_by in numeric_columns(df)
    key = q(order_by).cast("double") if numeric else F.unix_micros(q(order_by).cast("timestamp")).cast("double")
    rows = df.select(key.alias("k"), q(column).cast("double").alias("v")).where("k is not null and v is not null")
    ends = rows.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    width = (F.col("hi") - F.col("lo")) / points
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("k") - F.col("lo")) / width), F.lit(points - 1))).otherwise(F.lit(0))
    return rows.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bucket")).agg(F.avg("v").alias("mean")).orderBy("bucket")


def date_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """position, column, first, last as yyyy-MM-dd, of columns with any time in them."""
    texts = [c for c in columns if c in string_columns(df)]
    formats = best_formats(df, texts)
    usable = [c for c in columns if c in texts or c in time_typed_columns(df)]
    if not usable:
        return df.sparkSession.createDataFrame([], "position int, column string, first string, last string")
    parsed = df.select(*[(parse(q(c), formats[c][0]) if c in texts else q(c)).alias(c) for c in usable])
    text = lambda t: F.date_format(t, "yyyy-MM-dd")
    return per_column(parsed, usable, lambda c: {"first": text(F.min(c)), "last": text(F.max(c))}).where("first is not null")
