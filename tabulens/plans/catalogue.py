"""Queries of the profiler over the given tables, with their SQL for DuckDB.

Doubles are rounded on both sides, as sums come in different orders.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import q
from tabulens.operators import categorical, correlation, distribution, kpi, narrative, predict, profile, tables, timeseries
from tabulens.operators.saved_profile import SavedProfile
from tabulens.sources.pages import PageIndex
from tabulens.sources.scratch import scratch_path
from tabulens.sources.search_index import SearchIndex
from tabulens.sources.tables import cap_rows

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES]
LINEITEM = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing values in two columns."""
    df = _table(spark, sf_dir, "lineitem")
    return df.withColumns({"l_discount": F.when(~(F.col("l_quantity") > 45), F.col("l_discount")), "l_returnflag": F.when(F.col("l_linenumber") != 7, F.col("l_returnflag"))})


GAPPY = """gappy AS (SELECT * REPLACE (CASE WHEN l_quantity > 45 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS l_returnflag) FROM lineitem)"""


def _rounded(df: DataFrame, digits: int = 4, drop: tuple[str, ...] = ("position",)) -> DataFrame:
    return df.select(*[F.round(q(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else q(f.name) for f in df.schema if f.name not in drop])


def _each(columns: list[str], select: str, source: str, more: str = "") -> str:
    """One SELECT per column; {c} is its name and {i} its place."""
    return " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", {select.format(c=c, i=i)} FROM {source} {more.format(c=c, i=i)})" for i, c in enumerate(columns))


def _long(columns: list[str], source: str, cast: str = "DOUBLE") -> str:
    return " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", CAST({c} AS {cast}) AS value FROM {source}" for i, c in enumerate(columns))


def _query(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


# Profile -------------------------------------------------------------------------------------

_query(
    "numeric_stats",
    lambda s, d: _rounded(profile.numeric_stats(_table(s, d, "lineitem"))),
    _each(LINEITEM_NUMBERS, "count({c}) AS n, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max", "lineitem"),
)
_MISSING = _each(LINEITEM, "count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), {{digits}}) AS percent, {i} AS position", "gappy")
_query(
    "missing_values",
    lambda s, d: profile.missing_values(_gappy(s, d)).drop("position"),
    f'WITH {GAPPY} SELECT "column", missing, percent FROM ({_MISSING.format(digits=2)}) WHERE missing > 0',
)
_query("missing_table", lambda s, d: profile.missing_table(_gappy(s, d)), f'WITH {GAPPY} SELECT "column", missing, percent FROM ({_MISSING.format(digits=1)}) WHERE missing > 0')
_query(
    "missing_table_all_filled",
    lambda s, d: profile.missing_table(_table(s, d, "lineitem")),
    "SELECT CAST(NULL AS VARCHAR) AS \"column\", CAST(0 AS BIGINT) AS missing, CAST(0.0 AS DOUBLE) AS percent FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0",
)
_query(
    "missing_worst",
    lambda s, d: profile.missing_worst(_gappy(s, d)),
    f'WITH {GAPPY}, m AS ({_MISSING.format(digits=1)}) SELECT "column", missing, percent, (SELECT count(*) FROM m WHERE missing > 0) AS affected FROM m ORDER BY missing DESC, position LIMIT 1',
)
_query(
    "missing_total",
    lambda s, d: profile.missing_total(_gappy(s, d)),
    f"WITH {GAPPY} SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns, 2 * count(*) - count(l_discount) - count(l_returnflag) AS missing, round(100.0 * (11 * count(*) - (2 * count(*) - count(l_discount) - count(l_returnflag))) / (11 * count(*)), 1) AS filled FROM gappy",
)
_PART = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}
_query(
    "column_types",
    lambda s, d: profile.column_types(_table(s, d, "part")).drop("position"),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(DISTINCT {c}) AS n_unique FROM part" for c, t in _PART.items()),
)
_query(
    "dtype_histogram",
    lambda s, d: profile.dtype_histogram(_table(s, d, "part")),
    "SELECT dtype, count(*) AS columns, CAST(sum(present) AS BIGINT) AS present FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS dtype, count({c}) AS present FROM part" for c, t in _PART.items()) + ") GROUP BY dtype",
)
_DISTINCT = _each(ORDERS, "count(DISTINCT {c}) AS n_unique", "orders")
_query("distinct_counts", lambda s, d: profile.distinct_counts(_table(s, d, "orders")).drop("position"), _DISTINCT)
_STRINGS = "('o_orderstatus', 'o_orderpriority')"
_query("categorical_columns", lambda s, d: profile.categorical_columns(_table(s, d, "orders")).select("column", "n_unique"), f'SELECT * FROM ({_DISTINCT}) WHERE "column" IN {_STRINGS} OR n_unique <= 15')
_query("low_cardinality_strings", lambda s, d: profile.low_cardinality_strings(_table(s, d, "orders")).select("column", "n_unique"), f'SELECT * FROM ({_DISTINCT}) WHERE "column" IN {_STRINGS} AND n_unique <= 20')
_query("target_columns", lambda s, d: profile.target_columns(_table(s, d, "orders")).select("column", "n_unique"), f"SELECT * FROM ({_DISTINCT}) WHERE n_unique >= 2")
_query(
    "uniqueness",
    lambda s, d: profile.uniqueness(_table(s, d, "orders"), "o_custkey"),
    "SELECT 'o_custkey' AS \"column\", count(o_custkey) AS n, count(DISTINCT o_custkey) AS n_unique, round(100.0 * count(DISTINCT o_custkey) / count(o_custkey), 1) AS percent FROM orders",
)

# Distribution --------------------------------------------------------------------------------

_STATS = _each(MEASURES, "count({c}) AS n, avg({c}) AS mean, median({c}) AS median, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, skewness({c}) AS skew", "lineitem")
_query(
    "skew_labels",
    lambda s, d: _rounded(distribution.describe_distribution(_table(s, d, "lineitem"), MEASURES).drop("outliers")),
    f"""SELECT "column", n, round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max, round(skew, 4) AS skew,
    CASE WHEN skew IS NULL THEN 'undefined' WHEN skew < -1 THEN 'strongly left' WHEN skew < -0.5 THEN 'slightly left' WHEN skew < 0.5 THEN 'symmetric' WHEN skew < 1 THEN 'slightly right' ELSE 'strongly right' END AS label FROM ({_STATS})""",
)
_query(
    "outliers_sigma",
    lambda s, d: distribution.sigma_outliers(_table(s, d, "orders"), ["o_totalprice"], 1.5).drop("position"),
    "SELECT 'o_totalprice' AS \"column\", count(*) FILTER (WHERE abs(o_totalprice - m) > 1.5 * s) AS outliers FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)",
)
_FENCES = "SELECT '{c}' AS \"column\", quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM {t}"
_query(
    "outliers_iqr",
    lambda s, d: _rounded(distribution.iqr_outliers(_table(s, d, "lineitem"), MEASURES, 0.4)),
    "WITH f AS (" + " UNION ALL ".join(_FENCES.format(c=c, v=c, t="lineitem") for c in MEASURES) + "), v AS (" + _long(MEASURES, "lineitem") + """)
    SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(low, 4) AS low, round(high, 4) AS high, outliers, round(100.0 * outliers / (SELECT count(*) FROM lineitem), 2) AS percent
    FROM (SELECT f."column", q1, q3, q1 - 0.4 * (q3 - q1) AS low, q3 + 0.4 * (q3 - q1) AS high, count(*) FILTER (WHERE value < q1 - 0.4 * (q3 - q1) OR value > q3 + 0.4 * (q3 - q1)) AS outliers
          FROM f JOIN v ON f."column" = v."column" GROUP BY ALL) WHERE outliers > 0""",
)
_query(
    "outlier_rows",
    lambda s, d: distribution.outlier_rows(_table(s, d, "orders"), "o_totalprice", 0.4).select("o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) WHERE o_totalprice < q1 - 0.4 * (q3 - q1) OR o_totalprice > q3 + 0.4 * (q3 - q1)",
)
_query(
    "five_numbers",
    lambda s, d: _rounded(distribution.five_numbers(_table(s, d, "lineitem"))),
    _each(LINEITEM_NUMBERS, "round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3, round(CAST(max({c}) AS DOUBLE), 4) AS max", "lineitem"),
)
_BINNED = """SELECT "column", CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / bins)), bins - 1) ELSE 0 END AS INTEGER) AS bin, count(*) AS n
  FROM v JOIN p USING ("column") GROUP BY ALL"""
_query(
    "histogram_fixed",
    lambda s, d: distribution.histogram(_gappy(s, d), MEASURES).select("column", "bin", "n"),
    f"WITH {GAPPY}, v AS (SELECT * FROM ({_long(MEASURES, 'gappy')}) WHERE value IS NOT NULL), p AS ("
    + _each(MEASURES, "CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, least(10, count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END) AS bins", "gappy")
    + f") {_BINNED}",
)
_query(
    "histogram_auto",
    lambda s, d: distribution.histogram(_table(s, d, "lineitem"), MEASURES[:2], "fd").select("column", "bin", "n"),
    f"WITH v AS ({_long(MEASURES[:2], 'lineitem')}), p AS ("
    + _each(MEASURES[:2], "min({c}) AS lo, max({c}) AS hi, greatest(ceil(log2(count({c})) + 1), ceil((max({c}) - min({c})) / (2 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / cbrt(count({c}))))) AS bins", "lineitem")
    + f") {_BINNED}",
)
_query(
    "kde",
    lambda s, d: distribution.density(_table(s, d, "lineitem"), "l_extendedprice").select("point", F.round("x", 3).alias("x"), F.round(F.col("density") * 1e6, 4).alias("density_e6")),
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n, stddev_samp(l_extendedprice) * pow(count(*), -0.2) AS h FROM lineitem),
    b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 2000)), 1999) AS b, count(*) AS w FROM lineitem, s GROUP BY ALL),
    g AS (SELECT CAST(range AS INTEGER) AS point, lo, hi, n, h, lo + (hi - lo) * range / 199 AS x FROM range(200), s)
    SELECT point, round(x, 3) AS x, round(1e6 * sum(w * exp(-pow((x - (lo + (b + 0.5) * (hi - lo) / 2000)) / h, 2) / 2)) / (sqrt(2 * pi()) * h * n), 4) AS density_e6 FROM g, b GROUP BY point, x, h, n""",
)

# Categories ----------------------------------------------------------------------------------

_FLAGS = ["l_returnflag", "l_linestatus"]
_COUNTS = "counts AS (SELECT position, \"column\", value, count(*) AS n FROM ({long}) WHERE value IS NOT NULL GROUP BY ALL)"
_query(
    "top_values",
    lambda s, d: categorical.top_values(_table(s, d, "part")).drop("position"),
    "WITH " + _COUNTS.format(long=_long(["p_name", "p_brand", "p_type"], "part", "VARCHAR")) + ', r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM counts) SELECT "column", rank, value, n FROM r WHERE rank <= 5',
)
_TEXTS = ["text", "lang", "source"]
_query(
    "top_texts",
    lambda s, d: categorical.top_values(_table(s, d, "documents")).drop("position"),
    "WITH " + _COUNTS.format(long=_long(_TEXTS, "documents", "VARCHAR")) + ', r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM counts) SELECT "column", rank, value, n FROM r WHERE rank <= 5',
)
_query("value_counts", lambda s, d: categorical.value_counts(_gappy(s, d)).drop("position"), f"WITH {GAPPY}, " + _COUNTS.format(long=_long(_FLAGS, "gappy", "VARCHAR")) + ' SELECT "column", value, n FROM counts')
_query(
    "frequency_tables",
    lambda s, d: categorical.frequency_tables(_table(s, d, "orders")).drop("position"),
    "WITH " + _COUNTS.format(long=_long(["o_orderstatus", "o_orderpriority"], "orders", "VARCHAR")) + ' SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank, value, n FROM counts',
)
_query(
    "mode_share",
    lambda s, d: categorical.mode_share(_gappy(s, d)).drop("position"),
    f"WITH {GAPPY}, " + _COUNTS.format(long=_long(_FLAGS, "gappy", "VARCHAR")) + ', r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k, sum(n) OVER (PARTITION BY "column") AS total FROM counts) SELECT "column", value, n, round(100.0 * n / total, 1) AS percent FROM r WHERE k = 1',
)
_query(
    "category_samples",
    lambda s, d: categorical.category_samples(_table(s, d, "orders")).drop("position"),
    "WITH " + _COUNTS.format(long=_long(["o_orderstatus", "o_orderpriority"], "orders", "VARCHAR")) + ', r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k, count(*) OVER (PARTITION BY "column") AS n_unique FROM counts) SELECT "column", n_unique, string_agg(value, \', \' ORDER BY k) AS sample FROM r WHERE k <= 5 GROUP BY ALL',
)

# Correlation ---------------------------------------------------------------------------------

_query(
    "correlation",
    lambda s, d: correlation.correlation(_gappy(s, d), MEASURES, 4),
    f"WITH {GAPPY} " + " UNION ALL ".join(f"SELECT '{a}' AS col_x, '{b}' AS col_y, round(corr({a}, {b}), 4) AS corr FROM gappy" for a in MEASURES for b in MEASURES),
)
#: Eight columns of each measure, with gaps in different rows.
_WIDE = {f"{m}_{k}": f"CASE WHEN l_linenumber <> {k + 1} THEN {m} * {k + 1} + l_partkey % {k + 2} END" for m in MEASURES for k in range(8)}
_query(
    "saved_profile",
    lambda s, d: _rounded(SavedProfile.of(s, f"{d}/lineitem.parquet", scratch_path(s, "profile")).result().where("mean is not null").select("column", "rows", "n", "missing", "mean", "std", "min", "max"), drop=()),
    _each(LINEITEM_NUMBERS, "count(*) AS rows, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max", "lineitem"),
)
_query(
    "correlation_wide",
    lambda s, d: correlation.correlation(_table(s, d, "lineitem").select(*[F.expr(x).alias(c) for c, x in _WIDE.items()]), digits=4),
    "WITH wide AS MATERIALIZED (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _WIDE.items()) + " FROM lineitem), "
    "half AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) + 0.0 AS corr FROM wide" for a, b in combinations_with_replacement(_WIDE, 2)) + ") "
    "SELECT a AS col_x, b AS col_y, corr FROM half UNION ALL SELECT b, a, corr FROM half WHERE a <> b",
)
_query(
    "top_variance",
    lambda s, d: _rounded(correlation.top_variance(_table(s, d, "lineitem")), 2),
    "SELECT \"column\", round(variance, 2) AS variance FROM (" + _each(LINEITEM_NUMBERS, "var_samp({c}) AS variance", "lineitem") + ") ORDER BY variance DESC LIMIT 3",
)

# Key figures ---------------------------------------------------------------------------------

_BAND = "CASE WHEN percent < 50 THEN 'low' WHEN percent < 75 THEN 'medium' ELSE 'high' END AS band"
_query(
    "gauges",
    lambda s, d: kpi.gauges(_gappy(s, d)),
    f"""WITH {GAPPY}, g AS (
      SELECT 'filled' AS gauge, round(100.0 * (9 * count(*) + count(l_discount) + count(l_returnflag)) / (11 * count(*)), 1) AS percent FROM gappy
      UNION ALL SELECT 'unique', round(100.0 * count(DISTINCT l_orderkey) / count(l_orderkey), 1) FROM gappy) SELECT gauge, percent, {_BAND} FROM g""",
)
_query(
    "kpi_means",
    lambda s, d: _rounded(kpi.named_means(_table(s, d, "lineitem"))),
    "SELECT 'l_extendedprice' AS \"column\", round(avg(l_extendedprice), 4) AS mean FROM lineitem",
)
_query(
    "kpi_ratings",
    lambda s, d: _rounded(kpi.rating_means(_table(s, d, "events").withColumnRenamed("value", "rating"))),
    "SELECT 'rating' AS \"column\", round(avg(value), 4) AS mean FROM events",
)
_query(
    "kpi_ids",
    lambda s, d: kpi.id_counts(_table(s, d, "events")).drop("position"),
    _each(["event_id", "user_id"], "count(DISTINCT {c}) AS n_unique", "events"),
)
_query(
    "kpi_date_range",
    lambda s, d: kpi.date_ranges(_table(s, d, "lineitem")).drop("position"),
    "SELECT 'l_shipdate' AS \"column\", strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last FROM lineitem",
)
_query(
    "kpi_first_means",
    lambda s, d: _rounded(kpi.first_means(_table(s, d, "customer"))),
    _each(["c_custkey", "c_nationkey", "c_acctbal"], "round(avg({c}), 4) AS mean", "customer"),
)
_query(
    "key_figures",
    lambda s, d: kpi.key_figures(_table(s, d, "events")).select("kpi", "column", F.round("value", 4).alias("value")),
    """SELECT 'filled' AS kpi, CAST(NULL AS VARCHAR) AS "column", 100.0::DOUBLE AS value FROM (SELECT count(*) FROM events)
    UNION ALL SELECT 'unique', 'event_id', round(100.0 * count(DISTINCT event_id) / count(event_id), 1) FROM events
    UNION ALL SELECT 'mean', 'value', round(avg(value), 4) FROM events
    UNION ALL SELECT 'distinct ids', 'event_id', count(DISTINCT event_id) FROM events
    UNION ALL SELECT 'distinct ids', 'user_id', count(DISTINCT user_id) FROM events""",
)

# Time ----------------------------------------------------------------------------------------


def _text_dates(s: SparkSession, d: str) -> DataFrame:
    df = _table(s, d, "orders")
    return df.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_date"))


_query(
    "time_columns",
    lambda s, d: timeseries.time_columns(_text_dates(s, d)).drop("position"),
    "SELECT unnest(['o_orderdate', 'us_date']) AS \"column\", share FROM (SELECT CAST(count(try_cast(strftime(o_orderdate, '%Y-%m-%d') AS DATE)) AS DOUBLE) / count(*) AS share FROM orders)",
)
_query(
    "dashboard_time_columns",
    lambda s, d: timeseries.dashboard_time_columns(_text_dates(s, d)).select("column", "share"),
    "SELECT unnest(['o_orderdate', 'us_date']) AS \"column\", CAST(1.0 AS DOUBLE) AS share FROM (SELECT count(DISTINCT o_orderdate) AS n FROM orders) WHERE n > 3",
)
_query(
    "convert_time_columns",
    lambda s, d: timeseries.convert_time_columns(_text_dates(s, d))[0].select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), F.col("us_date").cast("date").alias("us_date")),
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(o_orderdate AS DATE) AS us_date FROM orders",
)
_query("trend_count", lambda s, d: timeseries.trend_count(_table(s, d, "events"), "ts", "day").select(F.col("time").cast("date").alias("time"), "n"), "SELECT CAST(ts AS DATE) AS time, count(*) AS n FROM events GROUP BY 1")
_query(
    "trend_mean",
    lambda s, d: _rounded(timeseries.trend_mean(_table(s, d, "events"), "ts", "value", "day").select(F.col("time").cast("date").alias("time"), "mean")),
    "SELECT CAST(ts AS DATE) AS time, round(avg(value), 4) AS mean FROM events GROUP BY 1",
)
_query(
    "trend_by_year",
    lambda s, d: timeseries.trend_count(_table(s, d, "orders").select(F.year("o_orderdate").alias("year")), "year"),
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS time, count(*) AS n FROM orders GROUP BY 1",
)
_query("trend_points", lambda s, d: timeseries.trend_points(_table(s, d, "events"), "ts", "value", F.col("event_id"), None), "SELECT ts AS time, value FROM events")
_query(
    "sparkline",
    lambda s, d: _rounded(timeseries.sparkline(_table(s, d, "events"), "value", "event_id")),
    """WITH e AS (SELECT min(event_id)::DOUBLE AS lo, max(event_id)::DOUBLE AS hi FROM events)
    SELECT CAST(least(floor((event_id - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bucket, round(avg(value), 4) AS mean FROM events, e GROUP BY 1""",
)

# Rows and texts ------------------------------------------------------------------------------

_query(
    "search_rows",
    lambda s, d: tables.search_rows(_table(s, d, "customer"), "BUILDING 12", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name"),
    "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'building') AND contains(lower(c_name || ' ' || c_mktsegment), '12')",
)
_query("page", lambda s, d: tables.page(_table(s, d, "customer"), [F.desc("c_acctbal"), "c_custkey"], number=2), "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20")
_query(
    "page_deep",
    lambda s, d: PageIndex.build(_table(s, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"], scratch_path(s, "pages")).page(10, 140),
    "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 1400",
)
_FOUND = "contains(lower(lang || ' ' || source || ' ' || text), '{}')"
_query(
    "search_filtered",
    lambda s, d: SearchIndex.build(s, f"{d}/documents.parquet", scratch_path(s, "filters"), ["lang", "source", "text"]).search("Tionment queaux").select("doc_id", "lang"),
    f"SELECT doc_id, lang FROM documents WHERE {_FOUND.format('tionment')} AND {_FOUND.format('queaux')}",
)
_query("head", lambda s, d: tables.head(_table(s, d, "customer"), order_by=["c_custkey"]), "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
_query("preview", lambda s, d: tables.preview(_table(s, d, "orders"), columns=3, order_by=["o_orderkey"]), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 4")
_query("row_cap", lambda s, d: cap_rows(_table(s, d, "orders"), 1000, ["o_orderkey"])[0], "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
_query("first_rows", lambda s, d: cap_rows(_table(s, d, "orders"), 1000)[0], "SELECT * FROM orders LIMIT 1000")
_query(
    "dense_columns",
    lambda s, d: _gappy(s, d).select(profile.dense_columns(_gappy(s, d), 0.9)).groupBy().agg(F.count(F.lit(1)).alias("rows"), F.lit(len(profile.dense_columns(_gappy(s, d), 0.9))).cast("long").alias("columns")),
    f"WITH {GAPPY} SELECT count(*) AS rows, 9 + CASE WHEN count(l_discount) >= 0.9 * count(*) THEN 1 ELSE 0 END + CASE WHEN count(l_returnflag) >= 0.9 * count(*) THEN 1 ELSE 0 END AS columns FROM gappy",
)
_query(
    "summary_lines",
    lambda s, d: narrative.dataset_summary(_table(s, d, "orders")).where("line <= 2"),
    "SELECT 1 AS line, 'size' AS topic, count(*) || ' rows, 6 columns' AS text FROM orders UNION ALL SELECT 2, 'missing', '0 columns with missing values' FROM (SELECT count(*) FROM orders)",
)
# The other lines of the same summary; summary_lines has those its SQL states.
_query(
    "summary_details",
    lambda s, d: narrative.dataset_summary(_table(s, d, "orders")).where("line > 2"),
    """WITH long AS (
      SELECT 2 AS position, 'o_orderstatus' AS name, o_orderstatus AS v FROM orders UNION ALL SELECT 5, 'o_orderpriority', o_orderpriority FROM orders
    ),
    counted AS (SELECT position, name, v, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, v) AS rank, count(*) OVER (PARTITION BY name) AS n FROM long GROUP BY position, name, v)
    SELECT 3 AS line, 'types' AS topic, 'bigint: 2, double: 1, string: 2, timestamp_ntz: 1' AS text FROM (SELECT count(*) FROM orders)
    UNION ALL SELECT 4 + position, 'category', name || ' (' || n || ' values): ' || string_agg(v, ', ' ORDER BY rank) FROM counted WHERE rank <= 5 GROUP BY position, name, n""",
)
_query(
    "distribution_comments",
    lambda s, d: narrative.distribution_comments(_table(s, d, "lineitem"), ["l_quantity"]),
    "SELECT 'l_quantity' AS \"column\", printf('median %.2f, from %.2f to %.2f', median(l_quantity), min(l_quantity), max(l_quantity)) AS comment FROM lineitem",
)
_query(
    "trend_comments",
    lambda s, d: narrative.trend_comments(_table(s, d, "events"), ["value"]),
    "SELECT 'value' AS \"column\", printf('from %.2f to %.2f', min(value), max(value)) AS comment FROM events",
)
_query(
    "missing_comment",
    lambda s, d: narrative.missing_comment(_table(s, d, "orders")),
    "SELECT 'no missing values' AS comment FROM (SELECT count(*) FROM orders)",
)
_query(
    "missing_comment_gaps",
    lambda s, d: narrative.missing_comment(_gappy(s, d)),
    f'WITH {GAPPY}, m AS ({_MISSING.format(digits=1)}) SELECT "column" || \' has most missing values (\' || percent || \'%); \' || (SELECT count(*) FROM m WHERE missing > 0) || \' columns have any\' AS comment FROM m ORDER BY missing DESC, position LIMIT 1',
)

_query(
    "model_features",
    lambda s, d: profile.distinct_counts(_gappy(s, d), columns=profile.model_features(_gappy(s, d), "l_tax")).drop("position"),
    f"WITH {GAPPY} " + _each([c for c in LINEITEM if c not in ("l_tax", "l_shipdate")], "count(DISTINCT {c}) AS n_unique", "gappy"),
)

# Prediction ----------------------------------------------------------------------------------

_KEY = ("l_orderkey", "l_linenumber")


def _forest(s: SparkSession, d: str, target: str):
    df = _table(s, d, "lineitem").drop("l_shipdate")
    return predict.predict(df, target, F.struct(*_KEY))


_query(
    "automatic_target",
    lambda s, d: s.createDataFrame([predict.choose_target(_table(s, d, "orders"))], "column string, task string"),
    "SELECT 'o_orderpriority' AS \"column\", 'classification' AS task FROM (SELECT count(DISTINCT o_orderpriority) AS n FROM orders) WHERE n BETWEEN 2 AND 20",
)
_query("predict_class", lambda s, d: _forest(s, d, "l_returnflag").metrics)
_query("predict_reg", lambda s, d: _forest(s, d, "l_extendedprice").metrics)
_query("importances", lambda s, d: _forest(s, d, "l_extendedprice").importances)
