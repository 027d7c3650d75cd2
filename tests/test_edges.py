"""Null, NaN, constant, tiny and odd tables; file formats; known values."""

import math

import pytest
from pyspark.sql import functions as F

from tabulens.functions.names import name_matches
from tabulens.operators import categorical, correlation, distribution, kpi, narrative, predict, profile, tables, timeseries
from tabulens.operators.quantiles import quantiles
from tabulens.plans.report import full_report
from tabulens.sources.report import read_report, write_report
from tabulens.sources.tables import cap_rows, load_table


def by_column(df):
    return {r["column"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(1.0, 2.0, "x"), (float("nan"), 4.0, None), (3.0, None, "y"), (None, 8.0, "x")], "a double, b double, s string")


def test_known_values(spark):
    df = spark.createDataFrame([(i, 10 * i) for i in range(1, 6)], "id long, value long")
    got = {c: [round(r[k], 2) for k in ("mean", "median", "std", "min", "max")] for c, r in by_column(profile.numeric_stats(df)).items()}
    assert got == {"id": [3.0, 3.0, 1.58, 1, 5], "value": [30.0, 30.0, 15.81, 10, 50]}


def test_temperature(spark):
    values = [30, 28, 25, 22, 20, 18, 15, 14, 13.5, 13, 13, 12, 10, 8, 5, 3, 1, 0, -2, -5]
    df = spark.createDataFrame([(float(v),) for v in values], "t double")
    row = quantiles(df, ["t"], [0.25, 0.5, 0.75]).first()
    import numpy as np

    assert row.q == pytest.approx(np.percentile(values, [25, 50, 75]).tolist())


def test_nan_is_missing(gaps):
    assert {c: r.missing for c, r in by_column(profile.missing_values(gaps)).items()} == {"a": 2, "b": 1, "s": 1}
    stats = by_column(profile.numeric_stats(gaps))
    assert (stats["a"]["mean"], stats["a"]["n"], stats["a"]["max"]) == (2.0, 2, 3.0)
    assert profile.missing_worst(gaps).first().asDict() == {"column": "a", "missing": 2, "percent": 50.0, "affected": 3}
    assert {c: r.n_unique for c, r in by_column(profile.distinct_counts(gaps)).items()} == {"a": 2, "b": 3, "s": 2}


def test_pairwise_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 5.0, 5.0), (None, 9.0, 5.0)], "a double, b double, k double")
    got = {(r.col_x, r.col_y): r["corr"] for r in correlation.correlation(df).collect()}
    assert got["a", "b"] == pytest.approx(0.9819805) and got["b", "a"] == got["a", "b"]
    assert got["a", "k"] is None and got["k", "k"] is None and got["a", "a"] == pytest.approx(1)
    assert correlation.correlation(df.select("a")).count() == 0


def test_constant_column(spark):
    df = spark.createDataFrame([(7.0,)] * 5, "k double")
    row = distribution.describe_distribution(df).first()
    assert (row.skew, row.label, row.outliers) == (0.0, "symmetric", 0)
    assert [(r.bin, r.n) for r in distribution.histogram(df).collect()] == [(0, 5)]
    assert [(r.bin, r.n) for r in distribution.histogram(df, bins="fd").collect()] == [(0, 5)]
    assert distribution.density(df, "k").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    df = spark.createDataFrame([(float(i), f"s{i}") for i in range(n)], "v double, s string")
    row = distribution.describe_distribution(df).first()
    assert row.skew is None and row.label == "undefined" and row.n == n
    assert distribution.iqr_outliers(df).count() == 0
    assert sum(r.n for r in distribution.histogram(df).collect()) == n
    assert profile.missing_values(df).count() == 0
    assert profile.uniqueness(df).first().percent == (100.0 if n else 0.0)
    assert categorical.top_values(df).count() == n
    assert timeseries.time_columns(df).count() == 0
    for section in full_report(df).values():
        section.collect()


def test_infinite_values(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "v double")
    assert quantiles(df, ["v"], [0.5]).first().q == [1.5]


def test_properties_of_histograms_and_counts(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("v"), (F.col("id") % 5).cast("string").alias("s"), F.when(F.col("id") % 10 != 0, F.col("id")).alias("gap"))
    assert {c: r["sum(n)"] for c, r in by_column(distribution.histogram(df).groupBy("column").sum("n")).items()} == {"v": 1000, "gap": 900}
    assert categorical.value_counts(df).groupBy().sum("n").first()[0] == 1000
    corr = {(r.col_x, r.col_y): r["corr"] for r in correlation.correlation(df).collect()}
    assert all(corr[a, b] == corr[b, a] and -1 <= corr[a, b] <= 1 for a, b in corr if corr[a, b] is not None) or corr["v", "v"] == pytest.approx(1)


def test_approximate_paths(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    exact, near = quantiles(df, ["v"], [0.1, 0.9]).first().q, quantiles(df, ["v"], [0.1, 0.9], approx=True).first().q
    assert near == pytest.approx(exact, abs=3)
    assert abs(profile.distinct_counts(df, approx=True).first().n_unique - 10_000) < 1000


def test_time_detection_and_conversion(spark):
    df = spark.createDataFrame([("2024-01-02", "01/31/2024", "12:30", "abc", 1999), ("2024-02-03", "02/01/2024", "13:45", None, 2001), ("2024-03-04", "12/24/2024", "09:10", "2024-01-01", 2003)], "iso string, us_date string, clock_time string, junk string, year int")
    assert {r["column"] for r in timeseries.time_columns(df).collect()} == {"iso", "us_date"}
    new, names = timeseries.convert_time_columns(df)
    row = new.orderBy("iso").first()
    assert row.us_date.isoformat() == "2024-01-31T00:00:00" and row.year.isoformat() == "1999-01-01T00:00:00" and row.clock_time is None
    assert names == ["us_date", "clock_time", "year"]
    assert [(r.time, r.n) for r in timeseries.trend_count(df, "year").collect()] == [(1999, 1), (2001, 1), (2003, 1)]


def test_names():
    assert name_matches("sentiment", ("time",)) and not name_matches("sentiment", ("time",), "token")
    assert name_matches("user_id", ("id",), "token") and name_matches("humidity", ("id",))


def test_kpis_by_name(spark):
    df = spark.createDataFrame([(1.5, 4.0, "u1", "x"), (2.5, 5.0, "u2", "x")], "unit_price double, rating double, user_id string, humidity string")
    assert {r["column"]: r["mean"] for r in kpi.named_means(df).collect()} == {"unit_price": 2.0}
    assert kpi.rating_means(df).first()["mean"] == 4.5
    assert {r["column"] for r in kpi.id_counts(df, match="token").collect()} == {"user_id"}
    assert {r["column"] for r in kpi.id_counts(df).collect()} == {"user_id", "humidity"}


def test_nested_columns_do_not_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0], {"a": 1}), ([1.0, 2.0], {"b": 2})], "arr array<float>, m map<string,int>")
    assert {c: r.n_unique for c, r in by_column(profile.column_types(df)).items()} == {"arr": 1, "m": None}
    assert profile.missing_values(df).count() == 0


def test_names_with_spaces_and_ticks(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (4.0, "b")], "`Outfit Recommendation` double, `odd``name` string")
    assert profile.numeric_stats(df).first()["column"] == "Outfit Recommendation"
    assert categorical.mode_share(df).first()["value"] == "b"
    assert tables.search_rows(df, "B 4").count() == 1


def test_narrative(gaps):
    lines = [r.text for r in narrative.dataset_summary(gaps).orderBy("line").collect()]
    assert lines[:3] == ["4 rows, 3 columns", "3 columns with missing values", "double: 2, string: 1"]
    assert narrative.missing_comment(gaps).first().comment == "a has most missing values (50.0%); 3 columns have any"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x, y"\n2,z\n')
    (tmp_path / "latin1.csv").write_bytes("a,b\n1,café\n".encode("latin-1"))
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    (tmp_path / "pretty.json").write_text('\n[\n {"a": 1,\n  "b": "x"},\n {"a": 2, "b": "y"}\n]\n')
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    read = lambda n, **k: load_table(spark, str(tmp_path / n), **k)
    assert [tuple(r) for r in read("a.csv")[0].orderBy("a").collect()] == [(1, "x, y"), (2, "z")]
    assert read("latin1.csv")[0].first().b == "café"
    assert tuple(read("t.tsv")[0].first()) == (1, "x")
    assert read("pretty.json")[0].count() == 2 and read("lines.json")[0].count() == 3
    assert read("lines.json", max_rows=2, order_by=["a"])[1] is True
    with pytest.raises(ValueError):
        read("b.xyz")


def test_cap_and_report(spark, tmp_path, gaps):
    few, cut = cap_rows(spark.range(10), 3, ["id"])
    assert (few.count(), cut) == (3, True) and cap_rows(spark.range(3), 3)[1] is False
    report = {"missing": profile.missing_values(gaps), "stats": profile.numeric_stats(gaps)}
    for fmt in ("parquet", "json"):
        write_report(report, str(tmp_path / fmt), fmt)
        back = read_report(spark, str(tmp_path / fmt), list(report), fmt)
        assert back["missing"].count() == 3 and back["stats"].count() == 2


def test_prediction(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 7 > 3, "hi").otherwise("lo").alias("y"))
    got = predict.predict(df, key=F.col("id"), trees=10, depth=4)
    assert (got.target, got.task) == ("y", "classification") and got.metrics.first().value > 0.95
    assert got.importances.orderBy("rank").first().feature == "x"
    assert math.isfinite(predict.predict(df, "x", F.col("id"), trees=5, depth=3).metrics.where("metric = 'mae'").first().value)
