"""Prediction on awkward tables, narrowed quantiles, files with line breaks, all sections of a report."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.operators import distribution, predict, profile, quantiles
from tabulens.plans.report import full_report
from tabulens.sources.tables import load_table


@pytest.mark.parametrize("ties", [False, True])
def test_quantiles_by_narrowing(spark, monkeypatch, ties):
    monkeypatch.setattr(quantiles, "INSIDE", 1)
    monkeypatch.setattr(quantiles, "BINS", 7)
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    rng = np.random.default_rng(5)
    values = rng.integers(0, 12, 997).astype(float) if ties else np.exp(rng.normal(size=998) * 4)
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "v double, w double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.column: r.q for r in quantiles.quantiles(df, ["v", "w"], probs).collect()}
    assert got["v"] == pytest.approx(np.quantile(values, probs).tolist()) and got["w"] == pytest.approx(np.quantile(-values, probs).tolist())


def test_histogram_bins_follow_few_values_only(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("double").alias("three"), F.col("id").cast("double").alias("many"), F.when(F.col("id") > 5, 1.0).alias("gap"))
    bins = {r.column: r.n for r in distribution.histogram(df).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert bins == {"three": 3, "many": 10, "gap": 1}


def test_prediction_on_awkward_tables(spark):
    df = spark.range(40).select(F.col("id"), (F.col("id") % 2).cast("int").alias("y"))
    for awkward, why in ((df.limit(0), "no column"), (df.select("y"), "no feature"), (df.limit(0).withColumn("y", F.col("id")), "no column")):
        with pytest.raises(ValueError, match=why):
            predict.predict(awkward)
    with pytest.raises(ValueError, match="no row"):
        predict.predict(df.limit(0), "y")
    for n in (1, 2, 3):
        few = spark.range(n).select(F.col("id").alias("x"), F.col("id").cast("double").alias("y"))
        try:
            metrics = predict.predict(few, "y", trees=2, depth=2).metrics.collect()
            assert all(m.value is None or np.isfinite(m.value) for m in metrics)
        except ValueError as error:
            assert "no row" in str(error)


def test_texts_of_many_values_are_features(spark):
    """Two texts of many values, one with nulls, decide a class and a number each by their alphabetical order."""
    code, other = F.format_string("c%05d-%s", F.col("id") * 7919 % 3000, F.repeat(F.lit("x"), 200)), F.format_string("o%05d", F.col("id") * 104729 % 3000)
    df = spark.range(3000).select(code.alias("a.b"), F.when(F.col("id") % 20 > 0, other).alias("other"))
    late = F.col("`a.b`") > "c01500"
    got = predict.predict(df.withColumn("kind", F.when(late, "late").otherwise("early")), "kind", trees=10, depth=4)
    assert got.metrics.first().value > 0.95
    assert [r.feature for r in got.importances.orderBy("rank").collect()] == ["a.b", "other"]
    number = df.withColumn("y", F.coalesce(F.substring("other", 2, 5).cast("double"), F.lit(-500.0)))
    figures = {r.metric: r.value for r in predict.predict(number, "y", trees=10, depth=6).metrics.collect()}
    assert figures["r2"] > 0.9
    sizes = {r.column: r.n_unique for r in profile.distinct_counts(df).collect()}
    cuts = predict._cuts(df, sizes)
    assert cuts == predict._cuts(df.repartition(7), sizes)
    assert all(len(c) == predict.MAX_BINS - 1 and c == sorted(c) and max(map(len, c)) <= predict.CUT_LENGTH for c in cuts)


def test_fields_with_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,"two\nlines, ""quoted"""\n2,plain\n3,"x ""y"" z"\n')
    with pytest.raises(ValueError, match="multi_line"):
        load_table(spark, str(path))
    rows = load_table(spark, str(path), multi_line=True)[0].orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, 'two\nlines, "quoted"'), (2, "plain"), (3, 'x "y" z')]
    (tmp_path / "b.csv").write_text('a,b\n1,"x ""y"" z, w"\n2,5" pipe\n')
    assert load_table(spark, str(tmp_path / "b.csv"))[0].count() == 2


def test_all_sections_of_a_report(spark):
    df = spark.range(300).select(F.col("id"), F.date_format(F.date_add(F.lit("2024-01-01"), (F.col("id") % 50).cast("int")), "yyyy-MM-dd").alias("date"), (F.col("id") % 7).cast("double").alias("price"), F.when(F.col("id") % 7 > 3, "hi").otherwise("lo").alias("kind"))
    report = full_report(df, predicted="kind")
    assert {"frequencies", "category_samples", "missing_comment", "distribution_comments", "trend_points", "trend_comments", "sparklines", "density", "five_numbers", "prediction", "importances"} <= set(report)
    sizes = {name: section.count() for name, section in report.items()}
    assert all(n > 0 for name, n in sizes.items() if name not in ("outliers", "variance")) and sizes["trend_points"] == 600
    assert report["prediction"].first().target == "kind"
    assert full_report(df.select("id").limit(0), predicted=True)["prediction"].first().reason
