"""Correlations of wide tables against pandas."""

import numpy as np
import pandas as pd
import pytest

from tabulens.operators import correlation as module
from tabulens.operators.correlation import correlation


def _same(found, frame):
    wanted = frame.corr(min_periods=1)
    got = found.toPandas().pivot(index="col_x", columns="col_y", values="corr").loc[frame.columns, frame.columns]
    assert got.isna().to_numpy().tolist() == wanted.isna().to_numpy().tolist()
    assert np.allclose(got.fillna(0), wanted.fillna(0), atol=1e-9)


def _frame(rows, columns, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 5))
    values = base @ rng.normal(size=(5, columns)) + rng.normal(size=(rows, columns)) * 0.3 + rng.choice([0, 1e6, -3e7], columns)
    frame = pd.DataFrame(values, columns=[f"c.{i:03}" for i in range(columns)])
    frame["constant"], frame["empty"] = 0.1, np.nan
    return frame.mask(rng.random(frame.shape) < 0.2 * (np.arange(frame.shape[1]) % 3 == 0))


def _spark(spark, frame, parts):
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False)
    return spark.createDataFrame(list(map(tuple, rows)), ", ".join(f"`{c}` double" for c in frame.columns)).repartition(parts)


@pytest.mark.parametrize("cells", [1_000_000, 100])
def test_equals_pandas(spark, monkeypatch, cells):
    monkeypatch.setattr(module, "CELLS", cells)
    frame = _frame(700, 12)
    _same(correlation(_spark(spark, frame, 5)), frame)


def test_three_hundred_columns_in_one_scan(spark):
    frame = _frame(400, 300)
    df = _spark(spark, frame, 3)
    found = correlation(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    _same(found, frame)


def test_awkward_columns(spark):
    rows = [(1, 2.0, float("nan"), 5, None), (2, 4.0, 1.0, 5, 1.0), (3, 6.0, 2.0, 5, None), (4, 8.0, float("inf"), 5, None)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d long, e double")
    got = {(r.col_x, r.col_y): r.corr for r in correlation(df).collect()}
    assert len(got) == 25 and got["a", "b"] == got["b", "a"] == pytest.approx(1) and got["a", "a"] == 1
    assert all(got[x, y] is None for x in "acd" for y in "cde" if x != y or x == "d") and got["e", "e"] is None
    empty = correlation(df.limit(0)).collect()
    assert len(empty) == 25 and all(r.corr is None for r in empty)
    assert correlation(df.select("a")).count() == 0


def test_constant_where_the_other_is_present(spark):
    """A column that varies, but not over the rows it shares with another."""
    rows = [(0.1, float(i), None) for i in range(50)] + [(0.7 + i, None, float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(6)
    got = {(r.col_x, r.col_y): r.corr for r in correlation(df).collect()}
    assert got["a", "b"] is None and got["b", "c"] is None and got["a", "c"] is not None and got["a", "a"] == 1
