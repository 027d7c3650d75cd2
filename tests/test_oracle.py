"""Every profiler query with SQL gives what DuckDB gives."""

import pytest
from frames import DATA, rows

from tabulens.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, oracle, name):
    found, wanted = QUERIES[name](spark, DATA).toPandas(), oracle(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_prediction_bounds(spark):
    accuracy = QUERIES["predict_class"](spark, DATA).first()
    assert accuracy.metric == "accuracy" and 0 <= accuracy.value <= 1
    weights = QUERIES["importances"](spark, DATA).toPandas()
    assert 0 < weights["importance"].sum() <= 1.0001 and len(weights) <= 10


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registered_queries_are_whole(spark):
    from tabulens.operators import predict
    from tabulens.plans import catalogue

    forest = catalogue._forest(spark, DATA, "l_returnflag").model.stages[-1]
    assert (forest.getNumTrees, forest.getMaxDepth()) == (predict.TREES, predict.DEPTH)
    assert "Limit" not in QUERIES["trend_points"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    topics = [r.topic for name in ("summary_lines", "summary_details") for r in QUERIES[name](spark, DATA).orderBy("line").collect()]
    assert topics == ["size", "missing", "types", "category", "category"]
