"""Most frequent values by sketches, by full counts and by both, against plain counting."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulens.operators import categorical
from tabulens.operators.categorical import mode_share, top_values


def _wanted(rows, columns, n):
    out = {}
    for i, c in enumerate(columns):
        counts = Counter(r[i] for r in rows if r[i] is not None)
        out[c] = [(v, k) for v, k in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:n]]
    return out


def _found(frame):
    out = {}
    for r in frame.orderBy("position", "rank").collect():
        out.setdefault(r.column, []).append((r.value, r.n))
    return out


COLUMNS = ("heavy", "distinct", "long", "few", "none")


@pytest.fixture(scope="module")
def table():
    rows = []
    for i in range(3000):
        heavy = f"hit{i % 10 % 4}" if i % 10 < 7 else f"own {i}"
        long = ("same beginning of a text " * 3 + str(i % 40 if i % 3 else i)) if i % 5 else None
        rows.append((heavy, f"value {i * 7919 % 100_003:06} é", long, "ab"[i % 2] if i % 9 else None, None))
    return rows


@pytest.mark.parametrize("few, tracked, listed, winners", [(50_000, 4096, 200, 10_000), (2, 256, 20, 10_000), (2, 64, 6, 3), (0, 4096, 5, 10_000)])
def test_equals_plain_counts(spark, monkeypatch, table, few, tracked, listed, winners):
    for name, value in (("FEW", few), ("TRACKED", tracked), ("LISTED", listed), ("WINNERS", winners)):
        monkeypatch.setattr(categorical, name, value)
    df = spark.createDataFrame(table, ", ".join(f"{c} string" for c in COLUMNS)).repartition(5)
    wanted = _wanted(table, COLUMNS, 5)
    assert _found(top_values(df)) == {c: v for c, v in wanted.items() if v}
    modes = {r.column: (r.value, r.n, r.percent) for r in mode_share(df).collect()}
    present = {c: sum(r[i] is not None for r in table) for i, c in enumerate(COLUMNS)}
    assert modes == {c: (*v[0], round(100 * v[0][1] / present[c], 1)) for c, v in wanted.items() if v}


def test_sketch_counts_candidates_only(spark, monkeypatch, table):
    """Where a few values hold most rows, others are not counted."""
    asked = []
    own = categorical._counted
    monkeypatch.setattr(categorical, "FEW", 2)
    monkeypatch.setattr(categorical, "_counted", lambda df, columns, full, candidates: asked.append((full, sorted(candidates))) or own(df, columns, full, candidates))
    df = spark.createDataFrame([r[:2] for r in table], "heavy string, distinct string")
    assert _found(top_values(df, n=4)) == _wanted(table, COLUMNS[:2], 4)
    assert asked[-1] == ([1], [0])


def test_texts_are_not_shuffled(spark):
    """What is exchanged has hashes and beginnings; whole texts only of the winners."""
    df = spark.range(50).select(F.repeat(F.concat(F.lit("long "), F.col("id").cast("string")), 1000).alias("text"))
    counted = categorical._counted(df, ["text"], [0], {})
    assert [f.name for f in counted.schema] == ["position", "a", "b", "prefix", "n"]
    assert counted.agg(F.max(F.length("prefix"))).first()[0] == categorical.PREFIX
    assert len(_found(top_values(df))["text"]) == 5


def test_no_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert top_values(df).count() == 0 and mode_share(df).count() == 0
    assert top_values(spark.createDataFrame([], "s string")).count() == 0
