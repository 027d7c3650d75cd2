"""Profiles that are added to, file by file, against the profile of everything."""

import pytest
from frames import DATA
from pyspark.sql import functions as F

from tabulens.operators.profile import distinct_counts, numeric_stats
from tabulens.operators.saved_profile import SavedProfile


def _split(spark, tmp_path, parts):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").withColumn("l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_tax")))
    table = str(tmp_path / "a table")
    for i in range(parts):
        df.where(F.pmod(F.col("l_orderkey"), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(table)
    return df, table


def _close(spark, found, df):
    got = {r.column: r for r in found.collect()}
    assert set(got) == set(df.columns)
    n = df.count()
    for r in numeric_stats(df).collect():
        own = got[r.column]
        assert (own.rows, own.n, own.missing, own.min, own.max) == (n, r.n, n - r.n, r.min, r.max)
        assert own.mean == pytest.approx(r.mean, rel=1e-12) and own.std == pytest.approx(r.std, rel=1e-9)
        for p, value in ((0.25, own.q1), (0.5, own.median), (0.75, own.q3)):
            below, upto = df.agg(F.count_if(F.col(r.column) < value), F.count_if(F.col(r.column) <= value)).first()
            assert below <= (p + 0.01) * r.n and upto >= (p - 0.01) * r.n
    for r in distinct_counts(df).collect():
        assert got[r.column].n_unique == pytest.approx(r.n_unique, rel=0.03, abs=1)
    assert got["l_returnflag"].mean is None and got["l_returnflag"].median is None


def test_files_one_by_one_or_at_once(spark, tmp_path):
    df, table = _split(spark, tmp_path, 3)
    files = spark.read.parquet(table).inputFiles()
    saved = SavedProfile(spark, str(tmp_path / "saved"))
    assert saved.result().count() == 0
    for f in files:
        assert saved.add(f.replace("%20", " ")) == 1
    assert saved.add(table) == 0
    _close(spark, saved.result(), df)
    _close(spark, SavedProfile.of(spark, table, str(tmp_path / "other")).result(), df)


def test_a_new_file_costs_one_file(spark, tmp_path):
    df, table = _split(spark, tmp_path, 2)
    saved = SavedProfile.of(spark, table, str(tmp_path / "saved"))
    (tmp_path / "hidden").mkdir()
    for f in list((tmp_path / "a table").glob("*.parquet")):
        # Known files are not read again: what they hold now does not matter, only that they have not changed.
        stat = f.stat()
        f.write_bytes(b"x" * stat.st_size)
        import os

        os.utime(f, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    extra = df.limit(100).coalesce(1)
    extra.write.parquet(str(tmp_path / "more"))
    assert saved.add(str(tmp_path / "more")) == 1
    got = {r.column: r for r in SavedProfile(spark, saved.path).result().collect()}
    assert got["l_orderkey"].rows == df.count() + 100


def test_changed_files_and_other_columns(spark, tmp_path):
    table = str(tmp_path / "t")
    spark.createDataFrame([(1, float("nan")), (5, 2.0)], "a int, b double").coalesce(1).write.parquet(table)
    saved = SavedProfile.of(spark, table, str(tmp_path / "saved"))
    got = {r.column: (r.rows, r.n, r.mean, r.max) for r in saved.result().collect()}
    assert got == {"a": (2, 2, 3.0, 5.0), "b": (2, 1, 2.0, 2.0)}
    spark.createDataFrame([(7, "x")], "a int, c string").coalesce(1).write.parquet(str(tmp_path / "u"))
    saved.add(str(tmp_path / "u"))
    got = {r.column: (r.rows, r.n, r.missing, r.n_unique) for r in saved.result().collect()}
    assert got == {"a": (3, 3, 0, 3), "b": (3, 1, 2, 1), "c": (3, 1, 2, 1)}
