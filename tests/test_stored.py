"""Stored orders and filters: the same rows as without them, and few files read."""

import os

import pytest
from frames import DATA, rows
from pyspark.sql import functions as F

from tabulens.operators.tables import page, search_rows
from tabulens.sources.pages import PageIndex
from tabulens.sources.scratch import shared_folder
from tabulens.sources.search_index import SearchIndex


def _folder(spark, tmp_path):
    return str(tmp_path / "stored")


@pytest.mark.parametrize("most", [100_000, 70])
def test_pages_of_any_depth(spark, tmp_path, most):
    df = spark.read.parquet(f"{DATA}/orders.parquet")
    order = [F.desc("o_totalprice"), "o_orderkey"]
    index = PageIndex.build(df, order, _folder(spark, tmp_path), most)
    assert index.rows == df.count()
    for n, number in ((10, 0), (10, 13), (10, 149), (64, 3), (200, 5), (1000, 1), (10, 99_999)):
        wanted, found = page(df, order, n, number).toPandas(), index.page(n, number).toPandas()
        assert found.to_dict() == wanted.to_dict(), (n, number)
    # Opened again, and bounded reads: a page of ten needs two files at most.
    again = PageIndex(spark, _folder(spark, tmp_path))
    assert len(again.page(10, 120).inputFiles()) <= 2 and again.page(10, 120).count() == 10


def test_pages_of_an_empty_table_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (2, 2), (1, 3)], "a int, `b.c` int")
    index = PageIndex.build(df, ["a"], str(tmp_path / "a"))
    assert [tuple(r) for r in index.page(2, 0).collect()] == [(None, 1), (1, 3)]
    empty = PageIndex.build(df.limit(0), ["a"], str(tmp_path / "b"))
    assert empty.page(10, 0).count() == 0 and empty.rows == 0


def test_search_skips_files(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("odd.name", F.lit("Tail"))
    table = str(tmp_path / "table")
    df.repartitionByRange(8, "doc_id").write.parquet(table)
    index = SearchIndex.build(spark, table, _folder(spark, tmp_path), ["lang", "text", "odd.name"])
    word = max(df.where("doc_id = 3").first().text.split(), key=len)
    for text in (word, word.upper()[:6], f"{word} en", "en", "a", "", "nothing like it 12345", "fr tail"):
        wanted = search_rows(df, text, index.columns)
        assert rows(index.search(text).toPandas()) == rows(wanted.toPandas()), text
    assert len(index.candidates(word)) < 8 and index.candidates("12345 nosuchword") == [] and index.candidates("a") is None
    files = index.search(word).select(F.input_file_name().alias("f")).distinct().count()
    assert 1 <= files <= len(index.candidates(word))
    # Files that cannot match are not opened.
    skipped = next(f for f in spark.read.parquet(table).inputFiles() if os.path.basename(f) not in {os.path.basename(x) for x in index.candidates(word)})
    with open(skipped.removeprefix("file://"), "wb") as file:
        file.write(b"damaged")
    assert index.search(word).count() == search_rows(df, word, index.columns).count()


def test_search_reads_new_files(spark, tmp_path):
    table, path = str(tmp_path / "table"), _folder(spark, tmp_path)
    spark.createDataFrame([(1, "old words"), (2, None)], "id int, text string").coalesce(1).write.parquet(table)
    index = SearchIndex.build(spark, table, path)
    spark.createDataFrame([(3, "fresh words"), (4, "é日本")], "id int, text string").coalesce(1).write.mode("append").parquet(table)
    assert {r.id for r in index.search("fresh").collect()} == {3} and {r.id for r in index.search("words").collect()} == {1, 3}
    assert index.refresh() == 1 and index.refresh() == 0
    assert {r.id for r in index.search("FRESH w").collect()} == {3} and {r.id for r in index.search("é日本").collect()} == {4}
    assert shared_folder(spark)
