"""Files: JSON of columns in every shape, and first rows in file order however files are split."""

import json

import pandas as pd
import pytest

from tabulens.sources import json_columns
from tabulens.sources.tables import cap_rows, load_table


def _write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def _rows(df):
    return [tuple(r) for r in df.collect()]


TABLE = {"a, b": {"0": 1, "1": None, "2": 3}, 'q"{': {"0": "x, y", "1": 'a "quote" \\ }', "2": "é"}, "f": {"0": 1, "1": 2.5, "2": None}, "n": {"0": [1, {"k": ","}], "1": {}, "2": None}, "t": {"0": True, "1": False, "2": None}, "mix": {"0": 1, "1": "one", "2": None}}


@pytest.mark.parametrize("indent", [None, 2])
def test_objects_of_columns(spark, tmp_path, indent):
    path = _write(tmp_path, "c.json", json.dumps(TABLE, indent=indent))
    df, cut = load_table(spark, path)
    assert not cut and df.dtypes == [("a, b", "bigint"), ('q"{', "string"), ("f", "double"), ("n", "string"), ("t", "boolean"), ("mix", "string")]
    got = sorted(_rows(df), key=str)
    assert got == sorted([(1, "x, y", 1.0, '[1, {"k": ","}]', True, "1"), (None, 'a "quote" \\ }', 2.5, "{}", False, "one"), (3, "é", None, None, None, None)], key=str)


def test_as_pandas_writes_it(spark, tmp_path):
    frame = pd.DataFrame({"x": range(50), "y": [f"v{i},{i}" for i in range(50)], "z": [i / 4 for i in range(50)]})
    frame.to_json(tmp_path / "p.json")
    df, _ = load_table(spark, str(tmp_path / "p.json"))
    assert sorted(_rows(df)) == list(frame.itertuples(index=False, name=None))
    first, cut = load_table(spark, str(tmp_path / "p.json"), max_rows=7)
    assert cut and sorted(_rows(first)) == list(frame.head(7).itertuples(index=False, name=None))


def test_arrays_as_columns_and_labels(spark, tmp_path):
    path = _write(tmp_path, "l.json", '{"a": [1, 2, [3, 4]], "b": ["x", null, "z"]}')
    assert sorted(_rows(load_table(spark, path)[0]), key=str) == sorted([("1", "x"), ("2", None), ("[3, 4]", "z")], key=str)
    path = _write(tmp_path, "w.json", '{"a": {"mon": 1, "tue": 2}, "b": {"tue": 5, "wed": 6}}')
    assert sorted(_rows(load_table(spark, path)[0]), key=str) == sorted([(1, None), (2, 5), (None, 6)], key=str)


def test_other_shapes_stay(spark, tmp_path):
    lines = _write(tmp_path, "j.json", '{"a": {"0": 1}, "b": 2}\n{"a": {"0": 3}, "b": 4}\n')
    assert sorted(r.b for r in load_table(spark, lines)[0].collect()) == [2, 4]
    array = _write(tmp_path, "k.json", '[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in load_table(spark, array)[0].collect()) == [1, 2]
    record = _write(tmp_path, "r.json", '{"a": 1, "b": {"0": 2}}')
    assert load_table(spark, record)[0].count() == 1


@pytest.mark.parametrize("text", ['{"a": {"0": 1, "1": 2}, "b": {"0": 1}', '{"a": {"0": 1}, "b": 3}', '{"a": {"0": 1}, "b": {"0": 2}} {"a": 1}', '{"a": {"0": 1 2}}'])
def test_what_is_no_object_of_columns_is_an_error(spark, tmp_path, text):
    with pytest.raises(ValueError, match="not one JSON object of columns"):
        json_columns.read_columns(spark, _write(tmp_path, "bad.json", text))


def test_a_long_file_is_read_in_order(spark, tmp_path):
    n = 30_000
    text = json.dumps({"a": {str(i): i for i in range(n)}, "b": {str(i): f"t,{i}" for i in range(n)}})
    path = _write(tmp_path, "long.json", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df, _ = load_table(spark, path)
        assert df.count() == n and df.where("b = concat('t,', a)").count() == n
        first, cut = load_table(spark, path, max_rows=20_000)
        assert cut and {r.a for r in first.collect()} == set(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "tsv"])
def test_first_rows_of_any_split(spark, tmp_path, fmt):
    df = spark.range(9000).selectExpr("id", "concat('text ', id) as t").repartitionByRange(3, "id").sortWithinPartitions("id")
    path = str(tmp_path / f"some table.{fmt}")
    writer = df.write.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("maxRecordsPerFile", 2000)
    getattr(writer, "csv" if fmt == "tsv" else fmt)(path)
    for size in ("128m", "9000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            for n in (0, 1, 2000, 4321, 8999):
                first, cut = load_table(spark, path, fmt=fmt, max_rows=n)
                assert cut and sorted(r.id for r in first.select("id").collect()) == list(range(n)), (size, n)
            whole, cut = load_table(spark, path, fmt=fmt, max_rows=9000)
            assert not cut and whole.count() == 9000
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_later_files_are_not_read(spark, tmp_path):
    spark.range(900).repartitionByRange(9, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "many.parquet"))
    first, cut = load_table(spark, str(tmp_path / "many.parquet"), max_rows=150)
    assert cut and len({r.f for r in first.selectExpr("input_file_name() as f").collect()}) == 2
    last = sorted(tmp_path.glob("many.parquet/part-0000[5-8]*"))
    for file in last:
        file.write_bytes(b"damaged")
    assert first.count() == 150


def test_tables_without_files(spark):
    some, cut = cap_rows(spark.range(10), 4)
    assert cut and some.count() == 4
