"""Tables from files of several formats."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import q, string_columns
from tabulens.sources import json_columns
from tabulens.sources.first_rows import first_rows

FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".parquet": "parquet"}
#: What Spark puts where bytes are not valid in the encoding.
BROKEN = "�"


def format_of(path: str) -> str:
    """By the lower-cased extension; a ValueError for an unknown one."""
    found = FORMATS.get(posixpath.splitext(path.rstrip("/"))[1].lower())
    if found is None:
        raise ValueError(f"unknown format: {path}")
    return found


def _delimited(spark: SparkSession, path: str, sep: str, schema: T.StructType | None, encoding: str, multi_line: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", multi_line)
    # As RFC 4180 has it: a quote in a quoted field is doubled.
    reader = reader.option("escape", '"') if multi_line else reader
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def _open_quotes(spark: SparkSession, path: str, sep: str) -> bool:
    """Whether a line ends within a quoted field, which goes on in the next one."""
    s, line = re.escape(sep), F.regexp_replace("value", '""', "")
    opened = line.rlike(f'(^|{s})"[^"]*$')
    return spark.read.text(path).where(opened).limit(1).count() > 0


def _csv(spark: SparkSession, path: str, sep: str, schema: T.StructType | None, multi_line: bool) -> DataFrame:
    # Fields with line breaks need each file in one task; without the option they are an error, not wrong rows.
    if not multi_line and _open_quotes(spark, path, sep):
        raise ValueError(f"{path} has quoted fields with line breaks: read it with multi_line=True")
    df = _delimited(spark, path, sep, schema, "UTF-8", multi_line)
    texts = string_columns(df)
    broken = F.concat_ws("", *[q(c) for c in texts]).contains(BROKEN) if texts else F.lit(False)
    bad_names = any(BROKEN in c for c in df.columns)
    if bad_names or (texts and df.where(broken).limit(1).count()):
        return _delimited(spark, path, sep, schema, "ISO-8859-1", multi_line)
    return df


def _json(spark: SparkSession, path: str, schema: T.StructType | None) -> tuple[DataFrame, DataFrame | None]:
    """An array document, JSON lines, or one object of columns: told apart by the beginning of the first file. The last has
    its rows' places beside it."""
    shape = json_columns.shape_of(spark, path)
    if shape == "columns":
        return json_columns.read_columns(spark, path, schema)
    reader = spark.read.option("multiLine", shape == "array")
    return (reader.schema(schema) if schema else reader).json(path), None


def load_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None, max_rows: int | None = None, order_by: list[str] | None = None, multi_line: bool = False) -> tuple[DataFrame, bool]:
    """The table at ``path`` (a file, folder or glob) and whether ``max_rows`` cut it short. There is
    no limit by default; with one, ``order_by`` decides which rows come first, and without it their order in the files
    does. ``multi_line``: fields of CSV and TSV files may hold line breaks; each file is then read by one task."""
    fmt, placed = fmt or format_of(path), None
    if fmt == "csv":
        df = _csv(spark, path, ",", schema, multi_line)
    elif fmt == "tsv":
        df = _csv(spark, path, "\t", schema, multi_line)
    elif fmt == "json":
        df, placed = _json(spark, path, schema)
    elif fmt == "parquet":
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
    if max_rows is not None and placed is not None and not order_by:
        return placed.orderBy("__file", "__row").limit(max_rows).select(*[q(c) for c in df.columns]), df.limit(max_rows + 1).count() > max_rows
    return (df, False) if max_rows is None else cap_rows(df, max_rows, order_by)


def cap_rows(df: DataFrame, max_rows: int, order_by: list[str] | None = None) -> tuple[DataFrame, bool]:
    """The first rows, and whether there are more: by ``order_by``, else in the order of the files that ``df`` is read from. A table
    that comes from elsewhere has no order of its own; any rows are taken then."""
    found = None if order_by else first_rows(df, max_rows)
    if found is not None:
        return found
    ordered = df.orderBy(*order_by) if order_by else df
    return ordered.limit(max_rows), df.limit(max_rows + 1).count() > max_rows
