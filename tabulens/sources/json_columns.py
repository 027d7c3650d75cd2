"""JSON documents that are one object of columns: ``{"a": {"0": 1, "1": 2}, "b": {...}}`` or ``{"a": [1, 2], "b": [...]}``.

A file is read as a stream of pieces between commas, in order, by one task that holds one cell at a time, and gives
(row, column, value) cells; these are pivoted by row in a shuffle. So no file and no column has to fit in memory.

Defined results: rows are the labels of all columns, in the order in which they come; a cell that is missing or null is null;
of a label given twice in a column the last counts; whole numbers are longs, with fractions doubles, objects and arrays
their JSON text; a column of several kinds is text. A file that is something else is a ValueError.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.sources.scratch import stored

CELLS = "file string, row long, label string, place int, column string, kind string, value string"
#: Pieces of a file's beginning by which its shape is told.
HEAD = 2000
_MARK = re.compile(r'\\.|["{}\[\]]', re.S)


class Scanner:
    """How deep in objects and arrays, and whether in a string, the text so far ends."""

    def __init__(self):
        self.depth, self.quoted, self.began = 0, False, False

    def feed(self, text: str) -> int | None:
        """The place after which the first value is complete, if it is completed in ``text``."""
        for mark in _MARK.finditer(text):
            c = mark.group()
            if c == '"':
                self.quoted = not self.quoted
            elif not self.quoted and c in "{[":
                self.depth, self.began = self.depth + 1, True
            elif not self.quoted and c in "}]":
                self.depth -= 1
                if not self.depth:
                    return mark.end()
        return None


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, id, value: what lies between commas."""
    read = spark.read.option("lineSep", ",").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def shape_of(spark: SparkSession, path: str) -> str:
    """array, columns or lines, by a file's beginning."""
    pieces = _pieces(spark, path).where("block = 0")
    first = pieces.agg(F.min("file")).first()[0]
    if first is None:
        return "lines"
    rows = pieces.where(F.col("file") == first).orderBy("id").limit(HEAD + 1).collect()
    head = ",".join(r.value for r in rows[:HEAD]).lstrip("\ufeff \t\r\n")
    if not head.startswith("{"):
        return "array" if head.startswith("[") else "lines"
    end = Scanner().feed(head)
    if end is not None:
        if head[end:].strip() or len(rows) > HEAD:
            return "lines"
        try:
            values = list(json.loads(head).values())
        except ValueError:
            return "lines"
        return "columns" if values and (all(isinstance(v, dict) for v in values) or all(isinstance(v, list) for v in values)) else "lines"
    return "columns" if re.match(r'\{\s*"(?:[^"\\]|\\.)*"\s*:\s*(\{\s*"-?\d+"\s*:|\[)', head) else "lines"


def _kind(value) -> tuple[str | None, str | None]:
    if value is None:
        return None, None
    if isinstance(value, bool):
        return "boolean", json.dumps(value)
    if isinstance(value, int):
        return ("long" if -(1 << 63) <= value < 1 << 63 else "double"), str(value)
    if isinstance(value, float):
        return "double", repr(value)
    return ("string", value) if isinstance(value, str) else ("json", json.dumps(value, ensure_ascii=False))


class _Reader:
    """Cells from the pieces of one file."""

    def __init__(self, file: str):
        self.file, self.scanner, self.held = file, Scanner(), []
        self.place, self.column, self.row, self.begun, self.done = -1, None, 0, False, False
        self.decode = json.JSONDecoder().raw_decode

    def _fail(self, why: str):
        raise ValueError(f"{self.file} is not one JSON object of columns: {why}")

    def feed(self, piece: str):
        self.held.append(piece)
        self.scanner.feed(piece)
        # A comma parts cells within a column, or columns.
        if not self.scanner.quoted and self.scanner.depth <= 2:
            text, self.held = ",".join(self.held), []
            yield from self._cells(text.strip())

    def end(self):
        if self.held or not self.done:
            self._fail("it ends early")

    def _cells(self, text: str):
        if self.done:
            self._fail("more follows the object")
        try:
            if not self.begun:
                text = text.lstrip("\ufeff")
                if not text.startswith("{"):
                    self._fail("no object")
                self.begun, text = True, text[1:].lstrip()
            while text:
                if text[0] == "}" and self.column is None:
                    self.done = True
                    if text[1:].strip():
                        self._fail("more follows the object")
                    return
                if self.column is None:
                    name, at = self.decode(text)
                    text = text[at:].lstrip()
                    opened = text[1:].lstrip()
                    if not isinstance(name, str) or text[:1] != ":" or opened[:1] not in ("{", "["):
                        self._fail(f"a value of {name!r} is neither object nor array")
                    self.column, self.labelled = name, opened[0] == "{"
                    self.place, self.row, text = self.place + 1, 0, opened[1:].lstrip()
                elif text[0] == ("}" if self.labelled else "]"):
                    self.column, text = None, text[1:].lstrip()
                else:
                    label = str(self.row)
                    if self.labelled:
                        label, at = self.decode(text)
                        text = text[at:].lstrip()
                        if text[:1] != ":":
                            self._fail("a label without a value")
                        text = text[1:].lstrip()
                    value, at = self.decode(text)
                    yield (self.file, self.row, label, self.place, self.column, *_kind(value))
                    self.row, text = self.row + 1, text[at:].lstrip()
        except json.JSONDecodeError as reason:
            self._fail(str(reason))


def _read(batches):
    names = [f.split()[0] for f in CELLS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 3]
    reader = None
    for batch in batches:
        out = []
        for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if reader is None or reader.file != file:
                if reader is not None:
                    reader.end()
                reader = _Reader(file)
            out += reader.feed(value)
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    if reader is not None:
        reader.end()


def _type(kinds: set[str]) -> str:
    if kinds == {"long"}:
        return "long"
    if kinds and kinds <= {"long", "double"}:
        return "double"
    return "boolean" if kinds == {"boolean"} else "string"


def read_columns(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """The table, and the same with __file and __row, by which its rows are in order."""
    order = _pieces(spark, path).repartition("file").sortWithinPartitions("file", "block", "id").select("file", "value")
    try:
        cells, _ = stored(order.mapInArrow(_read, CELLS), "json-cells")
    except PythonException as failed:
        found = re.search(r"ValueError: (.*is not one JSON object of columns.*)", str(failed))
        raise (ValueError(found.group(1)) if found else failed) from None
    # A row per column.
    columns = cells.groupBy("column").agg(F.min(F.struct("file", "place")).alias("at"), F.collect_set("kind").alias("kinds")).orderBy("at").collect()
    types = {r.column: _type(set(r.kinds)) for r in columns}
    if schema is not None:
        types = {f.name: f.dataType.simpleString() for f in schema}
    last = lambda c: F.max_by("value", F.when(F.col("column") == c, F.col("row")))
    wide = cells.groupBy(F.col("file").alias("__file"), "label").agg(F.min("row").alias("__row"), *[last(c).alias(f"c{i}") for i, c in enumerate(types)])
    named = [F.col(f"c{i}").cast(t).alias(c) for i, (c, t) in enumerate(types.items())]
    return wide.select(*named), wide.select("__file", "__row", *named)
