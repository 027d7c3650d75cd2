"""The first rows of files in their own order, without a column to sort by."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import q


def _placed(df: DataFrame) -> tuple[DataFrame, bool] | None:
    """``df`` with __file and __block (a split's first byte, or a file's row number where the format knows it); None for a table that no
    file source reads."""
    try:
        known = df.select("_metadata").schema["_metadata"].dataType.names
    except AnalysisException:
        return None
    numbered = "row_index" in known
    place = "row_index" if numbered else "file_block_start"
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col(f"_metadata.{place}").alias("__block")), numbered


def _plain(file: str) -> str:
    """A file's name without escapes or an empty authority: Spark writes it either way."""
    return unquote(re.sub(r"^([A-Za-z][\w+.-]*):///", r"\1:/", file))


def _of(files: list[str]):
    """Rows of these files, whichever way their names are written."""
    return F.col("__file").isin(sorted({x for f in files for x in (f, unquote(f), _plain(f), re.sub(":///", ":/", f, count=1))}))


def first_rows(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool] | None:
    """The first ``max_rows`` rows by file (in the order of their names), and by place in the file, and whether there are more; None
    if ``df`` is not read from files. However files are split or dealt to tasks, these are the same rows.

    Files are counted in order, ever more at a time, until there are enough; later ones are not read.
    A count comes to the driver for each split of these (for each file, where rows have numbers).
    """
    found = _placed(df)
    if found is None:
        return None
    placed, numbered = found
    files = sorted(df.inputFiles(), key=_plain)
    before, at, step = 0, 0, 1
    key = ["__file"] if numbered else ["__file", "__block"]
    while at < len(files):
        some = files[at : at + step]
        counts = sorted((_plain(r[0]), *r[1:]) for r in placed.where(_of(some)).groupBy(*key).count().collect())
        for file, *block, n in counts:
            if before + n > max_rows:
                earlier = [f for f in files if _plain(f) < file]
                blocks = [b[0] for f, *b, _ in counts if f == file and b < block]
                return _cut(placed, df.columns, earlier, [f for f in files if _plain(f) == file], blocks, block, max_rows - before), True
            before += n
        at, step = at + step, step * 2
    return df, False


def _cut(placed: DataFrame, columns: list[str], earlier: list[str], file: list[str], blocks: list[int], block: list[int], rest: int) -> DataFrame:
    """Rows of ``earlier`` files, of ``blocks`` of ``file``, and the first ``rest`` rows of ``block`` (empty where rows have numbers)."""
    own = placed.where(_of(file))
    parts = [placed.where(_of(earlier))] if earlier else []
    if block:
        parts += [own.where(F.col("__block").isin(blocks))] if blocks else []
        # At most one split's rows are put in order.
        last = own.where(F.col("__block") == block[0]).withColumn("__id", F.monotonically_increasing_id())
        parts.append(last.orderBy("__id").limit(rest).drop("__id"))
    else:
        parts.append(own.where(F.col("__block") < rest))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select(*[q(c) for c in columns])
