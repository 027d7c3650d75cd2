"""Correlation and variance of numeric columns.

Correlations of any number of columns come from one scan: each task turns its rows into co-moment (Gram) matrices
by Arrow batches, with masks for missing values, and the tasks' matrices are added up row by row of the
matrix. Moments are taken about the batch's means and merged by the difference of means, so large offsets do
not cancel digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import nan_to_null, numeric_columns, per_column, q

#: Cells of the matrix that one scan computes: a task holds about 100 bytes a cell. 1000 columns take one scan.
CELLS = 1_000_000
#: Matrices of tasks are merged in so many lots, and then the lots.
LOTS = 512
_PARTS = ("n", "mean_x", "mean_y", "m2_x", "m2_y", "c", "top")
_SCHEMA = "i int, " + ", ".join(f"{p} array<double>" for p in _PARTS)
_EPS = np.finfo(float).eps


def _moments(values: np.ndarray, first: int, last: int) -> list[np.ndarray]:
    """The parts for the rows first to last of the matrix: how many rows have both values, the means of either over
    these, their sums of squares and of products about the means, and the columns' largest absolute values."""
    present = ~np.isnan(values)
    with np.errstate(all="ignore"):
        some = present.any(axis=0)
        filled = np.where(present, values, 0)
        shift = filled.sum(axis=0) / np.maximum(present.sum(axis=0), 1)
        low, high = (np.where(some, f(np.where(present, values, fill), axis=0), 0) for f, fill in ((np.min, np.inf), (np.max, -np.inf)))
        # A constant is its own mean, to the last digit.
        shift = np.where(low == high, low, shift)
        x, rows = np.where(present, values - shift, 0), slice(first, last)
        own, k = x[:, rows], values.shape[1]
        if present.all():
            n = np.full((last - first, k), float(len(values)))
            s_x, s_y = np.repeat(own.sum(axis=0)[:, None], k, axis=1), np.repeat(x.sum(axis=0)[None], last - first, axis=0)
            q_x, q_y = np.repeat((own**2).sum(axis=0)[:, None], k, axis=1), np.repeat((x**2).sum(axis=0)[None], last - first, axis=0)
        else:
            mask = present.astype(float)
            n = mask[:, rows].T @ mask
            s_x, s_y = own.T @ mask, mask[:, rows].T @ x
            q_x, q_y = (own**2).T @ mask, mask[:, rows].T @ x**2
        some = np.maximum(n, 1)
        m_x, m_y = s_x / some, s_y / some
        about = lambda q, s, m: np.where(q - s * m <= 32 * _EPS * q, 0, q - s * m)
        return [n, shift[rows][:, None] + m_x, shift[None] + m_y, about(q_x, s_x, m_x), about(q_y, s_y, m_y), own.T @ x - s_x * m_y, np.repeat(np.maximum(abs(low), abs(high))[None], last - first, axis=0)]


def _merged(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Parts that are stacked along the first axis as those of all their rows together."""
    n, mean_x, mean_y, m2_x, m2_y, c, top = parts
    with np.errstate(all="ignore"):
        total = n.sum(axis=0)
        some = np.maximum(total, 1)
        # About the first stacked means that have rows, so that equal means stay what they are.
        x, y = ((n * (m - m[0])).sum(axis=0) / some + m[0] for m in (np.where(n > 0, mean_x, mean_x.max(axis=0)), np.where(n > 0, mean_y, mean_y.max(axis=0))))
        d_x, d_y = np.where(n > 0, mean_x - x, 0), np.where(n > 0, mean_y - y, 0)
        return [total, x, y, (m2_x + n * d_x**2).sum(axis=0), (m2_y + n * d_y**2).sum(axis=0), (c + n * d_x * d_y).sum(axis=0), top.max(axis=0)]


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def _gatherer(first: int, last: int):
    def gather(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                found = _moments(values, first, last)
                held = found if held is None else _merged([np.stack(pair) for pair in zip(held, found, strict=True)])
        if held is not None:
            yield pa.record_batch([pa.array(np.arange(first, last), pa.int32()), *map(_lists, held)], names=["i", *_PARTS])

    return gather


def _sum(table: pa.Table) -> list[np.ndarray]:
    """The parts of one row of the matrix, from several tasks."""
    return _merged([np.stack(table[p].combine_chunks().to_numpy(zero_copy_only=False)) for p in _PARTS])


def _added(table: pa.Table) -> pa.Table:
    return pa.table([table["i"].slice(0, 1), *[_lists(x[None]) for x in _sum(table)]], names=["i", *_PARTS])


def _coefficients(table: pa.Table) -> pa.Table:
    i = int(table["i"][0].as_py())
    n, _, _, m2_x, m2_y, c, top = _sum(table)
    with np.errstate(all="ignore"):
        # What rounding leaves of a constant is no variance.
        varies = (m2_x > n * (8 * _EPS * top[i]) ** 2) & (m2_y > n * (8 * _EPS * top) ** 2)
        corr = np.where(varies, np.clip(c / (np.sqrt(m2_x) * np.sqrt(m2_y)), -1, 1), np.nan)
    if not np.isnan(corr[i]):
        corr[i] = 1.0
    return pa.table({"i": pa.array(np.full(len(corr), i), pa.int32()), "j": pa.array(np.arange(len(corr)), pa.int32()), "corr": pa.array(corr, mask=~np.isfinite(corr))})


def correlation(df: DataFrame, columns: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """col_x, col_y, corr over rows where both are present, both ways round; null where a column is constant or
    infinite, no rows for fewer than two columns. One scan for up to 1000 columns."""
    columns = numeric_columns(df) if columns is None else columns
    k = len(columns)
    if k < 2:
        return df.sparkSession.createDataFrame([], "col_x string, col_y string, corr double")
    values = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    width, parts = max(1, CELLS // k), None
    for first in range(0, k, width):
        part = values.mapInArrow(_gatherer(first, min(k, first + width)), _SCHEMA)
        parts = part if parts is None else parts.union(part)
    lots = parts.groupBy("i", F.pmod(F.spark_partition_id(), F.lit(LOTS)).alias("lot")).applyInArrow(_added, _SCHEMA)
    found = lots.groupBy("i").applyInArrow(_coefficients, "i int, j int, corr double")
    # An empty table has no parts, but pairs.
    spark = df.sparkSession
    named = lambda i, name: F.broadcast(spark.createDataFrame(list(enumerate(columns)), f"{i} int, {name} string"))
    pairs = spark.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j"))
    pairs = pairs.join(named("i", "col_x"), "i").join(named("j", "col_y"), "j")
    # A small negative rounds to plain 0.
    corr = F.col("corr") if digits is None else F.round("corr", digits) + F.lit(0.0)
    return pairs.join(found, ["i", "j"], "left").select("col_x", "col_y", corr.alias("corr"))


def top_variance(df: DataFrame, n: int = 3) -> DataFrame:
    """column, variance of the most varying numeric columns; no rows if there are fewer than ``n``."""
    df = nan_to_null(df)
    columns = numeric_columns(df)
    found = per_column(df, columns, lambda c: {"variance": F.var_samp(c.cast("double"))})
    return found.where(F.lit(len(columns) >= n)).orderBy(F.desc("variance"), "position").limit(n).select("column", "variance")
