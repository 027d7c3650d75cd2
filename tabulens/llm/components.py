"""Connected components of a graph given as a table of links.

Defined results: repeated links and links of a node with itself count once; a link with a null end
counts for nothing; a node that only links with itself is a component of its own; an empty table
gives no rows. Only the columns a and b are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import join_groups, store


#: Graphs of more nodes have their hubs split: the whole table of a smaller one fits a task many times over.
SPLIT_FROM = 1_000_000


def _looked_up(rows: DataFrame, key: str, values: DataFrame, node: str, how: str, split: bool) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row per ``node``) for ``key``. A hub's node may be the
    key of most rows, so with ``split`` keys are counted first (partial sums) and hot ones are broadcast."""
    if not split:
        return rows.join(values, rows[key] == values[node], how).drop(node)
    sizes = rows.groupBy(F.col(key).alias("__node")).agg(F.count(F.lit(1)).alias("__n"))
    found = store(values.join(sizes, F.col(node) == F.col("__node")).drop("__node").withColumnRenamed(node, "__at"), "looked-up")
    return join_groups(rows.withColumn("__at", F.col(key)), found, "__at", "__n", how).drop("__at", "__n")


def components(links: DataFrame, split_from: int = SPLIT_FROM) -> DataFrame:
    """node, root for every node of ``links`` (a long, b long); nodes of one component share a root.

    Each round, every node takes the least of itself and its neighbours as parent, parents are
    followed a few steps, and the graph shrinks to the parents. Nodes are compared by a one-to-one
    hash of their number, so long chains of rising numbers shrink as fast as others. Links, parents
    and roots stay distributed; only their number is asked for.
    """
    links = links.where("a is not null and b is not null")
    edges = store(links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).where("a <> b").distinct(), "links")
    names = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = store(names.select("node", F.xxhash64("node").alias("root")), "roots")
    split = roots.count() > split_from
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        parents = store(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "parents")
        for _ in range(2):
            up = parents.select(F.col("a").alias("of"), F.col("p").alias("pp"))
            parents = store(_looked_up(parents, "p", up, "of", "inner", split).select("a", F.col("pp").alias("p")), "parents")
        of = lambda c: parents.select(F.col("a").alias("of"), F.col("p").alias(f"{c}_up"))
        roots = store(_looked_up(roots, "root", of("root"), "of", "left", split).select("node", F.coalesce("root_up", "root").alias("root")), "roots")
        half = _looked_up(edges, "a", of("a"), "of", "inner", split)
        half = store(half, "half") if split else half
        edges = _looked_up(half, "b", of("b"), "of", "inner", split)
        edges = store(edges.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).where("a <> b").distinct(), "links")
    return roots
