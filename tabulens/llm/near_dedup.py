"""Near-duplicates by bottom-k sketches of word shingles.

A document's set is its distinct shingles of five words; its sketch is the SKETCH smallest
hashes of that set under one hash function. Documents with equal sets form a class, and one
representative of each class goes on:

1. Inverted lists: each retained value lists the classes that hold it. Two sketches of similar
   sets share at least SHARED values, so it is enough to look at the ``size - shared + 1`` values
   of a sketch that are in the fewest lists: of any such pair, those two choices meet. Values that
   a third of all documents hold therefore count only for documents made of little else.
2. Each list is led by its most typical class (whose values are the most frequent), and lists with
   one leader become one group. Each member is compared with its leader: the sketch of the union
   estimates the similarity, and what may be similar is verified on the full sets.
3. Where members did not join their leader, the members of these groups are listed once more, by
   their full sets. A set of n with another at most as large shares the rarest n - ceil(6n/7) + 1
   of its shingles or one of them, and with a larger one the rarest n - ceil(3n/4) + 1 (for
   similarity 3/4), so a passage that many otherwise different documents share lists none of them.
   These lists are led and verified in the same way, at a cost linear in their members.
4. What even then hangs together with its leader by no chain of links may still be like another member. Two sets that first
   meet at a value with r values from there on in either can only be similar if 7 min(r) >= 3 (n + n'). So each
   member has a reach, 7r - 3n, of which a third bounds its partner's size. Members whose reach meets no size in their group, or whose
   size no reach, go; the few left are compared in blocks, those pairs that fit, on full sets. Pages that share one passage, of equal
   or of any lengths, so cost nothing here: their first meeting shows how much they can have in common.

So no list or group is ever expanded into all its pairs, and no pair of different texts with the
required similarity that meets in a list is left out.

Defined results: words are lower-cased in A-Z; a text with fewer than five words has its whole
word sequence as its one shingle; a null, empty or blank text has no set and is linked with
nothing; component_id is the smallest doc_id of the component (null ids come last); repeated rows
fall into one class; an empty table gives no rows. Rows are told apart by a stored row number, so
ids may repeat. Only ``doc_id`` and ``text`` are read by ``near_duplicates``; ``keep_one`` passes all
other columns through under any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm import words
from tabulens.llm.common import BROADCAST_ROWS, join_groups, packed, store, unpacked
from tabulens.llm.components import components

#: Values in a sketch, and those that the sketches of two sets with similarity 0.75 share at the
#: least: 72 of 96 are expected, and fewer than 52 come in less than one of a million such pairs.
SKETCH, SHARED = 96, 52
#: A set of up to FULL shingles can only be similar to one that fits a sketch whole: no chance there.
FULL = SKETCH * 75 // 100
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Rows of a group that one task compares with each other: unlinked members, and all members.
BLOCK_LEFT, BLOCK_ALL = 64, 192


def _sketches(batches):
    for batch in batches:
        rows, ids, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for a, b in words.chunks(texts):
            sets = list(words.shingle_sets(texts[a:b]))
            yield pa.record_batch(
                [
                    rows[a:b],
                    ids[a:b],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64())),
                ],
                names=["row", "doc_id", "n", "set_hash", "sketch"],
            )


def _full_sets(batches):
    for batch in batches:
        cls, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for a, b in words.chunks(texts):
            for c, s in zip(cls[a:b], words.shingle_sets(texts[a:b]), strict=True):
                n = len(s)
                yield pa.record_batch([pa.array(np.full(n, c)), pa.array(np.full(n, n)), pa.array(s)], names=["cls", "n", "v"])


def _linked(batches):
    """The pairs (a, b, text_a, text_b) whose full sets are similar enough."""
    for batch in batches:
        a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
        found = []
        for i, j in words.chunks([x + y for x, y in zip(left, right, strict=True)]):
            for k, x, y in zip(range(i, j), words.shingle_sets(left[i:j]), words.shingle_sets(right[i:j]), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    found.append(k)
        yield pa.record_batch([pa.array([a[k] for k in found], pa.int64()), pa.array([b[k] for k in found], pa.int64())], names=["a", "b"])


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between unlinked members and members of one block pair whose sizes and reaches fit, as few as connect them."""
    a, b, joined = left["cls"].to_pylist(), right["cls"].to_pylist(), right["joined"].to_pylist()
    links = []
    if a and b:
        n_a, n_b, reach_a, reach_b = (t[c].to_numpy() for c in ("n", "reach") for t in (left, right))
        fits = (3 * n_b[None] <= reach_a[:, None]) & (3 * n_a[:, None] <= reach_b[None])
        used = np.flatnonzero(fits.any(axis=0))
        if len(used):
            sets = list(words.shingle_sets([right["text"][i].as_py() for i in used.tolist()]))
            sizes = np.array([len(s) for s in sets])
            values, codes = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mark = np.zeros(len(values), dtype=np.int32)
            some = np.flatnonzero(fits.any(axis=1)).tolist()
            for i, own in zip(some, words.shingle_sets([left["text"][i].as_py() for i in some]), strict=True):
                at = np.searchsorted(values, own)
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == own)]
                mark[at] = 1
                both = np.add.reduceat(mark[codes], starts)
                mark[at] = 0
                with_leader = False
                for k in used[fits[i, used] & (100 * both >= PERCENT * (sizes + len(own) - both))].tolist():
                    if b[k] != a[i] and not (joined[k] and with_leader):
                        with_leader |= joined[k]
                        links.append((a[i], b[k]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _classes(sketches: DataFrame) -> DataFrame:
    """One row per distinct set: cls, set_hash, doc_id and row of its first document, n, sketch, copies."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "n", "sketch"))
    groups = sketches.where("n > 0").groupBy("set_hash").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"))
    return store(groups.select(F.monotonically_increasing_id().alias("cls"), "set_hash", "f.doc_id", "f.row", "f.n", "f.sketch", "copies"), "classes")


def _met(values: DataFrame, held_in: Column, name: str) -> DataFrame:
    """v, cls, n, k, place, typical for ``values`` (cls, n, k, v; k values a class) that several classes
    hold: the place of the value among its class's, rarest first, and how often the class's are held."""
    lists = store(values.groupBy("v").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), f"{name}-lists")
    own = Window.partitionBy("cls")
    alone = F.col("k") - F.count(F.lit(1)).over(own)
    place = F.row_number().over(own.orderBy("held", "v")) + alone
    typical = (F.sum("held").over(own) + alone) / F.col("k")
    met = join_groups(values, lists, "v", "held").select("v", "cls", "n", "k", place.alias("place"), typical.alias("typical"))
    return store(met.where(F.col("place") <= held_in), f"{name}-met")


def _led(met: DataFrame, may_lead: Column, name: str) -> DataFrame:
    """leader, cls, reach: the members of each group of lists with one leader, the leader left out. The reach is the largest over
    these lists; it bounds the sizes of those that first meet the member here."""
    lead = F.max(F.when(may_lead, F.struct("typical", "cls")))
    led = met.groupBy("v").agg(lead.alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1 and lead is not null")
    led = store(led.select("v", F.col("lead.cls").alias("leader"), "size"), f"{name}-led")
    reach = 7 * (F.col("n") - F.col("place") + 1) - 3 * F.col("n")
    members = join_groups(met.select("v", "cls", reach.alias("reach")), led, "v", "size").where("cls <> leader")
    return store(members.groupBy("leader", "cls").agg(F.max("reach").alias("reach")), f"{name}-groups")


def _groups(classes: DataFrame) -> DataFrame:
    """Groups by the values of sketches."""
    values = classes.select("cls", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    shared = F.when(F.col("n") <= FULL, F.ceil(F.col("n") * PERCENT / 100)).otherwise(F.lit(SHARED))
    return _led(_met(values, F.col("k") - shared + 1, "sketch"), F.lit(True), "sketch")


def _full_groups(texts: DataFrame) -> DataFrame:
    """Groups by the rarest shingles of full sets, each led by a class that may be the smaller of a pair."""
    values = store(texts.select("cls", "text").mapInArrow(_full_sets, "cls long, n long, v long"), "values").withColumn("k", F.col("n"))
    as_larger = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    as_smaller = F.col("n") - F.ceil(F.col("n") * (2 * PERCENT) / (100 + PERCENT)) + 1
    return _led(_met(values, as_larger, "full"), F.col("place") <= as_smaller, "full")


def _texts(rows: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """cls, text of every class in a group."""
    needed = groups.select("cls").union(groups.select("leader")).distinct()
    needed = store(classes.join(needed, "cls", "left_semi").select("cls", F.col("row").alias("__row")), "needed")
    few = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    return store(rows.join(few, F.col("row") == F.col("__row")).select("cls", "text"), "texts")


def _leader_links(classes: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    sizes = store(groups.groupBy("leader").agg(F.count(F.lit(1)).alias("size")), "led-sizes")
    fits = 100 * F.least("n_cls", "n_leader") >= PERCENT * F.greatest("n_cls", "n_leader")
    union = F.slice(F.sort_array(F.array_union("s_cls", "s_leader")), 1, SKETCH)
    estimate = F.size(F.array_intersect(F.array_intersect("union", "s_cls"), F.col("s_leader")))
    leaders = store(sizes.join(side("leader"), "leader"), "leaders")
    pairs = join_groups(groups, leaders, "leader", "size").join(side("cls"), "cls").where(fits).withColumn("union", union)
    pairs = store(pairs.where(estimate * SKETCH >= F.size("union") * SHARED).select("leader", "cls"), "pairs")
    of_leaders = store(sizes.join(texts.select(F.col("cls").alias("leader"), F.col("text").alias("text_leader")), "leader"), "leader-texts")
    of_members = pairs.join(texts.select("cls", F.col("text").alias("text_cls")), "cls")
    # Texts of any length: hot leaders' are broadcast only while they are short together.
    both = join_groups(of_members, of_leaders, "leader", "size", weight=F.octet_length("text_leader")).select("leader", "cls", "text_leader", "text_cls")
    return store(both.mapInArrow(_linked, "a long, b long"), "leader_links")


def _rest(classes: DataFrame, groups: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leader, cls, n, reach, joined (whether links hang it together with its leader) for members that may be like another that does
    not hang together with them, and the groups' leader, size, left (members that are not joined)."""
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    found = groups.join(root("cls"), "cls", "left").join(root("leader"), "leader", "left").join(classes.select("cls", "n"), "cls")
    members = store(found.select("leader", "cls", "n", "reach", F.coalesce(F.col("cls_root") == F.col("leader_root"), F.lit(False)).alias("joined")), "members")
    side = lambda f, c, joined, name: f(F.when(F.col("joined") == joined, F.col(c))).alias(name)
    bounds = members.groupBy("leader").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(~F.col("joined")).alias("left"),
        side(F.min, "n", True, "n_joined"), side(F.max, "reach", True, "reach_joined"), side(F.min, "n", False, "n_left"), side(F.max, "reach", False, "reach_left"),
    )
    bounds = store(bounds.where("left > 0"), "bounds")
    meets = lambda side: F.coalesce((3 * F.col(f"n_{side}") <= F.col("reach")) & (3 * F.col("n") <= F.col(f"reach_{side}")), F.lit(False))
    # The leader has met them all; a joined member need only meet those that are not.
    may = join_groups(members, bounds, "leader", "size").where(meets("left") | (~F.col("joined") & meets("joined")))
    may = store(may.select("leader", "cls", "n", "reach", "joined"), "may")
    sizes = may.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("joined")).alias("left"))
    return may, store(sizes.where("left > 0 and size > 1"), "sizes")


def _rest_links(members: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of members that are not joined with others of the group."""
    sized = join_groups(members, sizes, "leader", "size").join(texts, "cls")
    parts = lambda n, rows: F.ceil(F.col(n) / F.lit(rows)).cast("int")
    n_left, n_all = parts("left", BLOCK_LEFT), parts("size", BLOCK_ALL)
    own = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    what = ("cls", "n", "reach", "text")
    left = sized.where("not joined").select(F.col("leader").alias("g"), own(n_left).alias("i"), each(n_all).alias("j"), *[F.col(c).alias(c) for c in what])
    right = sized.select(F.col("leader").alias("rg"), each(n_left).alias("ri"), own(n_all).alias("rj"), *what, "joined")
    blocks = left.groupBy("g", "i", "j").cogroup(right.groupBy("rg", "ri", "rj"))
    return store(blocks.applyInArrow(_block_links, "a long, b long"), "rest_links")


def _links(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """node, root of all classes that have links; the links; how many comparisons each step made."""
    groups = _groups(classes)
    texts = _texts(rows, classes, groups)
    links = _leader_links(classes, groups, texts)
    made = {"led": groups.count(), "led again": 0, "blocks": 0}
    joined = links.select(F.col("a").alias("leader"), F.col("b").alias("cls"))
    apart = store(groups.join(joined, ["leader", "cls"], "left_anti"), "apart")
    if not apart.limit(1).count():
        return components(links), links, made
    # Where all members joined, they hang together; the others are looked at again, whole groups of them.
    open_groups = groups.join(apart.select("leader").distinct(), "leader", "left_semi")
    again = store(texts.join(open_groups.select("cls").union(open_groups.select("leader")).distinct(), "cls", "left_semi"), "again")
    groups = _full_groups(again)
    links = store(links.union(_leader_links(classes, groups, again)), "links")
    roots = components(links)
    members, sizes = _rest(classes, groups, roots)
    n = sizes.agg(F.coalesce(F.sum(F.col("left") * F.col("size")), F.lit(0)).alias("n")).first().n
    made |= {"led again": groups.count(), "blocks": n}
    if n:
        links = store(links.union(_rest_links(members, sizes, again)), "links")
        roots = components(links)
    return roots, links, made


def _assigned(rows: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, component_id, first (the row that stays of its component) for ``rows``: a stored row, doc_id, text."""
    schema = "row long, doc_id long, n long, set_hash binary, sketch array<long>"
    sketches = store(rows.select("row", "doc_id", "text").mapInArrow(_sketches, schema), "sketches")
    classes = _classes(sketches)
    roots, _, _ = _links(rows, classes)
    joined = classes.select("cls", "set_hash", "doc_id", "row", "copies").join(roots, F.col("cls") == F.col("node"), "left").drop("node")
    joined = store(joined, "joined")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    least = joined.where("root is not null").groupBy("root").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("parts"))
    linked = join_groups(joined.where("root is not null"), store(least, "least"), "root", "parts")
    found = linked.select("set_hash", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first"), "copies")
    found = store(found.union(joined.where("root is null").select("set_hash", "doc_id", "row", "copies")), "components")
    narrow = sketches.select("row", "doc_id", "n", "set_hash")
    out = join_groups(narrow.where("n > 0"), found, "set_hash", "copies").select("row", "doc_id", "n", "component_id", "first")
    out = out.union(narrow.where("n = 0").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.col("row").alias("first")))
    return out.withColumnRenamed("n", "n_shingles")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = store(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), "rows")
    return _assigned(rows).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their group (by doc_id, then by stored row), with all columns of
    ``docs``: exactly one row of each component, and every row without words."""
    rows = store(packed(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    own = lambda c, kind: F.col(f"__doc.c{docs.columns.index(c)}").cast(kind).alias(c)
    found = _assigned(rows.select("row", own("doc_id", "long"), own("text", "string")))
    gone = store(found.where("row <> first").select(F.col("row").alias("__row")), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return unpacked(rows.join(gone, F.col("row") == F.col("__row"), "left_anti"), docs.columns)
