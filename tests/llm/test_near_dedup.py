"""Near-duplicates and components against brute force."""

import random

import pytest
from frames import DATA
from pyspark.sql import functions as F

from tabulens.llm import near_dedup
from tabulens.llm.components import components
from tabulens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id: (n, component) by comparing all pairs; ids must differ."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in ids}


def check(df, rows):
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == want
    return got


def edited(words, rate, rng):
    return " ".join(f"new{rng.random()}" if rng.random() < rate else w for w in words)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = brute(rows)
    got = QUERIES["op9_near_dedup"](spark, DATA).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_of_noisy_copies(spark):
    """Copies whose similarity to each other lies around the threshold, and texts that share a passage only."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(base, rng.choice([0.005, 0.02, 0.03, 0.05]), rng)) for i in range(300)]
    passage = " ".join(base[:60])
    rows += [(1000 + i, passage + " " + " ".join(f"x{i}_{k}" for k in range(rng.randint(5, 60)))) for i in range(100)]
    got = check(spark.createDataFrame(rows, SCHEMA), rows)
    assert len({c for _, c in got.values()}) > 10


def test_chains_and_long_texts(spark):
    words = [f"v{i}" for i in range(3000)]
    chain = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(40)]
    long = [(100, " ".join(words)), (101, " ".join([*words[:1500], "other", *words[1500:]])), (102, "q " * 60_000)]
    check(spark.createDataFrame(chain + long, SCHEMA), chain + long)


def test_edges(spark):
    rows = [(1, "A b c"), (2, "a  B\tc"), (3, None), (4, ""), (5, " \n"), (6, "a b"), (7, "one two three four five"), (8, "ONE two three four five")]
    df = spark.createDataFrame([*rows, (None, "one two three four five"), (2, "a  B\tc"), (None, None)], SCHEMA).withColumns({c: F.lit(9) for c in ("cls", "n", "sketch", "set_hash", "leader")})
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    want = [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 7, False), (0, 1, 7, False), (0, 0, None, True)]
    assert got == sorted(want, key=str)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "x y z"), (1, "x y z")], SCHEMA)
    assert near_dedup.keep_one(twice).count() == 1


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 50)] + [(100, 101)]])
def test_components(spark, links):
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {x: x for ab in links for x in ab}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[top(a)] = top(b)
    assert set(got) == set(up)
    assert all((got[x] == got[y]) == (top(x) == top(y)) for x in list(up)[:60] for y in up)


def _made(spark, rows):
    """How many comparisons each step makes."""
    from tabulens.llm.common import store

    docs = store(spark.createDataFrame(rows, SCHEMA).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text"), "rows")
    sketches = store(docs.mapInArrow(near_dedup._sketches, "row long, doc_id long, n long, set_hash binary, sketch array<long>"), "sketches")
    return near_dedup._links(docs, near_dedup._classes(sketches))[2]


def _template(n, lengths, seed=3):
    rng = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(104))
    return [(i, passage + " " + " ".join(f"own{i}_{k}" for k in range(rng.choice(lengths) if i else min(lengths)))) for i in range(n)]


@pytest.mark.parametrize("stubs", ["one", "some", "mixed"])
def test_pages_of_one_template_cost_the_same_each(spark, stubs):
    """Pages that share a passage, with a short one, several short ones or all lengths among them: no square of comparisons."""
    small, large = 150, 600
    of = {"one": lambda n: [(i, t) for i, t in _template(n, [30]) if i] + _template(1, [10]), "some": lambda n: _template(n, [10, 30, 30, 30]), "mixed": lambda n: _template(n, range(5, 61))}[stubs]
    rows = of(small)
    check(spark.createDataFrame(rows, SCHEMA), rows)
    few, many = _made(spark, of(small)), _made(spark, of(large))
    assert few["blocks"] <= small and many["blocks"] <= large
    assert sum(many.values()) / large < 1.5 * sum(few.values()) / small + 1
