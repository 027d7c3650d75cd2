"""Exact dedup, mixing, quality, line dedup and licence scans: brute force, SQL and edge cases."""

import hashlib
import re
from collections import Counter

import pytest
from frames import DATA, rows
from pyspark.sql import functions as F

from tabulens.llm import exact_dedup, license_scan, line_dedup, mixing, quality
from tabulens.llm.common import join_groups, scratch_path, store
from tabulens.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, "a b\tc", "en", "s1", 5), (2, "a  b c", "en", "s1", 6), (3, None, "en", "s1", None), (4, "", "en", None, 0), (5, " \n\t", None, "s2", 3),
    (None, "a b c", "en", "s1", 5), (2, "a  b c", "en", "s1", 6), (7, "w " * 30_000, "en", "s2", 60_000), (8, "été é", "fr", "s2", 5),
]


def docs_of(spark, data=EDGE):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    """Edge rows with extra columns whose names operators use themselves."""
    extra = {c: F.lit(1) for c in ("size", "digest", "row", "kept", "n", "words", "host", "line", "target", "copies", "cls", "block", "fold")}
    return docs_of(spark).withColumns(extra)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, oracle, name):
    found, wanted = QUERIES[name](spark, DATA).toPandas(), oracle(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_duplicates_edges(spark, edge):
    got = exact_dedup.exact_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    size = Counter(normal(r[1]) for r in EDGE)
    kept = Counter()
    for r in got:
        own = next(normal(x[1]) for x in EDGE if hashlib.sha256(normal(x[1]).encode()).hexdigest() == r.text_sha256)
        assert r.group_size == size[own]
        assert r.keep_id == min(x[0] for x in EDGE if normal(x[1]) == own and x[0] is not None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_duplicates(docs_of(spark, [])).count() == 0


def test_index_persists_across_batches(spark):
    path = scratch_path(spark, "test-index")
    first = docs_of(spark, [(5, "x y", "en", "s", 3), (6, "z", "en", "s", 1)])
    again = docs_of(spark, [(1, "x  y", "en", "s", 3), (9, "new", "en", "s", 3), (10, "new", "en", "s", 3)])
    with exact_dedup.DigestIndex(spark, path, 4) as index:
        assert all(r.kept for r in exact_dedup.exact_duplicates(first, index).collect())
    # Another table over the same files: what a later session would open.
    with exact_dedup.DigestIndex(spark, path, 4) as index:
        got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(again, index).collect()}
        assert got == {1: (5, False), 9: (9, True), 10: (9, False)}
        assert index.rows().count() == 3


def _index_tables(spark):
    return {t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")}


def test_a_forgotten_index_leaves_the_catalog(spark):
    before = _index_tables(spark)
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "forgotten"), 2)
    assert len(_index_tables(spark) - before) == 1
    del index
    assert _index_tables(spark) == before


def test_the_result_comes_through_the_index(spark):
    """Batches by ranges of ids, each joined with the index, whose side of the joins is not exchanged."""
    path = scratch_path(spark, "through-index")
    docs = docs_of(spark, [(i, f"text {i % 7}", "en", "s", 1) for i in range(20)] + [(None, "text 3", "en", "s", 1), (None, "only null", "en", "s", 1)])
    asked = []
    with exact_dedup.DigestIndex(spark, path, 4) as index:
        own, index.append = index.append, lambda groups, batch: asked.append(groups.count()) or own(groups, batch)
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, index, "one").collect()}
        size = Counter(i % 7 for i in range(20)) + Counter([3])
        assert got == {(i, i % 7, size[i % 7], i < 7) for i in range(20)} | {(None, 3, size[3], False), (None, None, 1, True)}
        assert len(asked) == exact_dedup.BATCHES and min(asked) > 1
        assert index.rows().count() == 8 and {r.batch for r in index.rows().collect()} == {"one"}
        groups = store(index.rows().select("digest", "n"), "groups")
        for joined in (index.missing(groups), index.found(groups)):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1 and "Bucketed: true" in plan


def test_join_groups_with_a_hot_key(spark):
    many = store(spark.range(9000).select((F.when(F.col("id") < 3000, 0).otherwise(F.col("id"))).alias("k"), "id"), "rows")
    groups = store(many.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "groups")
    got = join_groups(many, groups, "k", "n")
    assert got.count() == 9000 and got.where("k = 0").select("n").distinct().collect() == [(3000,)]


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: cap * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixture_edges(spark, edge):
    got = mixing.mixture(edge).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in EDGE:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    assert len(got) == len(EDGE)
    assert {r.doc_id: r.size for r in got} == {r[0]: size(r[1]) for r in EDGE}
    assert sorted((r.source_size, round(r.target, 6)) for r in got) == sorted((sizes[r[3]], round(want[r[3]], 6)) for r in EDGE)
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in got)
    assert sorted(got, key=str) == sorted(mixing.mixture(edge.repartition(3)).collect(), key=str)
    assert mixing.mixture(docs_of(spark, [])).count() == 0


def test_mix_comes_near_its_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.floor(F.sqrt(F.col("id") / 100)).cast("string")).alias("source"), F.lit(7).cast("long").alias("n_chars"))
    got = mixing.mixture(df).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) < 0.12 * r.target + 200 for r in got)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() * 4 == sum(r.t for r in got)


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_edges(spark, edge):
    more = docs_of(spark, [(20, "a b c d e x a b c d e y", "en", "s1", 0), (21, "#1 *2* \n|x|\n|x|\n \n \n<y> é&", "en", "s1", 0), (22, "w w w w w w", "en", "s1", 0)]).withColumns({c: F.lit(1) for c in edge.columns if c not in docs_of(spark, []).columns})
    df = edge.union(more.select(edge.columns))
    want = Counter((r.doc_id, *brute_quality(r.text)) for r in df.collect())
    got = quality.judge(df).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge(docs_of(spark, [])).count() == 0


def test_quality_rejects_symbols_and_keeps_prose(spark):
    prose = [(i, " ".join(f"word{(i * 7 + k * k) % 97}x" for k in range(60)), "en", "s", 0) for i in range(60)]
    junk = [(100 + i, " ".join(f"w{k + i}%%%" for k in range(60)), "en", "s", 0) for i in range(4)]
    got = {r.doc_id: r.kept for r in quality.judge(docs_of(spark, prose + junk)).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(4))


def test_line_dedup_takes_boilerplate_only(spark):
    pages = [(i, f"own line {i} with its words {i}\n  share this page \nanother own line {i * 3}\n\nend {i}", "en", "host", 0) for i in range(30)]
    copies = [(100 + i, "the same page\nas many others\nword for word", "en", "host", 0) for i in range(10)]
    other = [(200, "share this page\nx", "en", "small", 0), (201, None, "en", "host", None), (202, "share this page", "en", None, 0)]
    df = docs_of(spark, pages + copies + other)
    got = {r.doc_id: r for r in line_dedup.lines_report(df).collect()}
    assert all(got[i].dropped_lines == 1 and got[i].text == f"own line {i} with its words {i}\nanother own line {i * 3}\n\nend {i}" for i in range(30))
    assert all(got[100 + i].dropped_lines == 0 and got[100 + i].spared for i in range(10))
    assert got[200].text == "share this page\nx" and got[201].text is None and got[202].dropped_lines == 0
    cleaned = line_dedup.drop_boilerplate(df)
    assert cleaned.columns == df.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {i: r.text for i, r in got.items()}
    assert cleaned.where("doc_id = 3").first().n_chars == len(got[3].text)


def test_line_dedup_takes_most_of_a_short_page(spark):
    footer = "all of these words are on each page of the host"
    pages = [(i, f"own {i}\n{footer}", "en", "host", 0) for i in range(30)]
    # Copies do not count: a line on one page of many copies stays, the footer on it goes.
    copies = [(100 + i, f"the same page\n{footer}", "en", "host", 0) for i in range(200)]
    got = {r.doc_id: r for r in line_dedup.lines_report(docs_of(spark, pages + copies)).collect()}
    assert all(got[i].text == f"own {i}" and got[i].dropped_lines == 1 and not got[i].spared for i in range(30))
    assert all(got[100 + i].text == "the same page" and got[100 + i].spared for i in range(200))


@pytest.mark.parametrize("n", [5, 19, 20, 49])
def test_line_dedup_at_any_host_size(spark, n):
    pages = [(i, f"own {i}\nfooter of the host", "en", "host", 0) for i in range(n)]
    got = line_dedup.lines_report(docs_of(spark, pages)).collect()
    assert sorted(r.text for r in got) == sorted(f"own {i}" for i in range(n))


def test_line_dedup_edges(spark, edge):
    assert line_dedup.lines_report(edge).count() == len(EDGE)
    assert line_dedup.drop_boilerplate(edge).columns == edge.columns
    assert line_dedup.lines_report(docs_of(spark, [])).count() == 0


def test_licence_scan(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    files = [
        ("LICENSE", "top/LICENSE", mit), ("a", "top/src/a.py", "def f():\n    return 1"), ("b", "top/src/deep/b.py", "# Licensed under the Apache License, Version 2.0.\nx = 1"),
        ("c", "other/c.py", "no licence words here"), ("d", "top/vendor/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("e", "top/vendor/x/y/e.py", None),
        ("f", "topmost/f.py", "plain"), ("g", None, "All rights reserved."),
    ]
    df = spark.createDataFrame(files, "name string, path string, body string").withColumn("row", F.lit(0))
    got = {r.doc_id: (r.licence, r.inherited_licence, r.inherited_from) for r in license_scan.scan(df, "name", F.col("path"), "body").collect()}
    assert got == {
        "LICENSE": ("MIT", None, None), "a": (None, "MIT", "top"), "b": ("Apache-2.0", None, None), "c": (None, None, None),
        "d": ("GPL-3.0", None, None), "e": (None, "GPL-3.0", "top/vendor"), "f": (None, None, None), "g": ("Proprietary", None, None),
    }


def test_each_template_finds_its_licence(spark):
    # Clauses make a licence together.
    whole = {k: "\n".join(license_scan.TEMPLATES[k][i] for i in places) for k, places in license_scan.CLAUSES.items()}
    own = [(f"{k} {i}", f"d{k}{i}/f", f"some prose\n{whole[k] if i in license_scan.CLAUSES.get(k, ()) else t}\nmore prose", k) for k, ts in license_scan.TEMPLATES.items() for i, t in enumerate(ts)]
    rest = [(f"p{i}", f"p{i}/f", f"the work of a {i} to be under this and is or not in all of it", None) for i in range(200)]
    df = spark.createDataFrame(own + rest, "name string, path string, body string, wanted string")
    got = {r.doc_id: r.licence for r in license_scan.scan(df, "name", F.col("path"), "body").collect()}
    assert got == {r[0]: r[3] for r in own + rest}


def test_gate_terms_bound_the_cosine():
    weights = [(0, "the", 1.0, 0.6), (0, "a", 1.5, 0.5), (0, "rare", 9.0, 0.6245), (1, "x", 2.0, 1.0)]
    assert license_scan.gate_terms(weights, 0.7) == ["a", "rare", "x"]
    assert license_scan.gate_terms(weights, 0.8) == ["rare", "x"]


def test_licence_scan_edges(spark, edge):
    assert license_scan.scan_documents(edge).count() == len(EDGE)
    assert license_scan.scan_documents(docs_of(spark, [])).count() == 0
