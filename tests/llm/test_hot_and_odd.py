"""Hot keys without a broadcast, column names that clash, repeated rows and retries."""

import random

import pytest
from frames import DATA
from pyspark.sql import functions as F
from test_near_dedup import brute

import corpus_pipeline
from tabulens.llm import common, exact_dedup, line_dedup, mixing, near_dedup, quality
from tabulens.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD_NAMES = ("a.b", "__id", "__copies", "__copy", "__lines", "__doc", "__key", "__hot", "__row", "row", "first", "host", "split", "kept", "key", "rows", "documents", "text_2", "b`c")


def plain(df):
    return sorted((tuple(map(str, r)) for r in df.collect()), key=str)


@pytest.fixture
def no_broadcast(monkeypatch):
    """Every join of bounded_join() goes the way of groups that are too many."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)


def test_bounded_join_beyond_the_broadcast(spark, no_broadcast):
    key = F.when(F.col("id") < 3000, "hot").when(F.col("id") % 11 != 0, (F.col("id") % 2000).cast("string"))
    rows = common.store(spark.range(9000).select(common.keyed(key).alias("k"), key.alias("plain"), "id"), "rows")
    groups = common.store(rows.where("plain is null or plain <> '5'").groupBy("k").agg(F.count(F.lit(1)).alias("n")), "groups")
    got = common.bounded_join(rows, groups, "k", "n")
    assert got.count() == 9000 and got.where("plain = 'hot'").select("n").distinct().collect() == [(3000,)]
    assert got.where("plain = '5'").where("n is not null").count() == 0 and got.where("plain is null").select("n").distinct().count() == 1


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_hot_groups_are_salted(spark, monkeypatch, how):
    """A group with a third of all rows and values too long to broadcast: rows are dealt out, none lost or doubled."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 2000)
    rows = common.store(spark.range(9000).select(key.alias("k"), "id").union(spark.range(50).select(F.lit(-1), F.lit(7))), "rows")
    groups = common.store(rows.where("k <> 4").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("long", F.repeat("k", 20)), "groups")
    want = plain(common.join_groups(rows, groups, "k", "n", how, weight=F.length("long")))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    got = common.join_groups(rows, groups, "k", "n", how, weight=F.length("long"))
    assert plain(got) == want and len(want) == rows.count() - (rows.where("k = 4").count() if how == "inner" else 0)
    assert groups.where(common.hot_parts(groups, "n") > 1).count() < common.HOT


def test_operators_beyond_the_broadcast(spark, no_broadcast, monkeypatch):
    rng = random.Random(2)
    rows = [(i, f"w{i} some words of {i} and {rng.random()}\nfooter of all\nend {i % 7}", "en", "hot" if i % 3 else f"s{i % 40}", 0) for i in range(600)]
    rows += [(1000 + i, None, None, None, None) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    runs = lambda: [plain(f(df)) for f in (mixing.mixture, line_dedup.lines_report, quality.judge)]
    split = runs()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1 << 25)
    assert split == runs()


@pytest.mark.parametrize("links", [[(0, i) for i in range(1, 300)], [(i, i + 1) for i in range(40)] + [(100, 101), (None, 3)]])
def test_components_with_split_hubs(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    assert plain(components(df, split_from=0).groupBy("root").agg(F.sort_array(F.collect_set("node")).alias("n")).select("n")) == plain(components(df).groupBy("root").agg(F.sort_array(F.collect_set("node")).alias("n")).select("n"))


def _made(spark, monkeypatch, rows):
    """Result and comparisons of near_duplicates over (id, text) rows."""
    seen, links = {}, near_dedup._links

    def spy(*a):
        out = links(*a)
        seen.update(out[2])
        return out

    monkeypatch.setattr(near_dedup, "_links", spy)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(near_dedup, "_links", links)
    return got, seen


def test_a_shared_passage_costs_linear_work(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(70))
    for n in (150, 600):
        rows = [(i, passage + " " + " ".join(f"x{i}_{k}" for k in range(50))) for i in range(n)]
        got, made = _made(spark, monkeypatch, rows)
        assert {c for _, c in got.values()} == set(range(n))
        assert made["led"] + made["led again"] <= 2 * n and made["blocks"] == 0


def test_passages_just_below_the_threshold(spark, monkeypatch):
    """Documents mostly made of one passage: some linked, some not, none lost."""
    passage = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join(passage + [f"x{i}_{k}" for k in range(n)])) for i, n in enumerate([0, 2, 6, 9, 11, 13, 14, 16, 18, 20, 22, 25, 30] * 6)]
    got, _ = _made(spark, monkeypatch, rows)
    assert got == brute(rows)


def test_leaders_with_texts_beyond_the_broadcast(spark, no_broadcast):
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(base[: 70 + i % 11])) for i in range(60)] + [(100 + i, " ".join(f"o{i}_{k}" for k in range(20))) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_keep_one_with_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "q w e r t y"), (None, "q w e r t y"), (3, None), (3, None)]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == [(1, "a b c d e f"), (2, "q w e r t y"), (3, None), (3, None)]


STAGES = {name: stage for name, stage in corpus_pipeline.STAGES}


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_take_any_column_names(spark, name):
    rows = [(i, f"some words of document {i} which are its own {i * 7} {i * 11}\nfooter", "en", "s", 9) for i in range(12)]
    rows += [(3, rows[3][1], "en", "s", 9), (None, None, None, None, None), (20, "", "en", None, 0), (21, "x " * 20_000, None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = docs.withColumns({c: F.lit(f"in {c}") for c in ODD_NAMES})
    before, after = STAGES[name](spark, docs, DATA), STAGES[name](spark, odd, DATA)
    assert after.columns == odd.columns and after.dtypes == odd.dtypes
    assert plain(after.select(SCHEMA.replace(" long", "").replace(" string", "").split(", "))) == plain(before)
    assert all(r[c] == f"in {c}" for r in after.collect() for c in ODD_NAMES)
    assert STAGES[name](spark, docs.limit(0), DATA).count() == 0


def test_last_stage_takes_what_the_others_do(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "a b", "en", "s", 3)], SCHEMA).withColumns({c: F.lit(1) for c in ODD_NAMES})
    assert STAGES["packing"](spark, docs, DATA).count() == 3 and STAGES["packing"](spark, docs.limit(0), DATA).count() == 0


def test_cleanup_empties_the_shared_folder(spark):
    stored = common.store(spark.range(3), "to-clean")
    path = stored.inputFiles()[0]
    common.cleanup(spark)
    import os

    assert not os.path.exists(path.removeprefix("file:").replace("///", "/"))


def test_a_batch_given_again_has_the_same_answer(spark):
    path = common.scratch_path(spark, "it's an index")
    before = {t.name for t in spark.catalog.listTables()}
    rows = [(5, "x y", "en", "s", 3), (6, "z", "en", "s", 1), (7, "z", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    with exact_dedup.DigestIndex(spark, path, 3) as index:
        first = plain(exact_dedup.exact_duplicates(docs, index, "monday"))
        assert plain(exact_dedup.exact_duplicates(docs, index, "monday")) == first
        assert index.rows().count() == 2
        later = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in exact_dedup.exact_duplicates(docs, index, "tuesday").collect()}
        assert later == {5: (5, False, 1), 6: (6, False, 2), 7: (6, False, 2)}
    with pytest.raises(ValueError, match="3 buckets"):
        exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.exact_duplicates(docs).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_targets_of_many_sources(spark):
    from test_exact_and_mixing import brute_targets

    rng = random.Random(4)
    sizes = {f"s{i:03}": rng.choice([1, 5, 40, 900]) for i in range(120)} | {None: 7, "zero": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(7)
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def prose(i, junk=""):
    return " ".join(f"word{(i * 7 + k * k) % 997}x{junk}" for k in range(60))


def test_fences_of_small_and_of_junk_groups(spark):
    rows = [(i, prose(i), "en", f"s{i % 3}", 0) for i in range(240)]
    rows += [(1000, prose(1, "%%%"), "en", "tiny", 0), (1001, prose(2), "en", "tiny", 0)]
    rows += [(2000 + i, prose(i, "%%%"), "en", "spam", 0) for i in range(60)] + [(3000 + i, prose(i), "en", "spam", 0) for i in range(20)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, kept in got.items() if not kept} == {1000, *range(2000, 2060)}


def test_quality_reruns_agree(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.substring(F.sha2((F.col("id") * 100 + k).cast("string"), 256), 1, (F.pmod(F.xxhash64("id", k), F.lit(9)) + 1).cast("int")))).alias("text"), F.lit("en").alias("lang"), F.lit("one").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    assert plain(quality.judge(df.repartition(7))) == plain(quality.judge(df.coalesce(1)))
