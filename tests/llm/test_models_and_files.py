"""Packing, language model, toxicity and WARC: brute force, round trips, held-out accuracy, edge cases."""

import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from frames import DATA
from pyspark.sql import functions as F

from tabulens.llm import lm, packing, toxicity, warc
from tabulens.llm.common import scratch_path
from tabulens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
ODD = ["<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>.", "É H̱ ẖ. Éa. É.", "don't DON'T. it's, x1.2, 3.14. a.b.", "x　y\x85z İstanbul, ΣΑΣ. \x1c a\x0bb", "﻿abc. ​d, é. ª. 한글.", "", " \n", None]
EXTRA = ("row", "ids", "task", "start", "block", "fold", "owner", "score", "toxic", "n", "bytes", "digest")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [*enumerate(ODD), (None, "no id"), (3, ODD[3]), (50, "w " * 40_000), (51, "x" * 50_000)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in EXTRA})


def check_pieces(pieces, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    by_doc = {}
    for i, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        by_doc[i] = ids
        want[i] += len(ids)
    got = Counter()
    sequences = {}
    for p in pieces:
        ids = by_doc[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        got[p.doc_id] += p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return sum(want.values()) / (packing.CAPACITY * len(sequences))


def test_packing_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    pieces = QUERIES["op2_packing"](spark, DATA).collect()
    assert check_pieces(pieces, docs) > 0.95
    starts = sorted((p.doc_id, p.start, p.length) for p in pieces)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(starts, starts[1:], strict=False))


def test_packing_edges(spark, edge):
    check_pieces(packing.pack(edge).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert packing.pack(edge.limit(0)).count() == 0
    one = packing.pack(edge.where("doc_id = 6"), with_ids=True).first()
    assert np.frombuffer(one.ids, "<u4").tolist() == [2]


def test_cuts_are_whole():
    for n in range(1, 20_000, 7):
        assert sum(packing.cut(n)) == n and all(0 < x <= packing.CAPACITY for x in packing.cut(n))


def brute_lm(rows):
    tokens = {i: (t or "").encode().lower().split() + [0] for i, t in rows}
    fold = {i: zlib.crc32((str(i) if i is not None else "").encode()) % 10 for i in tokens}
    count = Counter(w for i, ws in tokens.items() if fold[i] for w in ws)
    n, v = sum(count.values()), len(count)
    base = {i: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for i, ws in tokens.items()}
    return {i: (fold[i] == 0, len(ws), sum(count[w] > 0 for w in ws), n) for i, ws in tokens.items()}, base


def test_lm_whole_table(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 60_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = QUERIES["op3_lm_scoring"](spark, DATA).collect()
    want, base = brute_lm(rows)
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got} == want
    assert all(r.base_score == pytest.approx(base[r.doc_id], rel=1e-9) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # The score of one document from its definition, with the same weights.
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lm_scores_follow_the_definition(spark, monkeypatch):
    seen = {}
    fit = lm.fit_weights
    monkeypatch.setattr(lm, "fit_weights", lambda *a: seen.setdefault("w", fit(*a)))
    rows = [(i, f"the cat {i % 5} sat on the mat {i % 3}") for i in range(60)]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    tokens = {i: t.encode().split() for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    uni = Counter(w for i in train for w in [*tokens[i], 0])
    bi = Counter(p for i in train for p in zip([None, *tokens[i]], [*tokens[i], 0], strict=True))
    n, v = sum(uni.values()), len(uni)
    uni[None] = uni[0]
    for i, ws in tokens.items():
        total = 0.0
        for h, w in zip([None, *ws], [*ws, 0], strict=True):
            a, b, c = seen["w"][min(math.frexp(uni[h])[1], lm.CONTEXTS - 1)]
            total += math.log10(a / (v + 1) + b * uni[w] / n + (c * bi[h, w] / uni[h] if uni[h] else 0))
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_weights_sum_to_one_and_learn():
    cell = lambda context, p1, p2: (context * lm.SPAN + int(lm._bin(np.array([p1]))[0])) * lm.SPAN + int(lm._bin(np.array([p2]))[0])
    w = lm.fit_weights(np.array([cell(5, 0.01, 0.5), cell(3, 0.01, 0.0)]), np.array([1000, 1000]), 10_000)
    assert np.allclose(w.sum(axis=1), 1) and w[5, 2] > 0.9 and w[3, 1] > 0.9


def test_packed_counts_round_trip():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    assert (lm._unpacked(lm._packed(keys)) == keys).all()
    counts = np.arange(500) * 99_991
    assert (lm._from_planes(lm._planes(counts)) == counts).all()


def test_lm_edges(spark, edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = lm.score_documents(edge).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (5, 6, 7)} == {5: 1, 6: 1, 7: 1}
    assert lm.score_documents(edge.limit(0)).count() == 0


def test_toxicity_learns_words_and_pairs(spark):
    """Held-out accuracy on labels that need a single word, or two words together."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{k}" for k in rng.integers(0, 200, 30)]
        kind = i % 4
        words += {0: ["vile"], 1: ["group", "bad"], 2: ["group"], 3: ["bad"]}[kind]
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(kind in (0, 1))))
    got = toxicity.score_toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_toxicity_on_the_table(spark):
    got = QUERIES["op5_toxicity"](spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_edges(spark, edge):
    some = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (3, 0, 1), (50, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0), some.where("toxic = 1")):
        got = toxicity.score_toxicity(edge, labels).collect()
        assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(edge.limit(0), some).count() == 0


def test_warc_edges_and_small_ranges(spark):
    big = "<p>é" * 400
    pages = [(1, "http://a/x y\r\nz", big), (2, "http://a", big), (3, None, None), (4, "http://b", ""), (5, "http://b", "short"), (6, "http://b", "short"), (2, "http://a", big), (None, "http://n", big), (None, None, "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in EXTRA})
    folder = scratch_path(spark, "test-warc")
    manifest = warc.write_archives(df.repartition(2), folder, file_bytes=2000)
    assert manifest.count() >= 2
    got = warc.read_archives(manifest, range_bytes=50).collect()
    assert len(got) == len(pages)
    assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((p, len((h or "").encode())) for p, _, h in pages)
    copies = [r for r in got if r.payload_bytes == len(big.encode())]
    assert Counter(r.record_type for r in copies) == {"response": 1, "revisit": 3}
    assert {r.refers_to for r in copies if r.record_type == "revisit"} == {2}
    assert next(r for r in copies if r.record_type == "response").payload.decode() == big
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 1000)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_false_magic_is_passed_over():
    good = lambda text: zlib.compressobj(6, zlib.DEFLATED, 31).compress(b"") + _gzip(text)
    data = b"junk" + warc.MAGIC + b"not gzip at all" + good(b"WARC/1.1 first") + _gzip(b"other text") + good(b"WARC/1.1 second")
    source = pa.PythonFile(io.BytesIO(data), mode="r")
    read = lambda a, b: list(warc.members(source, len(data), a, b))
    assert read(0, len(data)) == [b"WARC/1.1 first", b"WARC/1.1 second"]
    parts = [m for a in range(0, len(data), 7) for m in read(a, min(a + 7, len(data)))]
    assert parts == [b"WARC/1.1 first", b"WARC/1.1 second"]


def _gzip(text):
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(text) + deflate.flush()


def test_exchange_of_the_language_model_grows_with_its_blocks(spark, monkeypatch):
    """Groups of blocks pass their lists on: the same scores, and rows in proportion to blocks."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.05)), 90)}" for _ in range(40))) for i in range(480)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id: tuple(r) for r in lm.score_documents(docs, 3).collect()}
    passed, own = [], lm._answers
    monkeypatch.setattr(lm, "_answers", lambda content, blocks, *rest: passed.append((blocks, own(content, blocks, *rest))) or passed[-1][1])
    for parts in (2, 8):
        got = {r.doc_id: tuple(r) for r in lm.score_documents(docs.repartition(parts), 3, fan=4).collect()}
        assert got.keys() == want.keys() and all(a == pytest.approx(b, rel=1e-9) for k in want for a, b in zip(got[k], want[k], strict=True))
    (few, small), (many, large) = ((blocks, answers.where("block >= 0").count()) for blocks, answers in passed)
    assert (few, many) == (4, 16) and large / many <= 1.2 * small / few


def test_packing_refuses_other_tokenizers(spark):
    import public_tokenizers

    packing.check_tokenizer(packing.default_tokenizer())
    docs = spark.createDataFrame([(1, "Some text")], SCHEMA)
    with pytest.raises(ValueError, match="words one by one"):
        packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
