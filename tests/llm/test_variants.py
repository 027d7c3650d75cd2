"""Spelling variants against all pairs by brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabulens.llm import variants
from tabulens.llm.common import store
from tabulens.llm.variants import near_words, spelling_variants


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    out = {}
    for w in n:
        near = sorted((x for x in n if _near(w, x)), key=lambda x: (-n[x], x))
        form = near[0] if near and n[near[0]] >= 5 * n[w] else None
        out[w] = [form, w, n[w], len(near), n[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {(w, *row) for w, row in out.items()}


def _documents(n, seed):
    rng = random.Random(seed)
    parts = ["ton", "nto", "re", "er", "äu", "É", "ch", "s", "tt"]
    bases = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(40)]
    rows = []
    for doc_id in range(n):
        words = []
        for _ in range(60):
            w = bases[min(int(rng.expovariate(0.12)), 39)]
            if rng.random() < 0.25:
                at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
                w = w[:at] + (rng.choice("abéx") if kind < 2 else "") + w[at + (kind > 0) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((doc_id, rng.choice([" ", "-", "9", "日"]).join(words)))
    return rows


def _found(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@pytest.mark.parametrize("subtree, visitors", [(20_000, 400_000), (7, 11)])
def test_all_pairs(spark, monkeypatch, subtree, visitors):
    monkeypatch.setattr(variants, "SUBTREE", subtree)
    monkeypatch.setattr(variants.near_words, "__defaults__", (subtree, visitors))
    rows = _documents(120, 1)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    wanted = _brute(rows)
    assert len(wanted) > 60 and sum(r[1] is not None for r in wanted) > 15
    assert _found(spelling_variants(docs)) == wanted


def test_chains_and_ties(spark):
    # Fifty times as often each: a chain of forms; two forms of equal number: the first in code-point order.
    text = " ".join(["abcdef"] * 5 + ["abcdefg"] * 30 + ["abcdefgh"] * 200 + ["abcdefghi"] * 1500 + ["xbcdef"] * 30 + ["zzzzzz"] * 9)
    rows = [(1, text), (None, None), (None, "Zzzzzz"), (3, "")]
    found = {r.word: r for r in spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert _found(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == _brute(rows)
    assert (found["abcdef"].form, found["abcdef"].root, found["abcdef"].n_near) == ("abcdefg", "abcdefghi", 2)
    assert (found["zzzzzz"].form, found["zzzzzz"].root, found["zzzzzz"].n_near) == (None, "zzzzzz", 0)


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(empty).count() == 0
    one = spark.createDataFrame([(1, "lonely " * 7)], "doc_id long, text string")
    assert [(r.word, r.root, r.n_near) for r in spelling_variants(one).collect()] == [("lonely", "lonely", 0)]


def test_deep_keys(spark):
    """One vector's words are over any subtree: they are dealt out in parts."""
    rng = random.Random(2)
    listed = list({"".join(rng.sample("abcdefgh", 8)) for _ in range(300)})
    found = store(spark.createDataFrame([(w, 5 + i) for i, w in enumerate(listed)], "word string, n long"), "words")
    got = {r.word: (r.n_near, r.form) for r in near_words(found, 20, 50).collect()}
    near = {w: [x for x in listed if _near(w, x)] for w in listed}
    assert got == {w: (len(x), max(x, key=lambda y: listed.index(y))) for w, x in near.items() if x}


def test_verification():
    tree = variants._Subtree(pa.table({"word": ["aaaaaa", "aaaaab"], "n": [5, 9]}), pa.table({"word": ["aaaaaa", "aaaaa", "baaaaaa", "aabbaa"], "surplus": [False, False, True, False], "deficit": [False, True, False, False]}), 0)
    who, count, best = tree.result()
    assert [(tree.visitors[i], c, tree.words[b]) for i, c, b in zip(who, count, best, strict=True)] == [("aaaaaa", 1, "aaaaab"), ("aaaaa", 2, "aaaaab"), ("baaaaaa", 1, "aaaaaa")]
    assert isinstance(tree.counts, np.ndarray)
