"""Token counts against the library itself, and the parts of the two machines against their definitions."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from tabulens.llm import token_counts
from tabulens.llm.token_counts import CHUNK, CLASSES, STATES, Tokenizer, begins, compiled, count_tokens, default_tokenizer

ODD = [
    "", " ", "'", "''s", "it's we'll they've I'm x'd 're 'r 'l 'v", "a  b", "a \n b", "\n\nx", " 's", "!'s", "1's", "'ll'll'", "'rex", "'R", "a b　c",
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "x" * 3000, "ab" * 999 + " b", "日本語テキスト" * 200, "😀😀 'v e", "\x00\x1c\x85 a", "ÀÉ́x²³½ Ⅷ", "a" * CHUNK + "'", "  " * CHUNK + "x",
]


@pytest.fixture(scope="module")
def library():
    return Library.from_file(default_tokenizer())


def _wanted(library, texts):
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def _random_texts(n):
    rng = random.Random(7)
    letters = "ab'srtvel1 \n\t!,é日 ²̀ <|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equals_the_library(spark, library):
    texts = [*ODD, *_random_texts(800)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "two words", "x"), (7, None, "x"), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    found = count_tokens(docs).collect()
    assert len(found) == len(rows)
    wanted = dict(enumerate(_wanted(library, texts)))
    for r in found:
        if r.doc_id is None:
            assert (r.n_bytes, r.n_tokens) == (9, 2)
        elif not (r.doc_id == 7 and r.n_tokens == 0):
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), wanted[r.doc_id], wanted[r.doc_id] > 1024), texts[r.doc_id][:50]
    assert sum(r.doc_id == 7 and r.n_tokens == 0 and r.n_bytes == 0 for r in found) == 2
    assert count_tokens(docs.limit(0)).count() == 0


def test_whole_table(spark, library):
    from frames import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    wanted = dict(zip(texts, _wanted(library, list(texts.values())), strict=True))
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()} == wanted


def test_long_texts_are_cut_where_words_begin(library, monkeypatch):
    monkeypatch.setattr(token_counts, "SEGMENT", 20)
    machine, text = compiled(default_tokenizer()), "it's one\n\n of  the's 12 " * 30 + "x" * 100
    pieces, _ = machine.pieces(text)
    assert len(pieces) > 10 and "".join(pieces) == text
    assert machine.counts(pieces).sum() == _wanted(library, [text])[0]


def test_few_states_give_the_same(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    machine, texts = Tokenizer(default_tokenizer()), _random_texts(200)
    assert machine.counts(texts).tolist() == _wanted(library, texts)
    assert len(machine.states) < 5000


def test_chunk_maps_compose_to_the_sequential_run():
    classes = np.random.default_rng(3).integers(0, len(CLASSES), CHUNK * 7 + 5).astype(np.uint8)
    state, found = STATES.index("fresh"), np.zeros(len(classes), bool)
    for i, c in enumerate(classes.tolist()):
        bits = int(token_counts._BEGINS[state, c])
        found[i] |= bool(bits & 1)
        found[i - 1] |= bool(bits & 2)
        state = int(token_counts._NEXT[state, c])
    assert (begins(classes) == found).all()


def test_which_tokens_may_follow(library):
    """The short rule on borders agrees with merging the bytes of both."""
    machine, rng = compiled(default_tokenizer()), random.Random(5)
    ids = sorted(i for i in machine.bytes if i < 2000 or i % 7 == 0)

    def merged(raw):
        parts = [next(i for i, b in machine.bytes.items() if b == bytes([x])) for x in raw]
        while found := [(machine.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in machine.merges]:
            i = min(found)[1]
            parts[i : i + 2] = [machine.merges[parts[i], parts[i + 1]][1]]
        return parts

    for _ in range(1500):
        a, b = rng.choice(ids), rng.choice(ids[:600])
        assert machine._may_follow(a, b) == (merged(machine.bytes[a] + machine.bytes[b]) == [a, b])


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
