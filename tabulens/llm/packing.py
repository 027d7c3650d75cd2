"""Harmonic packing of tokenised documents into sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths over capacity/(k+1) up to
capacity/k, and a sequence of class k takes exactly k pieces. Each task fills the sequences of
each class by itself as it tokenises, so no document moves. The few pieces in unfilled sequences
at a task's end are pooled over many tasks, filled by class again, and what is left then shares
sequences by first fit.

A document longer than the capacity gives whole sequences; what remains is cut to an exact unit
fraction of the capacity where its class would waste more than WASTE, so sequences are nearly full.

Defined results: a null text is empty and holds only the end id; a null doc_id is kept; repeated
rows are packed each; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm import words
from tabulens.llm.common import store

CAPACITY, END = 4096, 2
#: Part of a sequence that a class may waste before its pieces are cut to fit; shorter pieces are never cut.
WASTE, SHORT = 0.05, 256
#: Words and parts of words whose ids a Python worker remembers; the memory is emptied when full.
CACHE_WORDS = 2_000_000
#: New words that are tokenised as one text; a call a word takes thrice the time.
TOGETHER = 1000
#: Texts of about so many bytes are tokenised together.
CHUNK = 8_000_000
#: Tasks whose leftovers are pooled.
POOL = 256

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_known: dict[str, tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}
_tokenizers: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _parts(word: bytes) -> tuple[bytes, ...]:
    """``word`` as the pieces whose ids are remembered. The tokenizer lower-cases, and takes a run
    of letters and a mark after it apart, so these may be looked up by themselves. Words that may
    hold a special token, or composed characters with capitals, are left alone."""
    if word.isascii():
        if b"<" in word:
            return (word,)
        word = word.lower()
    if word[-1:] in b".," and len(word) > 1 and word[:-1].decode().isalpha():
        return word[:-1], word[-1:]
    return (word,)


def _word_ids(distinct: list[bytes], path: str) -> list[bytes]:
    """The ids of each word, as little-endian 32-bit numbers."""
    known, pieces = _known.setdefault(path, ({}, {}))
    if len(known) + len(pieces) > CACHE_WORDS:
        known.clear()
        pieces.clear()
    ids = list(map(known.get, distinct))
    missing = [i for i, x in enumerate(ids) if x is None]
    parts = [_parts(distinct[i]) for i in missing]
    new = list({p for ps in parts for p in ps if p not in pieces})
    for i in range(0, len(new), TOGETHER):
        some = new[i : i + TOGETHER]
        texts = [p.decode() for p in some]
        encoded = _tokenizer(path).encode(" ".join(texts), add_special_tokens=False)
        raw = np.array(encoded.ids, dtype="<u4").tobytes()
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        ends = (np.searchsorted([x for x, _ in encoded.offsets], begins) * 4).tolist()
        pieces.update((p, raw[a:b]) for p, a, b in zip(some, ends[:-1], ends[1:], strict=True))
    for i, ps in zip(missing, parts, strict=True):
        known[distinct[i]] = ids[i] = b"".join([pieces[p] for p in ps])
    return ids


def token_ids(texts: list[str | None], path: str):
    """Each text's ids with END after them, as an array."""
    codes, distinct, ends = words.split(texts, lower=False)
    ids = _word_ids(distinct, path)
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = codes[a:b]
        n = sizes[own]
        total = int(n.sum())
        shift = np.repeat(at[own] - (np.cumsum(n) - n), n) if total else np.zeros(0, np.int64)
        yield np.append(flat[shift + np.arange(total)], np.uint32(END)).astype("<u4")


#: Texts by which a tokenizer is tried: runs of white space, capitals, marks after words and within, accents, digits.
SAMPLES = ("Two  words.\n\tThree, FOUR", "Été à l'école, ÉCOLE.", "end. Of,line x.y a,b .,", "3.14 v2, (see) \"it's\" e-mail", "Straße 東京, ok", " led by space")


def check_tokenizer(path: str) -> None:
    """A ValueError unless words can be looked up one by one: the ids of whole texts are those that ``token_ids`` puts together."""
    for text, ids in zip(SAMPLES, token_ids(list(SAMPLES), path), strict=True):
        if _tokenizer(path).encode(text, add_special_tokens=False).ids != ids[:-1].tolist():
            raise ValueError(f"{path} does not treat words one by one, so texts cannot be packed with it: {text!r}")


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths for ``n`` ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest < SHORT or rest * k >= (1 - WASTE) * capacity:
            return [*out, rest]
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class _Filler:
    """Fills sequences of one task; ``first`` is the number of its first sequence."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity, self.open, self.done = first, capacity, {}, []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.done.append((*p, self.next, offset))
            offset += p[2]
        self.next += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            self.close(self.open.pop(k))

    def rest(self) -> list[tuple]:
        return [p for pieces in self.open.values() for p in pieces]


def _table(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _fields(with_ids: bool, more: tuple[str, ...] = ()) -> list[pa.Field]:
    own = [*(("ids",) if with_ids else ()), "sequence_id", "offset", *more]
    kinds = {"ids": pa.binary()}
    return [pa.field(n, kinds.get(n, pa.int64())) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *own)]


def _packer(path: str, capacity: int, with_ids: bool):
    fields = _fields(with_ids, ("task",))

    def pack(batches):
        task = TaskContext.get().partitionId()
        filler = _Filler(task << 32, capacity)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in words.chunks(texts):
                for doc, ids in zip(docs[a:b], token_ids(texts[a:b], path), strict=True):
                    start = 0
                    for n in cut(len(ids), capacity):
                        raw = ids[start : start + n].tobytes()
                        filler.add((doc, start, n, zlib.crc32(raw), len(ids), *((raw,) if with_ids else ())))
                        start += n
                yield _table([(*p, task) for p in filler.done], fields)
                filler.done = []
        yield _table([(*p, None, None, task) for p in filler.rest()], fields)

    return pack


def _pooler(capacity: int, with_ids: bool):
    fields = _fields(with_ids)

    def pool(pieces: pa.Table) -> pa.Table:
        filler = _Filler((1 << 61) + (pieces["pool"][0].as_py() << 32), capacity)
        names = [f.name for f in fields][:-2]
        for p in sorted(zip(*(pieces[n].to_pylist() for n in names), strict=True), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1])):
            filler.add(p)
        bins: list[list] = []
        for p in sorted(filler.rest(), key=lambda p: -p[2]):
            fit = next((x for x in bins if x[0] + p[2] <= capacity), None)
            if fit is None:
                bins.append(fit := [0, []])
            fit[0] += p[2]
            fit[1].append(p)
        for _, own in bins:
            filler.close(own)
        return pa.Table.from_batches([_table(filler.done, fields)])

    return pool


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with ``with_ids`` the ids themselves (little-endian 32-bit numbers). Pieces of one sequence
    follow each other by offset without a gap. A tokenizer whose ids of a word depend on more than the word is a ValueError."""
    path = tokenizer or default_tokenizer()
    check_tokenizer(path)
    schema = FIELDS.replace(", sequence_id", ", ids binary, sequence_id") if with_ids else FIELDS
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = store(texts.mapInArrow(_packer(path, capacity, with_ids), schema + ", task long"), "pieces")
    left = pieces.where("sequence_id is null").withColumn("pool", F.floor(F.col("task") / POOL)).drop("task")
    pooled = left.groupBy("pool").applyInArrow(_pooler(capacity, with_ids), schema)
    return pieces.where("sequence_id is not null").drop("task").unionByName(pooled)
