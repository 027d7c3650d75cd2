"""Spelling variants: words one edit apart, and the common spelling that each belongs to.

A trie of frequency vectors: the levels are a word's length and then how many of its letters lie in each
of GROUPS, one group after the other. A word with one letter more has one count higher by one (a surplus), with
one letter less one count lower (a deficit), and with another letter in a place one of each, or none within a
group. So from a word's own vector all its near words are reached by a depth-first search that may spend one surplus
and one deficit; words at a leaf are then verified letter by letter.

How it runs: words are counted by document batches and summed; only the vocabulary goes on. The upper levels of the
trie are a shuffle key: a word lies under one key and visits the keys that the budget reaches. Below it, a task searches one
subtree for all its visitors together: they go down as arrays, each with what is left of its budget. The number
of levels in the key is the least for which no subtree has over SUBTREE words; where all levels do not suffice, or a subtree has
very many visitors, words and visitors are dealt out in parts that meet each other. Visits to keys without words are dropped early.

Words: maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z. One run in DAMAGE loses a letter, as the
unsigned CRC-32 of ``<doc_id>:<run>`` says; all repetitions in a document fare alike.

Defined results: a null text has no words; a null doc_id counts as the empty string in the hash; repeated rows count each; words of
equal number go by code points; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm import words
from tabulens.llm.common import bounded_join, store, text_or_empty

#: One of so many runs loses a letter.
DAMAGE = 199
#: Letters and occurrences that a word has at least; how many times more often a form occurs than its variants.
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: Characters of text whose words are counted together.
TOGETHER = 16_000_000
#: Words and visitors of a subtree that one task searches at a time; pairs that are verified together.
SUBTREE, VISITORS, PAIRS = 20_000, 400_000, 200_000

_RUN = re.compile(rb"[a-z\xc0-\xff]+")
_LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
_BASES = ("e", "n", "i", "t", "a", "r", "o", "s", "hc", "dlu", "gmpb", "")


def _group(letter: str) -> int:
    """The group of a letter, an accent aside; the last group has all that no other names."""
    base = unicodedata.normalize("NFD", letter)[0].lower()
    return next((i for i, bases in enumerate(_BASES) if base in bases), len(_BASES) - 1)


GROUPS = ["".join(c for c in _LETTERS if _group(c) == g) for g in range(len(_BASES))]
_GROUP_OF = np.full(256, len(_BASES) - 1, dtype=np.uint8)
for _c in _LETTERS:
    _GROUP_OF[ord(_c)] = _group(_c)


def _counted(batches):
    def out(found: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    found, size = Counter(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            # Other characters become question marks, which end a run.
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
                if len(run) >= LEAST_LETTERS:
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if not h % DAMAGE:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    found[run] += n
            size += len(text)
            if size > TOGETHER:
                yield out(found)
                found, size = Counter(), 0
    yield out(found)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words that are long and frequent enough, a stored table."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    each = texts.mapInArrow(_counted, "word string, n long").where(F.length("word") >= LEAST_LETTERS)
    return store(each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "words")


def _moves(levels: int) -> list[tuple[list[int], int, int]]:
    """What a visitor may add to its length and its first counts: (changes, surplus spent, deficit spent) for words of its
    own length, one longer and one shorter. A budget that the length rules out is spent from the start."""
    unit = lambda at, by: [by if i == at else 0 for i in range(levels)]
    one = {by: [(unit(-1, by), 0)] + [(unit(i, by), 1) for i in range(levels)] for by in (1, -1)}
    longer = [([1, *c], s, 1) for c, s in one[1]]
    shorter = [([-1, *c], 1, d) for c, d in one[-1]]
    same = [([0, *(a + b for a, b in zip(x, y, strict=True))], s, d) for x, s in one[1] for y, d in one[-1] if not (s and d and x == [-v for v in y])]
    return longer + shorter + same


def _key(counts: Column) -> Column:
    return F.concat_ws(".", F.transform(counts, lambda c: c.cast("string")))


def _vector(levels: int) -> Column:
    letters = F.length("word")
    return F.array(letters, *[letters - F.length(F.translate("word", g, "")) for g in GROUPS[:levels]])


def _levels(found: DataFrame, subtree: int) -> int:
    """How many groups the key has beside the length."""
    for levels in range(2, len(GROUPS)):
        largest = found.groupBy(_key(_vector(levels)).alias("key")).count().agg(F.max("count")).first()[0] or 0
        if largest <= subtree:
            return levels
    return len(GROUPS)


class _Subtree:
    """The words under one key as a sorted matrix of the counts below it; nodes are ranges of its rows."""

    def __init__(self, table: pa.Table, visitors: pa.Table, levels: int):
        listed = sorted(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True))
        self.words, self.n = [w for w, _ in listed], np.array([n for _, n in listed])
        self.length = len(self.words[0])
        letters = self._matrix(self.words, self.length)
        self.counts = self._counts(letters, levels)
        order = np.lexsort(self.counts.T[::-1]) if self.counts.shape[1] else np.arange(len(letters))
        self.order, self.letters, self.counts = order, letters[order], self.counts[order]
        self.visitors = visitors["word"].to_pylist()
        sizes = np.array([len(w) for w in self.visitors])
        self.of_length = sizes - self.length
        self.own = np.zeros((len(sizes), self.length + 1), dtype=np.uint8)
        self.wanted = np.zeros((len(sizes), self.counts.shape[1]), dtype=np.int16)
        for more in (-1, 0, 1):
            rows = np.flatnonzero(self.of_length == more)
            if len(rows):
                matrix = self._matrix([self.visitors[i] for i in rows], self.length + more)
                self.own[rows, : self.length + more] = matrix
                self.wanted[rows] = self._counts(matrix, levels)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self._search(0, len(letters), 0, np.arange(len(sizes)), visitors["surplus"].to_numpy(), visitors["deficit"].to_numpy())
        self._verify()

    @staticmethod
    def _matrix(listed: list[str], length: int) -> np.ndarray:
        return np.frombuffer("".join(listed).encode("latin-1"), dtype=np.uint8).reshape(len(listed), length)

    @staticmethod
    def _counts(letters: np.ndarray, levels: int) -> np.ndarray:
        groups = _GROUP_OF[letters]
        return np.stack([(groups == g).sum(axis=1) for g in range(levels, len(GROUPS))], axis=1).astype(np.int16) if levels < len(GROUPS) else np.zeros((len(letters), 0), np.int16)

    def _search(self, a: int, b: int, level: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """Depth first below the node of rows a to b, with those visitors whose budget brought them here."""
        if not len(who):
            return
        if level == self.counts.shape[1] or b - a == 1:
            self.pairs.append((np.repeat(np.arange(a, b), len(who)), np.tile(who, b - a)))
            self.held += (b - a) * len(who)
            if self.held > PAIRS:
                self._verify()
            return
        column = self.counts[a:b, level]
        cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), b - a]
        wanted = self.wanted[who, level]
        for x, y in zip(cuts, cuts[1:], strict=False):
            more = column[x] - wanted
            up, down = more == 1, more == -1
            on = np.flatnonzero((more == 0) | (up & (surplus == 0)) | (down & (deficit == 0)))
            self._search(a + x, a + y, level + 1, who[on], surplus[on] | up[on], deficit[on] | down[on])

    def _verify(self) -> None:
        """Of the pairs met at leaves those that are one edit apart."""
        if self.pairs:
            rows, who = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
            self.pairs, self.held = [], 0
            for more in (-1, 0, 1):
                here = np.flatnonzero(self.of_length[who] == more)
                for part in np.array_split(here, max(1, len(here) // PAIRS)):
                    near = self._near(self.letters[rows[part]], self.own[who[part]], more)
                    self.found.append((self.order[rows[part][near]], who[part][near]))

    def _near(self, words: np.ndarray, own: np.ndarray, more: int) -> np.ndarray:
        if more == 0:
            return (words != own[:, : self.length]).sum(axis=1) == 1
        short, long = (own[:, : self.length - 1], words) if more < 0 else (words, own)
        # Equal up to the one letter, and from there on.
        before = np.cumprod(short == long[:, :-1], axis=1, dtype=np.uint8).sum(axis=1)
        after = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1)
        return before + after >= short.shape[1]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For visitors with near words here: their place, how many, and the row of the most frequent one."""
        rows, who = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, int), np.zeros(0, int))
        # Words are in code-point order, so that of equals the first is taken.
        ranking = np.lexsort((np.arange(len(self.n)), -self.n))
        rank = np.empty(len(ranking), int)
        rank[ranking] = np.arange(len(ranking))
        best = np.full(len(self.visitors), len(rank))
        np.minimum.at(best, who, rank[rows])
        some, count = np.unique(who, return_counts=True)
        return some, count, ranking[best[some]] if len(some) else some


NEAR = "word string, n_near long, form_n long, form string"


def _searcher(levels: int):
    def search(table: pa.Table, visitors: pa.Table) -> pa.Table:
        columns: list = [[], [], [], []]
        if table.num_rows and visitors.num_rows:
            tree = _Subtree(table, visitors, levels)
            who, count, best = tree.result()
            columns = [[tree.visitors[i] for i in who], count, tree.n[best], [tree.words[i] for i in best]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[f.split()[0] for f in NEAR.split(", ")])

    return search


def near_words(found: DataFrame, subtree: int = SUBTREE, visitors: int = VISITORS) -> DataFrame:
    """word, n_near, form_n and form (the most frequent near word) of the words of ``found`` (word, n; a stored table) that have near ones."""
    levels = _levels(found, subtree)
    moves = F.array(*[F.struct(F.array(*map(F.lit, c)).alias("by"), F.lit(bool(s)).alias("surplus"), F.lit(bool(d)).alias("deficit")) for c, s, d in _moves(levels)])
    lying = found.select("word", "n", _key(_vector(levels)).alias("key"))
    visits = found.select("word", _vector(levels).alias("own"), F.explode(moves).alias("m"))
    reached = F.zip_with("own", "m.by", lambda a, b: a + b)
    visits = visits.select("word", _key(reached).alias("key"), "m.surplus", "m.deficit")
    keys = store(lying.groupBy("key").agg(F.count(F.lit(1)).alias("n_words")), "keys")
    visits = store(bounded_join(visits, keys, "key", "n_words", "inner"), "visits")
    cells = visits.groupBy("key").agg(F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_visits"))
    parts = lambda n, most: F.ceil(F.col(n) / F.lit(most)).cast("int")
    cells = store(cells.select("key", parts("n_words", subtree).alias("w"), parts("n_visits", visitors).alias("v"), "n_words", "n_visits"), "cells")
    own = lambda n: F.pmod(F.xxhash64("word"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = bounded_join(lying, cells.drop("n_visits"), "key", "n_words", "inner").select("key", own("w").alias("i"), each("v").alias("j"), "word", "n")
    right = bounded_join(visits.drop("n_words"), cells.drop("n_words"), "key", "n_visits", "inner").select("key", each("w").alias("i"), own("v").alias("j"), "word", "surplus", "deficit")
    pairs = left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(_searcher(levels), NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    near = pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return near.select("word", "n_near", (-F.col("b.less")).alias("form_n"), F.col("b.form").alias("form"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    found = word_counts(docs)
    near = near_words(found).join(found, "word")
    common = F.col("form_n") >= RATIO * F.col("n")
    near = store(near.select("word", "n_near", F.when(common, F.col("form")).alias("form"), F.when(common, F.col("form_n")).alias("form_n")), "near")
    # Forms occur ever more often, so chains end; each round doubles their length.
    roots = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = store(roots, "roots")
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        joined = roots.join(up, "root", "left")
        if not joined.where("above is not null").limit(1).count():
            break
        roots = joined.select("word", F.coalesce("above", "root").alias("root"))
    out = found.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
