"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its words without punctuation at their ends and the words' beginnings, each
hashed to TERM_BITS bits; a text has a term once for each of COUNTS that its occurrences reach, as
a beginning that recurs says more than one that occurs once. The machine has a weight per term and, for
pairs, the product of two short vectors, so that two terms together can mean what neither means
alone, such as an insult near the mention of a group.

Fitting: the labels of at most SAMPLE documents (those whose ids hash lowest, a documented bound; of rows
that repeat an id, one text), the terms that tell the two labels apart best, found by a distributed count, and
full-batch Adam over the sample's selected terms. There are at most TERMS terms, and no more than one for each
DOCS_A_TERM labelled documents (but LEAST_TERMS), as more would be learned by heart; these bounds are
parameters of the fit alone. Scoring runs over every whole text.

Defined results: a null or blank text has no terms and gets the base score; without labels of
both kinds every score is the share of label 1 (0 without any label); a null doc_id hashes as the
empty string and has no label; repeated rows are scored each; of repeated labels the largest
counts; an empty table gives no rows. Of documents only doc_id and text are read; lang, source
and labels never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm import words
from tabulens.llm.common import BROADCAST_ROWS, store

FOLDS = 5
SAMPLE, TERMS, TERM_BITS = 20_000, 4096, 24
PREFIXES = (4, 5, 6, 7)
COUNTS = (1, 2, 3, 5)
FACTORS, ROUNDS, RATE = 8, 300, 0.05
#: Pull towards zero of weights and of pair vectors; the vectors are many, so they are held more.
DECAY, PAIR_DECAY = 1e-3, 1.0
DOCS_A_TERM, LEAST_TERMS = 2, 64
#: Terms of fewer labelled documents say nothing.
MIN_DOCS = 3
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_terms(word: bytes) -> set[int]:
    """Hashed terms of one lower-cased word."""
    bare = word.strip(PUNCTUATION)
    if not bare:
        return set()
    text = bare.decode()
    found = {xxhash.xxh3_64_intdigest(bare) >> (64 - TERM_BITS)}
    found.update(xxhash.xxh3_64_intdigest(text[:n].encode(), seed=n) >> (64 - TERM_BITS) for n in PREFIXES if len(text) >= n)
    return found


def text_terms(texts: list[str | None], index: np.ndarray | None = None):
    """(text number, term) pairs, each once; a term holds its hash and, above it, the place of its
    count in COUNTS. With ``index``, sorted terms, only those in it, as their places there."""
    codes, distinct, ends = words.split(texts)
    mask = (1 << TERM_BITS) - 1
    wanted = None if index is None else set((index & mask).tolist())
    own = [word_terms(w) for w in distinct]
    if wanted is not None:
        own = [ts & wanted for ts in own]
    sizes = np.array([len(x) for x in own], dtype=np.int64)
    flat = np.fromiter((t for ts in own for t in ts), dtype=np.int64, count=int(sizes.sum()))
    of_text = np.repeat(np.arange(len(texts)), np.diff(ends))
    n = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    at = (np.cumsum(sizes) - sizes)[codes] if len(codes) else n
    place = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    found, times = np.unique((np.repeat(of_text, n) << TERM_BITS) | flat[place], return_counts=True)
    rows = np.concatenate([found[times >= c] >> TERM_BITS for c in COUNTS])
    terms = np.concatenate([(found[times >= c] & mask) | (i << TERM_BITS) for i, c in enumerate(COUNTS)])
    if index is not None:
        at = np.minimum(np.searchsorted(index, terms), max(len(index) - 1, 0))
        keep = index[at] == terms if len(index) else np.zeros(len(terms), bool)
        rows, terms = rows[keep], at[keep]
    return rows, terms


class Machine:
    """w0 + sum of w + pairwise products of v over a text's terms, through a logistic."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def margins(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        total = lambda x: np.bincount(rows, x, n)
        out = self.w0 + total(self.w[terms])
        for f in range(self.v.shape[1]):
            own = self.v[terms, f]
            out += 0.5 * (total(own) ** 2 - total(own * own))
        return out

    def scores(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows, terms, n), -500, 500)))


def fit(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, n_terms: int, seed: int = 7) -> Machine:
    """Full-batch Adam on the logistic loss; the rarer label weighs up to four times as much."""
    n, share = len(y), float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Machine(500.0 if share else -500.0, np.zeros(n_terms), np.zeros((n_terms, FACTORS)))
    weight = np.where(y == 1, min(4.0, max(1.0, (1 - share) / share)), 1.0)
    weight /= weight.sum()
    params = [np.zeros(1), np.zeros(n_terms), np.random.default_rng(seed).normal(0, 0.02, (n_terms, FACTORS))]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, ROUNDS + 1):
        w0, w, v = params
        own = v[terms]
        sums = np.stack([np.bincount(rows, own[:, f], n) for f in range(FACTORS)], axis=1)
        squared = np.stack([np.bincount(rows, own[:, f] ** 2, n) for f in range(FACTORS)], axis=1)
        margin = w0[0] + np.bincount(rows, w[terms], n) + 0.5 * (sums**2 - squared).sum(axis=1)
        slope = weight * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y)
        per_term = slope[rows]
        by_factor = per_term[:, None] * (sums[rows] - own)
        slopes = [np.array([slope.sum()]), np.bincount(terms, per_term, n_terms) + DECAY / max(n_terms, 1) * w, np.stack([np.bincount(terms, by_factor[:, f], n_terms) for f in range(FACTORS)], axis=1) + PAIR_DECAY / max(n_terms, 1) * v]
        for p, g, m, s in zip(params, slopes, means, squares, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), params[1], params[2])


def _all_terms(batches):
    for batch in batches:
        y, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for a, b in words.chunks(texts):
            rows, terms = text_terms(texts[a:b])
            found, code = np.unique(terms, return_inverse=True)
            yield pa.record_batch([pa.array(found, pa.int64()), pa.array(np.bincount(code, y[a:b][rows], len(found)).astype(np.int64)), pa.array(np.bincount(code, minlength=len(found)))], names=["term", "toxic", "n"])


def _picked_terms(index: np.ndarray):
    def pick(batches):
        for batch in batches:
            y, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in words.chunks(texts):
                rows, terms = text_terms(texts[a:b], index)
                order = np.argsort(rows, kind="stable")
                rows, terms = rows[order], terms[order]
                cuts = np.searchsorted(rows, np.arange(b - a + 1))
                yield pa.record_batch([pa.array(y[a:b], pa.int32()), pa.array([terms[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int64()))], names=["toxic", "terms"])

    return pick


def _scorer(machine: Machine, index: np.ndarray):
    def score(batches):
        for batch in batches:
            ids, held, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in words.chunks(texts):
                rows, terms = text_terms(texts[a:b], index)
                s = machine.scores(rows, terms, b - a)
                yield pa.record_batch([ids[a:b], held[a:b], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def _fold(doc_id: str = "doc_id"):
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, docs_a_term: int = DOCS_A_TERM) -> tuple[Machine, np.ndarray]:
    """The machine and its terms, sorted."""
    known = labels.where("doc_id is not null and toxic is not null").where(_fold() != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = store(known.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")), "labelled")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(known) if sample <= BROADCAST_ROWS else known, F.col("doc_id") == F.col("__id"))
    # One text an id, partially aggregated: the bound on ids is one on rows.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")
    texts = store(texts.groupBy("__id").agg(F.first("toxic").alias("toxic"), one).select("toxic", "t.text"), "sample")
    counts = texts.mapInArrow(_all_terms, "term long, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    size, toxic = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    # The deviation from the count expected at the overall share, in standard deviations.
    share = toxic / size if size else 0.0
    apart = F.abs(F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    most = min(terms, max(LEAST_TERMS, size // docs_a_term))
    best = counts.where(F.col("n") >= MIN_DOCS).orderBy(apart.desc(), "term").limit(most).select("term").toPandas()
    index = np.sort(best["term"].to_numpy(np.int64))
    picked = texts.mapInArrow(_picked_terms(index), "toxic int, terms array<long>").toPandas()
    lengths = picked["terms"].map(len).to_numpy(np.int64)
    rows = np.repeat(np.arange(len(picked)), lengths)
    flat = np.concatenate(picked["terms"].to_list()).astype(np.int64) if len(picked) else np.zeros(0, np.int64)
    return fit(rows, flat, picked["toxic"].to_numpy(np.float64), len(index)), index


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    machine, index = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_fold() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(machine, index), "doc_id long, held_out boolean, score double, predicted int")
