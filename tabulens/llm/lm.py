"""Language-model scores by deleted interpolation.

An n-gram model of order 2 or 3. The probability of a token after another is a mix of a uniform share,
the unigram and the bigram maximum-likelihood estimate; at order 3 this mix is mixed in turn with the
trigram estimate. The weights depend on how often the context (a token, and a pair of tokens) was
seen (one set per power of two) and are learned by expectation-maximisation on counts held out from the
training documents, those of the lower order first.

How it runs: each task gathers its documents into blocks, stored as codes of tokens, so every block is as
its task met it and no key or repeated row decides where a document goes. Each block lists its distinct
tokens, bigrams and trigrams as sorted hashes with its own counts, cut into key ranges. The owner of a range adds
up all blocks' counts and answers each block in the order of its list, so keys travel once and no
task ever holds the model. A block sends to at most FAN ranges: of more blocks than that, groups first merge their
lists range by range, send these on to finer ranges, and hand the answers down; so what is exchanged grows with the blocks and
not with their square. Held-out training blocks then count how often each combination of context
frequency and binned probabilities occurs. This table has at most a fixed number of cells whatever
the input (probabilities are binned by eighths of an octave), and the weights are fitted on it.
Last, each block scores its documents with the answers it got. All documents take part.

Tokens are hashed to 64 bits, bigrams and trigrams to as many bits as the number of tokens asks for, so that
one of them shares its hash with another in less than one of 2^SPARE cases, at any size of input.

Defined results: words are lower-cased in A-Z; a null or blank text is its end token alone; a
null doc_id hashes as the empty string; repeated rows count and are scored each; an empty table
gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm import words
from tabulens.llm.common import store, text_or_empty

#: Documents with crc32(doc_id) mod FOLDS of 0 are never learned from; of the others, those with 1 teach the weights.
FOLDS = 10
#: Characters of text in a block, about; a longer text is a block by itself.
BLOCK_CHARS, CHUNK = 4_000_000, 1_000_000
#: Key ranges that a block or a group of blocks sends to, and blocks of a group, about.
FAN = 512
#: Pseudo-count of the base distribution.
ADD = 0.1
ROUNDS = 40
#: Order of the registered query's model.
ORDER = 3
#: Bits of a bigram's or trigram's hash beyond those that number the tokens.
SPARE = 14
#: Binned probabilities: BINS steps an octave, down to 2^-OCTAVES; context classes: powers of two.
BINS, OCTAVES, CONTEXTS = 8, 40, 40
SPAN = BINS * OCTAVES + 1
_EDGE = np.array([1, 2], dtype=np.uint64)  # hashes of the text's begin and end
UNI, BI, TRI = 0, 1, 2
_LEVELS = 3


def _shrunk(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _grown(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are zeros, which compress away."""
    return _shrunk(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(_grown(raw), np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _planes(counts: np.ndarray) -> bytes:
    return _shrunk(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_grown(raw), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _coded(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the place of each value among them."""
    coded = pa.array(key).dictionary_encode()
    distinct = coded.dictionary.to_numpy()
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[coded.indices.to_numpy()]


CONTENT = "block long, dev boolean, n_tokens long, ids array<long>, held array<boolean>, sizes binary, keys binary, codes binary"
_CONTENT = pa.schema(
    [("block", pa.int64()), ("dev", pa.bool_()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("keys", pa.binary()), ("codes", pa.binary())]
)


def _gatherer(block_chars: int):
    def gather(batches):
        task, number = TaskContext.get().partitionId(), 0
        held: dict[bool, list] = {False: [], True: []}
        chars = {False: 0, True: 0}

        def close(dev: bool) -> pa.RecordBatch:
            nonlocal number
            ids, folds, tokens, sizes = zip(*held[dev], strict=True)
            keys, codes = _coded(np.concatenate(tokens))
            number += 1
            row = [(task << 32) + number, dev, len(codes), np.concatenate(ids).tolist(), (np.concatenate(folds) == 0).tolist(), _planes(np.concatenate(sizes)), _packed(keys), _planes(codes)]
            held[dev], chars[dev] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CONTENT, strict=True)], schema=_CONTENT)

        for batch in batches:
            ids, folds, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in words.chunks(texts, CHUNK):
                codes, distinct, ends = words.split(texts[a:b])
                hashed = words.hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
                tokens, sizes = np.insert(hashed, ends[1:], _EDGE[1]), np.diff(ends) + 1
                for dev in (False, True):
                    own = (folds[a:b] == 1) == dev
                    if own.any():
                        held[dev].append((ids[a:b][own], folds[a:b][own], tokens[np.repeat(own, sizes)], sizes[own]))
                        chars[dev] += sum(len(t) + 1 for t, x in zip(texts[a:b], own, strict=True) if x)
                        if chars[dev] >= block_chars:
                            yield close(dev)
        for dev in (False, True):
            if held[dev]:
                yield close(dev)

    return gather


class _Block:
    """The tokens of a block: sizes and first places of its texts, and for each order of n-gram the sorted
    keys and each token's place among them."""

    def __init__(self, row: dict, bits: int, order: int):
        self.sizes = _from_planes(row["sizes"]).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.keys, self.codes = [_unpacked(row["keys"])], [_from_planes(row["codes"]).astype(np.int64)]
        grams = [self.keys[0][self.codes[0]]]
        for _ in range(order - 1):
            before = np.roll(grams[0], 1)
            before[self.first] = _EDGE[0]
            grams.insert(0, before)
            keys, codes = _coded(words.combine(grams) >> np.uint64(64 - bits))
            self.keys.append(keys)
            self.codes.append(codes)

    def counts(self, kind: int, answers: np.ndarray) -> np.ndarray:
        return answers[self.codes[kind]].astype(np.float64)

    def context(self, counts: np.ndarray, at_end: float) -> np.ndarray:
        """Counts of what stands before; a text's begin is seen as often as ends are."""
        out = np.roll(counts, 1)
        out[self.first] = at_end
        return out


def _owner(keys: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """The key range that holds each key; rises with the key."""
    return (((keys << np.uint64(64 - bits)) >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


_ASKED = pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("dev", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])


def _asker(owners: int, bits: int, order: int):
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, bits, order)
                learned = np.repeat(~np.array(row["held"], bool), block.sizes)
                rows = []
                for kind in range(order):
                    keys = block.keys[kind]
                    counts = np.bincount(block.codes[kind][learned], minlength=len(keys))
                    owner = _owner(keys, owners, bits if kind else 64)
                    cuts = np.flatnonzero(np.diff(owner, prepend=np.uint64(owners)))
                    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                        rows.append((int(owner[a]) * _LEVELS + kind, row["block"], row["dev"], _packed(keys[a:b]), _planes(counts[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ASKED, strict=True)], schema=_ASKED)

    return ask


ANSWER = "block long, owner long, fit binary, train binary, n_fit long, v_fit long, n_train long, v_train long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(schema, zip(*rows, strict=True), strict=True)}, schema=schema) if rows else schema.empty_table()


_ANSWER = pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("fit", pa.binary()), ("train", pa.binary()), *[(c, pa.int64()) for c in ("n_fit", "v_fit", "n_train", "v_train")]])


class _Lists:
    """Several sorted key lists as one, and where each list's keys are in it."""

    def __init__(self, packed: list[bytes]):
        keys = [_unpacked(x) for x in packed]
        self.sizes = [len(k) for k in keys]
        self.distinct, self.code = np.unique(np.concatenate(keys), return_inverse=True)

    def each(self):
        at = 0
        for n in self.sizes:
            yield self.code[at : at + n]
            at += n

    def total(self, counts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(self.distinct), np.int64)
        for mine, c in zip(self.each(), counts, strict=True):
            out[mine] += c
        return out


def _sums(owner: int, fit: np.ndarray, train: np.ndarray) -> list[tuple]:
    return [(-1, owner, b"", b"", int(fit.sum()), int((fit > 0).sum()), int(train.sum()), int((train > 0).sum()))] if owner % _LEVELS == UNI else []


def _to_blocks(lists: _Lists, asked: pa.Table, owner: int, fit: np.ndarray, train: np.ndarray) -> list[tuple]:
    """Rows of answers to the blocks that asked; only held-out ones are told what was fitted on."""
    blocks, dev = asked["block"].to_pylist(), asked["dev"].to_pylist()
    return [(b, owner, _planes(fit[mine]) if d else b"", _planes(train[mine]), 0, 0, 0, 0) for b, d, mine in zip(blocks, dev, lists.each(), strict=True)]


def _asked_totals(lists: _Lists, asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    own = [_from_planes(x) for x in asked["counts"].to_pylist()]
    learned = [np.zeros_like(c) if d else c for c, d in zip(own, asked["dev"].to_pylist(), strict=True)]
    return lists.total(learned), lists.total(own)


def _answer(asked: pa.Table) -> pa.Table:
    lists, owner = _Lists(asked["keys"].to_pylist()), asked["owner"][0].as_py()
    fit, train = _asked_totals(lists, asked)
    return _table(_to_blocks(lists, asked, owner, fit, train) + _sums(owner, fit, train), _ANSWER)


_PASSED = pa.schema([("owner", pa.int64()), ("sender", pa.int64()), ("keys", pa.binary()), ("fit", pa.binary()), ("train", pa.binary())])
PASSED = "owner long, sender long, keys binary, fit binary, train binary"


def _passer(owners: int, bits: int):
    def run(asked: pa.Table) -> pa.Table:
        """The merged list of a group of blocks in one range, cut into finer ranges."""
        lists, kind = _Lists(asked["keys"].to_pylist()), asked["owner"][0].as_py() % _LEVELS
        fit, train = _asked_totals(lists, asked)
        owner = _owner(lists.distinct, owners, bits if kind else 64)
        cuts = np.flatnonzero(np.diff(owner, prepend=np.uint64(owners)))
        sender = asked["sender"][0].as_py()
        rows = [(int(owner[a]) * _LEVELS + kind, sender, _packed(lists.distinct[a:b]), _planes(fit[a:b]), _planes(train[a:b])) for a, b in zip(cuts, [*cuts[1:], len(owner)], strict=True)]
        return _table(rows, _PASSED)

    return run


def _answer_groups(passed: pa.Table) -> pa.Table:
    """As ``_answer`` for groups of blocks, whose numbers stand in for blocks'."""
    lists, owner = _Lists(passed["keys"].to_pylist()), passed["owner"][0].as_py()
    fit, train = (lists.total([_from_planes(x) for x in passed[c].to_pylist()]) for c in ("fit", "train"))
    rows = [(s, owner, _planes(fit[mine]), _planes(train[mine]), 0, 0, 0, 0) for s, mine in zip(passed["sender"].to_pylist(), lists.each(), strict=True)]
    return _table(rows + _sums(owner, fit, train), _ANSWER)


def _hand_down(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """What a group was told, for each of its blocks."""
    if not asked.num_rows or not answers.num_rows:
        return _ANSWER.empty_table()
    lists, order = _Lists(asked["keys"].to_pylist()), np.argsort(answers["owner"].to_numpy())
    fit, train = (np.concatenate([_from_planes(answers[c][int(i)].as_py()) for i in order]) for c in ("fit", "train"))
    return _table(_to_blocks(lists, asked, asked["owner"][0].as_py(), fit, train), _ANSWER)


def _answers(content: DataFrame, blocks: int, bits: int, order: int, fan: int) -> DataFrame:
    """block, owner, fit, train of every block and range, and in rows of block -1 the sums; a stored table."""
    owners = blocks + max(4, content.sparkSession.sparkContext.defaultParallelism)
    ask = lambda n: content.mapInArrow(_asker(n, bits, order), "owner long, block long, dev boolean, keys binary, counts binary")
    if owners <= fan:
        return store(ask(owners).groupBy("owner").applyInArrow(_answer, ANSWER), "answers")
    # Finer ranges are whole parts of the wider ones, so each group's lists stay in order.
    fine = fan * -(-owners // fan)
    group = F.pmod(F.xxhash64("block"), F.lit(-(-blocks // fan)))
    asked = store(ask(fan).withColumn("sender", group * (fan * _LEVELS) + F.col("owner")), "asked")
    passed = asked.groupBy("sender").applyInArrow(_passer(fine, bits), PASSED)
    told = store(passed.groupBy("owner").applyInArrow(_answer_groups, ANSWER), "told")
    down = asked.groupBy("sender").cogroup(told.where("block >= 0").select(F.col("block").alias("to"), "owner", "fit", "train").groupBy("to")).applyInArrow(_hand_down, ANSWER)
    return store(down.union(told.where("block < 0")), "answers")


def _given(answers: pa.Table, column: str, order: int) -> list[np.ndarray]:
    """Counts in key order, of tokens, bigrams and so on."""
    out = []
    for kind in range(order):
        rows = sorted((o, c) for o, c in zip(answers["owner"].to_pylist(), answers[column].to_pylist(), strict=True) if o % _LEVELS == kind)
        out.append(np.concatenate([_from_planes(c) for _, c in rows]) if rows else np.zeros(0, np.int64))
    return out


class _Estimates:
    """Per token of a block: its count, and for each order the count of its context and its maximum-likelihood estimate."""

    def __init__(self, block: _Block, given: list[np.ndarray], n: int):
        counts = [block.counts(kind, g) for kind, g in enumerate(given)]
        end = float(given[UNI][np.searchsorted(block.keys[UNI], _EDGE[1])])
        self.token = counts[UNI]
        self.contexts, self.p = [None], [counts[UNI] / max(n, 1)]
        for kind in range(1, len(given)):
            context = block.context(counts[kind - 1], end)
            self.contexts.append(context)
            self.p.append(np.divide(counts[kind], context, out=np.zeros_like(context), where=context > 0))

    def mixed(self, v: int, weights: np.ndarray) -> np.ndarray:
        """Uniform, unigram and bigram share."""
        own = weights[_context_class(self.contexts[BI])]
        return own[:, 0] / (v + 1) + own[:, 1] * self.p[UNI] + own[:, 2] * self.p[BI]

    def score(self, v: int, weights: np.ndarray, shares: np.ndarray | None) -> np.ndarray:
        low = self.mixed(v, weights)
        if shares is None:
            return low
        own = shares[_context_class(self.contexts[TRI])]
        return (1 - own) * low + own * self.p[TRI]


def _context_class(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context)[1], CONTEXTS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for none, else 1 and up from the largest probability down."""
    level = np.floor(-np.log2(np.where(p > 0, p, 1)) * BINS).astype(np.int64)
    return np.where(p > 0, 1 + np.clip(level, 0, SPAN - 2), 0)


def _cell_counter(n_fit: int, bits: int, order: int, lower: tuple[int, np.ndarray] | None):
    """Cells of context class and two binned probabilities: unigram and bigram, or with ``lower`` (v and
    weights of the lower orders) their mix and trigram."""

    def count(content: pa.Table, answers: pa.Table) -> pa.Table:
        cells, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if content.num_rows and answers.num_rows:
            found = _Estimates(_Block(content.to_pylist()[0], bits, order), _given(answers, "fit", order), n_fit)
            kind, low = (BI, found.p[UNI]) if lower is None else (TRI, found.mixed(*lower))
            cells, n = np.unique((_context_class(found.contexts[kind]) * SPAN + _bin(low)) * SPAN + _bin(found.p[kind]), return_counts=True)
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})

    return count


def _cells(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context class and the two probabilities of each cell."""
    context, rest = np.divmod(cells, SPAN * SPAN)
    value = lambda b: np.where(b > 0, 2.0 ** (-(b - 0.5) / BINS), 0.0)
    low, high = np.divmod(rest, SPAN)
    return context, value(low), value(high)


def fit_shares(cells: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Per context class, the trigram's share beside the lower orders' mix. It starts from, and leans by one
    token's worth towards, a half; after an unseen context there is none."""
    context, low, high = _cells(cells)
    shares = np.full(CONTEXTS, 0.5)
    total = np.bincount(context, n, CONTEXTS) + 1
    for _ in range(rounds):
        own = shares[context]
        both = own * high + (1 - own) * low
        shares = (np.bincount(context, n * np.divide(own * high, both, out=np.zeros_like(both), where=both > 0), CONTEXTS) + 0.5) / total
    shares[0] = 0
    return shares


def fit_weights(cells: np.ndarray, n: np.ndarray, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (contexts x 3: uniform, unigram, bigram) that make the counted cells most likely.
    Each context class starts from, and leans by one token's worth towards, equal weights."""
    context, p1, p2 = _cells(cells)
    p = np.stack([np.full(len(cells), 1 / (v + 1)), p1, p2], axis=1)
    weights = np.full((CONTEXTS, 3), 1 / 3)
    for _ in range(rounds):
        share = weights[context] * p
        share *= (n / share.sum(axis=1))[:, None]
        new = np.full((CONTEXTS, 3), 1 / 3)
        np.add.at(new, context, share)
        weights = new / new.sum(axis=1, keepdims=True)
    # After an unseen context there is no bigram estimate.
    weights[0] = [weights[0, 0], 1 - weights[0, 0], 0]
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(n: int, v: int, bits: int, order: int, weights: np.ndarray, shares: np.ndarray | None):
    names = [f.split()[0] for f in SCORES.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def score(content: pa.Table, answers: pa.Table) -> pa.Table:
        if not content.num_rows:
            return pa.table({x: pa.array([], k) for x, k in zip(names, kinds, strict=True)})
        row = content.to_pylist()[0]
        block = _Block(row, bits, order)
        found = _Estimates(block, _given(answers, "train", order), n)
        per_doc = lambda x: np.add.reduceat(x, block.first)
        base = per_doc(np.log10((found.token + ADD) / (n + ADD * (v + 1))))
        known = per_doc((found.token > 0).astype(np.int64))
        columns = [row["ids"], row["held"], block.sizes, known, np.full(len(known), n), base, per_doc(np.log10(found.score(v, weights, shares)))]
        return pa.table({x: pa.array(c, k) for x, k, c in zip(names, kinds, columns, strict=True)})

    return score


def score_documents(docs: DataFrame, order: int = 2, block_chars: int | None = None, fan: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``block_chars`` and ``fan``
    (default: BLOCK_CHARS, FAN) change the plan alone."""
    if order not in (2, 3):
        raise ValueError(f"order: {order}")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.cast("int").alias("fold"), text_or_empty().alias("text"))
    content = store(texts.mapInArrow(_gatherer(block_chars or BLOCK_CHARS), CONTENT), "blocks")
    blocks, tokens = content.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    bits = min(64, tokens.bit_length() + SPARE)
    answers = _answers(content, blocks, bits, order, fan or FAN)
    sums = answers.where("block < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_fit", "v_fit", "n_train", "v_train")]).first()
    by_block = answers.where("block >= 0").select(F.col("block").alias("of"), "owner", "fit", "train")
    # Only the held-out blocks have answers without them.
    taught = content.where("dev").groupBy("block").cogroup(by_block.where("length(fit) > 0").groupBy("of"))

    def cells(lower):
        found = taught.applyInArrow(_cell_counter(sums.n_fit, bits, order, lower), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        return found["cell"].to_numpy(np.int64), found["n"].to_numpy(np.int64)

    weights = fit_weights(*cells(None), sums.v_fit)
    shares = fit_shares(*cells((sums.v_fit, weights))) if order == 3 else None
    every = content.groupBy("block").cogroup(by_block.groupBy("of"))
    return every.applyInArrow(_scorer(sums.n_train, sums.v_train, bits, order, weights, shares), SCORES)
