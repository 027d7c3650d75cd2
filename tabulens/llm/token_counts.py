"""Token counts by a finite-state compilation of a byte-level BPE tokenizer.

Two deterministic transducers do the work:

1. Splitting. A machine of STATES over classes of characters reads a text and says where its words begin;
   a transition may place a begin before the character read or before the one ahead of it. Texts lie
   end to end, with an END symbol after each, and are cut into chunks of CHUNK characters wherever that falls. Each
   chunk is read from every state at once, which gives its state map (state before -> state after); maps
   are composed by a parallel prefix scan (doubling steps over all chunks), so every chunk knows the state that
   it is entered in and places its begins. All chunks advance in step, one numpy operation a character.
2. Counting. A second machine reads a word byte by byte; each transition has the change of the number of
   tokens that the bytes so far make. Its states are compiled from the merges when a word first needs them:
   a state holds, for each suffix of what was read that a token could still go on from, the place in the trie of tokens, the
   last token before the suffix and how many tokens fewer that prefix has. Of the tokens that end at a byte exactly one can
   follow the token before it (the merges of the two leave both whole), and this one is the last of the encoding.
   Last tokens that allow the same go on as one. A worker holds at most about MAX_STATES states, is emptied beyond, and
   takes all words of its texts forward together, a byte at a time.

Classes of characters are asked of the tokenizer's own splitter, one character at a time as they come up,
so that its version of Unicode decides. No document moves: one narrow pass without a shuffle.

Defined results: a null text is empty; an empty text has 0 bytes and 0 tokens; a special string in a text
is one token, as by the library's default; a null doc_id is kept; repeated rows are counted each; an empty table
gives no rows. Only ``doc_id`` and ``text`` are read, so other columns may have any name. A tokenizer
that is not plain byte-level BPE is a ValueError.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm import words
from tabulens.llm.common import text_or_empty

#: More tokens than this are over the limit.
LIMIT = 1024
#: Characters of a chunk, of texts that are worked on together, and of a segment of a long text.
CHUNK, TOGETHER, SEGMENT = 256, 2_000_000, 1_000_000
#: States of the counting machine that a worker holds.
MAX_STATES = 300_000
#: Places in the trie with up to so many tokens beyond them tell last tokens apart only by which of these they allow.
FEW = 64
NEVER = 1 << 60

FIELDS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# The splitting machine: letters, numbers, other marks; white space, alone or after more of it; an apostrophe
# that began a word, and what may become 're, 've, 'll.
STATES = ("fresh", "letters", "numbers", "marks", "blank", "space", "blanks", "spaces", "quote", "quote r", "quote v", "quote l")
CLASSES = ("letter", "number", "mark", "blank", "space", "quote", "stmd", "r", "v", "e", "l", "end")
_LETTERS = {"letter", "stmd", "r", "v", "e", "l"}
_HERE, _BEFORE = 1, 2


def _transition(state: str, read: str) -> tuple[str, int]:
    """The next state, and whether a word begins at the character read (_HERE) or at the one before it (_BEFORE)."""
    kind = "letters" if read in _LETTERS else {"number": "numbers", "mark": "marks"}.get(read)
    if state.startswith("quote "):
        if (state, read) in (("quote r", "e"), ("quote v", "e"), ("quote l", "l")):
            return "fresh", 0
        # Not a short form: the apostrophe stands alone and its letter begins a word.
        after, begins = _transition("letters", read)
        return after, begins | _BEFORE
    if read == "end":
        return "fresh", _HERE
    if read in ("blank", "space"):
        if state in ("blank", "space", "blanks", "spaces"):
            return f"{read}s", 0
        return read, _HERE
    if state in ("space", "spaces"):
        # A space goes with what follows it, and leaves other white space before it.
        return kind or "marks", _BEFORE if state == "spaces" else 0
    if state == "blanks":
        after, begins = _transition("blank", read)
        return after, begins | _BEFORE
    if state == "quote":
        if read == "stmd":
            return "fresh", 0
        if read in ("r", "v", "l"):
            return f"quote {read}", 0
        return ("marks", 0) if read in ("mark", "quote") else (kind, _HERE)
    if read == "quote":
        return ("marks", 0) if state == "marks" else ("quote", _HERE)
    return kind, 0 if kind == state else _HERE


_RULES = [[_transition(s, c) for c in CLASSES] for s in STATES]
_NEXT = np.array([[STATES.index(after) for after, _ in row] for row in _RULES], dtype=np.uint8)
_BEGINS = np.array([[begins for _, begins in row] for row in _RULES], dtype=np.uint8)
_END = CLASSES.index("end")
_ASCII = {" ": "space", "'": "quote", "s": "stmd", "t": "stmd", "m": "stmd", "d": "stmd", "r": "r", "v": "v", "e": "e", "l": "l"}


def entry_states(classes: np.ndarray) -> np.ndarray:
    """For each chunk (row) of classes, the state that it is entered in."""
    after = np.broadcast_to(np.arange(len(STATES), dtype=np.uint8), (len(classes), len(STATES))).copy()
    for column in classes.T:
        after = _NEXT[after, column[:, None]]
    step = 1
    while step < len(after):
        # after[i] becomes the map over twice as many chunks up to i.
        after[step:] = np.take_along_axis(after[step:], after[:-step], axis=1)
        step *= 2
    return np.concatenate([[STATES.index("fresh")], after[:-1, STATES.index("fresh")]]).astype(np.uint8)


def begins(classes: np.ndarray) -> np.ndarray:
    """Whether a word begins at each place of ``classes``, texts with an end each."""
    n = len(classes)
    padded = np.full(-(-n // CHUNK) * CHUNK, _END, dtype=np.uint8)
    padded[:n] = classes
    chunks = padded.reshape(-1, CHUNK)
    state, out = entry_states(chunks), np.empty(chunks.T.shape, dtype=np.uint8)
    for at, column in enumerate(chunks.T):
        out[at] = _BEGINS[state, column]
        state = _NEXT[state, column]
    flat = out.T.ravel()[:n]
    found = (flat & _HERE).astype(bool)
    found[:-1] |= (flat[1:] & _BEFORE).astype(bool)
    return found


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of the vocabulary stands for: printable ones for themselves, others
    for the characters from 256 up in order."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """The compiled form of a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        bytewise = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        if not plain or not bytewise or spec.get("normalizer") or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is not plain byte-level BPE")
        self.splitter = Library.from_file(path).pre_tokenizer
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.classes = np.full(0x110000, 255, dtype=np.uint8)
        byte, vocab = _byte_alphabet(), model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.single = {byte[t]: i for t, i in vocab.items() if len(t) == 1}
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if all(c in byte for c in t)}
        self.made_of = {made: (rank, pair) for pair, (rank, made) in self.merges.items()}
        self.below: dict[int, list[int] | None] = {}
        # The trie of the tokens that the merges can make.
        made = {i for _, i in self.merges.values()} | set(self.single.values())
        self.children, self.token = [{}], [-1]
        for i, raw in self.bytes.items():
            if i in made:
                node = 0
                for b in raw:
                    if b not in self.children[node]:
                        self.children[node][b] = len(self.children)
                        self.children.append({})
                        self.token.append(-1)
                    node = self.children[node][b]
                self.token[node] = i
        self._empty()

    def _empty(self) -> None:
        self.states = [((0, -1, 0),)]
        self.numbers = {self.states[0]: 0}
        self.follows: dict[tuple[int, int], bool] = {}
        self.alike: dict[tuple[int, int], int | None] = {}
        self.standing: dict[tuple[int, tuple], int] = {}
        # Transitions: state << 8 | byte, sorted, with the next state << 16 | change of the count + 32768.
        self.keys, self.moves = np.array([-1], dtype=np.int64), np.zeros(1, dtype=np.int64)

    def _number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at the right (1) or left (0) end of ``token`` as it was made, each with the rank of the merge
        that took it up, innermost last; ``token`` itself is never taken up."""
        out, taken = [], NEVER
        while True:
            out.append((token, taken))
            if token not in self.made_of:
                return out
            taken, pair = self.made_of[token]
            token = pair[side]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether the two stay apart: no merge across their border comes before those that took up its two ends.
        Of equal ranks the left merge is made first."""
        if last < 0:
            return True
        known = self.follows.get((last, token))
        if known is None:
            known = True
            for left, left_taken in self._spine(last, 1):
                for right, right_taken in self._spine(token, 0):
                    across = self.merges.get((left, right))
                    if across and across[0] < left_taken and across[0] <= right_taken:
                        known = False
            self.follows[last, token] = known
        return known

    def _below(self, node: int) -> list[int] | None:
        """The tokens that go on from a place in the trie, None if they are many."""
        if node not in self.below:
            found = []
            for child in self.children[node].values():
                own = self._below(child)
                found = None if own is None or found is None else found + own + [t for t in [self.token[child]] if t >= 0]
                if found is None or len(found) > FEW:
                    found = None
                    break
            self.below[node] = found
        return self.below[node]

    def _alike(self, node: int, last: int) -> int | None:
        """A stand-in for ``last`` that allows the same tokens from ``node`` on; None if it allows none."""
        known = self.alike.get((node, last), self)
        if known is self:
            below = self._below(node)
            if below is None:
                known = last
            else:
                allowed = tuple(t for t in below if self._may_follow(last, t))
                known = self.standing.setdefault((node, allowed), last) if allowed else None
            self.alike[node, last] = known
        return known

    def _compiled(self, number: int, byte: int) -> int:
        """The transition of a state by a byte: next state and change of the count, in one number."""
        state = self.states[number]
        reached = [(self.children[node][byte], last, less) for node, last, less in state if byte in self.children[node]]
        last, change = next((self.token[node], less + 1) for node, before, less in reached if self.token[node] >= 0 and self._may_follow(before, self.token[node]))
        after = [(node, self._alike(node, before), less - change) for node, before, less in reached if self.children[node]]
        return self._number((*(x for x in after if x[1] is not None), (0, last, 0))) << 16 | (change + 32768)

    def _learn(self, missing: np.ndarray) -> None:
        """Compile transitions (state << 8 | byte), sorted, none of them known."""
        new = np.array([self._compiled(m >> 8, m & 255) for m in missing.tolist()], dtype=np.int64)
        at = np.searchsorted(self.keys, missing)
        self.keys, self.moves = np.insert(self.keys, at, missing), np.insert(self.moves, at, new)

    def word_counts(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """The number of tokens of each word, where ``offsets`` say what bytes of ``raw`` it has: all words advance
        together, longest first."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        at, total, state = offsets[:-1][order], np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        going = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
        for step, n in enumerate(going.tolist()):
            key = state[:n] << 8 | raw[at[:n] + step]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            unknown = self.keys[place] != key
            if unknown.any():
                if len(self.states) > MAX_STATES:
                    held = [self.states[i] for i in state[:n].tolist()]
                    self._empty()
                    state[:n] = [self._number(x) for x in held]
                    key = state[:n] << 8 | raw[at[:n] + step]
                    unknown = np.ones(n, bool)
                self._learn(np.unique(key[unknown]))
                place = np.searchsorted(self.keys, key)
            move = self.moves[place]
            state[:n] = move >> 16
            total[:n] += (move & 65535) - 32768
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out

    def _class_of(self, character: str) -> int:
        alone = lambda before: len(self.splitter.pre_tokenize_str(before + character)) == 1
        name = _ASCII.get(character) or ("letter" if alone("x") else "number" if alone("1") else "mark" if alone("!") else "blank")
        return CLASSES.index(name)

    def _classes(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if (found == 255).any():
            for p in np.unique(points[found == 255]).tolist():
                self.classes[p] = self._class_of(chr(p))
            found = self.classes[points]
        return found

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text, which hold no special strings."""
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes + 1) - 1
        classes = self._classes(points)
        classes[ends] = _END
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        width[ends] = 0
        starts = np.flatnonzero(begins(classes))
        offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[np.append(starts, len(points))]
        raw = "".join(texts).encode()
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
        coded = found.dictionary_encode()
        distinct = coded.dictionary
        spans = np.frombuffer(distinct.buffers()[1], dtype=np.int64, count=len(distinct) + 1)
        each = self.word_counts(spans, np.frombuffer(distinct.buffers()[2] or b"", dtype=np.uint8))
        upto = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])
        return np.diff(upto[np.searchsorted(starts, np.concatenate([[0], ends + 1]))])

    def pieces(self, text: str) -> tuple[list[str], int]:
        """What lies between special strings, long stretches cut before white space, and how many of these strings there are."""
        parts = self.special.split(text) if self.special else [text]
        out = []
        for part in parts:
            while len(part) > SEGMENT:
                # White space after a letter begins a word whatever comes before.
                cut = _BORDER.search(part, SEGMENT)
                if cut is None:
                    break
                out.append(part[: cut.start()])
                part = part[cut.start() :]
            out.append(part)
        return out, len(parts) - 1


_BORDER = re.compile(r"(?<=[A-Za-z0-9])[ \n]")
_compiled: dict[str, Tokenizer] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def compiled(path: str) -> Tokenizer:
    """One machine a worker and file."""
    if path not in _compiled:
        _compiled[path] = Tokenizer(path)
    return _compiled[path]


def _counter(path: str | None, limit: int):
    def run(batches):
        machine = compiled(path or default_tokenizer())
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in words.chunks(texts, TOGETHER):
                cut = [machine.pieces(t) for t in texts[a:b]]
                every = [p for pieces, _ in cut for p in pieces]
                per_piece = np.concatenate([machine.counts(every[i:j]) for i, j in words.chunks(every, TOGETHER)])
                first = np.cumsum([0, *(len(pieces) for pieces, _ in cut)])[:-1]
                tokens = np.add.reduceat(per_piece, first) + np.array([n for _, n in cut])
                size = [len(t.encode()) for t in texts[a:b]]
                yield pa.record_batch([ids[a:b], pa.array(size, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. ``tokenizer``: the path of a byte-level
    BPE file, at the same place on every executor; the public one of 50,257 ids by default."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(_counter(tokenizer, limit), FIELDS)
