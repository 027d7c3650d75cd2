"""Repair of conversation structure by weighted interval parsing.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Its nonterminals [p, q] stand for any rows that
take a reading from state p to state q of that form (STEPS), and the grammar is in Chomsky normal form: [p, q] -> [p, r] [r, q],
or one row kept, given another role or deleted. Insertions are closed over in every cell, so they may stand anywhere. A
cell of a span holds for each [p, q] the least (cost, audit). Cells are combined bottom-up by span length: 1, 2, 4 and
so on. CYK takes the least over all places where a span may be parted; as a cell here has all states between,
every place gives the same least cell, so one place a span is enough and the work grows in proportion to the rows.
(Of audits of one span and cost none begins another: it would lack an insertion, which costs. So the least of a joined
span is joined from the least of its parts.)

How it runs: rows are ranged by conversation and turn, so a conversation of any size is spread over tasks. A task reads its range
in order and parses each conversation in pieces of bounded size. One that lies whole within a range and a piece is
finished there. The pieces of others meet by their narrow cells, in a pass that holds four audits; their edits are
cut from the result, and their texts, repaired piece by piece, are hashed in order as they stream by.

Edits: K keeps a row (0), R gives it the role user or assistant (3), D deletes it (4; the only one for blank and duplicate
rows), I inserts an empty row of either role (3); a truncated row that stays costs 3 more. Ties: the least audit in ASCII.

Defined results: null roles, texts and parts of the damage key count as one space; null turns come first; rows of one turn
go by role, then text; repeated rows are duplicates; a role without an initial cannot be kept; a conversation that loses all rows
has zeros, an empty audit and the hash of nothing; a null conv_id is a conversation; an empty table gives no rows.
Only ``conv_id``, ``turn``, ``role`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import bounded_join, store

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What a role's initial does to the state; the text may end in the states of ENDS.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS, STATES = (0, 3), 4
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
DAMAGE = 20
#: Rows and characters of a piece.
PIECE_ROWS, PIECE_CHARS = 2000, 4_000_000
#: Spans of up to so many rows are remembered by their kinds of rows.
SPAN_KNOWN = 16

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cells) -> Cell:
    out: Cell = {}
    for at, found in cells:
        if at not in out or found < out[at]:
            out[at] = found
    return out


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side: [p, q] -> [p, r] [r, q]."""
    return _least(((p, q), (c + d, x + y)) for (p, r), (c, x) in left.items() for (r2, q), (d, y) in right.items() if r == r2)


def _inserted() -> Cell:
    """The cell of no rows: insertions only, closed over."""
    cell = {(p, p): (0, "") for p in range(STATES)}
    one = [((p, q), (INSERT, "I")) for (p, role), q in STEPS.items() if role in ROLES]
    while (more := _least([*cell.items(), *joined(cell, _least(one)).items()])) != cell:
        cell = more
    return cell


NOTHING = _inserted()


@lru_cache(maxsize=1000)
def _row(kind: str) -> Cell:
    """The cell of a row. Its kind: "-" for one that must go, else its role's initial ("?" for any that cannot be kept), in
    upper case where it is truncated."""
    cells = [((p, p), (DELETE, "D")) for p in range(STATES)]
    if kind != "-":
        more, role = TRUNCATED if kind.isupper() or kind == "!" else 0, kind.lower()
        cells += [((p, q), (KEEP + more, "K")) for (p, r), q in STEPS.items() if r == role]
        cells += [((p, q), (REROLE + more, "R")) for (p, r), q in STEPS.items() if r in ROLES]
    return joined(joined(NOTHING, _least(cells)), NOTHING)


@lru_cache(maxsize=20_000)
def _known(kinds: str) -> Cell:
    if len(kinds) == 1:
        return _row(kinds)
    half = len(kinds) // 2
    return joined(_known(kinds[:half]), _known(kinds[half:]))


def parse(kinds: str) -> Cell:
    """The cell of rows of these kinds, bottom-up by span length."""
    cells = [_known(kinds[i : i + SPAN_KNOWN]) for i in range(0, len(kinds), SPAN_KNOWN)] or [NOTHING]
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


def repaired(audit: str, rows, survivors: int, system: bool):
    """The repaired lines. ``rows``: (role, text) of each row in order; ``survivors``: rows that stay before
    these; ``system``: whether the first of the conversation that stays is a system row."""
    rows = iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        expected = ROLES["u" if (survivors - system) % 2 == 0 else "a"]
        yield f"{role if edit == 'K' else expected}:{text}"
        survivors += 1


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (repetitions) of the rows after damage. What was dropped leaves a row with n 0, so that its
    conversation is known."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % DAMAGE
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), fate.cast("int").alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role, gone = F.when(F.col("fate") == 4, "user").otherwise(F.col("role")), F.col("fate") == 0
    n = F.when(gone, 0).when(F.col("fate") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(role).alias("role"), F.when(gone, "").otherwise(text).alias("text"), n.alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _with_first(rows: DataFrame) -> DataFrame:
    """``rows``, a stored table, with again: whether an earlier turn has the same role and text."""
    same = F.struct(F.xxhash64("conv_id", "role", "text"), F.xxhash64(F.lit(1), "text", "role", "conv_id"))
    keyed = rows.withColumn("same", same)
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    several = keyed.where("n > 0").groupBy("same").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    found = bounded_join(keyed, store(several, "several"), "same", "turns")
    return found.select("conv_id", "turn", "role", "text", "n", F.coalesce(~turn.eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)).alias("again"))


_BLANK = " \t\n\v\f\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
#: A piece of an unfinished conversation: its place, its figures, its cell and its rows, without the texts that must go.
_PIECE = pa.schema([
    ("part", pa.int64()), ("seq", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("n_rows", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()),
    ("cell", pa.list_(pa.struct([("p", pa.int64()), ("q", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
_PARSED = pa.schema([*_RESULT, *_PIECE])


class _Piece:
    """Rows of one conversation in order, up to a bound."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.kinds, self.roles, self.texts = conv_id, [], [], []
        self.figures = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first_turn = self.last_turn = None
        self.turns = self.chars = 0
        self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        seen = text.rstrip(_BLANK)
        fault = "blank" if not seen else "duplicate" if again else "truncated" if seen[-1] not in ".!?" else None
        if fault:
            self.figures[fault] += 1
        initial = role[:1]
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in LEGAL:
            self.figures["illegal"] += 1
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        gone = fault in ("blank", "duplicate")
        kind = initial if initial in ("s", "u", "a") else "?"
        self.kinds.append("-" if gone else {"?": "!"}.get(kind, kind.upper()) if fault else kind)
        self.roles.append(role)
        self.texts.append("" if gone else text)
        self.chars += len(self.texts[-1]) + 1

    def full(self) -> bool:
        return len(self.kinds) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def result(self) -> dict:
        cost, audit = best(parse("".join(self.kinds)))
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        lines = repaired(audit, zip(self.roles, self.texts, strict=True), 0, _system(audit))
        return {"conv_id": self.conv_id, "gaps": gaps, **self.figures, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}

    def piece(self, part: int, seq: int) -> dict:
        cell = [{"p": p, "q": q, "cost": c, "audit": x} for (p, q), (c, x) in parse("".join(self.kinds)).items()]
        return {
            "conv_id": self.conv_id, **self.figures, "part": part, "seq": seq, "first_turn": self.first_turn, "last_turn": self.last_turn, "turns": self.turns,
            "n_rows": len(self.kinds), "first_role": self.first_role, "last_role": self.last_role, "cell": cell, "roles": self.roles, "texts": self.texts,
        }


def _system(audit: str) -> bool:
    """Whether the first row that stays is a system row: users and assistants come in pairs."""
    return (len(audit) - audit.count("D")) % 2 == 1


class _Batches:
    """Rows as record batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 1000, chars: int = 4_000_000):
        self.schema, self.rows, self.chars, self.held, self.size = schema, rows, chars, [], 0

    def add(self, row: dict, chars: int = 0):
        self.held.append(row)
        self.size += chars
        if len(self.held) >= self.rows or self.size >= self.chars:
            yield from self.rest()

    def rest(self):
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in self.held], f.type) for f in self.schema], schema=self.schema)
            self.held, self.size = [], 0


def _parsed(batches):
    """Results of conversations that lie whole in this range, pieces of the others."""
    part, seq, piece, opened, first = TaskContext.get().partitionId(), 0, None, False, True
    out = _Batches(_PARSED)

    def closed(last: bool):
        nonlocal seq, opened, first
        if opened or first or last:
            seq += 1
            yield from out.add(piece.piece(part, seq), piece.chars)
        else:
            yield from out.add(piece.result())
        opened = first = False

    for batch in batches:
        for conv_id, turn, role, text, n, again in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if piece is None or conv_id != piece.conv_id:
                if piece is not None:
                    yield from closed(False)
                piece = _Piece(conv_id)
            for i in range(n):
                if piece.full():
                    seq += 1
                    opened = True
                    yield from out.add(piece.piece(part, seq), piece.chars)
                    piece = _Piece(conv_id)
                piece.add(turn, role, text, again or i > 0)
    if piece is not None:
        yield from closed(True)
    yield from out.rest()


#: The edits of a piece, with the rows that stay before it and whether the conversation begins with a system row; its last one has the figures.
_CUT = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("edits", pa.string()), ("survivors", pa.int64()), ("system", pa.bool_()), ("last", pa.bool_()), *[(f"all_{c}", pa.int64()) for c in COUNTS], ("all_audit", pa.string())])


def _cut(pieces: list[tuple[int, int, int]], audit: str, figures: dict):
    """The edits of each piece (part, seq, rows); insertions at a border go with the next piece."""
    at = survivors = 0
    system = _system(audit)
    for i, (part, seq, n) in enumerate(pieces):
        begin, rows = at, 0
        last = i + 1 == len(pieces)
        while at < len(audit) and (last or rows < n):
            rows += audit[at] != "I"
            at += 1
        edits = audit[begin:at]
        own = {f"all_{c}": figures[c] for c in COUNTS} | {"all_audit": audit} if last else {}
        yield {"part": part, "seq": seq, "edits": edits, "survivors": survivors, "system": system, "last": last, **own}
        survivors += len(edits) - edits.count("D")


_FIGURES = ("blank", "duplicate", "truncated", "illegal")


def _folded(batches):
    """Read the pieces of each conversation in order, keep the least (cost, audit) that leads to each state, and cut the
    whole audit at the end."""
    conv_id, pieces = None, []
    out = _Batches(_CUT)

    def finish():
        cost, audit = min(reached[q] for q in ENDS if q in reached)
        gaps = last_turn - first_turn + 1 - turns if turns else 0
        for row in _cut(pieces, audit, figures | {"gaps": gaps, "cost": cost}):
            yield from out.add(row, len(row["edits"]))

    for batch in batches:
        for r in batch.to_pylist():
            if not pieces or r["conv_id"] != conv_id:
                if pieces:
                    yield from finish()
                conv_id, pieces, reached, figures = r["conv_id"], [], {0: (0, "")}, dict.fromkeys(_FIGURES, 0)
                first_turn = last_turn = last_role = None
                turns = 0
            pieces.append((r["part"], r["seq"], r["n_rows"]))
            reached = _least((c["q"], (reached[c["p"]][0] + c["cost"], reached[c["p"]][1] + c["audit"])) for c in r["cell"] if c["p"] in reached)
            for f in _FIGURES:
                figures[f] += r[f]
            if last_role is not None and r["first_role"] is not None:
                figures["illegal"] += last_role + r["first_role"] not in LEGAL
            last_role = last_role if r["last_role"] is None else r["last_role"]
            if r["turns"]:
                turns += r["turns"] - (r["first_turn"] == last_turn)
                first_turn = r["first_turn"] if first_turn is None else first_turn
                last_turn = r["last_turn"]
    if pieces:
        yield from finish()
    yield from out.rest()


_LINES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("lines", pa.string()), ("n_lines", pa.int64()), ("last", pa.bool_()), *[f for f in _CUT if f.name.startswith("all_")]])


def _mended(batches):
    """The repaired lines of each piece as one text."""
    out = _Batches(_LINES)
    for batch in batches:
        for r in batch.to_pylist():
            lines = list(repaired(r["edits"], zip(r["roles"], r["texts"], strict=True), r["survivors"], r["system"]))
            row = {"lines": "\n".join(lines), "n_lines": len(lines)} | {k: r[k] for k in _LINES.names if k in r}
            yield from out.add(row, len(row["lines"]))
    yield from out.rest()


def _hashed(batches):
    """Hash the lines of each conversation as they come, in order."""
    digest, begun = hashlib.sha256(), False
    out = _Batches(_RESULT)
    for batch in batches:
        for r in batch.to_pylist():
            if r["n_lines"]:
                digest.update((("\n" if begun else "") + r["lines"]).encode())
                begun = True
            if r["last"]:
                row = {c: r[f"all_{c}"] for c in (*COUNTS, "audit")}
                yield from out.add(row | {"conv_id": r["conv_id"], "repaired_sha256": digest.hexdigest()}, len(row["audit"]))
                digest, begun = hashlib.sha256(), False
    yield from out.rest()


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    order = ["conv_id", "turn", "role", "text"]
    rows = _with_first(store(damaged(conversations), "damaged"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parsed = store(ranged.mapInArrow(_parsed, _spark(_PARSED)), "parsed")
    done = parsed.where("part is null").select(*_RESULT.names)
    pieces = parsed.where("part is not null")
    place = ["conv_id", "part", "seq"]
    narrow = pieces.select(*place, *_FIGURES, "first_turn", "last_turn", "turns", "n_rows", "first_role", "last_role", "cell")
    cut = store(narrow.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_folded, _spark(_CUT)), "edits")
    # One row of edits a piece: keys are distinct on both sides.
    mended = pieces.select(*place, "roles", "texts").join(cut, ["part", "seq"]).mapInArrow(_mended, _spark(_LINES))
    whole = mended.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_hashed, _spark(_RESULT))
    return done.union(whole)


def _spark(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)
