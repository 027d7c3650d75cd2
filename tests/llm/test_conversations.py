"""Repair of conversations against exhaustive search and a plain run over each conversation."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tabulens.llm import conversations
from tabulens.llm.conversations import COUNTS, best, joined, parse, repair_conversations

SPACES = " \t\n\v\f\r"


def _edited(rows):
    """Least (cost, audit) and its lines by a run over the rows with all edits, insertions at every place. ``rows``: (role, text, fault)."""
    form = re.compile("(s?(ua)+)?")
    prefix = re.compile("(s?((ua)*u?))?")
    best_of = {"": (0, "", ())}

    def inserted(found):
        out = dict(found)
        for _ in range(3):
            for roles, (c, a, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    add(out, roles + role[0], (c + 3, a + "I", (*lines, f"{role}:")))
        return out

    def add(out, roles, new):
        if prefix.fullmatch(roles):
            # What may follow depends on the end alone.
            key = roles if len(roles) < 3 else ("s" if roles[0] == "s" else "") + ("ua" if roles[-1] == "a" else "uau")
            if key not in out or new[:2] < out[key][:2]:
                out[key] = new

    for role, text, fault in rows:
        now = {}
        for roles, (c, a, lines) in inserted(best_of).items():
            add(now, roles, (c + 4, a + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if role[:1]:
                    add(now, roles + role[0], (c + more, a + "K", (*lines, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    add(now, roles + to[0], (c + 3 + more, a + "R", (*lines, f"{to}:{text}")))
        best_of = now
    return min(x for roles, x in inserted(best_of).items() if form.fullmatch(roles))


def _brute(table):
    groups = {}
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = groups.setdefault(conv, [])
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        rows += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, figures, judged = set(), dict.fromkeys(COUNTS, 0), []
        for _, role, text in rows:
            shown = text.rstrip(SPACES)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                figures[fault] += 1
        turns = [t for t, _, _ in rows if t is not None]
        figures["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        figures["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        figures["cost"], audit, lines = _edited(judged)
        out[conv] = (*figures.values(), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _found(frame):
    rows = frame.collect()
    out = {r.conv_id: tuple(r[c] for c in (*COUNTS, "audit", "repaired_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


def _table(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([0, 1, 3, 6, 9])):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Hello.", "Why?\n", "é no stop", "", "  ", None, "Same text!", "Same text!", f"Own {turn}."])
            rows.append((rng.choice([conv, conv, conv, 1, None]), rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("piece_rows, partitions", [(2000, 4), (3, 7)])
def test_small_tables(spark, monkeypatch, piece_rows, partitions):
    rows = _table(120, 3) + [(5, 1, "user", "Twice?")] * 4
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece_rows)
    _shipped_bound(spark, monkeypatch, piece_rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", audit string").repartition(partitions)
    assert _found(repair_conversations(docs)) == _brute(rows)


def _shipped_bound(spark, monkeypatch, piece_rows):
    """Workers import the module anew, so the bound goes with the function that they are given."""
    own = conversations._parsed

    def bounded(batches):
        conversations.PIECE_ROWS = piece_rows
        yield from own(batches)

    monkeypatch.setattr(conversations, "_parsed", bounded)


def test_given_table(spark):
    from frames import DATA

    frame = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert _found(repair_conversations(frame)) == _brute(rows)


def test_one_conversation_in_many_tasks(spark, monkeypatch):
    """A conversation that holds nearly all rows is read and parsed by several tasks."""
    rng = random.Random(4)
    rows = [(9, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Ok.", f"Text {t}.", "cut", ""])) for t in range(1500)] + [(1, 0, "user", "Hi."), (20, 0, "user", "Hi.")]
    _shipped_bound(spark, monkeypatch, 100)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert _found(repair_conversations(frame)) == _brute(rows)


def test_all_rows_dropped_and_empty(spark):
    gone = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = _found(repair_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_parting_gives_the_same_cell():
    """The chart of all spans and all places to part them has the cell that doubling spans give."""
    rng = random.Random(1)
    for _ in range(60):
        kinds = "".join(rng.choice("suaSUA?!-") for _ in range(rng.randint(1, 9)))
        chart = {}
        for length in range(1, len(kinds) + 1):
            for i in range(len(kinds) - length + 1):
                parted = [joined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)] or [parse(kinds[i])]
                assert all(p == parted[0] for p in parted)
                chart[i, i + length] = parted[0]
        assert parse(kinds) == chart[0, len(kinds)]


def test_exhaustive_edits():
    """All edits of up to three rows with up to two insertions at each place."""
    form = re.compile("(s?(ua)+)?")
    for kinds in itertools.product("suU-?", repeat=3):
        options = []
        for k in kinds:
            more = 3 if k.isupper() else 0
            one = [(4, "D", "")]
            if k != "-":
                one += [(more, "K", k.lower())] + [(3 + more, "R", r) for r in "ua"]
            options.append([(0, "", "")] and one)
        gaps = [(0, "", ""), *[(3, "I", r) for r in "ua"], *[(6, "II", r + s) for r in "ua" for s in "ua"]]
        every = []
        for rows in itertools.product(*options):
            for ins in itertools.product(gaps, repeat=4):
                seq = [ins[0], *itertools.chain.from_iterable(zip(rows, ins[1:], strict=True))]
                cost = sum(x[0] for x in seq)
                if cost <= 12 and form.fullmatch("".join(x[2] for x in seq)):
                    every.append((cost, "".join(x[1] for x in seq)))
        assert best(parse("".join(kinds))) == min(every)
