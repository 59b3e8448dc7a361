"""Repair against exhaustive search, and long conversations against short ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from plumbline.llm import conversation_repair as cr
from plumbline.llm.common import read_table
from plumbline.llm.queries import LLM_QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_damage(rows):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, [])
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[c] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c in out:
        out[c].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def plain_repair(rows):
    """Forward search that keeps the least (cost, audit) with its lines for every list of roles' end.

    States are the initials so far, folded: "", "s", "u", "a".
    """
    seen, faults = set(), []
    for _, role, text in rows:
        words = re.search(r"[^\x20\x09-\x0D]", text)
        last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))

    def follow(state, initial):
        return initial if initial and state + initial in ("s", "u", "su", "ua", "au") else None

    def better(table, state, value):
        if state is not None and (state not in table or value[:2] < table[state][:2]):
            table[state] = value

    def inserted(table):
        for _ in range(2):
            for state, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    better(table, follow(state, role[0]), (cost + 2, audit + "I", [*lines, f"{role}:"]))
        return table

    table = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        now = {}
        for state, (cost, audit, lines) in inserted(table).items():
            better(now, state, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                better(now, follow(state, role[:1]), (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    better(now, follow(state, other[0]), (cost + 2 + extra, audit + "R", [*lines, f"{other}:{text}"]))
        table = now
    ends = [v for s, v in inserted(table).items() if s in ("", "a")]
    cost, audit, lines = min(ends, key=lambda v: v[:2])
    turns = {t for t, _, _ in rows if t is not None}
    legal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), legal, cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain(rows):
    return sorted(((c, *plain_repair(r)) for c, r in plain_damage(rows).items()), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_the_search_by_all_edits():
    """Every audit over the letters, by brute force, for all short conversations."""
    texts = {"k": "x.", "t": "x", "b": " "}
    for n in range(4):
        for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=n):
            for kinds in itertools.product("ktb", repeat=n):
                rows = [(i, r, f"{i}{texts[x]}" if x != "b" else " ") for i, (r, x) in enumerate(zip(roles, kinds))]
                if n == 3 and zlib.crc32(str(rows).encode()) % 8:
                    continue
                best = None
                for size in range(n, n + 5):
                    for audit in itertools.product("DIKR", repeat=size):
                        if size - audit.count("I") != n:
                            continue
                        cost, said, at, ok = 0, "", 0, True
                        for x in audit:
                            wanted = "a" if said[-1:] == "u" else "u"
                            if x == "I":
                                cost, said = cost + 2, said + wanted
                                continue
                            _, role, text = rows[at]
                            kind, at = kinds[at], at + 1
                            if x == "D":
                                cost += 3
                                continue
                            ok = ok and kind != "b"
                            cost += (kind == "t") + (2 if x == "R" else 0)
                            said += role[0] if x == "K" else wanted
                        if ok and re.fullmatch("(s?(ua)+)?", said):
                            value = (cost, "".join(audit))
                            best = value if best is None or value < best else best
                    if best and best[0] <= 2 * (size - n):
                        break
                got = cr.repair(rows)
                assert (got[5], got[6]) == best, rows


def awkward():
    rng = random.Random(5)
    rows = []
    for c in range(300):
        for t in range(rng.choice([1, 2, 3, 6, 12])):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "Unknown", "s"])
            text = rng.choice([f"text {t}.", "again!", "again!", "cut", "", None, " \n", "ends? \t", "é。", f"{t}"])
            rows.append((c, rng.choice([t, t, t + 3, None]), role, text))
    rows += [(None, 1, "user", "no id."), (None, 2, "assistant", "none?"), (-7, -3, "user", "x" * 200_000 + ".")]
    return rows


@pytest.mark.parametrize("long_rows", [cr.LONG_ROWS, 2])
def test_against_a_forward_search(spark, long_rows):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.selectExpr("*", "1 AS k", "2 AS place", "'x' AS audit", "3 AS copies", "4 AS kind", "5 AS chunk")
    assert found(cr.repaired_conversations(df, long_rows=long_rows)) == plain(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in read_table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(LLM_QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01")) == plain(rows)


def test_a_long_conversation_in_many_chunks(spark):
    rng = random.Random(9)
    rows = []
    for c in (1, 2):
        for t in range(600):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.8 else rng.choice(["user", "assistant", "system"])
            text = "copy." if 200 < t < 300 else f"{rng.random()}{rng.choice(['.', '!', '', ' '])}"
            rows.append((c, t, role, text))
    rows += [(3, t, "user", "all the same.") for t in range(100)] + [(4, 0, "user", "short.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(cr.repaired_conversations(df, long_rows=16)) == plain(rows)
    assert found(cr.repaired_conversations(df, long_chars=2000, long_rows=50)) == plain(rows)


def test_chunks_agree_up_to_a_constant():
    rng = random.Random(3)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 8, 17, 18]) for _ in range(rng.randrange(1, 30)))
        one, two = (tuple(rng.randrange(4) for _ in range(4)) for _ in range(2))
        first = cr.backward(codes, one)[0]
        assert cr.fixed_up(codes, one, two, first) == cr.backward(codes, two)[0]


def test_rows_all_dropped_and_empty_tables(spark):
    turns = [t for t in range(400) if zlib.crc32(f"8:{t}".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(8, t, "user", "gone.") for t in turns], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(cr.repaired_conversations(df)) == [(8, 0, 0, 0, 0, 0, 0, "", empty)]
    assert cr.repaired_conversations(df.limit(0)).collect() == []
