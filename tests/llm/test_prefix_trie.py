"""The prefix trie against a plain one, on small and awkward conversations."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import prefix_trie as pt
from plumbline.llm.common import read_table
from plumbline.llm.ordered import MODULUS, in_order
from plumbline.llm.queries import LLM_QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """All nodes, by walking every conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        full[c] = tuple(own.get(family, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * words
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(p))))
        parent = min(nodes[p[:-1]]) if p else None
        out.append(
            (min(members), len(p), parent, len(members), children[p], leaves[p], saved[p],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def awkward():
    rows = []
    for c in range(0, 130):
        n = c % 7
        for t in range(n):
            text = f"t {t} {c % 3 if t > 2 else ''} é\n word" if c % 5 else None
            rows.append((c, t, "user" if t % 2 == 0 else None, text))
    rows += [(None, 0, "user", "x"), (7, None, "a", "b"), (7, None, "a", "b"), (-21, 3, "u", "q w"), (-20, 3, "u", "q w")]
    rows += [(-25, i, "u", "same") for i in range(6)] + [(500, 0, "", ""), (501, 5, "user", "only"), (502, 5, "user", "y" * 100_000)]
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1100) for t in range(9)]
    return rows


@pytest.mark.parametrize("max_cells", [pt.MAX_CELLS, 16])
def test_against_a_plain_trie(spark, max_cells):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.selectExpr("*", "1 AS c", "2 AS k1", "'x' AS digest", "3 AS depth", "4 AS place", "5 AS words")
    assert found(pt.conversation_trie(df, max_cells=max_cells)) == plain_trie(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in read_table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(LLM_QUERIES["op13_prefix_trie"](spark, "/root/testdata/sf0.01")) == plain_trie(rows)


def test_one_long_conversation_and_its_copy(spark):
    """Deep shared nodes: pointers double, and the rows of one conversation are in many tasks."""
    rows = [(c, t, "u", f"w{t % 3} w") for c in (40, 60) for t in range(700)] + [(41, 0, "u", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(pt.conversation_trie(df)) == plain_trie(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pt.conversation_trie(df).collect() == []
    only_null = spark.createDataFrame([(None, 1, "u", "t")], SCHEMA)
    assert pt.conversation_trie(only_null).collect() == []


def test_sketch_never_counts_too_low(spark):
    rows = [(i % 400, (i * 7) % 400) for i in range(600)]
    df = spark.createDataFrame(rows, "k1 long, k2 long").repartition(4)
    import numpy as np

    for n_cells in (16, 1024):
        counts = pt.sketch(df, n_cells)
        true = Counter(rows)
        for (a, b), n in true.items():
            estimate = min(counts[r, pt._cells(np.array([a]), np.array([b]), r, n_cells)[0]] for r in range(pt.SKETCH_ROWS))
            assert estimate >= min(n, 2)


def test_places_and_running_sums(spark):
    big = MODULUS - 5
    rows = [(c, t, big - c * t) for c in (1, 2, 3, 4) for t in range(900 if c == 2 else 3)]
    df = spark.createDataFrame(rows, "k long, t long, v long").repartition(6)
    got = {(r.k, r.t): r for r in in_order(df, "k", [F.col("t")], "places", ("v",)).collect()}
    assert len(got) == len(rows)
    totals, sizes = Counter(), Counter(k for k, _, _ in rows)
    for k, t, v in sorted(rows):
        totals[k] = (totals[k] + v) % MODULUS
        r = got[k, t]
        assert (r.place, r.v_run, r.is_last) == (t, totals[k], t == sizes[k] - 1)
