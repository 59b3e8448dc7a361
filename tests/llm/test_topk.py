import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import topk


def brute(rows, k, scale=64):
    usable = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable[i] = [math.floor(scale * x) for x in v]
    out = []
    for q, v in usable.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable.items() if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, k=20, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string".replace(", id string", ""))
    df = df.selectExpr("*", "1 AS block", "'x' AS v").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, k, **options).collect())


def sample(n, width, seed=1):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.3), 3) for _ in range(width)]) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, list(same)) for i in range(150)]  # copies: ties far beyond k
    rows += [(5000, None), (5020, []), (5040, [0.1] * (width - 2)), (5060, [None] * width)]
    rows += [(5080, [float("nan")] * width), (5100, [float("inf")] + [0.0] * (width - 1)), (None, [0.1] * width)]
    rows += [(5120, [0.0] * width), (5140, [30.0] * width), (5160, [-30.0] * width)]
    return rows


@pytest.mark.parametrize("options", [{}, {"block_rows": 64, "group_queries": 8, "pivots": 5}, {"pivots": 1}])
def test_against_all_pairs(spark, options):
    rows = sample(500, 8)
    assert run(spark, rows, **options) == brute(rows, 20)


def test_huge_components_and_few_rows(spark):
    rows = [(0, [1e6, -1e6]), (1, [1e6, 1e6]), (20, [-1e6, 1e6]), (3, [0.5, 0.25])]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, rows[:1]) == []


def test_components_beyond_32_bits(spark):
    # Scaled by 64; the square of the vector of 1e9 is beyond 2**63.
    rows = [(0, [4e7, 1.0]), (1, [3.5e7, 3.0]), (2, [3.6e7, -7.0]), (3, [-5e7, 2.0])]
    large = [(0, [1.0, 0.0]), (20, [1e9, 0.0]), (1, [1e6, 5.0])]
    assert run(spark, rows) == brute(rows, 20) and run(spark, large) == brute(large, 20)


@pytest.mark.parametrize("rows", [[(0, [1e10]), (1, [1e10])], [(0, [1e18]), (1, [1.0])]])
def test_scores_that_do_not_fit_fail(spark, rows):
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, rows)


def test_nothing(spark):
    assert run(spark, [(1, None)]) == []
    assert run(spark, [(1, [1.0])]) == []


@pytest.mark.parametrize("width, length", [(1, 1e8), (2, 1e6), (8, 1e6), (8, 1e4)])
def test_one_long_vector_among_short_ones(spark, width, length):
    """A pivot far away tells nothing of the others; no candidate may be lost by its rounding."""
    rng = random.Random(width)
    rows = [(i, [round(i / 300 + rng.gauss(0, 0.02), 4)] + [round(rng.gauss(0, 0.02), 4) for _ in range(width - 1)]) for i in range(900)]
    rows.append((901, [length] + [0.0] * (width - 1)))
    assert run(spark, rows, block_rows=100) == brute(rows, 20)


def test_blocks_out_of_reach_are_not_visited(spark, monkeypatch):
    """Groups of vectors in different directions: a query visits its own and few others."""
    rng = random.Random(4)
    rows = [(i, [20.0 * (i % 6 == j) + round(rng.gauss(0, 0.3), 3) for j in range(6)]) for i in range(1200)]
    seen = []
    routes = topk._routes

    def counted(queries, table, p2, width):
        found = routes(queries, table, p2, width)
        seen.append((found.count(), queries.count() * table.select("block").distinct().count()))
        return found

    monkeypatch.setattr(topk, "_routes", counted)
    assert run(spark, rows, block_rows=32) == brute(rows, 20)
    assert seen[0][0] < 0.4 * seen[0][1]


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])]
    got = run(spark, rows, k=3)
    assert [(r[2], r[3]) for r in got] == [(2, 192 * 64), (1, 128 * 64), (1, 128 * 64)]
