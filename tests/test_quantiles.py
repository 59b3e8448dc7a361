import numpy as np
import pytest

from plumbline.operators import quantiles

SHARES = [0.0, 0.02, 0.5, 0.925, 1.0]


@pytest.mark.parametrize("small", [0, 100_000])
def test_against_numpy(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "_SMALL", small)
    rng = np.random.default_rng(3)
    groups = {
        "wide": rng.normal(size=30_001),
        "tied": np.round(rng.exponential(size=20_000), 1),
        "same": np.full(12_000, 4.5),
        "mostly": np.concatenate((np.zeros(15_000), rng.normal(size=5000))),
    }
    if small:
        groups |= {"one": np.array([3.0]), "two": np.array([1.0, 2.0]), "odd": np.array([5.0, 1.0, 9.0])}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("wide", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r for r in quantiles.exact_percentiles(df, ["k"], SHARES).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert got[k].n == len(xs)
        assert got[k].percentiles == pytest.approx(np.quantile(xs, SHARES).tolist(), rel=1e-12)


def test_infinities_are_values(spark):
    df = spark.createDataFrame([("a", x) for x in (float("-inf"), 1.0, 2.0, float("inf"))], "k string, x double")
    assert quantiles.exact_percentiles(df, ["k"], [0.0, 0.5, 1.0]).first().percentiles == [
        float("-inf"), 1.5, float("inf")
    ]


@pytest.mark.parametrize("bound", [1, 500, None])
def test_weights_in_rounds(spark, bound):
    """Brackets narrow round by round until few different values are left, copies and all."""
    rng = np.random.default_rng(5)
    groups = {
        "wide": (rng.normal(size=4000), rng.integers(1, 9, 4000)),
        "heavy": (np.arange(3000.0), np.where(np.arange(3000) == 1234, 50_000, 1)),
        "same": (np.full(2000, 7.0), np.full(2000, 3)),
        "edges": (np.concatenate(([-np.inf] * 3, np.arange(900.0), [np.inf])), np.full(904, 2)),
        "few": (np.array([1.0, 2.0]), np.array([1, 10])),
    }
    rows = [(k, float(x), int(w)) for k, (xs, ws) in groups.items() for x, w in zip(xs, ws)]
    df = spark.createDataFrame(rows, "k string, x double, w long").repartition(4)
    shares = [0.1, 0.5, 0.925]
    got = {r.k: r for r in quantiles.exact_percentiles(df, ["k"], shares, "w", bound=bound).collect()}
    for k, (xs, ws) in groups.items():
        every = np.repeat(xs, ws)
        assert got[k].n == len(every)
        assert got[k].percentiles == pytest.approx(np.quantile(every, shares).tolist(), rel=1e-12), k


def test_ranked_values_are_bounded(spark, monkeypatch):
    seen = []
    narrowed = quantiles._narrowed

    def watched(held, state, key, bound):
        out = narrowed(held, state, key, bound)
        seen.append((held.count(), out[0].groupBy(*key).count().agg({"count": "max"}).first()[0], bound))
        return out

    monkeypatch.setattr(quantiles, "_narrowed", watched)
    df = spark.range(200_000).selectExpr("'k' AS k", "CAST(id * 7919 % 200000 AS double) AS x", "id % 3 + 1 AS w")
    got = quantiles.exact_percentiles(df, ["k"], [0.25], "w", bound=300).first()
    every = np.repeat(np.arange(200_000) * 7919 % 200_000, np.arange(200_000) % 3 + 1)
    assert got.percentiles[0] == np.quantile(every, 0.25)
    (before, most, bound), = seen
    assert before == 200_000 and most <= bound
