"""Exact percentiles of groups of any size, weighted or not.

A mergeable sketch brackets each percentile first. What lies in a bracket is
collapsed to different values; while they are more than a bound, they are cut
at sketched quantiles, weights are counted between the cuts, and only the part
that holds the percentile goes on. No task ranks more than the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import settle

_ACCURACY = 10_000
#: Twice the sketch's rank error, and room for the neighbouring rank.
_MARGIN = 2.5 / _ACCURACY
#: Groups up to this size need no bracket: their values are their bracket. As
#: many different values are ranked by a task at most.
_SMALL = 100_000
#: Parts that a bracket is cut into in each further round.
_PARTS = 16


def exact_percentiles(
    values: DataFrame, keys: list[str], shares: list[float], weight: str | None = None, bound: int | None = None
) -> DataFrame:
    """(keys, n, percentiles): interpolated percentiles of the column ``x``.

    ``values`` holds the key columns and ``x``; nulls do not count, and a
    group without values has no row. Infinities are values. Each percentile
    is at the share of n - 1 in rank order, between two ranks in proportion.
    A row stands for as many values as its ``weight``, a positive long, says.
    ``bound`` is _SMALL unless given.
    """
    bound = _SMALL if bound is None else bound
    copies = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    values = values.where("x IS NOT NULL").select(*keys, "x", copies.alias("copies"))
    held, state = _bracketed(values, keys, shares, weight is not None, bound)
    held, state = _narrowed(held, state, [*keys, "i"], max(bound, 4 * _PARTS))
    ranks = Window.partitionBy(*keys, "i").orderBy("x")
    up_to = F.sum("copies").over(ranks)
    place = F.col("place")

    def at(rank: Column) -> Column:
        """The value whose copies cover a rank counted from 0."""
        return F.min(F.when(F.col("up_to") > rank, F.col("x")))

    part = F.first(place - F.floor(place))
    low, high = at(F.floor(place)), at(F.ceil(place))
    found = (
        held.join(state, [*keys, "i"])
        .withColumn("up_to", up_to + F.col("below"))
        .groupBy(*keys, "i")
        .agg(
            F.first("n").alias("n"),
            F.when((part == 0) | (low == high), low)
            .otherwise((1 - part) * low + part * high)
            .alias("value"),
        )
    )
    return (
        found.groupBy(*keys)
        .agg(
            F.first("n").alias("n"),
            F.sort_array(F.collect_list(F.struct("i", "value"))).alias("all"),  # one per share
        )
        .select(*keys, "n", F.col("all")["value"].alias("percentiles"))
    )


def _bracketed(
    values: DataFrame, keys: list[str], shares: list[float], weighted: bool, bound: int
) -> tuple[DataFrame, DataFrame]:
    """(keys, i, x, copies) inside the bracket of share i, and (keys, i, n, place, below).

    ``below`` is the weight of all values under the bracket, ``place`` the
    rank that is looked for. A sketch does not know weights, so a weighted
    bracket holds everything at first.
    """
    levels = sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-_MARGIN, _MARGIN)})
    sketch = F.percentile_approx("x", levels, _ACCURACY)
    whole = F.array(F.lit(float("-inf")), F.lit(float("inf")))
    edges = F.array(
        *[
            F.array(
                F.col("sketch")[levels.index(max(s - _MARGIN, 0.0))],
                F.col("sketch")[levels.index(min(s + _MARGIN, 1.0))],
            )
            for s in shares
        ]
    )
    all_of_it = F.array_repeat(whole, len(shares))
    large = (F.col("n") > bound) & F.lit(not weighted)
    counted = [F.sum("copies").alias("n"), *([] if weighted else [sketch.alias("sketch")])]
    brackets = settle(
        values.groupBy(*keys)
        .agg(*counted)
        .select(*keys, "n", (all_of_it if weighted else F.when(large, edges).otherwise(all_of_it)).alias("edges")),
        "brackets",
    )
    placed = values.join(brackets, keys)
    inside = F.filter(
        F.sequence(F.lit(0), F.lit(len(shares) - 1)),
        lambda i: F.col("x").between(F.get("edges", i)[0], F.get("edges", i)[1]),
    )
    below = [
        F.coalesce(F.sum(F.when(F.col("x") < F.col("edges")[i][0], F.col("copies"))), F.lit(0))
        for i in range(len(shares))
    ]
    counts = placed.groupBy(*keys).agg(F.first("n").alias("n"), F.array(*below).alias("all_below"))
    held = (
        placed.select(*keys, "x", "copies", F.explode(inside).alias("i"))
        .groupBy(*keys, "i", "x")
        .agg(F.sum("copies").alias("copies"))
    )
    share = F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("i"))
    state = counts.select(*keys, "n", F.posexplode("all_below").alias("i", "below")).withColumn(
        "place", share * (F.col("n") - 1)
    )
    return settle(held, "held-values"), settle(state, "percentile-state")


def _narrowed(held: DataFrame, state: DataFrame, key: list[str], bound: int) -> tuple[DataFrame, DataFrame]:
    """``held`` and ``state`` with at most ``bound`` different values for each key.

    A round cuts brackets at quantiles of their values, so each part has some
    sixteenth of them; the parts that cover the place and the next rank stay.
    """
    cuts = [i / _PARTS for i in range(1, _PARTS)]
    while True:
        large = settle(
            held.groupBy(*key)
            .agg(F.count(F.lit(1)).alias("values"), F.percentile_approx("x", cuts, 1000).alias("cuts"))
            .where(F.col("values") > bound)
            .drop("values"),
            "wide-brackets",
        )
        if large.isEmpty():
            return held, state
        marked = held.join(large, key).withColumn(
            "part", F.size(F.filter("cuts", lambda c: c < F.col("x")))
        )
        in_order = Window.partitionBy(*key).orderBy("part")  # as many rows as parts
        sums = marked.groupBy(*key, "part").agg(F.sum("copies").alias("weight")).withColumn(
            "up_to", F.sum("weight").over(in_order)
        )
        first = F.col("below") + F.col("up_to") - F.col("weight")
        covering = (first <= F.ceil("place")) & (F.col("below") + F.col("up_to") > F.floor("place"))
        picked = settle(
            sums.join(state, key)
            .where(covering)
            .groupBy(*key)
            .agg(F.min("part").alias("least"), F.max("part").alias("most"), F.min(first).alias("now_below")),
            "picked-parts",
        )
        kept = marked.join(picked, key).where(F.col("part").between(F.col("least"), F.col("most")))
        rest = held.join(large.select(*key), key, "left_anti")
        held = settle(rest.unionByName(kept.select(*held.columns)), "held-values")
        state = settle(
            state.join(picked.select(*key, "now_below"), key, "left")
            .withColumn("below", F.coalesce("now_below", "below"))
            .drop("now_below"),
            "percentile-state",
        )
