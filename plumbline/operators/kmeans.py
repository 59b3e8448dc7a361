"""Weighted k-means for several cluster counts and restarts at once.

All of it follows from the points, their ids and a seed, so any engine can
replay it. Seeds are k-means++ by races: a point's digest is a uniform number,
the exponential time it stands for is divided by the point's weight and its
squared distance to the seeds so far, and the least time wins. A race is one
partial aggregate, and as every draw depends on earlier seeds only, the seeds
of the largest k serve all smaller ones. A round assigns all points to the
centres of all runs not yet at rest, in one job that returns sums per run and
cluster. What passes through the driver is as many centres as counts, restarts
and features allow, whatever the number of points.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Executors need no installed copy of this package: kernels travel with tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Digits that centres keep, so that sums in any order give the same ones.
_DIGITS = 12
#: Digits by which costs and centres are compared when the best run is chosen.
_COMPARED = 9
_SLAB = 4096
Centre = tuple[float, ...]


@dataclass(frozen=True)
class Partition:
    """Centres in ascending order and the weighted sum of squared distances to them."""

    centres: list[Centre]
    cost: float


def in_order(centres: list[Centre]) -> list[Centre]:
    """Ascending by the digits that are compared."""
    return sorted(centres, key=lambda c: tuple(round(x, _COMPARED) + 0.0 for x in c))


def square_distances(features: str, centres: list[Centre]) -> Column:
    """Squared Euclidean distances of an array column to given centres."""
    fixed = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in c) + ")" for c in centres) + ")")
    axes = range(len(centres[0]))

    def distance(centre: Column) -> Column:
        gaps = [F.col(features)[i] - centre[i] for i in axes]
        return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])

    return F.transform(fixed, distance)


def nearest(features: str, centres: list[Centre]) -> Column:
    """Number of the nearest centre, the first of equally near ones."""
    distances = square_distances(features, centres)
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def draw_seeds(points: DataFrame, most: int, restarts: int, seed: int) -> list[list[Centre]]:
    """For each restart up to ``most`` points, fewer if there are no more different ones.

    ``points`` is (point_id, features, weight), one row for equal features.
    """
    chosen: list[list[Centre]] = [[] for _ in range(restarts)]
    for step in range(most):
        gaps = [F.array_min(square_distances("features", c)) if c else F.lit(1.0) for c in chosen]
        races = F.array(*[F.struct(F.lit(r).alias("restart"), gap.alias("gap")) for r, gap in enumerate(gaps)])
        name = F.concat_ws("/", F.lit(str(seed)), "restart", F.lit(str(step)), "point_id")
        digest = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
        time = -F.log((digest + 0.5) / float(2**52)) / (F.col("weight") * F.col("gap"))
        won = (
            points.select("point_id", "features", "weight", F.inline(races))
            .where("gap > 0")
            .groupBy("restart")
            .agg(F.min_by("features", F.struct(time, F.col("point_id"))).alias("features"))
            .collect()
        )
        if not won:
            break
        for row in won:
            chosen[row["restart"]].append(tuple(float(x) for x in row["features"]))
    return chosen


def _round_of(points: DataFrame, runs: dict[int, list[Centre]], width: int) -> dict[int, dict[int, tuple]]:
    """For each run and cluster its weight, cost and weighted feature sums."""
    centres = {run: np.array(c) for run, c in runs.items()}
    names = [f"s{i}" for i in range(width)]

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {run: np.zeros((len(c), 2 + width)) for run, c in centres.items()}
        for frame in frames:
            for at in range(0, len(frame), _SLAB):
                part = frame.iloc[at : at + _SLAB]
                x, weight = np.stack(part["features"].to_numpy()), part["weight"].to_numpy()
                for run, c in centres.items():
                    square = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
                    mine = square.argmin(axis=1)
                    held = [weight, weight * square[np.arange(len(x)), mine], *(weight * f for f in x.T)]
                    for i, values in enumerate(held):
                        sums[run][:, i] += np.bincount(mine, values, minlength=len(c))
        for run, found in sums.items():
            table = pd.DataFrame(found, columns=["weight", "cost", *names])
            yield table.assign(run=run, cluster=range(len(found)))[table["weight"] > 0]

    columns = ["weight", "cost", *names]
    schema = ", ".join(f"{c} double" for c in columns) + ", run int, cluster int"
    found = (
        points.select("features", "weight")
        .mapInPandas(assign, schema)
        .groupBy("run", "cluster")
        .agg(*[F.sum(c).alias(c) for c in columns])
        .collect()
    )
    result: dict[int, dict[int, tuple]] = {run: {} for run in runs}
    for row in found:
        result[row["run"]][row["cluster"]] = tuple(row[c] for c in columns)
    return result


def fit_partitions(
    points: DataFrame, counts: Iterable[int], *, restarts: int, seed: int, rounds: int = 300
) -> dict[int, Partition]:
    """The cheapest partition for every k, of ``restarts`` runs each.

    A run rests when its centres stay, at the latest after ``rounds``. A
    cluster without points keeps its centre. Runs of the same cost, to nine
    digits, are told by their number. With fewer different points than k, a
    partition has as many centres as there are points.
    """
    counts = list(counts)
    seeds = draw_seeds(points, max(counts), restarts, seed)
    names = [(k, r) for k in counts for r in range(restarts)]
    centres = {i: list(seeds[r][:k]) for i, (k, r) in enumerate(names) if seeds[r]}
    width = len(seeds[0][0]) if seeds[0] else 0
    costs: dict[int, float] = {}
    moving = set(centres)
    for _ in range(rounds):
        if not moving:
            break
        found = _round_of(points, {run: centres[run] for run in sorted(moving)}, width)
        for run in list(moving):
            held = found[run]
            costs[run] = sum(held[c][1] for c in sorted(held))
            moved = [
                tuple(round(s / held[c][0], _DIGITS) for s in held[c][2:]) if c in held else centre
                for c, centre in enumerate(centres[run])
            ]
            if all(np.allclose(a, b, rtol=0, atol=10.0**-_DIGITS) for a, b in zip(moved, centres[run], strict=True)):
                moving.discard(run)
            else:
                centres[run] = moved
    best: dict[int, Partition] = {}
    for k in counts:
        mine = [i for i, (count, _) in enumerate(names) if count == k and i in centres]
        if mine:
            run = min(mine, key=lambda i: (round(costs[i], _COMPARED), i))
            best[k] = Partition(in_order(centres[run]), costs[run])
    return best
