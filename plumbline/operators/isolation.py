"""Isolation forests over many datasets at once.

Every tree draws its own rows from the whole dataset, and growing needs these
draws only; scoring is a pure row-wise pass. So the forest of a dataset is one
row of arrays, and the rows to score are split into chunks of bounded size
that each meet a copy of their forest: no step depends on the size of the
largest dataset, and nothing is broadcast. Draws, features and cuts come from
digests of the seed, the dataset, the tree and the node, so a forest is the
same wherever and whenever it grows. Scores do not depend on the
contamination, so one fit serves a whole sweep.
"""

from __future__ import annotations

import hashlib
import sys
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.defaults import CONTAMINATION, CONTAMINATIONS, SEED, TREE_SAMPLE, TREES
from plumbline.functions.scoring import ratio
from plumbline.operators.quantiles import exact_percentiles
from plumbline.session import settle

# Executors need no installed copy of this package: kernels travel with tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CHUNK = 65_536
#: Rows that walk a tree together.
_WALK = 4096
_EULER_GAMMA = 0.5772156649

_FOREST = (
    "dataset_id string, depth int, psi int, feature array<int>, cut array<double>, "
    "path array<double>"
)
_SCORES = "dataset_id string, row_id string, score double"


def _expected_path(size: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``size`` points."""
    size = np.asarray(size, dtype=float)
    many = 2.0 * (np.log(np.maximum(size - 1, 1)) + _EULER_GAMMA)
    many -= 2.0 * (size - 1) / np.maximum(size, 1)
    return np.where(size > 2, many, np.where(size == 2, 1.0, 0.0))


def _digest(text: str) -> int:
    """The first 52 bits of the text's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def _grow(points: np.ndarray, seed: int, key: str) -> tuple:
    """Grow the trees of one dataset level by level on heap-numbered nodes.

    ``points`` is (trees, rows per tree, features). Node 1 is the root and
    node i has children 2i and 2i+1. Of the features that vary at a node the
    one with the smallest digest is cut, at a point that another digest sets
    between its least and largest value.
    """
    trees, psi, width = points.shape
    depth = int(np.ceil(np.log2(psi))) if psi > 1 else 0
    nodes = 2 ** (depth + 1)
    x = points.reshape(-1, width)
    base = np.repeat(np.arange(trees) * nodes, psi)
    node = np.ones(trees * psi, dtype=np.int64)
    feature = np.full(trees * nodes, -1, dtype=np.int32)
    cut = np.zeros(trees * nodes)
    for level in range(depth):
        slot = base + node
        low = np.full((trees * nodes, width), np.inf)
        high = np.full((trees * nodes, width), -np.inf)
        np.minimum.at(low, slot, x)
        np.maximum.at(high, slot, x)
        for here in np.unique(slot[node >= 2**level]).tolist():
            varied = np.flatnonzero(high[here] > low[here]).tolist()
            if not varied:
                continue
            name = f"{seed}:{key}/{here // nodes}/{here % nodes}"
            chosen = min(varied, key=lambda f: _digest(f"{name}/{f}"))
            lo, hi = low[here, chosen], high[here, chosen]
            value = lo + _digest(name) / 2**52 * (hi - lo)
            feature[here], cut[here] = chosen, value if value < hi else lo
        axis = feature[slot]
        moving = (axis >= 0) & (node >= 2**level)
        right = x[np.arange(len(x)), np.maximum(axis, 0)] > cut[slot]
        node = np.where(moving, 2 * node + right, node)
    size = np.bincount(base + node, minlength=trees * nodes)
    level_of = np.zeros(nodes)
    level_of[1:] = np.floor(np.log2(np.arange(1, nodes)))
    path = np.tile(level_of, trees) + _expected_path(size)
    return depth, psi, feature, cut, path


def _score(points: np.ndarray, depth: int, psi: int, feature, cut, path) -> np.ndarray:
    """Scores of rows that walk one tree after the other, each tree small enough to stay at hand."""
    nodes = 2 ** (depth + 1)
    trees, width = len(feature) // nodes, points.shape[1]
    # A leaf leads to itself: nothing is beyond its cut.
    inner = feature.reshape(trees, nodes) >= 0
    axis = np.where(inner, feature.reshape(trees, nodes), 0).astype(np.intp)
    limit = np.where(inner, cut.reshape(trees, nodes), np.inf)
    child = np.where(inner, 2, 1) * np.arange(nodes)
    path = path.reshape(trees, nodes)
    scores = np.empty(len(points))
    for start in range(0, len(points), _WALK):
        x = points[start : start + _WALK].ravel()
        first = np.arange(0, len(x), width)
        found = np.empty((len(first), trees))
        for tree in range(trees):
            node = np.ones(len(first), dtype=np.intp)
            for _ in range(depth):
                right = x.take(axis[tree].take(node) + first) > limit[tree].take(node)
                node = child[tree].take(node) + right
            found[:, tree] = path[tree].take(node)
        scores[start : start + _WALK] = found.mean(axis=1)
    usual = float(_expected_path(np.array([psi]))[0])
    return np.power(2.0, -scores / usual) if usual > 0 else np.full(len(points), 0.5)


def lots_wanted(sample: int) -> int:
    """Draws a tree should expect so that fewer than ``sample`` have a chance below 1e-18."""
    return int(np.ceil(sample + 42 + np.sqrt(83 * sample + 1722)))


def least_prime(at_least: int) -> int:
    """The smallest prime that is not below ``at_least``."""
    return next(p for p in range(max(at_least, 2), 2 * at_least + 3) if all(p % d for d in range(2, int(p**0.5) + 1)))


def _trees_upto(share: Column, trees: int) -> Column:
    """For k below ``trees``, the chance that at most k trees draw a row."""
    ways = F.array(*[F.lit(lgamma(trees + 1) - lgamma(k + 1) - lgamma(trees - k + 1)) for k in range(trees)])

    def chance(k: Column) -> Column:
        return F.exp(F.get(ways, k) + k * F.log(share) + (trees - k) * F.log(1 - share))

    sums = F.aggregate(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        F.array().cast("array<double>"),
        lambda seen, k: F.concat(seen, F.array(F.coalesce(F.get(seen, k - 1), F.lit(0.0)) + chance(k))),
    )
    return F.when(share < 1, sums).otherwise(F.array_repeat(F.lit(0.0), trees))


def tree_rows(
    matrix: DataFrame, *, trees: int = TREES, sample: int = TREE_SAMPLE, seed: int = SEED
) -> DataFrame:
    """(dataset_id, tree, row_id, features): the rows every tree grows from.

    Each tree draws ``sample`` rows of its dataset, or all if there are no
    more. One digest per row says by the inverse binomial distribution how
    many trees draw a row, and rows drawn by none end there, inside the scan.
    For the others it starts a walk over the trees, modulo a prime, whose
    first stops are the trees. So a tree holds some 450 rows of a large
    dataset, and of them takes the ``sample`` smallest digests of tree and row.
    """
    share = F.least(F.lit(1.0), F.lit(float(lots_wanted(sample))) / F.col("n_records"))
    prime = least_prime(trees)

    def digits(start: int, length: int) -> Column:
        return F.conv(F.substring("digest", start, length), 16, 10).cast("long")

    lots = (
        matrix.select("dataset_id", "row_id", "features", "n_records")
        .withColumn("digest", F.md5(F.concat(F.lit(f"{seed}/"), F.col("row_id"))))
        .withColumn("u", digits(1, 13) / F.lit(float(2**52)))
        .where((share >= 1) | (F.col("u") >= F.exp(trees * F.log(1 - share))))
        .select(
            "dataset_id",
            "row_id",
            "features",
            "u",
            (digits(14, 7) % prime).alias("first"),
            (1 + digits(21, 7) % (prime - 1)).alias("step"),
        )
    )
    sizes = matrix.groupBy("dataset_id").agg(F.max("n_records").alias("n_records"))
    chances = sizes.select("dataset_id", _trees_upto(share, trees).alias("upto"))
    number = F.size(F.filter("upto", lambda c: c <= F.col("u")))
    stops = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(prime - 1), F.col("number") - 1 + F.lit(prime - trees))),
        lambda j: ((F.col("first") + j * F.col("step")) % prime).cast("int"),
    )
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("tree").cast("string"), F.lit(":"), F.col("row_id")))
    first = Window.partitionBy("dataset_id", "tree").orderBy("order", "row_id")
    return (
        lots.join(chances, "dataset_id")
        .withColumn("number", number)
        .where("number > 0")
        .withColumn("stops", F.slice(F.filter(stops, lambda t: t < trees), F.lit(1), F.col("number")))
        .select("dataset_id", F.explode("stops").alias("tree"), "row_id", "features")
        .withColumn("order", order)
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= sample)
        .drop("order", "place")
    )


def grow_forest(
    matrix: DataFrame, *, trees: int = TREES, sample: int = TREE_SAMPLE, seed: int = SEED
) -> DataFrame:
    """One row per dataset holding its forest as arrays.

    What one task receives is ``trees`` times ``sample`` rows.
    """

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tree", "row_id"])
        key = rows["dataset_id"].iloc[0]
        points = np.stack(rows["features"].to_numpy())
        depth, psi, feature, cut, path = _grow(
            points.reshape(trees, -1, points.shape[1]), seed, key
        )
        return pd.DataFrame(
            {
                "dataset_id": [key],
                "depth": [depth],
                "psi": [psi],
                "feature": [feature],
                "cut": [cut],
                "path": [path],
            }
        )

    drawn = tree_rows(matrix, trees=trees, sample=sample, seed=seed)
    return drawn.groupBy("dataset_id").applyInPandas(grow, _FOREST)


def score_rows(matrix: DataFrame, forest: DataFrame, *, seed: int = SEED) -> DataFrame:
    """(dataset_id, row_id, score) of every matrix row; higher is more anomalous."""

    def score(rows: pa.Table, trees: pa.Table) -> pa.Table:
        found = rows.select(["dataset_id", "row_id"])
        if not rows.num_rows or not trees.num_rows:
            return found.slice(0, 0).append_column("score", pa.array([], pa.float64()))
        depth, psi = (trees[c][0].as_py() for c in ("depth", "psi"))
        arrays = (trees[c][0].values.to_numpy() for c in ("feature", "cut", "path"))
        points = rows["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        scores = _score(points.reshape(rows.num_rows, -1), depth, psi, *arrays)
        return found.append_column("score", pa.array(scores))

    chunks = F.ceil(F.col("n_records") / F.lit(_CHUNK)).cast("long")
    rows = matrix.select(
        "dataset_id",
        F.pmod(F.xxhash64(F.lit(seed), "row_id"), chunks).alias("chunk"),
        "row_id",
        "features",
    )
    sizes = matrix.groupBy("dataset_id").agg(F.max("n_records").alias("n_records"))
    copies = forest.join(sizes, "dataset_id").select(
        forest["*"], F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk")
    )
    return (
        rows.groupBy("dataset_id", "chunk")
        .cogroup(copies.groupBy("dataset_id", "chunk"))
        .applyInArrow(score, _SCORES)
    )


def isolation_scores(
    matrix: DataFrame, *, trees: int = TREES, sample: int = TREE_SAMPLE, seed: int = SEED
) -> DataFrame:
    """Fit and score in one call."""
    forest = grow_forest(matrix, trees=trees, sample=sample, seed=seed)
    return score_rows(matrix, forest, seed=seed)


def score_cuts(scores: DataFrame, contaminations: list[float] = CONTAMINATIONS) -> DataFrame:
    """(dataset_id, contamination, cut): interpolated score percentile at 1 − c.

    Exact for datasets of any size; a small written table.
    """
    levels = F.array(*[F.lit(float(c)) for c in contaminations])
    values = scores.select("dataset_id", F.col("score").alias("x"))
    found = exact_percentiles(values, ["dataset_id"], [1.0 - float(c) for c in contaminations])
    pairs = F.arrays_zip(levels.alias("contamination"), F.col("percentiles").alias("cut"))
    return settle(
        found.select("dataset_id", F.inline(pairs)).toDF("dataset_id", "contamination", "cut"), "cuts"
    )


def anomaly_labels(scores: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """(dataset_id, row_id, score, anomaly): strictly beyond the cut is anomalous."""
    cuts = score_cuts(scores, [contamination]).select("dataset_id", "cut")
    return scores.join(cuts, "dataset_id").select(
        "dataset_id", "row_id", "score", (F.col("score") > F.col("cut")).alias("anomaly")
    )


def anomaly_summary(
    labels: DataFrame, matrix: DataFrame, keys: DataFrame
) -> DataFrame:
    """Anomaly rate, score moments and accuracy proxy per dataset.

    The accuracy proxy is 1 − rate and hence mostly restates the
    contamination: without tied scores the rate is ⌈(n−1)·c⌉/n.
    """
    widths = matrix.groupBy("dataset_id").agg(F.max("n_features").alias("n_features"))
    rates = labels.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.avg(F.col("anomaly").cast("double")).alias("anomaly_rate"),
        F.avg("score").alias("anomaly_score_mean"),
        F.stddev_pop("score").alias("anomaly_score_std"),
    )
    return (
        keys.select("dataset_id")
        .join(rates, "dataset_id", "left")
        .join(widths, "dataset_id", "left")
        .select(
            "dataset_id",
            F.col("anomaly_rate").isNotNull().alias("applicable"),
            "anomaly_rate",
            "anomaly_score_mean",
            "anomaly_score_std",
            F.coalesce("n_records", F.lit(0).cast("long")).alias("n_records"),
            "n_features",
            (1 - F.col("anomaly_rate")).alias("accuracy_proxy"),
        )
    )


def contamination_sweep(
    scores: DataFrame, keys: DataFrame, contaminations: list[float] = CONTAMINATIONS
) -> DataFrame:
    """Anomaly rate per (dataset, contamination) from one set of scores.

    Datasets in ``keys`` that no forest applied to keep a row per
    contamination, not applicable and without a rate. Other columns of
    ``keys``, such as the sector, are carried along.
    """
    cuts = score_cuts(scores, contaminations)
    packed = settle(
        cuts.groupBy("dataset_id").agg(
            F.collect_list(F.struct("contamination", "cut")).alias("cuts")
        ),
        "packed-cuts",
    )
    beyond = F.transform(
        "cuts",
        lambda c: F.struct(
            c["contamination"].alias("contamination"),
            (F.col("score") > c["cut"]).cast("long").alias("hit"),
        ),
    )
    rates = (
        scores.join(packed, "dataset_id")
        .select("dataset_id", F.inline(beyond))
        .groupBy("dataset_id", "contamination")
        .agg(ratio(F.sum("hit"), F.count(F.lit(1))).alias("anomaly_rate"))
    )
    levels = F.array(*[F.lit(float(c)) for c in contaminations])
    return (
        keys.withColumn("contamination", F.explode(levels))
        .join(rates, ["dataset_id", "contamination"], "left")
        .withColumn("applicable", F.col("anomaly_rate").isNotNull())
    )


def rank_stability(
    sweep: DataFrame,
    baseline: float = CONTAMINATION,
    contaminations: list[float] = CONTAMINATIONS,
) -> DataFrame:
    """Spearman correlation of dataset ranks at each contamination with the baseline.

    Datasets lacking any rate are left out. Ties share their average rank,
    worked out on the distinct rates so that the windows hold one row per
    rate. The baseline reports 1.0; a constant side or fewer than two
    datasets leaves the correlation undefined.
    """
    complete = (
        sweep.where("anomaly_rate is not null")
        .groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") == len(contaminations))
        .select("dataset_id")
    )
    rates = sweep.join(complete, "dataset_id").select(
        "dataset_id", "contamination", "anomaly_rate"
    )
    running = Window.partitionBy("contamination").orderBy("anomaly_rate")
    ranks = (
        rates.groupBy("contamination", "anomaly_rate")
        .agg(F.count(F.lit(1)).alias("ties"))
        .select(
            "contamination",
            "anomaly_rate",
            (F.sum("ties").over(running) - (F.col("ties") - 1) / 2.0).alias("position"),
        )
    )
    ranked = rates.join(ranks, ["contamination", "anomaly_rate"])
    base = ranked.where(F.col("contamination") == F.lit(float(baseline))).select(
        "dataset_id", F.col("position").alias("base")
    )
    x, y = F.col("position"), F.col("base")
    moments = (
        ranked.join(base, "dataset_id")
        .groupBy("contamination")
        .agg(
            F.count(F.lit(1)).alias("n_datasets"),
            F.covar_pop(x, y).alias("together"),
            (F.stddev_pop(x) * F.stddev_pop(y)).alias("apart"),
        )
    )
    rho = F.when(F.col("n_datasets") > 1, F.try_divide(F.col("together"), F.col("apart")))
    return moments.select(
        "contamination",
        "n_datasets",
        F.when(F.col("contamination") == F.lit(float(baseline)), 1.0)
        .otherwise(rho)
        .alias("spearman"),
    )
