"""Clusters of datasets by their quality profile, and their projection."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.defaults import CLUSTER_COUNTS, INHERENT_DIMENSIONS, MIN_CLUSTERS, RESTARTS, SEED
from plumbline.operators.kmeans import Partition, fit_partitions, in_order, nearest
from plumbline.session import settle

# Executors need no installed copy of this package: kernels travel with tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BLOCK = 2048
_ROWS_PER_TASK = 100_000


def profile_vectors(scores: DataFrame, population: bool = False) -> DataFrame:
    """(dataset_id, features): z-scored completeness, consistency and uniqueness.

    Missing scores count as 0 and a constant feature is left at 0. Clustering
    uses the sample deviation, the projection the population one.
    """
    filled = scores.select(
        "dataset_id", *[F.coalesce(F.col(d), F.lit(0.0)).alias(d) for d in INHERENT_DIMENSIONS]
    )
    spread = F.stddev_pop if population else F.stddev_samp
    moments = filled.agg(
        *[F.avg(d).alias(f"mean_{d}") for d in INHERENT_DIMENSIONS],
        *[spread(d).alias(f"sd_{d}") for d in INHERENT_DIMENSIONS],
    ).withColumn("_one", F.lit(1))
    scaled = []
    for d in INHERENT_DIMENSIONS:
        sd = F.coalesce(F.col(f"sd_{d}"), F.lit(0.0))
        scaled.append((F.col(d) - F.col(f"mean_{d}")) / F.when(sd == 0, 1.0).otherwise(sd))
    return (
        filled.withColumn("_one", F.lit(1))
        .join(F.broadcast(moments), "_one")
        .select("dataset_id", F.array(*scaled).alias("features"))
    )


def _silhouette_block(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
    """Weighted distance sums from each point of one block to the clusters of another."""
    columns = ["vec_id", "candidate", "cluster", "total", "weight"]
    if mine.empty or theirs.empty:
        return pd.DataFrame(columns=columns, dtype=object)
    a = np.stack(mine["features"].to_numpy())
    b = np.stack(theirs["features"].to_numpy())
    weight = theirs["weight"].to_numpy()
    square = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    dist = np.sqrt(square)
    labels = np.stack(theirs["labels"].to_numpy())
    parts = []
    for candidate in range(labels.shape[1]):
        for cluster in np.unique(labels[:, candidate]):
            member = labels[:, candidate] == cluster
            parts.append(
                pd.DataFrame(
                    {
                        "vec_id": mine["vec_id"].to_numpy(),
                        "candidate": candidate,
                        "cluster": int(cluster),
                        "total": dist[:, member] @ weight[member],
                        "weight": int(weight[member].sum()),
                    }
                )
            )
    return pd.concat(parts, ignore_index=True)[columns]


def euclidean_silhouettes(points: DataFrame, n_points: int) -> DataFrame:
    """(candidate, silhouette): mean Euclidean silhouette of several partitions.

    ``points`` is (dataset_id, features, labels) with one label per candidate
    partition. Equal points collapse to one weighted point; pairs of point
    blocks meet in separate tasks, which return sums per cluster, so neither
    a pair nor the whole table is ever held in one place. A member of a
    singleton cluster scores 0; a partition with fewer than two clusters, or
    with as many as points, scores −1.
    """
    blocks = max(1, -(-n_points // _BLOCK))
    weighted = settle(
        points.groupBy("features", "labels")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("dataset_id").alias("vec_id"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")),
        "silhouette",
    )
    numbers = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    mine = weighted.select(
        F.col("block").alias("mine"), numbers.alias("theirs"), "vec_id", "features"
    )
    theirs = weighted.select(
        numbers.alias("mine"), F.col("block").alias("theirs"), "features", "labels", "weight"
    )
    sums = (
        mine.groupBy("mine", "theirs")
        .cogroup(theirs.groupBy("mine", "theirs"))
        .applyInPandas(
            _silhouette_block,
            "vec_id string, candidate int, cluster int, total double, weight long",
        )
        .groupBy("vec_id", "candidate", "cluster")
        .agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    )
    own = weighted.select(
        "vec_id",
        F.col("weight").alias("copies"),
        F.posexplode("labels").alias("candidate", "own"),
    )
    inside = F.col("cluster") == F.col("own")
    per_point = (
        sums.join(own, ["vec_id", "candidate"])
        .groupBy("vec_id", "candidate", "copies")
        .agg(
            F.max(F.when(inside, F.col("weight"))).alias("size"),
            F.max(F.when(inside, F.col("total"))).alias("inner"),
            F.min(F.when(~inside, F.col("total") / F.col("weight"))).alias("outer"),
        )
    )
    a = F.try_divide(F.col("inner"), F.col("size") - 1)
    b = F.col("outer")
    value = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    )
    defined = (F.count(b) > 0) & (F.sum("copies") > F.max("clusters"))
    clusters = own.groupBy("candidate").agg(F.count_distinct("own").alias("clusters"))
    mean = F.sum(value * F.col("copies")) / F.sum("copies")
    return (
        per_point.join(clusters, "candidate")
        .groupBy("candidate")
        .agg(F.when(defined, mean).otherwise(-1.0).alias("silhouette"))
    )


@dataclass
class QualityClusters:
    """The selected partition and the record of the choice."""

    k_selected: int
    silhouette: float
    silhouettes: dict[int, float]
    inertias: dict[int, float]
    centroids: list[list[float]]
    feature_names: list[str]
    labels: DataFrame

    def meta(self) -> DataFrame:
        """One row: k, silhouette, candidates, centroids and feature names."""
        candidates = [
            (k, float(self.inertias[k]), float(self.silhouettes[k])) for k in sorted(self.inertias)
        ]
        return self.labels.sparkSession.createDataFrame(
            [
                (
                    self.k_selected,
                    float(self.silhouette),
                    candidates,
                    self.centroids,
                    self.feature_names,
                )
            ],
            "k_selected int, silhouette double, "
            "candidates array<struct<k: int, inertia: double, silhouette: double>>, "
            "centroids array<array<double>>, feature_names array<string>",
        )


def _sampled_partitions(
    points: DataFrame, counts: list[int], restarts: int, seed: int, parallelism: int = 8
) -> dict[int, Partition]:
    """The cheapest of ``restarts`` fits of the evaluator's k-means for every k."""
    # A fixed order makes seeds repeatable.
    vectors = points.sortWithinPartitions("features").select(array_to_vector("features").alias("vector"), "weight")
    vectors = vectors.persist()

    def fit(task: tuple[int, int]):
        k, restart = task
        return KMeans(
            k=k,
            seed=seed + restart,
            featuresCol="vector",
            weightCol="weight",
            maxIter=300,
            tol=1e-6,
        ).fit(vectors)

    with ThreadPool(parallelism) as pool:
        models = pool.map(fit, [(k, r) for k in counts for r in range(restarts)], 1)
    vectors.unpersist()
    best = {}
    for i, k in enumerate(counts):
        model = min(models[i * restarts : (i + 1) * restarts], key=lambda m: m.summary.trainingCost)
        centres = [tuple(float(x) for x in c) for c in model.clusterCenters()]
        best[k] = Partition(in_order(centres), float(model.summary.trainingCost))
    return best


def quality_clusters(
    scores: DataFrame,
    counts: Iterable[int] = CLUSTER_COUNTS,
    *,
    min_k: int = MIN_CLUSTERS,
    restarts: int = RESTARTS,
    seed: int = SEED,
    method: str = "sampled",
) -> QualityClusters | None:
    """k-means over quality profiles for several k, best silhouette wins.

    Each k keeps the least-cost partition of ``restarts`` seeded runs, its
    clusters numbered in the order of their centroids. The choice is made
    among k ≥ ``min_k`` where there are any; None without candidates.

    ``method`` is ``sampled``, the ML evaluator's fits, which find the
    published local minima, or ``digests``, where all runs advance in one job
    per round and any engine can replay them (:mod:`kmeans`).
    """
    if method not in ("sampled", "digests"):
        raise ValueError(f"unknown method {method!r}")
    vectors = settle(profile_vectors(scores), "profiles")
    n_points = vectors.count()
    candidates = [k for k in counts if k < n_points]
    if not candidates:
        return None
    # Equal profiles weigh as one point.
    points = settle(
        vectors.groupBy("features")
        .agg(F.min("dataset_id").alias("point_id"), F.count(F.lit(1)).cast("double").alias("weight"))
        .repartitionByRange(max(1, n_points // _ROWS_PER_TASK), "features"),
        "points",
    )
    if method == "sampled":
        best = _sampled_partitions(points, candidates, restarts, seed)
    else:
        best = fit_partitions(points, candidates, restarts=restarts, seed=seed)
    labelled = settle(
        vectors.select(
            "dataset_id",
            "features",
            F.array(*[nearest("features", best[k].centres) for k in candidates]).alias("labels"),
        ),
        "clusters",
    )
    measured = euclidean_silhouettes(labelled, n_points).collect()
    silhouettes = {candidates[row["candidate"]]: row["silhouette"] for row in measured}
    inertias = {k: best[k].cost for k in candidates}
    pool_of_k = [k for k in candidates if k >= min_k] or candidates
    chosen = max(pool_of_k, key=lambda k: (round(silhouettes[k], 9), -k))
    position = candidates.index(chosen)
    return QualityClusters(
        k_selected=chosen,
        silhouette=silhouettes[chosen],
        silhouettes=silhouettes,
        inertias=inertias,
        centroids=[list(c) for c in best[chosen].centres],
        feature_names=list(INHERENT_DIMENSIONS),
        labels=labelled.select("dataset_id", F.col("labels")[position].alias("cluster")),
    )


def clustered_scores(
    scores: DataFrame, class_counts: DataFrame, clusters: QualityClusters
) -> DataFrame:
    """Scores with the column class counts and the cluster of each dataset."""
    return scores.join(class_counts, "dataset_id").join(clusters.labels, "dataset_id")


def project_profiles(scores: DataFrame) -> tuple[DataFrame, list[float]]:
    """First two principal components of the profiles and their variance shares.

    A component's sign is free; it is set so that its largest loading is
    positive.
    """
    vectors = profile_vectors(scores, population=True).select(
        "dataset_id", array_to_vector("features").alias("vector")
    )
    model = PCA(k=2, inputCol="vector", outputCol="components").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if column[np.abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    parts = vector_to_array("components")
    projected = model.transform(vectors).select(
        "dataset_id", (parts[0] * signs[0]).alias("pc1"), (parts[1] * signs[1]).alias("pc2")
    )
    return projected, [float(x) for x in model.explainedVariance]
