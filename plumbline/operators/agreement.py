"""Agreement of the two detectors, record by record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scoring import kappa_label, ratio


def _kappa(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Cohen's kappa of two flags from their counts; null when undefined."""
    a, b, both, n = (x.cast("double") for x in (a, b, both, n))
    observed = (n - a - b + 2 * both) / n
    expected = (a * b + (n - a) * (n - b)) / (n * n)
    return F.when(expected < 1, F.try_divide(observed - expected, 1 - expected))


def detector_agreement(
    anomalies: DataFrame, noise: DataFrame, sectors: DataFrame | None = None
) -> DataFrame:
    """Kappa and Jaccard of (anomaly, noise) flags per dataset.

    Takes (dataset_id, row_id, anomaly) and (dataset_id, row_id, noise) and
    pairs them by the full row key, in one shuffle. Datasets whose two label lists differ in
    length, or that only one detector covers, have no row.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = anomalies.select(
        "dataset_id", "row_id", F.col("anomaly").alias("flag"), one.alias("l"), none.alias("r")
    ).unionByName(
        noise.select("dataset_id", "row_id", F.col("noise").alias("flag"), none.alias("l"), one.alias("r"))
    )
    # One row for every key of either side; a key that repeats pairs all its rows, as a join does.
    flagged = F.col("flag").cast("long")
    keys = sides.groupBy("dataset_id", "row_id").agg(
        F.sum("l").alias("l"),
        F.sum("r").alias("r"),
        F.coalesce(F.sum(F.col("l") * flagged), none).alias("a"),
        F.coalesce(F.sum(F.col("r") * flagged), none).alias("b"),
    )

    def paired(x: str, y: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("row_id").isNotNull(), F.col(x) * F.col(y))), none)

    counted = (
        keys.groupBy("dataset_id")
        .agg(
            paired("a", "r").alias("if_anom_count"),
            paired("l", "b").alias("dbscan_noise_count"),
            paired("a", "b").alias("overlap"),
            paired("l", "r").alias("n_records"),
            F.sum("l").alias("n_left"),
            F.sum("r").alias("n_right"),
        )
        .where("dataset_id IS NOT NULL AND n_records > 0 AND n_left = n_records AND n_right = n_records")
    )
    return agreement_measures(counted, sectors)


def agreement_measures(counted: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """Kappa, Jaccard and the verbal strength from the four counts."""
    a, b, both, n = (
        F.col(c) for c in ("if_anom_count", "dbscan_noise_count", "overlap", "n_records")
    )
    measured = counted.select(
        "dataset_id",
        F.lit(True).alias("applicable"),
        _kappa(a, b, both, n).alias("kappa"),
        ratio(both, a + b - both).alias("jaccard"),
        "if_anom_count",
        "dbscan_noise_count",
        "overlap",
        "n_records",
    ).withColumn("kappa_interp", kappa_label(F.col("kappa")))
    return measured if sectors is None else with_sector(measured, sectors)


def with_sector(table: DataFrame, sectors: DataFrame) -> DataFrame:
    """Add the sector where a table lacks it; ``Unknown`` for strangers."""
    known = sectors.select("dataset_id", "sector").dropDuplicates(["dataset_id"])
    return table.join(known, "dataset_id", "left").fillna("Unknown", subset=["sector"])


def agreement_means(agreement: DataFrame) -> DataFrame:
    """Mean kappa and mean Jaccard over the datasets where they are defined."""
    return agreement.agg(
        F.avg("kappa").alias("mean_if_dbscan_kappa"),
        F.avg("jaccard").alias("mean_if_dbscan_jaccard"),
    )
