"""The whole audit: from rows to dataset scores and everything built on them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.defaults import AUDIT_DATE, CONTAMINATION, CONTAMINATIONS, SEED
from plumbline.operators.agreement import agreement_means, detector_agreement
from plumbline.operators.clustering import QualityClusters, clustered_scores, quality_clusters
from plumbline.operators.density import DensityNoise
from plumbline.operators.dimensions import (
    completeness_from,
    consistency_from,
    last_updates,
    timeliness,
    uniqueness,
)
from plumbline.operators.isolation import (
    anomaly_labels,
    contamination_sweep,
    isolation_scores,
    rank_stability,
)
from plumbline.operators.matrix import numeric_matrix
from plumbline.operators.profile import (
    class_counts,
    column_classes,
    column_stats,
    dataset_keys,
    dataset_shape,
    measured_columns,
)
from plumbline.plans import compliance, portfolio
from plumbline.session import drop_tables, settle


def dataset_scores(
    catalogue: DataFrame,
    shape: DataFrame,
    completeness: DataFrame,
    consistency: DataFrame,
    uniqueness: DataFrame,
    timeliness: DataFrame | None = None,
    anomalies: DataFrame | None = None,
    noise: DataFrame | None = None,
) -> DataFrame:
    """Join the measures of every dataset of the catalogue and score them.

    ``catalogue`` is (dataset_id, sector, file_name); ``anomalies`` needs
    (dataset_id, anomaly_rate) and ``noise`` (dataset_id, noise_rate). Each
    input holds one row per dataset.
    """
    table = (
        catalogue.select("dataset_id", "sector", "file_name")
        .join(shape, "dataset_id")
        .join(completeness.select("dataset_id", "completeness"), "dataset_id")
        .join(consistency.select("dataset_id", "consistency"), "dataset_id")
        .join(uniqueness.select("dataset_id", "uniqueness"), "dataset_id")
    )
    optional = [
        (timeliness, "timeliness", "timeliness"),
        (anomalies, "anomaly_rate", "if_anomaly_rate"),
        (noise, "noise_rate", "db_noise_rate"),
    ]
    for source, name, target in optional:
        if source is None:
            table = table.withColumn(target, F.lit(None).cast("double"))
        else:
            column = F.col(name).cast("double").alias(target)
            table = table.join(source.select("dataset_id", column), "dataset_id", "left")
    scored = portfolio.composites(
        table.withColumns(
            {
                "accuracy": 1 - F.col("if_anomaly_rate"),
                "if_applicable": F.col("if_anomaly_rate").isNotNull(),
                "db_applicable": F.col("db_noise_rate").isNotNull(),
            }
        )
    )
    return scored.select(*schemas.DATASET_SCORES.names)


@dataclass
class Audit:
    """Results of one audit; later tables are built when first asked for."""

    scores: DataFrame
    classes: DataFrame
    anomaly_scores: DataFrame
    noise: DensityNoise
    catalogue: DataFrame
    cluster_method: str = "sampled"

    def close(self) -> None:
        """Delete the tables that this application wrote in the shared folder.

        The results here are among them; other applications' tables stay.
        """
        drop_tables(self.scores.sparkSession)

    @cached_property
    def sweep(self) -> DataFrame:
        keys = self.catalogue.select("dataset_id", "sector")
        swept = contamination_sweep(self.anomaly_scores, keys, CONTAMINATIONS)
        return settle(swept.select(*schemas.SWEEP.names), "sweep")

    @cached_property
    def stability(self) -> DataFrame:
        return rank_stability(self.sweep)

    @cached_property
    def agreement(self) -> DataFrame:
        labels = anomaly_labels(self.anomaly_scores)
        table = detector_agreement(labels, self.noise.labels(), self.catalogue)
        return settle(table.select(*schemas.AGREEMENT.names), "agreement")

    @cached_property
    def clusters(self) -> QualityClusters | None:
        return quality_clusters(self.scores, method=self.cluster_method)

    @cached_property
    def clustered(self) -> DataFrame:
        return clustered_scores(self.scores, class_counts(self.classes, self.catalogue), self.clusters)

    @cached_property
    def gaps(self) -> DataFrame:
        return compliance.gap_report(self.scores)

    @cached_property
    def sector_matrix(self) -> DataFrame:
        return compliance.sector_matrix(self.gaps)

    @cached_property
    def gap_register(self) -> DataFrame:
        return compliance.gap_register(self.gaps)

    @cached_property
    def headline(self) -> DataFrame:
        return portfolio.headline(
            self.scores,
            agreement_means=agreement_means(self.agreement),
            stability=self.stability,
        )

    @cached_property
    def sector_summary(self) -> DataFrame:
        return portfolio.sector_summary(self.scores)

    @cached_property
    def band_sensitivity(self) -> DataFrame:
        return portfolio.band_sensitivity(self.scores)

    @cached_property
    def band_sensitivity_per_dataset(self) -> DataFrame:
        return portfolio.band_sensitivity_per_dataset(self.scores)


def inherent_scores(
    df: DataFrame,
    catalogue: DataFrame,
    by: str | None = None,
    columns: list[str] | None = None,
    *,
    updates: DataFrame | None = None,
    audit_date: str = AUDIT_DATE,
    anomalies: DataFrame | None = None,
    noise: DataFrame | None = None,
) -> DataFrame:
    """Dataset scores of a typed frame; detector rates are passed in.

    The catalogue is written once, as its keys are wanted by every dimension
    and may themselves come from the data.
    """
    names = [name for name, _ in measured_columns(df, by, columns)]
    catalogue = settle(catalogue.select("dataset_id", "sector", "file_name"), "catalogue")
    keys = catalogue.select("dataset_id")
    stats = settle(column_stats(df, by, names), "stats")
    timely = None
    if updates is not None:
        known = keys.join(updates, "dataset_id", "left")
        timely = timeliness(known, audit_date)
    return dataset_scores(
        catalogue,
        dataset_shape(stats, keys, len(names)),
        completeness_from(stats, keys)[0],
        consistency_from(stats, keys)[0],
        uniqueness(df, by, names, keys),
        timely,
        anomalies,
        noise,
    )


def audit(
    df: DataFrame,
    row_id: str,
    by: str | None = None,
    columns: list[str] | None = None,
    *,
    catalogue: DataFrame | None = None,
    features: list[str] | None = None,
    timestamp: str | None = None,
    audit_date: str = AUDIT_DATE,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> Audit:
    """Audit every slice of a typed frame in one chain of jobs.

    All columns but ``by`` are measured, the row id too, unless ``columns``
    names others.

    ``catalogue`` (dataset_id, sector, file_name) names the datasets,
    including those without rows; by default every value of ``by`` is one.
    """
    if catalogue is None:
        catalogue = dataset_keys(df, by).select(
            "dataset_id",
            F.lit("Unknown").alias("sector"),
            F.col("dataset_id").alias("file_name"),
        )
    catalogue = settle(catalogue.select("dataset_id", "sector", "file_name"), "catalogue")
    names = [name for name, _ in measured_columns(df, by, columns)]
    matrix = settle(
        numeric_matrix(df, row_id, by, features or names), "matrix"
    )
    anomaly_scores = settle(isolation_scores(matrix, seed=seed), "anomaly-scores")
    noise = DensityNoise(matrix)
    rates = (
        anomaly_labels(anomaly_scores, contamination)
        .groupBy("dataset_id")
        .agg(F.avg(F.col("anomaly").cast("double")).alias("anomaly_rate"))
    )
    scores = inherent_scores(
        df,
        catalogue,
        by,
        names,
        updates=last_updates(df, timestamp, by) if timestamp else None,
        audit_date=audit_date,
        anomalies=rates,
        noise=noise.summary(catalogue, clusters=False),
    )
    return Audit(
        scores=settle(scores, "scores"),
        classes=settle(column_classes(df, row_id, by, names), "classes"),
        anomaly_scores=anomaly_scores,
        noise=noise,
        catalogue=catalogue,
    )
