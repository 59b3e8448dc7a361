"""Audit of a catalogue of delimited files, one dataset per file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.defaults import AUDIT_DATE, CONTAMINATION, SECTOR_FOLDERS
from plumbline.operators.density import DensityNoise
from plumbline.operators.dimensions import (
    completeness_from,
    consistency_from,
    timeliness,
    uniqueness_from,
)
from plumbline.operators.isolation import anomaly_labels, isolation_scores
from plumbline.operators.profile import class_counts, dataset_shape
from plumbline.plans.audit import Audit, dataset_scores
from plumbline.session import settle
from plumbline.sources.catalogue import scan_catalogue
from plumbline.sources.delimited import (
    cell_classes,
    cell_matrix,
    cell_row_counts,
    cell_stats,
    read_cells,
    sniff_files,
)


@dataclass
class LoadedCatalogue:
    """Parsed files and their profile, each worked out once."""

    files: DataFrame
    cells: DataFrame
    stats: DataFrame
    classes: DataFrame

    @property
    def keys(self) -> DataFrame:
        return self.files.where("load_ok").select("dataset_id", "sector", "file_name")

    @property
    def shape(self) -> DataFrame:
        return dataset_shape(self.stats, self.keys.select("dataset_id"))

    def inventory(self) -> DataFrame:
        """One row per file; files that did not load carry the error instead."""
        counts = class_counts(self.classes, self.keys)
        joined = (
            self.files.join(self.shape, "dataset_id", "left")
            .join(counts, "dataset_id", "left")
            .select(*schemas.INVENTORY.names)
        )
        return joined.orderBy("dataset_id")


def load_catalogue(
    spark: SparkSession, root: str, sectors: list[tuple[str, str, str]] = SECTOR_FOLDERS
) -> LoadedCatalogue:
    """Scan, sniff, parse and profile every file below ``root``."""
    files = sniff_files(spark, scan_catalogue(spark, root, sectors))
    cells = read_cells(spark, files)
    stats = settle(cell_stats(cells, files), "cell-stats")
    return LoadedCatalogue(files, cells, stats, settle(cell_classes(cells, stats), "cell-classes"))


def audit_files(
    spark: SparkSession,
    root: str,
    sectors: list[tuple[str, str, str]] = SECTOR_FOLDERS,
    *,
    audit_date: str = AUDIT_DATE,
    contamination: float = CONTAMINATION,
) -> tuple[LoadedCatalogue, Audit]:
    """The whole audit of a file catalogue; file times stand in for updates."""
    loaded = load_catalogue(spark, root, sectors)
    keys = loaded.keys.select("dataset_id")
    matrix = settle(cell_matrix(loaded.cells, loaded.stats), "matrix")
    anomaly_scores = settle(isolation_scores(matrix), "anomaly-scores")
    noise = DensityNoise(matrix)
    rates = (
        anomaly_labels(anomaly_scores, contamination)
        .groupBy("dataset_id")
        .agg(F.avg(F.col("anomaly").cast("double")).alias("anomaly_rate"))
    )
    updates = loaded.files.where("load_ok").select(
        "dataset_id", F.col("modified").alias("last_update")
    )
    scores = dataset_scores(
        loaded.keys,
        loaded.shape,
        completeness_from(loaded.stats, keys)[0],
        consistency_from(loaded.stats, keys)[0],
        uniqueness_from(cell_row_counts(loaded.cells, loaded.stats), keys),
        timeliness(updates, audit_date, 365),
        rates,
        noise.summary(keys, clusters=False),
    )
    audit = Audit(
        scores=settle(scores, "scores"),
        classes=loaded.classes,
        anomaly_scores=anomaly_scores,
        noise=noise,
        catalogue=loaded.keys,
    )
    return loaded, audit
