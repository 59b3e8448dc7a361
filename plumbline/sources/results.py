"""Result tables on disk: written for people as CSV or JSON, read back typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline import schemas

# Result tables that may be absent when there is nothing to report.
OPTIONAL_TABLES = {
    "if_dbscan_agreement": schemas.AGREEMENT,
    "gap_register": schemas.GAP_REGISTER,
    "kmeans_clusters": schemas.CLUSTERS,
}


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_audit(audit, folder: str) -> list[str]:
    """Write all result tables of an audit under one folder; return their names.

    Agreement, gap register and clusters are written only when they have rows.
    """
    folder = folder.rstrip("/")
    tables = {
        "dataset_scores": audit.scores,
        "if_contamination_sweep": audit.sweep,
        "sector_matrix": audit.sector_matrix,
        "band_sensitivity": audit.band_sensitivity,
        "band_sensitivity_per_dataset": audit.band_sensitivity_per_dataset,
        "sector_summary": audit.sector_summary,
    }
    if not audit.agreement.isEmpty():
        tables["if_dbscan_agreement"] = audit.agreement
    if not audit.gap_register.isEmpty():
        tables["gap_register"] = audit.gap_register
    records = {"headline": audit.headline}
    if audit.clusters is not None:
        tables["kmeans_clusters"] = audit.clustered
        records["kmeans_meta"] = audit.clusters.meta()
    for name, table in tables.items():
        write_csv(table, f"{folder}/{name}.csv")
    for name, record in records.items():
        write_json(record, f"{folder}/{name}.json")
    return sorted([*tables, *records])


def load_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Read result tables back; absent optional tables come back empty.

    Without dataset scores there is nothing to show, which is an error.
    """
    folder = folder.rstrip("/")
    if not _exists(spark, f"{folder}/dataset_scores.csv"):
        raise FileNotFoundError(f"no dataset_scores.csv under {folder}")
    tables = {
        "dataset_scores": read_csv(spark, f"{folder}/dataset_scores.csv", schemas.DATASET_SCORES),
        "if_contamination_sweep": read_csv(
            spark, f"{folder}/if_contamination_sweep.csv", schemas.SWEEP
        ),
    }
    for name, schema in OPTIONAL_TABLES.items():
        path = f"{folder}/{name}.csv"
        tables[name] = (
            read_csv(spark, path, schema)
            if _exists(spark, path)
            else spark.createDataFrame([], schema)
        )
    for name in ("sector_matrix", "sector_summary"):
        path = f"{folder}/{name}.csv"
        if _exists(spark, path):
            tables[name] = spark.read.option("header", True).csv(path)
    if _exists(spark, f"{folder}/headline.json"):
        tables["headline"] = spark.read.json(f"{folder}/headline.json")
    return tables


def load_metadata(inventory: DataFrame, dataset_id: str) -> DataFrame:
    """What a loader reports about one file, stamped with the load time."""
    return inventory.where(F.col("dataset_id") == dataset_id).select(
        "encoding", "delimiter", "rows", "cols", F.current_timestamp().alias("loaded_at")
    )
