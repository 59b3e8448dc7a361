"""Shared-folder helpers: where intermediate tables go and how they are cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder the cluster names in ``spark.checkpoint.dir``.

    A local-mode session without that setting uses its own warehouse folder.
    On a cluster the setting is required: a machine-local folder would vanish
    with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = configured or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def tables_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/plumbline/{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{tables_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the table.

    Used where several consumers need the same intermediate rows: the work is
    done once, the lineage is short, the size is known to the planner, and a
    lost executor costs a re-read rather than a recomputation. With ``by``,
    rows of one value of that column are read without the others.
    """
    path = new_table_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables :func:`settle` wrote for this application.

    Tables of other sessions in the same shared folder stay.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(tables_folder(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(root, True)
