"""Catalogue of delimited files: identity, metadata, manifest check.

The metadata columns of the binary file source need no file contents, so the
catalogue listing prunes them; only the digest reads the bytes.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.defaults import SECTOR_FOLDERS
from plumbline.sources.streamed import STREAMED_BYTES, streamed_files


_LISTING = (
    "sector string, prefix string, file_path string, source string, file_name string, "
    "size_bytes long, modified timestamp"
)


def _empty_files(spark: SparkSession, folder: str) -> list[tuple] | None:
    """(path, name, modified) of the zero-byte CSV files of a folder, which
    Spark's file sources leave out; None if the folder does not exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [f for f in fs.listStatus(path) if f.getLen() == 0 and f.isFile()]
    named = [(f.getPath().toString(), f.getPath().getName(), f.getModificationTime()) for f in found]
    return [
        (path, name, datetime.fromtimestamp(millis / 1000))
        for path, name, millis in named
        if name.lower().endswith(".csv")
    ]


def scan_catalogue(
    spark: SparkSession,
    root: str,
    sectors: list[tuple[str, str, str]] = SECTOR_FOLDERS,
) -> DataFrame:
    """(dataset_id, sector, file_name, file_path, source, size_bytes, size_kb, modified).

    Takes the ``.csv`` files directly inside each sector folder, whatever the
    case of the suffix; sector folders that do not exist are skipped. Ids are
    the sector prefix and the 1-based place in file name order within the
    sector. A file keeps its place even if it later fails to load. ``source``
    is the path as Spark's file metadata spells it, the key of later joins.
    """
    root = root.rstrip("/")
    empty, parts = [], None
    for sector, folder, prefix in sectors:
        blank = _empty_files(spark, f"{root}/{folder}")
        if blank is None:
            continue
        empty += [(sector, prefix, path, None, name, 0, time) for path, name, time in blank]
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.[cC][sS][vV]")
            .load(f"{root}/{folder}")
            .select(
                F.lit(sector).alias("sector"),
                F.lit(prefix).alias("prefix"),
                F.col("path").alias("file_path"),
                F.col("_metadata.file_path").alias("source"),
                F.element_at(F.split(F.col("path"), "/"), -1).alias("file_name"),
                F.col("length").alias("size_bytes"),
                F.col("modificationTime").alias("modified"),
            )
        )
        parts = files if parts is None else parts.unionByName(files)
    if parts is None:
        raise ValueError(f"no sector folder under {root}")
    if empty:
        parts = parts.unionByName(spark.createDataFrame(empty, _LISTING))
    place = F.row_number().over(Window.partitionBy("sector").orderBy("file_name"))
    return parts.withColumn("place", place).select(
        F.format_string("%s-%02d", "prefix", "place").alias("dataset_id"),
        "sector",
        "file_name",
        "file_path",
        "source",
        "size_bytes",
        F.bround(F.col("size_bytes") / 1024, 1).alias("size_kb"),
        "modified",
    )


def file_digests(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(file_path, sha256) of every CSV file in the folders."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .load(folders)
        .select(
            F.col("path").alias("file_path"), "length", "content", F.col("_metadata.file_path").alias("source")
        )
    )
    digests = ["file_path", F.sha2("content", 256).alias("sha256")]
    streamed, uncut = streamed_files(spark, folders)
    found = listed.where(F.col("length") < STREAMED_BYTES).select(*digests)
    if streamed is None:
        return found
    large = listed.where(F.col("length") >= STREAMED_BYTES)
    found = found.unionByName(large.select("file_path", "source").join(streamed, "source").select("file_path", "sha256"))
    return found.unionByName(large.where(F.col("source").isin(uncut)).select(*digests)) if uncut else found


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, manifest_path) from lines of a digest, blanks and a path."""
    line = spark.read.text(path).select(
        F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$", 1).alias("sha256"),
        F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$", 2).alias("manifest_path"),
    )
    return line.where("sha256 != ''").withColumn("sha256", F.lower("sha256"))


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """ok, changed, missing or extra for every path on either side.

    ``files`` is (manifest_path, sha256), the path as the manifest spells it.
    """
    left = files.select("manifest_path", F.col("sha256").alias("found"))
    right = manifest.select("manifest_path", F.col("sha256").alias("expected"))
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("expected").isNull(), "extra")
        .when(F.col("found") == F.col("expected"), "ok")
        .otherwise("changed")
    )
    return right.join(left, "manifest_path", "full").withColumn("status", status)


def identical_files(files: DataFrame) -> DataFrame:
    """Digests shared by several files, with the number of copies."""
    return (
        files.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("manifest_path").alias("first_path"))
        .where("copies > 1")
    )
