"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents and bytes a Python kernel takes at once.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20
#: Those of a window, for kernels that gain from seeing many texts at once.
WINDOW_ROWS, WINDOW_BYTES = 2000, 8 << 20


#: Rows and bytes of an Arrow batch between the JVM and a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that long texts fit in small workers.

    In a local session, also let Python workers find this package; on a
    cluster it is installed or shipped with the job.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, most)
    if spark.sparkContext.master.startswith("local"):
        root = str(Path(__file__).resolve().parents[2])
        spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(
    batch: pa.RecordBatch, column: str, rows: int = BATCH_ROWS, size: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of bounded rows and, over ``column``, bounded bytes.

    A value that is longer than the bound makes a slice of its own.
    """
    lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        n = int(n) if n == n else 0
        if i > start and (held + n > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def windows(
    batches: Iterator[pa.RecordBatch], column: str, rows: int = WINDOW_ROWS, size: int = WINDOW_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, several put together or one cut, within bounds as in :func:`slices`."""
    held, n_rows, n_bytes = [], 0, 0
    for batch in batches:
        more = batch.column(column).nbytes
        if held and (n_rows + batch.num_rows > rows or n_bytes + more > size):
            yield from slices(pa.concat_batches(held), column, rows, size)
            held, n_rows, n_bytes = [], 0, 0
        held.append(batch)
        n_rows, n_bytes = n_rows + batch.num_rows, n_bytes + more
    if held:
        yield from slices(pa.concat_batches(held), column, rows, size)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return batch.column(column).to_pylist()


def widened(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` followed by the fields of the DDL text ``more``."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])
