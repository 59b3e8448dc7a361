"""Token ids in files of Huffman-coded blocks.

Codes are canonical and length-limited, made from the corpus' own counts. A
block holds consecutive whole documents, its ids' codes as one bit string, and
the bit offset of every 64th id, so that any block is read without another
and a reader can start at many places of it at once: decoding looks up the
next bits of all these places in one table, step by step.

A folder holds ``blocks`` (Parquet, sorted by first document within a file and
from file to file), ``codebook`` (id, code length) and ``index`` (ids before
each block).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import slices
from plumbline.llm.tokenizing import END_ID, TokenizerFile, encoded, vocabulary_size
from plumbline.session import settle

MAX_BITS = 18
BLOCK_IDS = 1 << 16
CHECKPOINT_IDS = 64
#: Bytes of ids that go to one file, about.
FILE_BYTES = 64 << 20


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of the best prefix code of at most ``max_bits``, by package-merge.

    ``counts`` are positive. The code is optimal among all so limited.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need more than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        levels.append(rank >= n)  # at which places of the merged row packages are
        row = both[rank]
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_package in reversed(levels):
        taken = int(is_package[:take].sum())
        lengths[: take - taken] += 1
        take = 2 * taken
    out = np.empty(n, np.uint8)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then of place."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, before = 0, 0
    sizes = lengths[order].astype(int).tolist()
    for at, size in zip(order.tolist(), sizes):
        code <<= size - before
        codes[at] = code
        code, before = code + 1, size
    return codes


class Code:
    """Coder and decoder of the symbols (ids, code lengths) of a codebook."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.lengths = ids[order].astype(np.uint32), lengths[order].astype(np.uint8)
        self.codes = canonical_codes(self.lengths)
        self.bits = int(self.lengths.max(initial=1))
        first = self.codes.astype(np.int64) << (self.bits - self.lengths.astype(np.int64))
        self._symbol = np.zeros(1 << self.bits, np.uint32)
        self._length = np.ones(1 << self.bits, np.uint8)
        by_code = np.argsort(first)
        spans = 1 << (self.bits - self.lengths[by_code].astype(np.int64))
        used = int(spans.sum())
        self._symbol[:used] = np.repeat(self.ids[by_code], spans)
        self._length[:used] = np.repeat(self.lengths[by_code], spans)
        self._place = np.zeros(int(self.ids.max(initial=0)) + 1, np.int64)
        self._place[self.ids] = np.arange(len(self.ids))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string of ``ids`` and the offsets of every 64th."""
        at = self._place[ids]
        sizes = self.lengths[at].astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1]) if len(ids) else 0
        word, shift = starts >> 5, 64 - (starts & 31) - sizes
        wide = self.codes[at].astype(np.uint64) << shift.astype(np.uint64)
        n_words = (total >> 5) + 2
        high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n_words)
        low = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
        packed = (high + low).astype(np.uint64).astype(">u4").tobytes()
        return packed[: (total + 7) // 8], starts[::CHECKPOINT_IDS]

    def decode(self, bits: bytes, checkpoints: np.ndarray, n_ids: int) -> np.ndarray:
        raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        # The 32 bits from each byte on; a code starts within the first 8 of them.
        ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        lanes = np.asarray(checkpoints, np.int64).copy()
        out = np.zeros((len(lanes), CHECKPOINT_IDS), np.uint32)
        down, mask = np.int64(32 - self.bits), np.uint32((1 << self.bits) - 1)
        last = len(ahead) - 1
        for step in range(min(CHECKPOINT_IDS, n_ids)):
            byte = np.minimum(lanes >> 3, last)
            key = ahead[byte] >> (down - (lanes & 7)).astype(np.uint32) & mask
            out[:, step] = self._symbol[key]
            lanes += self._length[key]
        return out.reshape(-1)[:n_ids]


@lru_cache(maxsize=2)
def _code(ids: bytes, lengths: bytes) -> Code:
    return Code(np.frombuffer(ids, "<u4"), np.frombuffer(lengths, np.uint8))


def id_counts(tokens: DataFrame, id_bytes: int = 4) -> DataFrame:
    """(id, n) over all ``ids`` of ``tokens``; counted within tasks first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for piece in slices(batch, "ids"):
                joined = b"".join(piece.column("ids").to_pylist())
                part = np.bincount(np.frombuffer(joined, f"<u{id_bytes}"))
                if len(part) > len(total):
                    part[: len(total)] += total
                    total = part
                else:
                    total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"]
        )

    parts = tokens.select("ids").mapInArrow(kernel, "id long, n long")
    return parts.groupBy("id").agg(F.sum("n").alias("n"))


_BLOCKS = (
    "file long, block long, n_ids long, bits binary, checkpoints array<long>, "
    "ids array<{id}>, lengths array<long>"
)


def _spark_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def write_token_files(
    docs: DataFrame,
    path: str,
    file: TokenizerFile,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    max_bits: int = MAX_BITS,
) -> None:
    """Write ``docs`` as token files under ``path``, in ascending order of id.

    Null texts are empty (their end id is written), null ids come first, and
    rows with equal ids stay next to each other in any order.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_bytes = 2 if vocabulary_size(file) <= 1 << 16 and end_id < 1 << 16 else 4
    tokens = settle(encoded(source, file, ["id"], "text", end_id, id_bytes), "tokens")
    book = id_counts(tokens, id_bytes).orderBy("id").toPandas()  # no longer than the vocabulary
    lengths = code_lengths(book["n"].to_numpy(), max_bits)
    spark.createDataFrame(
        [(int(i), int(n)) for i, n in zip(book["id"], lengths)], "id long, bits int"
    ).coalesce(1).write.parquet(f"{path}/codebook")
    size = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    files = max(1, int(4 * size // FILE_BYTES))
    key = (book["id"].to_numpy().astype("<u4").tobytes(), lengths.tobytes())
    id_type = docs.schema[id_col].dataType

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, at, held, n, own = _code(*key), TaskContext.get().partitionId(), [], 0, 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), f"<u{id_bytes}")
            bits, checkpoints = code.encode(ids)
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "file": at,
                        "block": own,
                        "n_ids": len(ids),
                        "bits": bits,
                        "checkpoints": checkpoints.tolist(),
                        "ids": [i for i, _ in held],
                        "lengths": [len(x) // id_bytes for _, x in held],
                    }
                ],
                schema=schema,
            )

        schema = None
        for batch in batches:
            schema = schema or pa.schema(
                [
                    ("file", pa.int64()),
                    ("block", pa.int64()),
                    ("n_ids", pa.int64()),
                    ("bits", pa.binary()),
                    ("checkpoints", pa.list_(pa.int64())),
                    ("ids", pa.list_(batch.schema.field("id").type)),
                    ("lengths", pa.list_(pa.int64())),
                ]
            )
            for i, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                held.append((i, ids))
                n += len(ids) // id_bytes
                if n >= BLOCK_IDS:
                    yield block()
                    held, n, own = [], 0, own + 1
        if held:
            yield block()

    blocks = (
        tokens.select("id", "ids")
        .repartitionByRange(files, "id")
        .sortWithinPartitions("id")
        .mapInArrow(kernel, _BLOCKS.format(id=id_type.simpleString()))
    )
    blocks.write.parquet(f"{path}/blocks")
    # Blocks before a block, within its file and in all files before.
    sizes = spark.read.parquet(f"{path}/blocks").select("file", "block", "n_ids")
    totals = sizes.groupBy("file").agg(F.sum("n_ids").alias("n"))
    earlier_files = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "file", F.coalesce(F.sum("n").over(earlier_files), F.lit(0)).alias("file_start")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("in_file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(
        starts, "file"
    ).select("file", "block", (F.col("file_start") + F.col("in_file")).alias("start")).write.parquet(
        f"{path}/index"
    )


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document, decoded from the files."""
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").toPandas()
    key = (book["id"].to_numpy().astype("<u4").tobytes(), book["bits"].to_numpy().astype(np.uint8).tobytes())
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["ids"].dataType.elementType

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code(*key)
        for batch in batches:
            for row in range(batch.num_rows):
                x = {name: batch.column(name)[row] for name in batch.schema.names}
                lengths = x["lengths"].values.to_numpy()
                ids = code.decode(
                    x["bits"].as_py(), x["checkpoints"].values.to_numpy(), x["n_ids"].as_py()
                ).astype("<u4")
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        x["ids"].values,
                        pa.array(np.full(len(lengths), x["file"].as_py()), pa.int64()),
                        pa.array(np.full(len(lengths), x["block"].as_py()), pa.int64()),
                        pa.array(ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())], pa.binary()),
                        pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64()),
                    ],
                    names=["id", "file", "block", "in_block", "n_tokens", "ids", "ids_crc32"],
                )

    decoded = blocks.mapInArrow(
        kernel,
        f"id {kind.simpleString()}, file long, block long, in_block long, n_tokens long, ids binary, ids_crc32 long",
    )
    index = spark.read.parquet(f"{path}/index")
    return decoded.join(index, ["file", "block"]).select(
        F.col("id").alias(id_col),
        (F.col("start") + F.col("in_block")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "ids",
    )
