"""Near-duplicates by 64-bit SimHash fingerprints at a small Hamming distance.

A fingerprint is embedded as its bit counts over 16 segments of four bits.
The Manhattan distance of two such points never exceeds the Hamming distance,
so fingerprints within two bits lie within Manhattan distance two, and then
share a grid cell at distance one at most from both. Every distinct
fingerprint is therefore sent to its own cell and the up to 32 next ones, and
those that meet are verified bit by bit.

A cell that many distinct fingerprints share would make quadratic work. Its
members are linked by a second exact way: each is sent to itself and its 64
one-bit neighbours, and all that meet there (65 at most) are within two bits
of one another by construction, so a star links them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, slices, text_or_empty, widened
from plumbline.operators.components import components
from plumbline.session import settle

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_DISTANCE = 2  # the grid and the one-bit neighbours are made for two bits
SEGMENTS, SEGMENT_BITS = 16, 4
#: Distinct fingerprints of a cell that are compared pair by pair.
CELL_PAIRS_UP_TO = 24
_BITS_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of UTF-8 ``text``; 0 if it has no words.

    Bytes ``lower`` and ``split`` touch ASCII only: A-Z, and the white space
    of ``[\\x20\\x09-\\x0D]``.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [
            digest(joined[s:e], HASH_SEED)
            for s, e in zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist())
        ],
        dtype="<u8",
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BITS_AT_ONCE):
        part = hashes[at : at + _BITS_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    packed = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``fp`` of every document; null text is empty."""
    source = docs.select(*keep, text_or_empty(text_col).cast("binary").alias("_bytes"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_bytes"):
                found = [fingerprint(x.as_py()) for x in part.column("_bytes")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(found, pa.int64())],
                    names=[*keep, "fp"],
                )

    return source.mapInArrow(kernel, widened(source.select(*keep), "fp long"))


def _counts(fp: Column) -> list[Column]:
    mask = (1 << SEGMENT_BITS) - 1
    return [
        F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(F.lit(mask)))
        for i in range(SEGMENTS)
    ]


def grid_cells(fp: Column) -> Column:
    """Cells of the point of ``fp`` and of all points next to it."""
    counts = _counts(fp)
    own = sum((F.shiftleft(c.cast("long"), 3 * i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    near = []
    for i, c in enumerate(counts):
        near.append(F.when(c < SEGMENT_BITS, own + (1 << 3 * i)))
        near.append(F.when(c > 0, own - (1 << 3 * i)))
    return F.filter(F.array(own, *near), lambda x: x.isNotNull())


def one_bit_neighbours(fp: Column) -> Column:
    flips = [F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)]
    return F.array(fp, *(fp.bitwiseXOR(flip) for flip in flips))


def fingerprint_links(
    fps: DataFrame, cell_pairs_up_to: int = CELL_PAIRS_UP_TO
) -> DataFrame:
    """(a, b): links that join all distinct ``fp`` within two bits of each other.

    Every link is a verified pair; the pairs that hold and are not listed are
    joined through others that are.
    """
    cells = settle(fps.select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell")), "cells")
    sizes = cells.groupBy("cell").count().where("count > 1")
    shared = settle(cells.join(sizes.hint("merge"), "cell"), "shared-cells")
    members = (
        shared.where(F.col("count") <= cell_pairs_up_to)
        .groupBy("cell")
        .agg(F.collect_list("fp").alias("fps"))
    )
    pairs = (
        members.select("fps", F.explode("fps").alias("a"))
        .select(
            "a",
            F.explode(
                F.filter(
                    "fps",
                    lambda b: (b > F.col("a"))
                    & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= MAX_DISTANCE),
                )
            ).alias("b"),
        )
        .distinct()
    )
    crowded = shared.where(F.col("count") > cell_pairs_up_to).select("fp").distinct()
    meetings = (
        crowded.select("fp", F.explode(one_bit_neighbours(F.col("fp"))).alias("key"))
        .groupBy("key")
        .agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps"))  # 65 at most
        .where(F.size("fps") > 1)
    )
    stars = meetings.select("a", F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(stars)


def near_duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    cell_pairs_up_to: int = CELL_PAIRS_UP_TO,
) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` and ``component_id``.

    Documents link when their fingerprints differ in two bits at most; the
    component's id is its smallest document id (null only if all are null).
    Texts without words have fingerprint zero and link like any other. Rows
    repeated in ``docs`` are repeated in the result.
    """
    found = settle(
        fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), f"`{text_col}`"), ["id"], text_col),
        "fingerprints",
    )
    fps = settle(found.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = components(fingerprint_links(fps.select("fp"), cell_pairs_up_to))
    rooted = settle(
        fps.join(roots.hint("merge"), fps.fp == roots.node, "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "rooted-fingerprints",
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = settle(rooted.join(smallest.hint("merge"), "root").select("fp", "component_id"), "classes")
    return found.join(named.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each_class(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The document with the smallest id of every class, with all its columns.

    Rows without an id come last; of rows with equal ids, the first stays.
    """
    uid = free_name(docs, "uid")
    numbered = settle(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    place = F.struct(
        F.col(f"`{id_col}`").isNull().alias("last"), F.col(f"`{id_col}`").alias("id"), F.col(uid).alias("row")
    )
    classes = near_duplicate_classes(
        numbered.select(place.alias("place"), F.col(f"`{text_col}`").alias("text")), "place"
    )
    dropped = classes.where("place <> component_id").select(F.col("place.row").alias(uid))
    return numbered.join(dropped, uid, "left_anti").drop(uid)
