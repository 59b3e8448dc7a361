"""Best-fit packing of token pieces into sequences, hierarchically.

Pieces are dealt to groups of bounded size and packed there by best fit, the
longest first. Best fit leaves at most one bin a group that is half empty or
more; only such light bins, and the few emptiest of the others, which could
take them, go on. They are the items of the next round, in which several
groups become one, until a single group is left. All other bins are final, so
rounds shrink by a constant factor and the last one holds a few bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_or_empty, texts, widened, windows
from plumbline.llm.tokenizing import END_ID, TokenizerFile, encoder
from plumbline.session import settle

CAPACITY = 1024
#: Pieces of a group of the first round, about.
GROUP_ITEMS = 200_000
#: Groups that become one in the next round.
FAN_IN = 8

_BINS = "id long, fill int, final boolean, pids array<long>, offsets array<int>, grp long"


def pieces(
    docs: DataFrame,
    file: TokenizerFile,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of every document, with ``pid``.

    A document longer than ``capacity`` is cut from its end, so that only its
    first piece can be shorter. Null texts are empty: their one piece is the
    end id. The table is written; ``pid`` numbers its rows.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("_text"))
    end = np.array([end_id], "<u4").tobytes()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file).encode
        for part in windows(batches, "_text"):
            rows, cut = [], []
            for row, ids in enumerate(encode(texts(part, "_text"))):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                edges = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    one = ids[4 * a : 4 * b]
                    rows.append(row)
                    cut.append((k, a, b - a, zlib.crc32(one), one))
            columns = list(zip(*cut)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(rows, pa.int64())),
                    *(pa.array(c, kind) for c, (_, kind) in zip(columns, fields)),
                ],
                names=["id", *(name for name, _ in fields)],
            )

    schema = widened(
        source.select("id"), "piece int, start long, length long, ids_crc32 long, ids binary"
    )
    found = source.mapInArrow(kernel, schema)
    return settle(found.withColumn("pid", F.monotonically_increasing_id()), "pieces")


def best_fit(fills: list[int], capacity: int) -> list[list[int]]:
    """Bins, as lists of places in ``fills``, which must be in falling order.

    Every item goes to the fullest bin that has room for it.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for i, fill in enumerate(fills):
        wide = rooms >> fill
        if wide:
            room = fill + (wide & -wide).bit_length() - 1
            stack = by_room[room]
            at = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        left = room - fill
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


def _pack_group(capacity: int, fan_in: int):
    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        fill = table.column("fill").to_numpy()
        order = np.lexsort((ids, -fill))
        pids, offsets = table.column("pids").to_pylist(), table.column("offsets").to_pylist()
        grp = int(table.column("grp")[0].as_py())
        packed = []
        for members in best_fit(fill[order].tolist(), capacity):
            own_pids, own_offsets, at = [], [], 0
            for i in order[members].tolist():
                own_pids += pids[i]
                own_offsets += [at + x for x in offsets[i]]
                at += int(fill[i])
            packed.append((own_pids[0], at, own_pids, own_offsets))
        # Room for a light bin of another group is in the emptiest bins, if anywhere.
        heavy = sorted((x for x in packed if 2 * x[1] > capacity), key=lambda x: (x[1], x[0]))
        open_ids = {x[0] for x in packed if 2 * x[1] <= capacity} | {x[0] for x in heavy[:fan_in] if x[1] < capacity}
        return pa.table(
            {
                "id": pa.array([x[0] for x in packed], pa.int64()),
                "fill": pa.array([x[1] for x in packed], pa.int32()),
                "final": pa.array([x[0] not in open_ids for x in packed], pa.bool_()),
                "pids": pa.array([x[2] for x in packed], pa.list_(pa.int64())),
                "offsets": pa.array([x[3] for x in packed], pa.list_(pa.int32())),
                "grp": pa.array([grp // fan_in] * len(packed), pa.int64()),
            }
        )

    return pack


def pack(
    items: DataFrame,
    capacity: int = CAPACITY,
    group_items: int = GROUP_ITEMS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(pid, sequence_id, offset) of items (pid, length), gapless in every sequence.

    Lengths are from 1 to ``capacity``. ``pid`` must be unique; a sequence has
    the pid of its first item as its number.
    """
    full = items.where(F.col("length") >= capacity).select(
        "pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = items.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_items))
    waiting = rest.select(
        F.col("pid").alias("id"),
        F.col("length").cast("int").alias("fill"),
        F.lit(False).alias("final"),
        F.array("pid").alias("pids"),
        F.array(F.lit(0)).alias("offsets"),
        F.pmod(F.xxhash64("pid"), F.lit(groups)).alias("grp"),
    )
    done = []
    while True:
        bins = settle(
            waiting.groupBy("grp").applyInArrow(_pack_group(capacity, fan_in), _BINS), "bins"
        )
        if groups == 1:
            done.append(bins)
            break
        done.append(bins.where("final"))
        waiting, groups = bins.where("NOT final"), -(-groups // fan_in)
    for bins in done:
        members = bins.select(
            F.col("id").alias("sequence_id"), F.explode(F.arrays_zip("pids", "offsets")).alias("m")
        )
        full = full.unionByName(
            members.select(
                F.col("m.pids").alias("pid"), "sequence_id", F.col("m.offsets").cast("long").alias("offset")
            )
        )
    return full


def packed_documents(
    docs: DataFrame,
    file: TokenizerFile,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Every piece of every document with its ids and its place in a sequence.

    Repeated rows are packed as often as they occur.
    """
    cut = pieces(docs, file, id_col, text_col, capacity, end_id)
    return cut.join(pack(cut.select("pid", "length"), capacity).hint("merge"), "pid").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, length): the token ids of every sequence, joined."""
    parts = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"),  # bounded by capacity
        F.sum("length").alias("length"),
    )
    joined = F.aggregate("parts", F.lit(b""), lambda have, x: F.concat(have, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), "length")
