"""Places and running sums within keys of any size.

A window over a key puts all its rows into one task. Here rows are dealt by
ranges of key and order, so that a key with a third of all rows spreads over a
third of the tasks; each task numbers and sums what it holds, and the totals of
the keys at the ends of tasks, two rows a task at most, carry over.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import widened
from plumbline.session import settle

#: Running sums are modulo this, so that two of them add up to a long.
MODULUS = 1 << 62


def _local(key: str, sums: tuple[str, ...], schema):
    """Kernel over sorted rows: places and sums within what a task holds."""

    def finish(batch: pa.RecordBatch, next_key, first_key, carried: dict):
        keys = batch.column(key)
        n = batch.num_rows
        same = np.zeros(n, bool)
        if n > 1:
            same[1:] = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
        same[0] = carried.get("key") == keys[0].as_py() and "key" in carried
        starts = np.flatnonzero(~same)
        run = np.cumsum(~same)  # 0: the run that goes on from the batch before
        begin = np.concatenate(([0], starts))[run]
        place = np.arange(n) - begin + np.where(run == 0, carried.get("n", 0), 0)
        columns = [pa.array(place, pa.int64())]
        for name in sums:
            value = batch.column(name).to_numpy(zero_copy_only=False).astype(np.uint64)
            total = np.cumsum(value, dtype=np.uint64)  # wraps at 2**64, a multiple of the modulus
            before = total[begin] - value[begin]
            now = total - before + np.where(run == 0, np.uint64(carried.get(name, 0)), np.uint64(0))
            now &= np.uint64(MODULUS - 1)
            columns.append(pa.array(now.astype(np.int64)))
        last = np.ones(n, bool)
        last[:-1] = ~same[1:]
        last[-1] = next_key is None or next_key[0] != keys[n - 1].as_py()
        edge = np.zeros(n, bool)
        if next_key is None:
            edge[-1] = True
        head = pc.fill_null(pc.equal(keys, pa.scalar(first_key, keys.type)), False)
        edge |= last & head.to_numpy(zero_copy_only=False)
        carried.update(key=keys[n - 1].as_py(), n=int(place[-1]) + 1)
        for name, column in zip(sums, columns[1:]):
            carried[name] = column[n - 1].as_py()
        arrays = [*batch.columns, *columns, pa.array(last), pa.array(edge)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carried, first_key = None, {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                first_key = batch.column(key)[0].as_py()
            else:
                yield finish(held, (batch.column(key)[0].as_py(),), first_key, carried)
            held = batch
        if held is not None:
            yield finish(held, None, first_key, carried)

    return kernel


def in_order(
    rows: DataFrame, key: str, order: list[Column], name: str, sums: tuple[str, ...] = ()
) -> DataFrame:
    """``rows`` with ``place`` and ``is_last`` in their key's order, as a written table.

    Places count from 0. For every column of non-negative longs in ``sums``,
    ``<column>_run`` is the sum, modulo 2**62, of the key's rows up to this
    one. Keys are not null; rows must differ in ``order`` within a key for
    the result to be the same in every run. On the driver are two rows for
    every task of the shuffle at most.
    """
    runs = [f"{c}_run" for c in sums]
    added = "".join(f"{r} long, " for r in runs)
    dealt = (
        rows.repartitionByRange(F.col(key), *order)
        .sortWithinPartitions(F.col(key), *order)
        .withColumn("_task", F.spark_partition_id())
    )
    schema = widened(dealt, f"place long, {added}is_last boolean, _edge boolean")
    table = settle(dealt.mapInArrow(_local(key, sums, schema), schema), name)
    ends = table.where("_edge").select(key, "_task", "place", *runs).collect()
    pieces = defaultdict(list)
    for row in ends:
        pieces[row[key]].append(row)
    carried = []
    for value, mine in pieces.items():
        n, totals = 0, [0] * len(runs)
        mine.sort(key=lambda r: r["_task"])
        for row in mine if len(mine) > 1 else []:
            carried.append((value, row["_task"], n, row is not mine[-1], *totals))
            n += row["place"] + 1
            totals = [(a + row[r]) % MODULUS for a, r in zip(totals, runs)]
    if carried:
        kind = table.schema[key].dataType.simpleString()
        more = "".join(f", _{r} long" for r in runs)
        carry = rows.sparkSession.createDataFrame(
            carried, f"{key} {kind}, _task int, _n long, _goes_on boolean{more}"
        )
        table = table.join(F.broadcast(carry), [key, "_task"], "left").withColumns(
            {
                "place": F.col("place") + F.coalesce("_n", F.lit(0)),
                "is_last": F.col("is_last") & ~F.coalesce("_goes_on", F.lit(False)),
                **{r: (F.col(r) + F.coalesce(f"_{r}", F.lit(0))) % MODULUS for r in runs},
            }
        )
    return table.select(*rows.columns, "place", *runs, "is_last")
