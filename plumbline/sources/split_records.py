"""Records of quoted delimited files, read by many tasks a file.

Where a record begins depends on every quote before it. Two passes over runs
of lines that Spark's text reader cuts from a file settle that:

1. every task scans its run as if it began outside a quoted field and as if it
   began inside one, and notes where it then ends, a transition of two states;
2. transitions are composed along each file, so that each run's state is known,
   and tasks cut their runs into records. What is left of a record at either
   end of a run is put together with its neighbours.

Quotes count as the CSV reader counts them: one opens a field only at the
field's beginning, two together stand for one, and text between a closing
quote and the next delimiter is part of the field.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.defaults import DELIMITERS
from plumbline.session import settle

# Executors need no installed copy of this package: kernels travel with tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Runs whose states are sent to all tasks; beyond, lines meet them by a shuffle.
BROADCAST_RUNS = 200_000
_TRANSITIONS = "source string, start long, " + ", ".join(f"d{i} int" for i in range(len(DELIMITERS)))
_RECORDS = "source string, start long, seq long, part string, record binary"


@lru_cache(maxsize=None)
def _patterns(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """Lines that end inside a quoted field: begun outside one, and begun inside."""
    d = re.escape(delimiter)
    opened = rf'(?:(?:"(?:[^"]++|"")*+"[^{d}]*+|[^"{d}][^{d}]*+|){d})*+"(?:[^"]++|"")*+\Z'
    outside = re.compile(opened.encode("ascii"), re.DOTALL)
    inside = re.compile(rf'(?:[^"]++|"")*+(?:\Z|"[^{d}]*+{d}{opened})'.encode("ascii"), re.DOTALL)
    return outside, inside


def ends_inside(line: bytes, inside: bool, delimiter: str) -> bool:
    """Whether a line ends inside a quoted field, from how it begins."""
    if b'"' not in line:
        return inside
    return _patterns(delimiter)[inside].match(line) is not None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Slices of batches that belong to one run of one file."""
    for batch in batches:
        at = 0
        sources, starts = batch.column("source"), batch.column("start")
        while at < batch.num_rows:
            source, start, end = sources[at].as_py(), starts[at].as_py(), batch.num_rows
            if sources[end - 1].as_py() != source or starts[end - 1].as_py() != start:
                low, high = at, end - 1  # the run's rows are neighbours
                while high - low > 1:
                    middle = (low + high) // 2
                    same = sources[middle].as_py() == source and starts[middle].as_py() == start
                    low, high = (middle, high) if same else (low, middle)
                end = high
            yield source, start, batch.slice(at, end - at)
            at = end


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every run and delimiter, where it ends if begun outside (1: inside) and inside (2: inside)."""
    now, states = None, []

    def row() -> pa.RecordBatch:
        values = [pa.array([now[0]]), pa.array([now[1]], pa.int64())]
        values += [pa.array([a + 2 * b], pa.int32()) for a, b in states]
        return pa.RecordBatch.from_arrays(values, names=["source", "start", *(f"d{i}" for i in range(len(states)))])

    for source, start, part in _runs(batches):
        if now != (source, start):
            if now is not None:
                yield row()
            now, states = (source, start), [(False, True)] * len(DELIMITERS)
        lines = part.column("line")
        for line in lines.filter(pc.match_substring(lines, b'"')).to_pylist():
            states = [
                (ends_inside(line, a, d), ends_inside(line, b, d)) for (a, b), d in zip(states, DELIMITERS)
            ]
    if now is not None:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of runs whose state is known; ``part`` tells what a run holds only a piece of.

    Parts are ``whole``, ``tail`` (the end of a record begun before), ``head``
    (the beginning of one that goes on) and ``middle`` (neither end is here).
    """
    now, out, held, inside, first, seq, delimiter, wide = None, [], [], False, True, 0, ",", False

    def put(part: str) -> None:
        nonlocal held, seq
        record = b"\n".join(held)
        if wide and part in ("whole", "tail"):
            record = record.removesuffix(b"\r")
        if part != "whole" or record:  # blank lines are no records
            out.append((*now, seq, part, record))
            seq += 1
        held = []

    def rows() -> pa.RecordBatch:
        columns = zip(*out) if out else [[]] * 5
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(x), t) for x, t in zip(columns, types)], names=["source", "start", "seq", "part", "record"]
        )
        out.clear()
        return batch

    def finish() -> None:
        if now is not None and held:
            put("middle" if first else "head")

    for source, start, part in _runs(batches):
        if now != (source, start):
            finish()
            now, held, seq = (source, start), [], 0
            inside, delimiter, wide = (part.column(c)[0].as_py() for c in ("inside", "delimiter", "wide_end"))
            first = inside  # what comes first is the rest of an earlier record
        for line in part.column("line").to_pylist():
            held.append(line)
            inside = ends_inside(line, inside, delimiter)
            if not inside:
                put("tail" if first else "whole")
                first = False
        if out:
            yield rows()
    finish()
    if out:
        yield rows()


def _lines(spark: SparkSession, folders: list[str]) -> DataFrame:
    return (
        spark.read.option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("lineSep", "\n")
        .text(folders)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("value").cast("binary").alias("line"),
        )
    )


def run_states(transitions: DataFrame) -> DataFrame:
    """(source, start, delimiter, inside) of every run, from its file's transitions before it.

    A run that ends alike from both states settles what follows; after it only
    the runs that swap the states count. The window holds one row for each
    run of a file.
    """
    before = Window.partitionBy("source").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("source").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("ends")  # bit 0: from outside, bit 1: from inside
    settled = ends.isin(0, 3)
    swaps = transitions.withColumn("swaps", F.sum((ends == 1).cast("int")).over(so_far))
    known = swaps.withColumns(
        {
            "base": F.last(F.when(settled, (ends == 3).cast("int")), ignorenulls=True).over(before),
            "then": F.last(F.when(settled, F.col("swaps")), ignorenulls=True).over(before),
            "last": F.last("swaps").over(before),
        }
    )
    turned = F.coalesce("last", F.lit(0)) - F.coalesce("then", F.lit(0))
    return known.select(
        "source", "start", "delimiter", "wide_end", ((F.coalesce("base", F.lit(0)) + turned) % 2 == 1).alias("inside")
    )


def split_records(
    spark: SparkSession,
    folders: list[str],
    files: DataFrame,
    broadcast_runs: int = BROADCAST_RUNS,
    tasks: int | None = None,
) -> DataFrame:
    """(source, row_id, record) of all records of ``files``, headers too, as bytes.

    ``files`` are (source, delimiter, wide_end), read from ``folders``; bytes
    below 128 must mean what they do in ASCII, and lines end in a line feed,
    which may follow a carriage return if ``wide_end``. ``row_id``
    counts a file's records from 0, blank lines left out. A run is a piece of
    a file of ``spark.sql.files.maxPartitionBytes``; a task takes one, or, where
    there are more runs than ``tasks``, several one after the other. So tasks
    follow the bytes, not the files. A record is one value, wherever its lines
    are; no other rows of a file need to meet.
    """
    lines = _lines(spark, folders)
    if tasks is not None:
        lines = lines.coalesce(tasks)
    found = settle(lines.mapInArrow(_scan, _TRANSITIONS), "quote-transitions")
    ends = F.lit(None).cast("int")
    for i, sep in enumerate(DELIMITERS):
        ends = F.when(F.col("delimiter") == sep, F.col(f"d{i}")).otherwise(ends)
    mine = found.join(files.select("source", "delimiter", "wide_end"), "source").select(
        "source", "start", "delimiter", "wide_end", ends.alias("ends")
    )
    states = settle(run_states(mine), "quote-states")
    if states.count() <= broadcast_runs:
        known = lines.join(F.broadcast(states), ["source", "start"])
    else:
        known = (
            lines.withColumn("place", F.monotonically_increasing_id())
            .join(states, ["source", "start"])
            .repartition("source", "start")
            .sortWithinPartitions("source", "start", "place")
        )
    columns = ["source", "start", "line", "delimiter", "wide_end", "inside"]
    cut = settle(known.select(columns).mapInArrow(_cut, _RECORDS), "cut-records")
    # Pieces belong to the last record that began before them.
    pieces = cut.where("part != 'whole'")
    order = Window.partitionBy("source").orderBy("start", "seq")  # two rows a run at most
    begun = F.struct("start", "seq")
    owned = pieces.withColumn("begun", F.last(F.when(F.col("part") == "head", begun), ignorenulls=True).over(order))
    joined = (
        owned.groupBy("source", "begun")
        .agg(F.sort_array(F.collect_list(F.struct("start", "seq", "record"))).alias("pieces"))
        .select(
            "source",
            "begun.start",
            "begun.seq",
            F.expr("unhex(array_join(transform(pieces, x -> hex(x.record)), '0A'))").alias("record"),
        )
    )
    records = cut.where("part = 'whole'").drop("part").unionByName(joined)
    n = cut.where("part IN ('whole', 'head')").groupBy("source", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("least")
    )
    earlier = Window.partitionBy("source").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = n.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).drop("n", "least")
    # A row for each run; as a written table its size is known, and records need not move to meet it.
    offsets = settle(offsets, "record-offsets")
    return records.join(offsets, ["source", "start"]).select(
        "source", (F.col("offset") + F.col("seq")).alias("row_id"), "record"
    )
