"""Digest, encoding and head of files too large for one binary value.

Spark's text reader hands a task the file's runs of bytes between two
separators, in order and as they are, and the kernel puts the separators back
between them. Runs beyond a bound are skipped by the reader, so that no task
holds more; a file whose bytes do not add up to its size is read again with
the next separator.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import settle
from plumbline.sources.code_pages import NO_TEXT, code_page

# Executors need no installed copy of this package: kernels travel with tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Files of this size and more are streamed, in runs that are shorter than it.
STREAMED_BYTES = 64 << 20
#: Bytes from which a header record is looked for first.
_HEAD_BYTES = 65_536
_SEPARATORS = "\n\r,;\t| \"\0"
#: Bound of the runs of files that no separator cuts into shorter ones.
_LONGEST_RUN = 1 << 30
_FIRST_RECORD = re.compile(r'(?:[ \t]*\r?\n)*+[^"\r\n]*+(?:"[^"]*+"[^"\r\n]*+)*+[\r\n]')
_LOOKED = "source string, sha256 string, encoding string, content binary"


class _File:
    """What is known of a file so far."""

    def __init__(self, source: str, size: int, separator: bytes, longest: int):
        self.source, self.size, self.separator, self.longest = source, size, separator, longest
        self.held, self.given, self.valid = 0, 0, True
        # The reader drops the byte order mark of UTF-8, which shows only at the end.
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(codecs.BOM_UTF8)
        self.decoder = codecs.getincrementaldecoder("utf-8")()
        self.head, self.closed, self.next_look = bytearray(), False, _HEAD_BYTES

    def add(self, runs: list[bytes]) -> None:
        data = self.separator.join(runs)
        self._put(self.separator + data if self.held else data)
        self.held += sum(map(len, runs)) + len(runs)

    def _put(self, data: bytes) -> None:
        self.given += len(data)
        self.plain.update(data)
        self.marked.update(data)
        if self.valid:
            try:
                self.decoder.decode(data)
            except UnicodeDecodeError:
                self.valid = False
        if not self.closed and len(self.head) < self.longest:
            self.head += data[: self.longest]
            if len(self.head) >= self.next_look:
                self.closed, self.next_look = self._is_closed(), 2 * len(self.head)

    def _wide(self) -> bool:
        return self.head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)

    def _is_closed(self) -> bool:
        return _FIRST_RECORD.match(self.head.decode("utf-16" if self._wide() else "latin-1", "replace")) is not None

    def looked(self) -> pa.RecordBatch | None:
        """The file's row, or None if some of its bytes were skipped."""
        surplus = self.held - self.size
        if surplus not in (1, 0, -2, -3):
            return None
        if surplus in (0, -3):
            self._put(self.separator)
        if self.valid:
            try:
                self.decoder.decode(b"", final=True)
            except UnicodeDecodeError:
                self.valid = False
        mark = surplus < 0
        encoding = "utf-8-sig" if mark else "utf-16" if self._wide() else "utf-8"
        if encoding == "utf-8" and not self.valid:
            encoding = code_page(bytes(self.head)) or NO_TEXT
        whole = len(self.head) == self.given or self.closed or self._is_closed()
        row = {
            "source": [self.source],
            "sha256": [(self.marked if mark else self.plain).hexdigest()],
            "encoding": [encoding],
            "content": [bytes(self.head) if whole else b""],
        }
        return pa.RecordBatch.from_pydict(row, pa.schema([(k, pa.binary() if k == "content" else pa.string()) for k in row]))


def _looks(separator: bytes, longest: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, sources = 0, batch.column("source")
            while at < batch.num_rows:
                source, end = sources[at].as_py(), batch.num_rows
                if sources[end - 1].as_py() != source:
                    end = next(i for i in range(at, end) if sources[i].as_py() != source)
                if batch.column("start")[end - 1].as_py():
                    raise RuntimeError(f"{source} reached the task in pieces")
                if file is None or file.source != source:
                    if file is not None and (row := file.looked()) is not None:
                        yield row
                    file = _File(source, batch.column("size")[at].as_py(), separator, longest)
                file.add(batch.column("run").slice(at, end - at).to_pylist())
                at = end
        if file is not None and (row := file.looked()) is not None:
            yield row

    return kernel


@contextmanager
def _unsplit(spark: SparkSession):
    """A partition for every file, whatever its size; for planning only."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(1 << 60))
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def streamed_files(
    spark: SparkSession, folders: list[str], least_bytes: int = STREAMED_BYTES
) -> tuple[DataFrame | None, list[str]]:
    """(source, sha256, encoding, content) of the CSV files of ``least_bytes`` and more.

    ``content`` begins like the file, without a byte order mark of UTF-8, and
    holds its first record; it is empty if that does not end within
    that many bytes. Files that no separator cuts into such runs are read in
    runs of at most 1 GiB; one with longer runs has no row and is named in the
    second result. None if there are no such files.
    """
    glob = {"pathGlobFilter": "*.[cC][sS][vV]"}
    listed = spark.read.format("binaryFile").options(**glob).load(folders).where(F.col("length") >= least_bytes)
    large = settle(listed.select(F.col("_metadata.file_path").alias("source")), "large-files")
    if large.isEmpty():
        return None, []
    parts, left = [], None
    ways = [(x, least_bytes) for x in _SEPARATORS] + [(x, max(least_bytes, _LONGEST_RUN)) for x in _SEPARATORS[:2]]
    for separator, longest in ways:
        size, source = F.col("_metadata.file_size"), F.col("_metadata.file_path")
        runs = (
            spark.read.options(**glob)
            .option("lineSep", separator)
            .option("mapreduce.input.linerecordreader.line.maxlength", longest)
            .text(folders)
            .where(size >= least_bytes)
        )
        if left is not None:
            runs = runs.where(source.isin(left))
        runs = runs.select(
            source.alias("source"),
            size.alias("size"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("value").cast("binary").alias("run"),
        )
        with _unsplit(spark):
            parts.append(settle(runs.mapInArrow(_looks(separator.encode(), longest), _LOOKED), "streamed"))
        found = reduce(DataFrame.unionByName, parts)
        # Large files without line ends, a few at most.
        left = [row[0] for row in large.join(found, "source", "left_anti").collect()]
        if not left:
            break
    return found, left
