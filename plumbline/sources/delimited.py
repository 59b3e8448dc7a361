"""Delimited text files of unknown encoding, delimiter and types.

Two passes. The first looks at each file's bytes inside the scan task and
keeps only a small record per file: encoding, delimiter, header, digest. The
second cuts files into records, many tasks a file, and has Spark's CSV parser
read them, grouped by what the first pass found; it yields every record as an
array of cell texts, since files differ in width. Files in UTF-16, and those
whose lines end in a carriage return alone, go to the CSV reader whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.defaults import DELIMITERS, FREETEXT_LENGTH, NULL_TOKENS, SENTINELS
from plumbline.functions.cells import is_sentinel, numeric_like
from plumbline.operators.matrix import standardise
from plumbline.operators.profile import classify, date_share, distinct_texts, long_texts
from plumbline.session import settle
from plumbline.sources.code_pages import JVM_CHARSETS, NO_TEXT, pages_of
from plumbline.sources.split_records import split_records
from plumbline.sources.split_records import _lines as text_lines
from plumbline.sources.streamed import STREAMED_BYTES, streamed_files

_HEAD_BYTES = 65_536
# What one binary value can hold.
_VALUE_BYTES = 2**31 - 1024
# One record: text outside quotes up to a line end, quoted runs taken whole.
_FIRST_RECORD = r'^(?:[ \t]*\r?\n)*+([^"\r\n]*+(?:"[^"]*+"[^"\r\n]*+)*+)(\r?\n|\r|\z)'
_QUOTED = r'"[^"]*"'
_CHARSETS = {**JVM_CHARSETS, "utf-16": "UTF-16"}
# How a delimited reader spells booleans.
_TRUE, _FALSE = ["True", "TRUE", "true"], ["False", "FALSE", "false"]


@contextmanager
def _legacy_charsets(spark: SparkSession):
    """Windows code pages need the Java charset lookup, and a character cut in
    two must not fail a file; both on for planning only."""
    names = ["spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"]
    before = {name: spark.conf.get(name, "false") for name in names}
    for name in names:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def _decoded(content: Column, encoding: Column) -> Column:
    """Text of some bytes; a character cut off at the end turns into U+FFFD."""
    unicode = F.make_valid_utf8(content.cast("string"))
    text = F.regexp_replace(unicode, "^\ufeff", "")
    for name, charset in _CHARSETS.items():
        text = F.when(encoding == name, F.decode(content, charset)).otherwise(text)
    return text


def _fields(record: Column, delimiter: str) -> Column:
    """Number of fields of a record: delimiters outside quotes plus one."""
    bare = F.regexp_replace(record, _QUOTED, "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def _header_names(header: Column, delimiter: Column) -> Column:
    """Column names, with repeats numbered and blanks named by position."""
    names = F.lit(None).cast("array<string>")
    for sep in reversed(DELIMITERS):
        pattern = ("\\|" if sep == "|" else sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
        names = F.when(delimiter == sep, F.split(header, pattern, -1)).otherwise(names)
    bare = F.transform(
        names,
        lambda x, i: F.when(
            F.trim(x) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))
        ).otherwise(F.replace(F.regexp_replace(x, r'^"|"$', ""), F.lit('""'), F.lit('"'))),
    )

    def numbered(name: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(bare, F.lit(1), i), lambda x: x == name))
        return F.when(before > 0, F.concat(name, F.lit("."), before.cast("string"))).otherwise(
            name
        )

    return F.transform(bare, numbered)


def sniff_files(
    spark: SparkSession, catalogue: DataFrame, streamed_bytes: int = STREAMED_BYTES
) -> DataFrame:
    """Encoding, delimiter, header and digest of every catalogue file.

    Encoding: byte order mark of UTF-8 or UTF-16, then valid UTF-8, then the
    code page that the first 65,536 bytes speak for; windows-1256 if they are
    all ASCII. Bytes that are text in no code page do not load. Delimiter: the
    first of comma, semicolon, tab and pipe that gives the header at least two
    fields, else comma. A file without a header record does not load. Contents stay inside the scan task; those of
    ``streamed_bytes`` and more pass through it in bounded runs.
    """
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    folders = sorted(row[0] for row in catalogue.select(folder).distinct().collect())
    streamed, uncut = streamed_files(spark, folders, streamed_bytes)
    with _legacy_charsets(spark):
        listed = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.[cC][sS][vV]")
            .load(folders)
            .select("length", "content", F.col("_metadata.file_path").alias("source"))
        )
        length = F.col("length")
        files = listed.where(length < streamed_bytes)
        if uncut:
            # Files that no separator cuts into runs are held whole if they can be.
            held = listed.where((length >= streamed_bytes) & (length < _VALUE_BYTES))
            files = files.unionByName(held.where(F.col("source").isin(uncut)))
        content = F.col("content")
        mark = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
        encoding = (
            F.when(mark, "utf-8-sig")
            .when(F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF"), "utf-16")
            .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        )
        unknown = F.when(F.col("known").isNull(), F.substring("content", 1, _HEAD_BYTES))
        looked = (
            files.select("source", F.sha2(content, 256).alias("sha256"), encoding.alias("known"), "content")
            .withColumn("page", F.pandas_udf(pages_of, T.StringType())(unknown))
            .select("source", "sha256", F.coalesce("known", "page").alias("encoding"), "content")
        )
        if streamed is not None:
            looked = looked.unionByName(streamed)
        looked = looked.withColumn("head", F.substring("content", 1, _HEAD_BYTES))
        head = F.regexp_extract(_decoded_head(), _FIRST_RECORD, 1)
        closed = F.regexp_extract(_decoded_head(), _FIRST_RECORD, 2) != ""
        short = F.length("content") <= _HEAD_BYTES
        header = F.when(closed | short, head).otherwise(
            F.regexp_extract(_decoded(F.col("content"), F.col("encoding")), _FIRST_RECORD, 1)
        )
        first_end = F.regexp_extract(_decoded_head(), r"(\r\n|\n|\r)", 1)
        seen = looked.select(
            "source", "sha256", "encoding", header.alias("header"), first_end.alias("line_end")
        )
        width = [F.when(_fields(F.col("header"), sep) >= 2, sep) for sep in DELIMITERS]
        delimiter = F.coalesce(*width, F.lit(","))
        seen = seen.withColumn("delimiter", delimiter)
        seen = seen.withColumn("column_names", _header_names(F.col("header"), F.col("delimiter")))
        no_text = F.col("encoding") == NO_TEXT
        empty = (F.coalesce(F.trim("header"), F.lit("")) == "") | no_text
        found = catalogue.join(seen, "source", "left").select(
            *catalogue.columns,
            F.when(F.col("size_bytes") == 0, F.sha2(F.lit(""), 256))
            .otherwise(F.col("sha256"))
            .alias("sha256"),
            F.when(~no_text, F.col("encoding")).alias("encoding"),
            F.when(~empty, F.col("delimiter")).alias("delimiter"),
            F.when(~empty, F.col("column_names")).alias("column_names"),
            (~empty).alias("load_ok"),
            F.when(
                (F.col("size_bytes") >= _VALUE_BYTES) & F.col("sha256").isNull(),
                "file cannot be cut into runs of bytes",
            )
            .when(no_text, "bytes are text in no known encoding")
            .when(empty, "no columns to parse from file")
            .alias("error"),
            F.when(~empty, F.col("line_end")).alias("line_end"),
        )
        return settle(found, "sniffed")


def _decoded_head() -> Column:
    return _decoded(F.col("head"), F.col("encoding"))


def read_cells(
    spark: SparkSession, sniffed: DataFrame, run_bytes: int | None = None
) -> DataFrame:
    """(dataset_id, row_id, cells array<string>) of every record that loads.

    Quoted line breaks stay inside a cell, blank lines vanish, short records
    are padded with nulls and records longer than the header are dropped. Null
    tokens become null. ``row_id`` counts records from the start of the file,
    dropped ones too. Files are read in runs of some ``run_bytes``, or of what
    ``spark.sql.files.maxPartitionBytes`` says; short runs share a task. On the driver are the folders
    and the different (encoding, delimiter, width), and the paths of files
    that must be read whole.
    """
    loaded = sniffed.where("load_ok").select(
        "dataset_id",
        "source",
        "file_path",
        "encoding",
        "delimiter",
        F.size("column_names").alias("width"),
        (F.col("line_end") == "\r\n").alias("wide_end"),
        ((F.col("encoding") == "utf-16") | (F.col("line_end") == "\r")).alias("alone"),
    )
    loaded = settle(loaded, "loaded-files")
    kinds = ["encoding", "delimiter", "width"]
    shared, alone = loaded.where("NOT alone"), loaded.where("alone")
    groups = sorted(tuple(r) for r in shared.select(*kinds).distinct().collect())
    parts = []
    if groups:
        folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
        folders = sorted(r[0] for r in shared.select(folder).distinct().collect())
        parts += _split_parts(spark, folders, shared, groups, run_bytes)
    paths = defaultdict(list)
    for row in alone.collect():
        path = re.sub(r"([*?\[\]{}\\])", r"\\\1", row["file_path"])
        paths[tuple(row[k] for k in kinds)].append(path)
    with _legacy_charsets(spark):
        whole = [_read_group(spark, paths[k], *k) for k in sorted(paths)]
        if whole:
            read = reduce(DataFrame.unionByName, whole)
            records = settle(read.join(alone.select("dataset_id", "source"), "source"), "records")
            starts = records.groupBy("dataset_id").agg(F.min("place").alias("start"))
            parts.append(
                records.join(starts, "dataset_id").select(
                    "dataset_id", (F.col("place") - F.col("start")).alias("row_id"), "cells", "keep"
                )
            )
    if not parts:
        raise ValueError("no file of the catalogue could be loaded")
    return reduce(DataFrame.unionByName, parts).where("keep").select("dataset_id", "row_id", "cells")


@contextmanager
def _run_bytes(spark: SparkSession, most: int | None):
    """Runs of at most ``most`` bytes; for planning only."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {name: spark.conf.get(name) for name in names}
    if most is not None:
        spark.conf.set(names[0], str(most))
        spark.conf.set(names[1], str(min(most, int(before[names[1]].rstrip("b")))))
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def _split_parts(spark, folders, shared, groups, run_bytes) -> list[DataFrame]:
    """Parsed records, a frame for each kind of file; the records are cut for all of them at once."""
    # As many tasks as the session's own settings give, however short the runs.
    tasks = None if run_bytes is None else text_lines(spark, folders).rdd.getNumPartitions()
    with _run_bytes(spark, run_bytes):
        records = split_records(spark, folders, shared.select("source", "delimiter", "wide_end"), tasks=tasks)
    kind = F.lit(None).cast("int")
    for i, (encoding, delimiter, width) in enumerate(groups):
        same = (F.col("encoding") == encoding) & (F.col("delimiter") == delimiter) & (F.col("width") == width)
        kind = F.when(same, i).otherwise(kind)
    with _legacy_charsets(spark):
        text = _decoded(F.col("record"), F.col("encoding"))
        text = F.when(F.col("wide_end"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
        texts = records.where("row_id > 0").join(shared.withColumn("kind", kind), "source")
        held = settle(
            texts.select("dataset_id", (F.col("row_id") - 1).alias("row_id"), text.alias("text"), "kind"),
            "record-texts",
            by="kind",
        )
    return [
        _parsed(held.where(F.col("kind") == i), delimiter, width) for i, (_, delimiter, width) in enumerate(groups)
    ]


def _schema(width: int) -> T.StructType:
    names = [*(f"c{i}" for i in range(width)), "raw"]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _options(delimiter: str) -> dict[str, str]:
    return {
        "sep": delimiter,
        "quote": '"',
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "raw",
    }


def _kept_cells(width: int, delimiter: str) -> list[Column]:
    """``cells`` and whether a record stays, from columns c0 … and raw."""
    names = [f"c{i}" for i in range(width)]
    # Where both kinds of line end occur, the carriage return of the other
    # kind stays on the last cell.
    held = [F.col(n) for n in names[:-1]] + [F.regexp_replace(names[-1], r"\r$", "")]
    cells = F.array(*[F.when(~x.isin(NULL_TOKENS), x) for x in held])
    whole = F.col("raw").isNull() | (_fields(F.col("raw"), delimiter) <= width)
    return [cells.alias("cells"), whole.alias("keep")]


def _parsed(texts: DataFrame, delimiter: str, width: int) -> DataFrame:
    """(dataset_id, row_id, cells, keep) of single records.

    Of a last cell with quotes where none belong, the parser keeps one more
    than it would before a line end.
    """
    fields = F.from_csv("text", _schema(width).simpleString()[7:-1].replace(":", " "), _options(delimiter))
    found = texts.select("dataset_id", "row_id", fields.alias("r")).select("dataset_id", "row_id", "r.*")
    return found.select("dataset_id", "row_id", *_kept_cells(width, delimiter))


def _read_group(spark, paths, encoding, delimiter, width) -> DataFrame:
    lines = (
        spark.read.schema(_schema(width))
        .option("header", True)
        .option("multiLine", True)
        .option("encoding", _CHARSETS.get(encoding, "UTF-8"))
        .options(**_options(delimiter))
        .csv(paths)
    )
    return lines.select(
        F.col("_metadata.file_path").alias("source"),
        F.monotonically_increasing_id().alias("place"),
        *_kept_cells(width, delimiter),
    )


def cell_stats(
    cells: DataFrame, sniffed: DataFrame, sentinels: list[str] = SENTINELS
) -> DataFrame:
    """Column statistics of cell rows, with types inferred over whole columns.

    A column is numeric when every value reads as a number, or a non-empty
    file has no value in it at all, or it is boolean: every row holds one of
    the spellings of true and false. With a null in it, a column of those is
    text.
    """
    rows = cells.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_rows"))
    text = F.col("text")
    whole_number = text.rlike(r"^\s*[+-]?\d+\s*$")
    tested = (
        cells.select("dataset_id", F.posexplode("cells").alias("col_idx", "text"))
        .where("text is not null")
        .groupBy("dataset_id", "col_idx")
        .agg(
            F.count(F.lit(1)).alias("held"),
            F.count_if(~is_sentinel(text, sentinels)).alias("n_clean"),
            F.count_if(numeric_like(text)).alias("n_numeric"),
            F.count_if(whole_number).alias("n_whole"),
            F.count_if(text.isin(*_TRUE, *_FALSE)).alias("n_flags"),
            F.sum(F.length("text")).alias("text_length"),
        )
    )
    zero = F.lit(0).cast("long")
    counts = ["held", "n_clean", "n_numeric", "n_whole", "n_flags", "text_length"]
    held, n_rows = F.col("held"), F.col("n_rows")
    number = (n_rows > 0) & (F.col("n_numeric") == held)
    flag = (held > 0) & (F.col("n_flags") == held) & (held == n_rows)
    return (
        sniffed.where("load_ok")
        .select("dataset_id", F.posexplode("column_names").alias("col_idx", "col_name"))
        .join(rows, "dataset_id", "left")
        .join(tested, ["dataset_id", "col_idx"], "left")
        .fillna(0, subset=["n_rows", *counts])
        .select(
            "dataset_id",
            "n_rows",
            "col_idx",
            "col_name",
            F.when(flag, "boolean")
            .when(number & (F.col("n_whole") == held) & (held == n_rows), "bigint")
            .when(number, "double")
            .otherwise("string")
            .alias("col_type"),
            (number | flag).alias("is_numeric"),
            (n_rows - held).alias("n_nulls"),
            F.when(number | flag, held).otherwise(F.coalesce("n_clean", zero)).alias("n_clean"),
            "text_length",
        )
    )


def cell_classes(cells: DataFrame, stats: DataFrame, **cuts) -> DataFrame:
    """Column classes of delimited files."""
    long = cells.select(
        "dataset_id", F.col("row_id").alias("order_key"), F.posexplode("cells").alias("col_idx", "text")
    ).where("text is not null")
    types = stats.select("dataset_id", "col_idx", "col_type")
    dated = long.join(types, ["dataset_id", "col_idx"]).select(
        "dataset_id",
        "col_idx",
        "order_key",
        F.when(F.col("col_type") == "bigint", F.col("text").try_cast("decimal(38,0)").cast("string"))
        .when(F.col("col_type") == "double", F.col("text").try_cast("double").cast("string"))
        .otherwise(F.col("text"))
        .alias("text"),
    )
    texts = long_texts(stats, cuts.get("freetext_length", FREETEXT_LENGTH))
    distinct = distinct_texts(long.join(texts, ["dataset_id", "col_idx"], "left_semi"))
    return classify(stats, date_share(dated), distinct, **cuts)


def cell_row_counts(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows and distinct rows per file; numbers compare by value."""
    kinds = stats.groupBy("dataset_id").agg(
        F.sort_array(F.collect_list(F.struct("col_idx", "col_type"))).alias("types")
    )
    value = F.transform(
        "cells",
        lambda x, i: F.coalesce(
            F.when(
                F.element_at("types", i + 1)["col_type"] == "bigint",
                x.try_cast("decimal(38,0)").cast("string"),
            ).when(
                F.element_at("types", i + 1)["col_type"] == "double",
                (x.try_cast("double") + 0.0).cast("string"),
            ).when(F.element_at("types", i + 1)["col_type"] == "boolean", F.lower(x)),
            x,
        ),
    )
    return (
        cells.join(kinds, "dataset_id")
        .select("dataset_id", F.unhex(F.sha2(F.to_json(F.struct(value.alias("v"))), 256)).alias("d"))
        .groupBy("dataset_id", "d")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("dataset_id")
        .agg(F.sum("copies").alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows"))
    )


def cell_matrix(cells: DataFrame, stats: DataFrame, **limits) -> DataFrame:
    """Standardised numeric matrix of delimited files."""
    numbers = (
        stats.where("is_numeric and col_type != 'boolean'")
        .groupBy("dataset_id")
        .agg(F.sort_array(F.collect_list("col_idx")).alias("positions"))
    )
    width = numbers.agg(F.max(F.size("positions"))).first()[0] or 1
    rows = cells.join(numbers, "dataset_id").select(
        "dataset_id",
        F.col("row_id").cast("string").alias("row_id"),
        F.transform(
            "positions", lambda i: F.element_at("cells", i + 1).try_cast("double")
        ).alias("features"),
    )
    return standardise(rows, width, **limits)
