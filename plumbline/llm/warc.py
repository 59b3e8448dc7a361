"""WARC archives: written with one record per page, read back by verified offsets.

Records are lines of Spark's text writer whose line separator is the blank
lines that end a record, so any store that Spark writes to will do. Reading
cuts files at every occurrence of the version line. Some of these are inside
payloads; each names, through its Content-Length, where the record after it
must begin, and only those count that the file's start leads to, found by
pointer jumping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import text_or_empty
from plumbline.session import settle

VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Records of one archive file.
FILE_RECORDS = 20_000
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(payload: Column) -> Column:
    """SHA-1 of a string's bytes, as 32 upper-case base32 characters."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), *_BASE32)


def revisits(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0
) -> DataFrame:
    """``pages`` (uid, id, url, payload ...) as records: digest, type and what they refer to.

    Among records with equal payloads of at least ``least_bytes``, the one
    with the smallest id (null last) is the response that the others revisit.
    """
    digests = settle(
        pages.select(
            "uid",
            F.col(f"`{id_col}`").alias("id"),
            sha1_base32(F.col(html_col)).alias("digest"),
            F.octet_length(html_col).cast("long").alias("n_bytes"),
        ),
        "digests",
    )
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("uid").alias("uid")))
    groups = (
        digests.where(F.col("n_bytes") >= least_bytes)
        .groupBy("digest", "n_bytes")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return digests.join(groups, ["digest", "n_bytes"]).where("uid <> first.uid").select(
        F.col("uid"), F.col("first.id").alias("refers_to"), F.col("first.uid").alias("refers_uid")
    )


def _header(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Line breaks in values become blanks."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    compression: str = "gzip",
    file_records: int = FILE_RECORDS,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record for every row of ``pages`` to archive files under ``path``.

    The payload is the html in UTF-8 (null: empty). A revisit has no payload
    but the digest of the one it revisits. Null ids and urls have no header.
    """
    rows = settle(
        pages.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{url_col}`").cast("string").alias("url"),
            text_or_empty(html_col).alias("payload"),
        ),
        "payloads",
    )
    again = settle(revisits(rows, "id", "payload", least_bytes), "revisits")
    joined = rows.join(again, "uid", "left")
    is_revisit = F.col("refers_uid").isNotNull()
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))
    headers = F.concat(
        F.lit("WARC-Type: "),
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\n"),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("uid").cast("string"), F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("X-Page-ID", F.col("id")),
        _header(
            "WARC-Refers-To",
            F.concat(F.lit("<urn:page:"), F.col("refers_uid").cast("string"), F.lit(">")),
        ),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("payload")))),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _header("Content-Length", F.octet_length(body)),
    )
    record = F.concat(F.lit(VERSION), headers, F.lit("\r\n"), body)
    joined.select(record.alias("value")).write.option("lineSep", END).option(
        "compression", compression
    ).option("maxRecordsPerFile", file_records).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece of the files from one version line to the next.

    Columns: file, place (order within the file) and text (what follows the
    version line; a file's first piece is what comes before the first one).
    """
    return spark.read.option("lineSep", VERSION).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("text"),
    )


def _placed(raw: DataFrame) -> DataFrame:
    """(file, place, offset, next) of every piece, in bytes of the uncompressed file.

    ``offset`` is that of the version line, -1 before the first one; ``next``
    is where the record after it must begin, null without a valid header.
    """
    head_end = F.locate(END, F.col("text"))
    head = F.when(head_end > 0, F.expr(f"substr(text, 1, locate('{_sql(END)}', text) + 3)"))
    length = F.regexp_extract(head, r"(?i)(?:^|\n)Content-Length: *(\d{1,18})\r\n", 1)
    sized = raw.select(
        "file",
        "place",
        F.octet_length("text").cast("long").alias("size"),
        F.octet_length(head).cast("long").alias("head_size"),
        F.when(length != "", length.cast("long")).alias("n_bytes"),
    )
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.sum(F.col("size") + len(VERSION)).over(before)  # each piece but the first has a version line
    placed = sized.withColumn("offset", F.coalesce(earlier - len(VERSION), F.lit(-1)))
    return placed.select(
        "file",
        "place",
        "offset",
        F.when(
            F.col("offset") >= 0,
            F.col("offset") + len(VERSION) + F.col("head_size") + F.col("n_bytes") + len(END),
        ).alias("next"),
    )


def _sql(text: str) -> str:
    return text.replace("\r", "\\r").replace("\n", "\\n")


def reachable(chain: DataFrame) -> DataFrame:
    """(file, offset) of the candidates that each file's start leads to.

    ``chain`` is (file, offset, next). In round r every candidate knows the
    one 2**r steps on, and those known to be reached mark where they lead to.
    """
    state = settle(
        chain.where("offset >= 0").select(
            "file", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("reached")
        ),
        "offsets",
    )
    n = state.where("reached").count()
    while True:
        ahead = state.select(
            "file", F.col("offset").alias("jump"), F.col("jump").alias("further")
        )
        led = state.join(ahead.hint("merge"), ["file", "jump"], "left")
        marks = led.where("reached").select("file", F.col("jump").alias("offset"))
        marked = marks.where("offset IS NOT NULL").withColumn("hit", F.lit(True))
        state = settle(
            led.join(marked.hint("merge"), ["file", "offset"], "left").select(
                "file",
                "offset",
                F.col("further").alias("jump"),
                (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached"),
            ),
            "offsets",
        )
        now = state.where("reached").count()
        if now == n:
            return state.where("reached").select("file", "offset")
        n = now


def _parsed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``head`` and ``payload`` for the text of a whole record."""
    at = f"locate('{_sql(END)}', text)"
    return pieces.withColumn("head", F.expr(f"substr(text, 1, {at} + 1)")).withColumn(
        "payload", F.expr(f"substr(text, {at} + 4, length(text) - {at} - 7)")
    )


def header(name: str) -> Column:
    """A header's value, from the column ``head``; null if there is none."""
    found = F.regexp_extract("head", rf"(?i)(?:^|\n){name}: *([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_warc(spark: SparkSession, path: str, columns: list[Column] | None = None) -> DataFrame:
    """The records under ``path``: file, offset and ``columns``.

    ``columns`` are made from ``head`` and ``payload`` (strings), by default
    these two, where the record is read, so that payloads need not move. One
    that holds version lines is put together from its pieces; whatever no
    chain of records leads to is not a record.
    """
    columns = columns or [F.col("head"), F.col("payload")]
    raw = candidates(spark, path)
    placed = settle(_placed(raw), "pieces")
    starts = settle(reachable(placed.select("file", "offset", "next")), "record-offsets")
    last = Window.partitionBy("file").orderBy("place")
    owned = settle(
        placed.join(starts.withColumn("is_start", F.lit(True)).hint("merge"), ["file", "offset"], "left")
        .withColumn(
            "record", F.last(F.when(F.col("is_start"), F.col("offset")), ignorenulls=True).over(last)
        )
        .where("record IS NOT NULL")
        .withColumn("n_pieces", F.count(F.lit(1)).over(Window.partitionBy("file", "record")))
        .select("file", "place", F.col("record").alias("offset"), "n_pieces"),
        "owned-pieces",
    )
    made = _parsed(raw).select("file", "place", *columns)
    single = made.join(owned.where("n_pieces = 1").hint("merge"), ["file", "place"]).drop("place", "n_pieces")
    several = (
        raw.join(owned.where("n_pieces > 1"), ["file", "place"])
        .groupBy("file", "offset")
        .agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("pieces"))  # one record's
        .select("file", "offset", F.array_join("pieces.text", VERSION).alias("text"))
    )
    return single.unionByName(_parsed(several).select("file", "offset", *columns))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: the page, its payload's size and digest, and its type.

    Sizes and digests are computed from the payloads read; a revisit has
    those of the record it refers to.
    """
    records = settle(
        read_warc(
            spark,
            path,
            [
                header("WARC-Record-ID").alias("record_id"),
                header("X-Page-ID").cast("long").alias("page_id"),
                header("WARC-Type").alias("record_type"),
                header("WARC-Refers-To").alias("refers_id"),
                F.octet_length("payload").cast("long").alias("payload_bytes"),
                sha1_base32(F.col("payload")).alias("payload_digest"),
            ],
        ),
        "records",
    )
    meant = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("meant_bytes"),
        F.col("payload_digest").alias("meant_digest"),
    )
    again = records.where("record_type = 'revisit'").join(meant.hint("merge"), "refers_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        records.where("record_type <> 'revisit'")
        .withColumn("refers_to", F.lit(None).cast("long"))
        .select(*columns)
        .unionByName(
            again.select(
                "page_id",
                F.col("meant_bytes").alias("payload_bytes"),
                F.col("meant_digest").alias("payload_digest"),
                "record_type",
                "refers_to",
            )
        )
    )
