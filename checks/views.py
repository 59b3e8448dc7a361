"""Check inputs: driver tables with nulls, sentinels and copies worked in.

Every view has one SQL text per engine with the same meaning. All rows of the
underlying table are used; some rows occur twice so that there are duplicates
to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


EVENT_COLUMNS = ["event_id", "ts", "user_id", "value", "props"]
EVENT_FEATURES = ["user_id", "value"]

_EVENT_CELLS = """
  event_id, ts, event_type,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 11 = 0 THEN NULL
       WHEN event_id % 400 = 3 THEN value * 50 + 1000 ELSE value END AS value,
  CASE WHEN event_id % 13 = 0 THEN '-'
       WHEN event_id % 19 = 0 THEN NULL ELSE props END AS props
"""

# Events of five types, one dataset per type; some events are copied once.
DIRTY_EVENTS_SQL = f"""
dirty_events AS (
  SELECT CAST(event_id AS VARCHAR) || '-' || CAST(copy AS VARCHAR) AS row_id, {_EVENT_CELLS}
  FROM (SELECT *, unnest(range(1, CASE WHEN event_id % 50 = 0 THEN 3 ELSE 2 END)) AS copy
        FROM events) e)
"""


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    copied = table(spark, folder, "events").selectExpr(
        "*", "explode(sequence(1, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END)) AS copy"
    )
    return spark.sql(
        f"SELECT concat(event_id, '-', copy) AS row_id, {_EVENT_CELLS} FROM {{copied}}",
        copied=copied,
    )


DOCUMENT_COLUMNS = ["doc_id", "n_chars", "lang", "text"]
DOCUMENT_FEATURES = ["doc_id", "n_chars"]

_DOCUMENT_CELLS = """
  doc_id, source, n_chars,
  CASE WHEN n_chars % (2 + CAST(substr(source, 4) AS INT)) = 0 THEN NULL ELSE lang END AS lang,
  CASE WHEN source IN ('src3', 'src7', 'src11') AND n_chars % 2 = 0 THEN '-'
       ELSE text END AS text
"""

# Documents of twenty sources, one dataset per source; two sources are copied.
DIRTY_DOCUMENTS_SQL = f"""
dirty_documents AS (
  SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(copy AS VARCHAR) AS row_id, {_DOCUMENT_CELLS}
  FROM (SELECT *, unnest(range(1, CASE WHEN source IN ('src5', 'src9') THEN 3 ELSE 2 END)) AS copy
        FROM documents) d)
"""


def dirty_documents(spark: SparkSession, folder: str) -> DataFrame:
    copied = table(spark, folder, "documents").selectExpr(
        "*",
        "explode(sequence(1, CASE WHEN source IN ('src5', 'src9') THEN 2 ELSE 1 END)) AS copy",
    )
    return spark.sql(
        f"SELECT concat(doc_id, '-', copy) AS row_id, {_DOCUMENT_CELLS} FROM {{copied}}",
        copied=copied,
    )


# The sources found plus one that has no rows; four sectors by source number.
CATALOGUE_SQL = """
catalogue AS (
  SELECT source AS dataset_id,
         CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'press' WHEN 1 THEN 'web'
              WHEN 2 THEN 'books' ELSE 'forum' END AS sector,
         source || '.csv' AS file_name
  FROM (SELECT DISTINCT source FROM documents UNION SELECT 'src20') s)
"""


def document_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("source").distinct()
    known = found.union(spark.sql("SELECT 'src20' AS source")).distinct()
    return known.selectExpr(
        "source AS dataset_id",
        "CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'press' WHEN 1 THEN 'web' "
        "WHEN 2 THEN 'books' ELSE 'forum' END AS sector",
        "source || '.csv' AS file_name",
    )


# A last update per source, from 0 to 899 days before the audit date.
UPDATES_SQL = """
updates AS (
  SELECT source AS dataset_id,
         TIMESTAMP '2026-06-03' - to_days(CAST(max(n_chars) % 900 AS INTEGER)) AS last_update
  FROM documents GROUP BY source)
"""


def document_updates(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "documents")
        .groupBy("source")
        .agg({"n_chars": "max"})
        .selectExpr(
            "source AS dataset_id",
            "TIMESTAMP '2026-06-03' - make_dt_interval(CAST(`max(n_chars)` % 900 AS INT)) "
            "AS last_update",
        )
    )


# Letters of other scripts for those of the English alphabet, one for one.
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {
    "windows-1251": "абвгдежзийклмнопрстуфхцчшщ",
    "windows-1256": "ابتثجحخدذرزسشصضطظعغفقكلمنه",
    "gb18030": "的一是不了人我在有他这中大来上个国和地到说们为子出也",
    "shift_jis": "あいうえおかきくけこさしすせそたちつてとなにぬねのは",
}
# All but printable ASCII and the letters above it in the first 256 characters.
NOT_LATIN = r"[^\x20-\x7E\x{C0}-\x{FF}]"
