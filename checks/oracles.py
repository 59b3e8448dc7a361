"""Independent SQL for the registered queries, built from shared CTE texts."""

from __future__ import annotations

import re

from checks.partitions import partitions
from checks.views import (
    CATALOGUE_SQL,
    DIRTY_DOCUMENTS_SQL,
    DIRTY_EVENTS_SQL,
    NOT_LATIN,
    SCRIPTS,
    UPDATES_SQL,
)
from plumbline.operators.isolation import least_prime, lots_wanted

ORACLES: dict[str, str] = {}

SENTINELS = "('N/A','n/a','NA','-','--','غير متاح','Not Available','?','')"
NULL_TOKENS = (
    "('','#N/A','#N/A N/A','#NA','-1.#IND','-1.#QNAN','-NaN','-nan','1.#IND','1.#QNAN',"
    "'<NA>','N/A','NA','NULL','NaN','None','n/a','nan','null')"
)

# How the derived catalogue is written: one sector in UTF-16, one with an empty file.
ENCODING = "CASE WHEN sector = 'forum' THEN 'utf-16' ELSE 'utf-8' END"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def query(name: str, *ctes: str, select: str) -> None:
    text = ",\n".join(c.strip() for c in ctes)
    ORACLES[name] = (f"WITH RECURSIVE {text}\n" if ctes else "") + select.strip()


def long_cells(view: str, key: str, columns: list[tuple[str, bool]], extra: str = "") -> str:
    """CTE ``cells``: every cell of a view as text, with its column and type."""
    parts = [
        f"SELECT {key} AS dataset_id, {extra} {i} AS col_idx, '{name}' AS col_name, "
        f"CAST({name} AS VARCHAR) AS x, {str(typed).lower()} AS typed FROM {view}"
        for i, (name, typed) in enumerate(columns)
    ]
    return "cells AS (" + "\nUNION ALL ".join(parts) + ")"


STATS = f"""
stats AS (
  SELECT dataset_id, col_idx, col_name, bool_and(typed) OR count(x) = 0 AS is_numeric,
         count(*) AS n_rows, count(*) - count(x) AS n_nulls,
         count(*) FILTER (WHERE x IS NOT NULL AND (typed OR x NOT IN {SENTINELS})) AS n_clean
  FROM cells GROUP BY dataset_id, col_idx, col_name)
"""

EVENTS = [
    ("event_id", True),
    ("ts", False),
    ("user_id", True),
    ("value", True),
    ("props", False),
]
DOCUMENTS = [("doc_id", True), ("n_chars", True), ("lang", False), ("text", False)]

EVENT_CELLS = [DIRTY_EVENTS_SQL, long_cells("dirty_events", "event_type", EVENTS)]
EVENT_STATS = [*EVENT_CELLS, STATS]
DOCUMENT_CELLS = [DIRTY_DOCUMENTS_SQL, long_cells("dirty_documents", "source", DOCUMENTS)]
DOCUMENT_STATS = [*DOCUMENT_CELLS, CATALOGUE_SQL, STATS]

# A date among the numbers of the driver tables: a year, a year and month, or
# six and eight digits in calendar order.
IS_DATE = r"""
(CASE WHEN col_name IN ('ts', 'o_orderdate') THEN true
      WHEN regexp_full_match(x, '\d{4}') THEN CAST(x AS INT) BETWEEN 1678 AND 2262
      WHEN regexp_full_match(x, '\d{4}\.\d{1,2}')
        THEN CAST(substr(x, 1, 4) AS INT) BETWEEN 1678 AND 2262
             AND CAST(substr(x, 6) AS INT) BETWEEN 1 AND 12
      WHEN regexp_full_match(x, '\d{8}')
        THEN coalesce(try_strptime(x, '%Y%m%d') BETWEEN TIMESTAMP '1677-09-22'
                      AND TIMESTAMP '2262-04-11', false)
      WHEN regexp_full_match(x, '\d{6}') THEN
        CASE WHEN CAST(substr(x, 1, 2) AS INT) > 31
               THEN try_strptime('19' || x, '%Y%m%d') IS NOT NULL
             WHEN CAST(substr(x, 1, 2) AS INT) > 12
               THEN try_strptime(x, '%d%m%y') IS NOT NULL
             ELSE try_strptime(x, '%m%d%y') IS NOT NULL END
      ELSE false END)
"""

# Standardised event matrix, neighbours, eps and density flags.
EVENT_MATRIX = f"""
medians AS (
  SELECT event_type AS dataset_id, quantile_cont(CAST(user_id AS DOUBLE), 0.5) AS mu,
         quantile_cont(value, 0.5) AS mv
  FROM dirty_events GROUP BY event_type),
filled AS (
  SELECT event_type AS dataset_id, row_id, coalesce(CAST(user_id AS DOUBLE), mu) AS u,
         coalesce(value, mv) AS w
  FROM dirty_events JOIN medians ON dataset_id = event_type),
moments AS (
  SELECT dataset_id, count(*) AS n, avg(u) AS au, stddev_pop(u) AS su, avg(w) AS aw,
         stddev_pop(w) AS sw FROM filled GROUP BY dataset_id),
matrix AS (
  SELECT dataset_id, row_id, (u - au) / su AS a, (w - aw) / sw AS b, n
  FROM filled JOIN moments USING (dataset_id))
"""


def density(matrix: str, minpts: int = 4) -> str:
    return f"""
pairs AS (
  SELECT p.dataset_id, p.row_id, q.row_id AS other,
         sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) AS dist
  FROM {matrix} p JOIN {matrix} q ON p.dataset_id = q.dataset_id),
kdist AS (
  SELECT dataset_id, row_id, min(dist, {minpts})[{minpts}] AS kd
  FROM pairs GROUP BY dataset_id, row_id),
eps_base AS (
  SELECT dataset_id, quantile_cont(kd, 0.9) AS base FROM kdist GROUP BY dataset_id),
eps AS (
  SELECT dataset_id, CASE WHEN base > 0 THEN base ELSE 0.5e0 END AS eps FROM eps_base),
core AS (
  SELECT dataset_id, row_id, kd <= eps AS core FROM kdist JOIN eps USING (dataset_id)),
noise AS (
  SELECT p.dataset_id, p.row_id, NOT bool_or(c.core) AS noise
  FROM pairs p JOIN eps e ON p.dataset_id = e.dataset_id
  JOIN core c ON c.dataset_id = p.dataset_id AND c.row_id = p.other
  WHERE p.dist <= e.eps GROUP BY p.dataset_id, p.row_id)
"""


EVENT_DENSITY = [DIRTY_EVENTS_SQL, EVENT_MATRIX, density("matrix")]

# Without accidental ties the number of scores above the cut follows from the
# rows, the contamination c and how often each vector occurs (w times).
def beyond(n: str, c: str, w: str = "1") -> str:
    return f"({n} - {w} * (floor(floor((1 - {c}) * ({n} - 1)) / {w}) + 1))"


# Scores of the document datasets.
DOCUMENT_MATRIX = """
dmoments AS (
  SELECT source AS dataset_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs,
         avg(doc_id) AS ad, stddev_pop(doc_id) AS sd, avg(n_chars) AS an, stddev_pop(n_chars) AS sn
  FROM dirty_documents GROUP BY source HAVING count(*) >= 10),
dmatrix AS (
  SELECT source AS dataset_id, row_id, (doc_id - ad) / sd AS a, (n_chars - an) / sn AS b
  FROM dirty_documents JOIN dmoments ON dataset_id = source)
"""

SCORES_ONLY = f"""
shape AS (
  SELECT c.dataset_id, c.sector, c.file_name, coalesce(s.n_rows, 0) AS rows, 4 AS cols,
         4 * coalesce(s.n_rows, 0) AS total_cells, coalesce(s.n_nulls, 0) AS n_nulls,
         coalesce(s.passing, 0e0) / 4 AS consistency
  FROM catalogue c LEFT JOIN (
    SELECT dataset_id, max(n_rows) AS n_rows, sum(n_nulls) AS n_nulls,
           sum(CASE WHEN CASE WHEN is_numeric THEN 1e0 WHEN n_rows = n_nulls THEN 0e0
                    ELSE n_clean / CAST(n_rows - n_nulls AS DOUBLE) END >= 0.95e0
               THEN 1 ELSE 0 END) AS passing
    FROM stats GROUP BY dataset_id) s USING (dataset_id)),
repeats AS (
  SELECT dataset_id, sum(copies - 1) AS repeated FROM (
    SELECT source AS dataset_id, count(*) AS copies FROM dirty_documents
    GROUP BY source, doc_id, n_chars, lang, text) g GROUP BY dataset_id),
rates AS (
  SELECT dataset_id,
         {beyond("n", "0.05e0", "CAST(n / n_docs AS BIGINT)")} / CAST(n AS DOUBLE) AS anomaly_rate
  FROM dmoments),
noise_rates AS (
  SELECT dataset_id, avg(CASE WHEN noise THEN 1e0 ELSE 0e0 END) AS noise_rate
  FROM noise GROUP BY dataset_id),
base AS (
  SELECT s.dataset_id, s.sector, s.file_name, s.rows, s.cols, s.total_cells, s.n_nulls,
         CASE WHEN s.rows = 0 THEN 0e0
              ELSE 1 - s.n_nulls / CAST(s.total_cells AS DOUBLE) END AS completeness,
         s.consistency,
         CASE WHEN s.rows = 0 THEN 0e0
              ELSE 1 - coalesce(d.repeated, 0) / CAST(s.rows AS DOUBLE) END AS uniqueness,
         1 - a.anomaly_rate AS accuracy, a.anomaly_rate AS if_anomaly_rate,
         z.noise_rate AS db_noise_rate,
         CASE WHEN u.last_update IS NULL THEN 0e0 ELSE greatest(0e0, 1 - least(1e0,
           date_diff('day', u.last_update, TIMESTAMP '2026-06-03') / 730e0)) END AS timeliness
  FROM shape s LEFT JOIN repeats d USING (dataset_id) LEFT JOIN rates a USING (dataset_id)
  LEFT JOIN noise_rates z USING (dataset_id) LEFT JOIN updates u USING (dataset_id)),
composed AS (
  SELECT *, (completeness + consistency + uniqueness) / 3 AS three_dim_composite,
         (completeness + consistency + uniqueness + timeliness + coalesce(accuracy, 0))
           / (4 + CASE WHEN accuracy IS NULL THEN 0 ELSE 1 END) AS full_composite,
         accuracy IS NOT NULL AS if_applicable, db_noise_rate IS NOT NULL AS db_applicable
  FROM base),
scores AS (
  SELECT *, CASE WHEN full_composite >= 0.85e0 THEN 'Band A'
                 WHEN full_composite >= 0.70e0 THEN 'Band B' ELSE 'Band C' END AS drl_band
  FROM composed)
"""
SCORES = [
    *DOCUMENT_STATS,
    UPDATES_SQL,
    DOCUMENT_MATRIX,
    density("dmatrix"),
    SCORES_ONLY,
]

GAPS = """
specs AS (
  SELECT * FROM (VALUES (0, '3.1', 'Accuracy', 'accuracy', 0.95e0),
    (1, '3.2', 'Completeness', 'completeness', 0.95e0),
    (2, '3.4', 'Consistency', 'consistency', 0.95e0),
    (3, '3.5', 'Validity', 'consistency', 0.95e0),
    (4, '3.7', 'Currency / Timeliness', 'timeliness', 0.8e0),
    (5, '3.13', 'Uniqueness', 'uniqueness', 0.99e0))
    t(spec_order, specification, ndmo_name, dimension, threshold)),
dims AS (
  SELECT dataset_id, sector, 'accuracy' AS dimension, accuracy AS value FROM scores
  UNION ALL SELECT dataset_id, sector, 'completeness', completeness FROM scores
  UNION ALL SELECT dataset_id, sector, 'consistency', consistency FROM scores
  UNION ALL SELECT dataset_id, sector, 'timeliness', timeliness FROM scores
  UNION ALL SELECT dataset_id, sector, 'uniqueness', uniqueness FROM scores),
gaps AS (
  SELECT dataset_id, sector, specification, ndmo_name, d.dimension, value, threshold,
         CASE WHEN value IS NULL THEN 'n/a' WHEN value >= threshold THEN 'pass'
              WHEN value < threshold - 0.05e0 THEN 'fail' ELSE 'borderline' END AS verdict
  FROM dims d JOIN specs s ON s.dimension = d.dimension),
verdicts AS (
  SELECT specification, ndmo_name, sector, n,
         CASE WHEN n = 0 THEN 'n/a' WHEN p >= f AND p >= b THEN 'pass'
              WHEN f >= b THEN 'fail' ELSE 'borderline' END AS majority,
         CASE WHEN n > 0 THEN round_even(100e0 * p / n, 1) END AS pct_pass
  FROM (SELECT specification, ndmo_name, sector,
               count(*) FILTER (WHERE verdict <> 'n/a') AS n,
               count(*) FILTER (WHERE verdict = 'pass') AS p,
               count(*) FILTER (WHERE verdict = 'fail') AS f,
               count(*) FILTER (WHERE verdict = 'borderline') AS b
        FROM gaps GROUP BY specification, ndmo_name, sector) g)
"""
GAP_CTES = [*SCORES, GAPS]

# Sources --------------------------------------------------------------------

SECTOR_ROWS = f"""
sector_rows AS (
  SELECT c.sector, d.doc_id, d.n_chars,
         CASE WHEN d.text IN {NULL_TOKENS} THEN NULL ELSE d.text END AS text,
         CASE WHEN d.lang IN {NULL_TOKENS} THEN NULL ELSE d.lang END AS lang
  FROM documents d JOIN catalogue c ON c.dataset_id = d.source)
"""
SECTOR_CTES = [CATALOGUE_SQL, SECTOR_ROWS]

query(
    "s01_catalogue_scan",
    *SECTOR_CTES,
    select="""
SELECT DISTINCT sector, upper(substr(sector, 1, 3)) AS prefix, CAST(1 AS BIGINT) AS first_number,
       true AS numbered_through FROM sector_rows""",
)
query(
    "s02_file_metadata",
    *SECTOR_CTES,
    select="""
SELECT DISTINCT sector, true AS sized, true AS digested, true AS all_different FROM sector_rows""",
)
query(
    "s03_load_status",
    *SECTOR_CTES,
    select="""
SELECT DISTINCT sector, sector <> 'books' AS all_loaded,
       CAST(CASE WHEN sector = 'books' THEN 1 ELSE 0 END AS BIGINT) AS errors FROM sector_rows""",
)
query(
    "s04_encoding",
    *SECTOR_CTES,
    select=f"SELECT DISTINCT sector, {ENCODING} AS encoding FROM sector_rows",
)
DELIMITER = """CASE sector WHEN 'press' THEN ',' WHEN 'web' THEN ';'
       WHEN 'books' THEN chr(9) ELSE '|' END"""
query(
    "s05_delimiter",
    *SECTOR_CTES,
    select=f"SELECT DISTINCT sector, {DELIMITER} AS delimiter FROM sector_rows",
)
query(
    "s06_delimited_parse",
    *SECTOR_CTES,
    select="""
SELECT sector, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS text_length,
       CAST(sum(n_chars) AS BIGINT) AS sum_chars FROM sector_rows GROUP BY sector""",
)
query(
    "s06_split_parse",
    *SECTOR_CTES,
    select="""
SELECT sector, count(*) AS n_rows, count(*) AS n_places, CAST(sum(length(text)) AS BIGINT) AS text_length,
       min(md5(text)) AS least_digest, max(md5(text)) AS largest_digest,
       CAST(sum(n_chars) AS BIGINT) AS sum_chars FROM sector_rows GROUP BY sector""",
)
_PAGES = " ".join(f"WHEN {i} THEN '{page}'" for i, page in enumerate(SCRIPTS))
query(
    "s04_code_pages",
    f"""
coded AS (
  SELECT doc_id, CASE WHEN lang <> 'en' THEN 'windows-1252' ELSE CASE doc_id % {len(SCRIPTS)} {_PAGES} END END AS page,
         CASE WHEN lang <> 'en' THEN regexp_replace(text, '{NOT_LATIN}', '', 'g')
              ELSE regexp_replace(lower(text), '[^a-z ]', '', 'g') END AS text
  FROM documents WHERE lang IS NOT NULL)""",
    f"""
kept AS (
  SELECT doc_id, page,
         CASE WHEN text = '' OR (page = 'windows-1252' AND text IN {NULL_TOKENS}) THEN NULL ELSE text END AS text
  FROM coded)""",
    select="""
SELECT page, page AS encoding, count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS sum_ids,
       CAST(sum(length(text)) AS BIGINT) AS text_length, min(md5(text)) AS least_digest,
       max(md5(text)) AS largest_digest FROM kept GROUP BY page""",
)
query(
    "s07_null_tokens",
    *SECTOR_CTES,
    select="""
SELECT sector, col_name, CAST(sum(missing) AS BIGINT) AS n_nulls FROM (
  SELECT sector, 'doc_id' AS col_name, 0 AS missing FROM sector_rows
  UNION ALL SELECT sector, 'n_chars', 0 FROM sector_rows
  UNION ALL SELECT sector, 'lang', CASE WHEN lang IS NULL THEN 1 ELSE 0 END FROM sector_rows
  UNION ALL SELECT sector, 'text', CASE WHEN text IS NULL THEN 1 ELSE 0 END FROM sector_rows) t
GROUP BY sector, col_name""",
)
query(
    "s08_type_inference",
    *SECTOR_CTES,
    select="""
SELECT DISTINCT sector, c.col_name, c.col_type, c.col_type = 'bigint' AS is_numeric
FROM sector_rows CROSS JOIN (VALUES ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'),
     ('n_chars', 'bigint')) c(col_name, col_type)""",
)
query(
    "s09_load_metadata",
    *SECTOR_CTES,
    select=f"""
SELECT {ENCODING} AS encoding, {DELIMITER} AS delimiter, CAST(4 AS BIGINT) AS cols,
       count(*) AS rows FROM sector_rows GROUP BY sector""",
)
query(
    "s10_csv_sink",
    *SCORES,
    select=f"""
SELECT dataset_id, sector, {r("completeness", "completeness")}, {r("consistency", "consistency")},
       rows, drl_band FROM scores""",
)
query(
    "s11_json_sink",
    *SCORES,
    select=f"""
SELECT count(*) AS n_datasets, CAST(sum(rows) AS BIGINT) AS portfolio_total_rows,
       {r("avg(completeness)", "mean_per_dataset_completeness")} FROM scores""",
)
query(
    "s12_result_reread",
    *GAP_CTES,
    select="""
SELECT 'dataset_scores' AS table_name, count(*) AS n FROM scores
UNION ALL SELECT 'if_contamination_sweep', 5 * count(*) FROM scores
UNION ALL SELECT 'gap_register', count(*) FROM gaps WHERE verdict IN ('fail', 'borderline')
UNION ALL SELECT 'if_dbscan_agreement', 0
UNION ALL SELECT 'kmeans_clusters', 0""",
)
query(
    "s13_manifest",
    select="""
SELECT CASE WHEN lang = 'en' AND upper(text) <> text THEN 'changed' ELSE 'ok' END AS status,
       count(*) AS n FROM documents GROUP BY 1""",
)
query(
    "s13_identical_files",
    select="""
SELECT sha256(text) AS sha256, count(*) AS copies,
       min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS first_path
FROM documents GROUP BY text HAVING count(*) > 1""",
)

# Profiling ------------------------------------------------------------------

query(
    "p01_shape",
    *DOCUMENT_STATS,
    select="""
SELECT c.dataset_id, CAST(coalesce(max(n_rows), 0) AS BIGINT) AS rows, CAST(4 AS BIGINT) AS cols,
       CAST(4 * coalesce(max(n_rows), 0) AS BIGINT) AS total_cells,
       CAST(coalesce(sum(n_nulls), 0) AS BIGINT) AS n_nulls
FROM catalogue c LEFT JOIN stats USING (dataset_id) GROUP BY c.dataset_id""",
)
query(
    "p02_null_cells",
    *EVENT_STATS,
    select="""
SELECT dataset_id, CAST(sum(n_nulls) AS BIGINT) AS n_nulls FROM stats GROUP BY dataset_id""",
)
DATE_CELLS = f"""
date_cells AS (
  SELECT dataset_id, col_idx, col_name, avg(CASE WHEN {IS_DATE} THEN 1e0 ELSE 0e0 END) AS date_share
  FROM cells WHERE x IS NOT NULL GROUP BY dataset_id, col_idx, col_name)
"""
LEADING_CELLS = f"""
date_cells AS (
  SELECT dataset_id, col_idx, col_name, avg(CASE WHEN {IS_DATE} THEN 1e0 ELSE 0e0 END) AS date_share
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, col_idx ORDER BY row_id) AS place
        FROM cells WHERE x IS NOT NULL) c
  WHERE place <= 50 GROUP BY dataset_id, col_idx, col_name)
"""
ORDERED_EVENTS = [
    DIRTY_EVENTS_SQL,
    long_cells("dirty_events", "event_type", EVENTS, "row_id,"),
    DATE_CELLS,
]
query(
    "p03_column_classes",
    *ORDERED_EVENTS,
    STATS,
    """
spread AS (
  SELECT dataset_id, col_idx, count(DISTINCT x) AS n_distinct, avg(length(x)) AS mean_length
  FROM cells GROUP BY dataset_id, col_idx)
""",
    select="""
SELECT s.dataset_id, s.col_name,
       CASE WHEN f.date_share > 0.8e0 THEN 'date' WHEN s.is_numeric THEN 'numeric'
            WHEN d.n_distinct / CAST(s.n_rows AS DOUBLE) > 0.5e0 AND d.mean_length > 20
            THEN 'freetext' ELSE 'categorical' END AS class
FROM stats s LEFT JOIN date_cells f USING (dataset_id, col_idx)
LEFT JOIN spread d USING (dataset_id, col_idx)""",
)
query(
    "p03a_date_share",
    *ORDERED_EVENTS,
    select=f"SELECT dataset_id, col_idx, {r('date_share', 'date_share')} FROM date_cells",
)
query(
    "p03a_date_share_of_first",
    *ORDERED_EVENTS[:2],
    LEADING_CELLS,
    select=f"SELECT dataset_id, col_idx, {r('date_share', 'date_share')} FROM date_cells",
)
query(
    "p03b_numeric_columns",
    *DOCUMENT_STATS,
    select="SELECT dataset_id, col_name, is_numeric FROM stats",
)
query(
    "p03c_freetext",
    *DOCUMENT_CELLS,
    select=f"""
SELECT dataset_id, col_name, count(DISTINCT x) AS n_distinct,
       {r("avg(length(x))", "mean_length")}
FROM cells WHERE col_name IN ('lang', 'text') AND x IS NOT NULL GROUP BY dataset_id, col_name""",
)
KINDS = """
spread AS (
  SELECT dataset_id, col_idx, count(DISTINCT x) AS n_distinct, avg(length(x)) AS mean_length
  FROM cells GROUP BY dataset_id, col_idx),
kinds AS (
  SELECT s.dataset_id,
         CASE WHEN f.date_share > 0.8e0 THEN 'date' WHEN s.is_numeric THEN 'numeric'
              WHEN d.n_distinct / CAST(s.n_rows AS DOUBLE) > 0.5e0 AND d.mean_length > 20
              THEN 'freetext' ELSE 'categorical' END AS class
  FROM stats s LEFT JOIN date_cells f USING (dataset_id, col_idx)
  LEFT JOIN spread d USING (dataset_id, col_idx))
"""
CLASS_COUNTS = """
SELECT c.dataset_id, count(*) FILTER (WHERE class = 'numeric') AS numeric_cols,
       count(*) FILTER (WHERE class = 'categorical') AS categorical_cols,
       count(*) FILTER (WHERE class = 'date') AS date_cols,
       count(*) FILTER (WHERE class = 'freetext') AS freetext_cols
FROM catalogue c LEFT JOIN kinds USING (dataset_id) GROUP BY c.dataset_id"""
query(
    "p03d_class_counts",
    DIRTY_DOCUMENTS_SQL,
    long_cells("dirty_documents", "source", DOCUMENTS, "row_id,"),
    CATALOGUE_SQL,
    STATS,
    DATE_CELLS,
    KINDS,
    select=CLASS_COUNTS,
)
query(
    "p04_date_likeness",
    long_cells("orders", "o_orderpriority", [("o_orderkey", True), ("o_orderdate", False)]),
    select=f"""
SELECT dataset_id, col_name,
       {r(f"avg(CASE WHEN {IS_DATE} THEN 1e0 ELSE 0e0 END)", "date_rate")}
FROM cells GROUP BY dataset_id, col_name""",
)

# Dimensions -----------------------------------------------------------------

query(
    "m01_completeness",
    *SCORES,
    select=f"""
SELECT dataset_id, {r("completeness", "completeness")}, CAST(n_nulls AS BIGINT) AS n_nulls,
       CAST(total_cells AS BIGINT) AS total_cells FROM scores""",
)
query(
    "m01_column_completeness",
    *EVENT_STATS,
    select=f"""
SELECT dataset_id, col_name, {r("1 - n_nulls / CAST(n_rows AS DOUBLE)", "completeness")}
FROM stats""",
)
query(
    "m02_uniqueness",
    *SCORES,
    select=f"""
SELECT s.dataset_id, {r("uniqueness", "uniqueness")},
       CAST(coalesce(repeated, 0) AS BIGINT) AS duplicate_rows, CAST(rows AS BIGINT) AS total_rows
FROM scores s LEFT JOIN repeats USING (dataset_id)""",
)
query(
    "m02_uniqueness_lineitem",
    select=f"""
SELECT l_returnflag AS dataset_id, {r("count(*) / CAST(sum(c) AS DOUBLE)", "uniqueness")},
       CAST(sum(c) - count(*) AS BIGINT) AS duplicate_rows, CAST(sum(c) AS BIGINT) AS total_rows
FROM (SELECT l_returnflag, count(*) AS c FROM lineitem
      GROUP BY l_returnflag, l_linenumber, l_quantity, l_discount, l_tax, l_linestatus) g
GROUP BY l_returnflag""",
)
query(
    "m03_numeric_parse_rate",
    *EVENT_CELLS,
    select=f"""
SELECT dataset_id, col_name, {r('''coalesce(avg(CASE WHEN typed OR
  try_cast(x AS DOUBLE) IS NOT NULL THEN 1e0 ELSE 0e0 END) FILTER (WHERE x IS NOT NULL), 1e0)''',
  "numeric_rate")}
FROM cells GROUP BY dataset_id, col_name""",
)
query(
    "m04_date_parse_rate",
    *EVENT_CELLS,
    select=f"""
SELECT dataset_id, col_name, {r(f'''coalesce(avg(CASE WHEN {IS_DATE}
  THEN 1e0 ELSE 0e0 END) FILTER (WHERE x IS NOT NULL), 1e0)''', "date_rate")}
FROM cells GROUP BY dataset_id, col_name""",
)
query(
    "m05_clean_rate",
    *DOCUMENT_STATS,
    select=f"""
SELECT dataset_id, col_name, {r('''CASE WHEN n_rows = n_nulls THEN 0e0
  ELSE n_clean / CAST(n_rows - n_nulls AS DOUBLE) END''', "clean_rate")} FROM stats""",
)
CONFORMANCE = """CASE WHEN is_numeric THEN 1e0 WHEN n_rows = n_nulls THEN 0e0
  ELSE n_clean / CAST(n_rows - n_nulls AS DOUBLE) END"""
query(
    "m06_conformance",
    *EVENT_STATS,
    select=f"""
SELECT dataset_id, col_name, {r(CONFORMANCE, "conformance")}, {CONFORMANCE} >= 0.95e0 AS passes
FROM stats""",
)
query(
    "m07_consistency",
    *SCORES,
    select=f"SELECT dataset_id, {r('consistency', 'consistency')} FROM scores",
)
query(
    "m08_timeliness",
    CATALOGUE_SQL,
    UPDATES_SQL,
    """
lags AS (
  SELECT c.dataset_id, date_diff('day', last_update, TIMESTAMP '2026-06-03') AS lag
  FROM catalogue c LEFT JOIN updates USING (dataset_id))
""",
    select=f"""
SELECT dataset_id, {r('''CASE WHEN lag IS NULL THEN 0e0
  ELSE greatest(0e0, 1 - least(1e0, lag / 730e0)) END''', "timeliness")},
       CAST(lag AS BIGINT) AS days_lag,
       CASE WHEN lag IS NOT NULL THEN CAST(365 AS BIGINT) END AS stated_frequency_days,
       coalesce(lag > 730, true) AS stale
FROM lags""",
)
query(
    "m09_composite_weighted",
    *SCORES,
    select=f"""
SELECT dataset_id, {r('''(3 * completeness + consistency + coalesce(2 * accuracy, 0))
  / (4 + CASE WHEN accuracy IS NULL THEN 0 ELSE 2 END)''', "composite")} FROM scores""",
)
query(
    "m10_readiness_band",
    *SCORES,
    select="""
SELECT dataset_id, CASE WHEN consistency >= 0.85e0 THEN 'Band A'
       WHEN consistency >= 0.7e0 THEN 'Band B' ELSE 'Band C' END AS band FROM scores""",
)
query(
    "m11_three_dimensions",
    *SCORES,
    select=f"SELECT dataset_id, {r('three_dim_composite', 'three_dim_composite')} FROM scores",
)
query(
    "m12_full_composite",
    *SCORES,
    select=f"""
SELECT dataset_id, {r("accuracy", "accuracy")}, {r("timeliness", "timeliness")},
       {r("full_composite", "full_composite")}, drl_band FROM scores""",
)
query(
    "m13_update_proxy",
    DIRTY_EVENTS_SQL,
    """
lags AS (
  SELECT event_type AS dataset_id,
         CAST(floor(epoch(TIMESTAMP '2024-02-05 12:00:00' - max(ts)) / 86400) AS BIGINT) AS lag
  FROM dirty_events GROUP BY event_type)
""",
    select=f"""
SELECT dataset_id, {r("greatest(0e0, 1 - least(1e0, lag / 14e0))", "timeliness")},
       lag AS days_lag, CAST(7 AS BIGINT) AS stated_frequency_days, lag > 14 AS stale FROM lags""",
)

# Detectors ------------------------------------------------------------------

query(
    "a01_numeric_matrix",
    DIRTY_EVENTS_SQL,
    EVENT_MATRIX,
    select=f"""
SELECT dataset_id, row_id, {r("a", "user_id")}, {r("b", "value")}, n AS n_records FROM matrix""",
)
query(
    "a01_full_matrix",
    """
keyed AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-'
         || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS row_id,
         l_quantity AS q, l_extendedprice AS p FROM lineitem),
moments AS (
  SELECT count(*) AS n, avg(q) AS aq, stddev_pop(q) AS sq, avg(p) AS ap, stddev_pop(p) AS sp
  FROM keyed)
""",
    select=f"""
SELECT row_id, {r("(q - aq) / sq", "quantity")}, {r("(p - ap) / sp", "price")}, n AS n_records
FROM keyed CROSS JOIN moments""",
)


def forest(matrix: str, trees: int = 100, sample: int = 256, levels: int = 8) -> str:
    """CTE ``forest_scores``: the same trees grown and walked level by level."""
    usual = "CASE WHEN {0} > 2 THEN 2 * (ln({0} - 1) + 0.5772156649e0) - 2e0 * ({0} - 1) / {0} WHEN {0} = 2 THEN 1e0 ELSE 0e0 END"
    name = "'42:' || dataset_id || '/' || tree || '/' || node"
    key = "dataset_id, tree, node"
    wanted, prime = lots_wanted(sample), least_prime(trees)
    parts = [
        f"""
shares AS (
  SELECT dataset_id, least(1e0, {wanted}e0 / any_value(n)) AS share FROM {matrix} GROUP BY dataset_id),
chances AS MATERIALIZED (
  SELECT dataset_id, k, CASE WHEN share = 1 THEN 0e0 ELSE sum(exp(
           lgamma({trees} + 1) - lgamma(k + 1) - lgamma({trees} - k + 1)
           + k * ln(share) + ({trees} - k) * ln(CASE WHEN share < 1 THEN 1 - share ELSE 1 END)))
         OVER (PARTITION BY dataset_id ORDER BY k) END AS upto
  FROM shares, range(0, {trees}) r(k)),
digests AS (
  SELECT dataset_id, row_id, a, b, n, md5('42/' || row_id) AS d FROM {matrix}),
numbers AS MATERIALIZED (
  SELECT dataset_id, row_id, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, count(*) AS number,
         any_value(CAST('0x' || substr(d, 14, 7) AS BIGINT) % {prime}) AS first,
         any_value(1 + CAST('0x' || substr(d, 21, 7) AS BIGINT) % ({prime} - 1)) AS step
  FROM digests JOIN chances USING (dataset_id)
  WHERE upto <= CAST('0x' || substr(d, 1, 13) AS BIGINT) / 4503599627370496e0
  GROUP BY dataset_id, row_id),
lots AS MATERIALIZED (
  SELECT dataset_id, (first + j * step) % {prime} AS tree, a, b, least({sample}, n) AS psi,
         md5('42:' || (first + j * step) % {prime} || ':' || row_id) AS lot
  FROM numbers, range(0, {prime}) r(j) WHERE (first + j * step) % {prime} < {trees}
  QUALIFY row_number() OVER (PARTITION BY dataset_id, row_id ORDER BY j) <= number),
points0 AS MATERIALIZED (
  SELECT dataset_id, tree, CAST(1 AS BIGINT) AS node, a, b, psi FROM lots
  QUALIFY row_number() OVER (PARTITION BY dataset_id, tree ORDER BY lot) <= {sample}),
walk0 AS (
  SELECT dataset_id, row_id, t AS tree, CAST(1 AS BIGINT) AS node, a, b
  FROM {matrix}, range(0, {trees}) r(t))"""
    ]
    for i in range(levels + 1):
        parts.append(f"""
ranges{i} AS (
  SELECT {key}, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, count(*) AS size,
         any_value(psi) AS psi
  FROM points{i} GROUP BY {key}),
picked{i} AS (
  SELECT *, CASE WHEN {i} >= ceil(log2(psi)) OR (ha <= la AND hb <= lb) THEN -1
                 WHEN hb <= lb THEN 0 WHEN ha <= la THEN 1
                 WHEN md5({name} || '/0') <= md5({name} || '/1') THEN 0 ELSE 1 END AS f,
         CAST('0x' || substr(md5({name}), 1, 13) AS BIGINT) / 4503599627370496e0 AS u
  FROM ranges{i}),
nodes{i} AS MATERIALIZED (
  SELECT {key}, f, {i} + {usual.format("size")} AS path, {usual.format("psi")} AS usual,
         CASE f WHEN 0 THEN (CASE WHEN la + u * (ha - la) < ha THEN la + u * (ha - la) ELSE la END)
                ELSE (CASE WHEN lb + u * (hb - lb) < hb THEN lb + u * (hb - lb) ELSE lb END) END AS cut
  FROM picked{i})""")
        if i < levels:
            for name_of, columns in (("points", "a, b, psi"), ("walk", "row_id, a, b")):
                parts.append(f"""
{name_of}{i + 1} AS MATERIALIZED (
  SELECT dataset_id, tree, {columns},
         2 * node + CASE WHEN (CASE f WHEN 0 THEN a ELSE b END) > cut THEN 1 ELSE 0 END AS node
  FROM {name_of}{i} JOIN nodes{i} USING ({key}) WHERE f >= 0)""")
    ends = " UNION ALL ".join(
        f"SELECT dataset_id, row_id, path, usual FROM walk{i} JOIN nodes{i} USING ({key}) WHERE f < 0"
        for i in range(levels + 1)
    )
    parts.append(f"""
forest_scores AS MATERIALIZED (
  SELECT dataset_id, row_id, pow(2e0, -(sum(path) / {trees}e0) / any_value(usual)) AS score
  FROM ({ends}) e GROUP BY dataset_id, row_id)""")
    return ",".join(parts)


FOREST = [DIRTY_EVENTS_SQL, EVENT_MATRIX, forest("matrix")]
FOREST_CUTS = ",\n".join(
    f"k{i} AS (SELECT dataset_id, CAST({c} AS DOUBLE) AS c, quantile_cont(score, {1 - c!r}) AS cut "
    "FROM forest_scores GROUP BY dataset_id)"
    for i, c in enumerate([0.02, 0.05, 0.075, 0.10, 0.15])
)
FOREST_SWEEP = [
    *FOREST,
    FOREST_CUTS,
    """
sweep AS (
  SELECT p.dataset_id, c, avg(CASE WHEN score > cut THEN 1e0 ELSE 0e0 END) AS rate
  FROM forest_scores p JOIN (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2
                             UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4) k USING (dataset_id)
  GROUP BY p.dataset_id, c)
""",
]
query(
    "a02_forest_scores",
    *FOREST,
    select=f"SELECT dataset_id, row_id, {r('score', 'score')} FROM forest_scores",
)
query(
    "a02_isolation_forest",
    *FOREST,
    FOREST_CUTS,
    select=f"""
SELECT p.dataset_id, true AS applicable,
       {r("avg(CASE WHEN score > cut THEN 1e0 ELSE 0e0 END)", "anomaly_rate")},
       {r("avg(score)", "anomaly_score_mean")}, {r("stddev_pop(score)", "anomaly_score_std")},
       {r("1 - avg(CASE WHEN score > cut THEN 1e0 ELSE 0e0 END)", "accuracy_proxy")},
       count(*) AS n_records, 2 AS n_features
FROM forest_scores p JOIN k1 USING (dataset_id) GROUP BY p.dataset_id""",
)
PRICES = """
prices AS (
  SELECT o_orderpriority AS dataset_id, CAST(o_orderkey AS VARCHAR) AS row_id,
         abs(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority)) AS score
  FROM orders)
"""
query(
    "a02a_percentile_cut",
    PRICES,
    """
cuts AS (
  SELECT dataset_id, quantile_cont(score, 0.95) AS cut FROM prices GROUP BY dataset_id)
""",
    select="SELECT dataset_id, row_id, score > cut AS anomaly FROM prices JOIN cuts USING (dataset_id)",
)
query(
    "a03_contamination_sweep",
    *FOREST_SWEEP,
    select=f"""
SELECT dataset_id, {r("c", "contamination")}, {r("rate", "anomaly_rate")}, true AS applicable
FROM sweep""",
)
PRICE_CUTS = ",\n".join(
    f"c{i} AS (SELECT dataset_id, CAST({c} AS DOUBLE) AS c, quantile_cont(score, {1 - c!r}) AS cut "
    "FROM prices GROUP BY dataset_id)"
    for i, c in enumerate([0.02, 0.05, 0.075, 0.10, 0.15])
)
PRICE_SWEEP = [
    PRICES,
    PRICE_CUTS,
    """
sweep AS (
  SELECT p.dataset_id, c, avg(CASE WHEN score > cut THEN 1e0 ELSE 0e0 END) AS rate
  FROM prices p JOIN (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2
                      UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4) k USING (dataset_id)
  GROUP BY p.dataset_id, c)
""",
]
query(
    "a03_sweep_of_prices",
    *PRICE_SWEEP,
    select=f"""
SELECT dataset_id, {r("c", "contamination")}, {r("rate", "anomaly_rate")}, true AS applicable
FROM sweep""",
)
STABILITY = """
places AS (
  SELECT dataset_id, c, rank() OVER (PARTITION BY c ORDER BY rate)
         + (count(*) OVER (PARTITION BY c, rate) - 1) / 2e0 AS place FROM sweep),
stability AS (
  SELECT p.c, count(*) AS n_datasets,
         CASE WHEN p.c = 0.05e0 THEN 1e0
              WHEN stddev_pop(p.place) * stddev_pop(b.place) > 0
              THEN covar_pop(p.place, b.place) / (stddev_pop(p.place) * stddev_pop(b.place))
         END AS rho
  FROM places p JOIN places b ON b.dataset_id = p.dataset_id AND b.c = 0.05e0 GROUP BY p.c)
"""
query(
    "a04_rank_stability",
    *PRICE_SWEEP,
    STABILITY,
    select=f"""
SELECT {r("c", "contamination")}, n_datasets, {r("rho", "spearman")} FROM stability""",
)
query(
    "a05_calibrated_eps",
    *EVENT_DENSITY,
    select=f"SELECT dataset_id, 4 AS minpts, {r('eps', 'eps')} FROM eps",
)
query(
    "a06_dbscan_noise",
    *EVENT_DENSITY,
    select=f"""
SELECT dataset_id, true AS applicable,
       {r("avg(CASE WHEN noise THEN 1e0 ELSE 0e0 END)", "noise_rate")},
       {r("max(eps)", "eps_used")}, 4 AS minpts, count(*) AS n_records
FROM noise JOIN eps USING (dataset_id) GROUP BY dataset_id""",
)
query(
    "a06_noise_labels",
    *EVENT_DENSITY,
    select="SELECT dataset_id, row_id, noise FROM noise",
)
query(
    "a06_cluster_counts",
    DIRTY_DOCUMENTS_SQL,
    DOCUMENT_MATRIX,
    density("dmatrix"),
    """
links AS (
  SELECT p.dataset_id, p.row_id, p.other FROM pairs p JOIN eps e ON e.dataset_id = p.dataset_id
  JOIN core a ON a.dataset_id = p.dataset_id AND a.row_id = p.row_id AND a.core
  JOIN core b ON b.dataset_id = p.dataset_id AND b.row_id = p.other AND b.core
  WHERE p.dist <= e.eps),
reach(dataset_id, row_id, other) AS (
  SELECT dataset_id, row_id, other FROM links
  UNION SELECT r.dataset_id, r.row_id, l.other FROM reach r
        JOIN links l ON l.dataset_id = r.dataset_id AND l.row_id = r.other),
groups AS (
  SELECT dataset_id, row_id, min(other) AS grp FROM reach GROUP BY dataset_id, row_id)
""",
    select="""
SELECT dataset_id, CAST(count(DISTINCT grp) AS INTEGER) AS n_clusters
FROM groups GROUP BY dataset_id""",
)
FLAGS = """
cuts AS (SELECT dataset_id, quantile_cont(abs(b), 0.95) AS cut FROM matrix GROUP BY dataset_id),
flags AS (
  SELECT m.dataset_id, m.row_id, abs(b) > cut AS anomaly, noise
  FROM matrix m JOIN cuts USING (dataset_id)
  JOIN noise z ON z.dataset_id = m.dataset_id AND z.row_id = m.row_id),
counts AS (
  SELECT dataset_id, count(*) FILTER (WHERE anomaly) AS x, count(*) FILTER (WHERE noise) AS y,
         count(*) FILTER (WHERE anomaly AND noise) AS o, count(*) AS n
  FROM flags GROUP BY dataset_id),
agreed AS (
  SELECT *, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa,
         CASE WHEN x + y - o = 0 THEN 0e0 ELSE o / CAST(x + y - o AS DOUBLE) END AS jaccard
  FROM (SELECT *, (n - x - y + 2 * o) / CAST(n AS DOUBLE) AS po,
               (x * y + (n - x) * (n - y)) / (CAST(n AS DOUBLE) * n) AS pe FROM counts) c),
agreement AS (
  SELECT *, CASE WHEN kappa IS NULL THEN 'n/a' WHEN kappa < 0 THEN 'poor'
              WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair'
              WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial'
              ELSE 'almost perfect' END AS kappa_interp FROM agreed)
"""
AGREEMENT = [*EVENT_DENSITY, FLAGS]
query(
    "a07_agreement",
    *AGREEMENT,
    select=f"""
SELECT dataset_id, true AS applicable, {r("kappa", "kappa")}, {r("jaccard", "jaccard")},
       x AS if_anom_count, y AS dbscan_noise_count, o AS overlap, n AS n_records, kappa_interp
FROM agreement""",
)
query(
    "a08_kappa_label",
    DIRTY_EVENTS_SQL,
    EVENT_MATRIX,
    select="""
SELECT dataset_id, CASE WHEN k < 0 THEN 'poor' WHEN k < 0.2e0 THEN 'slight'
       WHEN k < 0.4e0 THEN 'fair' WHEN k < 0.6e0 THEN 'moderate' WHEN k < 0.8e0 THEN 'substantial'
       ELSE 'almost perfect' END AS label, count(*) AS n
FROM (SELECT dataset_id, round(b, 6) AS k FROM matrix) m GROUP BY 1, 2""",
)
query(
    "a09_agreement_means",
    *AGREEMENT,
    select=f"""
SELECT {r("avg(kappa)", "mean_if_dbscan_kappa")}, {r("avg(jaccard)", "mean_if_dbscan_jaccard")}
FROM agreement""",
)
PROFILES = """
profiles AS (
  SELECT dataset_id, sector, drl_band,
         (completeness - avg(completeness) OVER ()) / s1 AS x,
         (consistency - avg(consistency) OVER ()) / s2 AS y,
         (uniqueness - avg(uniqueness) OVER ()) / s3 AS z
  FROM scores CROSS JOIN (
    SELECT stddev_samp(completeness) AS s1, stddev_samp(consistency) AS s2,
           stddev_samp(uniqueness) AS s3 FROM scores) d)
"""
query(
    "a10_profile_vectors",
    *SCORES,
    PROFILES,
    select=f"""
SELECT dataset_id, {r("x", "completeness")}, {r("y", "consistency")}, {r("z", "uniqueness")}
FROM profiles""",
)
query(
    "a12_silhouette",
    *SCORES,
    PROFILES,
    """
labelled AS (
  SELECT dataset_id, x, y, z, 0 AS candidate, sector AS label FROM profiles
  UNION ALL SELECT dataset_id, x, y, z, 1, drl_band FROM profiles),
gaps AS (
  SELECT p.candidate, p.dataset_id, p.label, q.label AS other, count(*) AS n,
         sum(sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z))) AS total
  FROM labelled p JOIN labelled q ON q.candidate = p.candidate
  GROUP BY p.candidate, p.dataset_id, p.label, q.label),
parts AS (
  SELECT candidate, dataset_id, max(CASE WHEN other = label THEN n END) AS size,
         max(CASE WHEN other = label AND n > 1 THEN total / (n - 1) END) AS a,
         min(CASE WHEN other <> label THEN total / n END) AS b
  FROM gaps GROUP BY candidate, dataset_id)
""",
    select=f"""
SELECT candidate, {r('''CASE WHEN count(b) = 0 THEN -1e0
  ELSE avg(CASE WHEN size = 1 OR greatest(a, b) = 0 THEN 0e0
           ELSE (b - a) / greatest(a, b) END) END''', "silhouette")}
FROM parts GROUP BY candidate""",
)


CLUSTERED = [*SCORES, PROFILES.replace("profiles AS (", "profiles AS MATERIALIZED ("), partitions()]
query(
    "a13_cluster_meta",
    *CLUSTERED,
    select=f"""
SELECT k AS k_selected, {r("silhouette", "silhouette")}, (SELECT count(*) FROM candidates) AS n_candidates
FROM chosen""",
)
query(
    "r06_selection_series",
    *CLUSTERED,
    select=f"SELECT k, {r('inertia', 'inertia')}, {r('silhouette', 'silhouette')} FROM candidates",
)
query(
    "r07_centroids",
    *CLUSTERED,
    select=" UNION ALL ".join(
        f"SELECT cluster, '{name}' AS feature, {r('c' + axis, 'value')} FROM centroids"
        for axis, name in (("x", "completeness"), ("y", "consistency"), ("z", "uniqueness"))
    ),
)


def _power(name: str, matrix: str, steps: int = 600) -> str:
    """The leading eigenvector (a, b, c) of a symmetric 3 x 3 matrix, its sign
    such that the largest loading is positive, and its eigenvalue."""
    norm = "sqrt(na * na + nb * nb + nc * nc)"
    return f"""
{name}_steps AS (
  SELECT 0 AS i, 1e0 AS a, 0.9e0 AS b, 0.7e0 AS c
  UNION ALL
  SELECT i + 1, na / {norm}, nb / {norm}, nc / {norm}
  FROM (SELECT i, xx * a + xy * b + xz * c AS na, xy * a + yy * b + yz * c AS nb,
               xz * a + yz * b + zz * c AS nc
        FROM {name}_steps CROSS JOIN {matrix}) s
  WHERE i < {steps}),
{name} AS (
  SELECT a * sign AS a, b * sign AS b, c * sign AS c,
         xx * a * a + yy * b * b + zz * c * c + 2 * (xy * a * b + xz * a * c + yz * b * c) AS value
  FROM (SELECT *, CASE WHEN (CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN a
                                  WHEN abs(b) >= abs(c) THEN b ELSE c END) >= 0 THEN 1 ELSE -1 END AS sign
        FROM {name}_steps WHERE i = {steps}) e CROSS JOIN {matrix})"""


query(
    "a14_projection",
    *SCORES,
    """
centred AS (
  SELECT dataset_id, (u - avg(u) OVER ()) / s1 AS x, (v - avg(v) OVER ()) / s2 AS y,
         (w - avg(w) OVER ()) / s3 AS z
  FROM (SELECT dataset_id, coalesce(completeness, 0e0) AS u, coalesce(consistency, 0e0) AS v,
               coalesce(uniqueness, 0e0) AS w FROM scores) f
  CROSS JOIN (
    SELECT stddev_pop(coalesce(completeness, 0e0)) AS s1, stddev_pop(coalesce(consistency, 0e0)) AS s2,
           stddev_pop(coalesce(uniqueness, 0e0)) AS s3 FROM scores) d),
spread AS (
  SELECT avg(x * x) AS xx, avg(x * y) AS xy, avg(x * z) AS xz, avg(y * y) AS yy, avg(y * z) AS yz,
         avg(z * z) AS zz FROM centred)
""",
    _power("first", "spread"),
    """
rest AS (
  SELECT xx - value * a * a AS xx, xy - value * a * b AS xy, xz - value * a * c AS xz,
         yy - value * b * b AS yy, yz - value * b * c AS yz, zz - value * c * c AS zz
  FROM spread CROSS JOIN first)
""",
    _power("second", "rest"),
    select=f"""
SELECT dataset_id, {r("x * f.a + y * f.b + z * f.c", "pc1", 5)}, {r("x * s.a + y * s.b + z * s.c", "pc2", 5)},
       {r("f.value / (xx + yy + zz)", "share_1", 5)}, {r("s.value / (xx + yy + zz)", "share_2", 5)}
FROM centred CROSS JOIN first f CROSS JOIN second s CROSS JOIN spread""",
)

# Compliance -----------------------------------------------------------------

query(
    "c01_specifications",
    *GAP_CTES,
    select="""
SELECT specification, ndmo_name, dimension, threshold, count(value) AS n_values
FROM gaps GROUP BY ALL""",
)


def _verdict(value: str, threshold: str) -> str:
    return f"""CASE WHEN {value} IS NULL THEN 'n/a' WHEN {value} >= {threshold} THEN 'pass'
      WHEN {value} < {threshold} - 0.05e0 THEN 'fail' ELSE 'borderline' END"""


query(
    "c02_verdict",
    *SCORES,
    select=f"""
SELECT dataset_id, {_verdict("completeness", "0.95e0")} AS completeness_verdict,
       {_verdict("timeliness", "0.8e0")} AS timeliness_verdict,
       {_verdict("accuracy", "0.95e0")} AS accuracy_verdict FROM scores""",
)
query(
    "c03_gap_report",
    *GAP_CTES,
    select=f"""
SELECT dataset_id, sector, specification, ndmo_name, dimension, {r("value", "value")},
       threshold, verdict FROM gaps""",
)
_wide = ", ".join(
    f"max(CASE WHEN sector = '{s}' THEN majority END) AS {s}, "
    f"max(CASE WHEN sector = '{s}' THEN n END) AS {s}_n, "
    f"max(CASE WHEN sector = '{s}' THEN pct_pass END) AS {s}_pct_pass"
    for s in ("books", "forum", "press", "web")
)
query(
    "c04_sector_matrix",
    *GAP_CTES,
    select=f"""
SELECT specification, ndmo_name AS name, {_wide} FROM verdicts GROUP BY specification, ndmo_name""",
)
query(
    "c05_gap_register",
    *GAP_CTES,
    select=f"""
SELECT dataset_id, sector, specification, ndmo_name, dimension, {r("value", "observed")},
       threshold, verdict FROM gaps WHERE verdict IN ('fail', 'borderline')
ORDER BY verdict, sector, specification, dataset_id""",
)

# Portfolio ------------------------------------------------------------------

query(
    "k01_portfolio_completeness",
    *SCORES,
    select=f"""
SELECT CAST(sum(total_cells) AS BIGINT) AS portfolio_total_cells,
       CAST(sum(n_nulls) AS BIGINT) AS portfolio_nulls,
       {r("1 - sum(n_nulls) / CAST(sum(total_cells) AS DOUBLE)",
          "portfolio_completeness_aggregate")} FROM scores""",
)
HEADLINE = f"""
headline AS (
  SELECT count(*) AS n_datasets, CAST(sum(rows) AS BIGINT) AS portfolio_total_rows,
    CAST(sum(total_cells) AS BIGINT) AS portfolio_total_cells,
    {r("1 - sum(n_nulls) / CAST(sum(total_cells) AS DOUBLE)", "portfolio_completeness_aggregate")},
    {r("avg(completeness)", "mean_per_dataset_completeness")},
    {r("stddev_samp(completeness)", "sd_per_dataset_completeness")},
    count(*) FILTER (WHERE completeness >= 0.95e0) AS datasets_meeting_95pct_completeness,
    {r("avg(consistency)", "mean_per_dataset_consistency")},
    {r("stddev_samp(consistency)", "sd_per_dataset_consistency")},
    count(*) FILTER (WHERE consistency >= 0.95e0) AS datasets_meeting_95pct_consistency,
    {r("avg(uniqueness)", "mean_per_dataset_uniqueness")},
    count(*) FILTER (WHERE uniqueness >= 0.99e0) AS datasets_lt_1pct_duplicates,
    count(*) FILTER (WHERE if_applicable) AS if_applicable_count,
    {r("avg(if_anomaly_rate)", "mean_if_anomaly_rate")},
    count(*) FILTER (WHERE db_applicable) AS db_applicable_count,
    {r("avg(db_noise_rate)", "mean_db_noise_rate")}
  FROM scores)
"""
query("k02_headline", *SCORES, HEADLINE, select="SELECT * FROM headline")
query(
    "k03_band_distribution",
    *SCORES,
    select="SELECT drl_band, count(*) AS n FROM scores GROUP BY drl_band ORDER BY n DESC, drl_band",
)
BANDS = """
spec_scores AS (
  SELECT dataset_id, 'as_reported_available_dims' AS specification, 'available' AS dimensions,
         full_composite AS score FROM scores
  UNION ALL SELECT dataset_id, 'completeness_consistency', 'completeness+consistency',
         (completeness + consistency) / 2 FROM scores
  UNION ALL SELECT dataset_id, 'completeness_consistency_uniqueness',
         'completeness+consistency+uniqueness', three_dim_composite FROM scores
  UNION ALL SELECT dataset_id, 'excl_timeliness_incl_accuracy',
         'completeness+consistency+uniqueness+accuracy',
         (completeness + consistency + uniqueness + coalesce(accuracy, 0))
           / (3 + CASE WHEN accuracy IS NULL THEN 0 ELSE 1 END) FROM scores),
banded AS (
  SELECT *, CASE WHEN score >= 0.85e0 THEN 'Band A' WHEN score >= 0.7e0 THEN 'Band B'
                 ELSE 'Band C' END AS band FROM spec_scores),
sensitivity AS (
  SELECT specification, dimensions, count(*) AS n,
         count(*) FILTER (WHERE band = 'Band A') AS band_a,
         count(*) FILTER (WHERE band = 'Band B') AS band_b,
         count(*) FILTER (WHERE band = 'Band C') AS band_c,
         round_even(100e0 * count(*) FILTER (WHERE band = 'Band A') / count(*), 1) AS pct_band_a
  FROM banded GROUP BY specification, dimensions)
"""
query("k04_band_sensitivity", *SCORES, BANDS, select="SELECT * FROM sensitivity")
_spec_columns = ", ".join(
    f"max(CASE WHEN specification = '{s}' THEN round_even(score, 4) END) AS score_{s}, "
    f"max(CASE WHEN specification = '{s}' THEN band END) AS band_{s}"
    for s in (
        "as_reported_available_dims",
        "completeness_consistency",
        "completeness_consistency_uniqueness",
        "excl_timeliness_incl_accuracy",
    )
)
_dimension_columns = ", ".join(
    r(f"max(s.{d})", d)
    for d in ("completeness", "consistency", "uniqueness", "accuracy", "timeliness")
)
query(
    "k05_bands_per_dataset",
    *SCORES,
    BANDS,
    select=f"""
SELECT dataset_id, max(s.sector) AS sector, {_dimension_columns},
       {r("max(s.full_composite)", "full_composite")}, {_spec_columns}
FROM banded JOIN scores s USING (dataset_id) GROUP BY dataset_id""",
)
query(
    "k06_band_share_interval",
    *SCORES,
    BANDS,
    select="""
SELECT min(pct_band_a) AS band_a_min_pct, max(pct_band_a) AS band_a_max_pct FROM sensitivity""",
)
SUMMARY = """
summary AS (
  SELECT sector, count(*) AS n, round_even(avg(completeness), 4) AS completeness_mean,
         round_even(stddev_samp(completeness), 4) AS completeness_sd,
         round_even(min(completeness), 4) AS completeness_min,
         round_even(max(completeness), 4) AS completeness_max,
         round_even(avg(consistency), 4) AS consistency_mean,
         round_even(stddev_samp(consistency), 4) AS consistency_sd,
         round_even(avg(uniqueness), 4) AS uniqueness_mean,
         round_even(avg(if_anomaly_rate), 4) AS if_anomaly_mean
  FROM scores GROUP BY sector)
"""
query("k07_sector_summary", *SCORES, SUMMARY, select="SELECT * FROM summary")
for _dimension in ("completeness", "consistency"):
    query(
        f"k08_sector_{_dimension}",
        *SCORES,
        select=f"""
SELECT coalesce(sector, 'Portfolio') AS sector, count(*) AS n, {r(f"avg({_dimension})", "mean")},
       {r(f"stddev_samp({_dimension})", "sd")}, {r(f"min({_dimension})", "min")},
       {r(f"max({_dimension})", "max")},
       {r(f"100e0 * count(*) FILTER (WHERE {_dimension} >= 0.95e0) / count(*)", "pct_meeting")}
FROM scores GROUP BY ROLLUP (sector)""",
    )

# Joins, windows, sorts ------------------------------------------------------

query(
    "j01_scores_with_classes",
    *SCORES,
    """
classes AS (
  SELECT dataset_id, count(*) FILTER (WHERE class = 'numeric') AS numeric_cols,
         count(*) FILTER (WHERE class = 'categorical') AS categorical_cols,
         count(*) FILTER (WHERE class = 'date') AS date_cols
  FROM (
    SELECT dataset_id, col_name,
           CASE WHEN avg(CASE WHEN place <= 50 THEN CASE WHEN """
    + IS_DATE
    + """ THEN 1e0 ELSE 0e0 END END) > 0.8e0 THEN 'date'
                WHEN bool_and(typed) THEN 'numeric'
                WHEN count(DISTINCT x) / CAST(max(n_all) AS DOUBLE) > 0.5e0
                     AND avg(length(x)) > 20 THEN 'freetext' ELSE 'categorical' END AS class
    FROM (SELECT c.*, count(*) OVER (PARTITION BY dataset_id, col_name) AS n_all,
                 CASE WHEN x IS NOT NULL THEN row_number() OVER (
                   PARTITION BY dataset_id, col_name, x IS NULL ORDER BY row_id) END AS place
          FROM ordered_cells c) p
    GROUP BY dataset_id, col_name) k
  GROUP BY dataset_id)
""",
    select=f"""
SELECT dataset_id, {r("completeness", "completeness")},
       coalesce(numeric_cols, 0) AS numeric_cols, coalesce(categorical_cols, 0) AS categorical_cols,
       coalesce(date_cols, 0) AS date_cols
FROM scores LEFT JOIN classes USING (dataset_id)""",
)
ORACLES["j01_scores_with_classes"] = ORACLES["j01_scores_with_classes"].replace(
    "classes AS (",
    long_cells("dirty_documents", "source", DOCUMENTS, "row_id,").replace(
        "cells AS (", "ordered_cells AS (", 1
    )
    + ",\nclasses AS (",
    1,
)
query(
    "j02_agreement_sector",
    select="""
SELECT DISTINCT event_type AS dataset_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'traffic'
            WHEN event_type IN ('signup', 'purchase') THEN 'conversion' ELSE 'Unknown' END AS sector
FROM events""",
)
query(
    "j03_dataset_lookup",
    *SCORES,
    select=f"""
SELECT dataset_id, {r("uniqueness", "uniqueness")}, CAST(rows AS BIGINT) AS rows
FROM scores WHERE dataset_id = 'src5'""",
)
query(
    "j04_label_alignment",
    *AGREEMENT,
    select="SELECT dataset_id, anomaly, noise, count(*) AS n FROM flags GROUP BY ALL",
)
query(
    "t01_by_completeness",
    *SCORES,
    select=f"SELECT dataset_id, sector, {r('completeness', 'completeness')} FROM scores",
)
query(
    "t01_by_anomaly_rate",
    *SCORES,
    select=f"""
SELECT dataset_id, sector, {r("if_anomaly_rate", "if_anomaly_rate")},
       {r("db_noise_rate", "db_noise_rate")} FROM scores WHERE if_anomaly_rate IS NOT NULL""",
)
query(
    "t01_by_composite",
    *SCORES,
    select=f"""
SELECT dataset_id, sector, {r("full_composite", "full_composite")}, drl_band FROM scores""",
)
query(
    "t02_worst_completeness",
    *SCORES,
    select=f"""
SELECT dataset_id, sector, {r("completeness", "value")} FROM scores
ORDER BY completeness, dataset_id LIMIT 5""",
)
query("d01_sector_bands", *SCORES, select="SELECT DISTINCT sector, drl_band FROM scores")
query("d01_sectors", *SCORES, select="SELECT DISTINCT sector FROM scores")
_pivot = ", ".join(
    r(f"100 * max(CASE WHEN c = {c}e0 THEN rate END)", f"c_{str(c).replace('.', '_')}")
    for c in (0.02, 0.05, 0.075, 0.1, 0.15)
)
query(
    "v01_sweep_pivot",
    *PRICE_SWEEP,
    select=f"SELECT dataset_id, {_pivot} FROM sweep GROUP BY dataset_id",
)

# Reports --------------------------------------------------------------------

query(
    "r01_hierarchy",
    *SCORES,
    select=f"""
SELECT 'Portfolio' AS id, 'Portfolio' AS label, '' AS parent, {r("sum(full_composite)", "total")}
FROM scores
UNION ALL SELECT sector, sector, 'Portfolio', round(sum(full_composite), 6) FROM scores
GROUP BY sector
UNION ALL SELECT sector || ' // ' || drl_band, drl_band, sector, round(sum(full_composite), 6)
FROM scores GROUP BY sector, drl_band
UNION ALL SELECT dataset_id, dataset_id, sector || ' // ' || drl_band, round(full_composite, 6)
FROM scores""",
)
query(
    "r02_sweep_means",
    *PRICE_SWEEP,
    select=f"""
SELECT {r("c", "contamination")}, {r("avg(rate)", "mean_rate")} FROM sweep GROUP BY c""",
)
_radar = ", ".join(
    r(f"coalesce(avg({d}), 0e0)", d)
    for d in ("completeness", "consistency", "uniqueness", "accuracy", "timeliness")
)
query(
    "r03_sector_radar", *SCORES, select=f"SELECT sector, {_radar} FROM scores GROUP BY sector"
)
query(
    "r04_box_statistics",
    *SCORES,
    """
vals AS (
  SELECT sector, 'completeness' AS dimension, completeness AS v FROM scores
  UNION ALL SELECT sector, 'consistency', consistency FROM scores
  UNION ALL SELECT sector, 'uniqueness', uniqueness FROM scores
  UNION ALL SELECT sector, 'if_anomaly_rate', if_anomaly_rate FROM scores
            WHERE if_anomaly_rate IS NOT NULL),
quarts AS (
  SELECT sector, dimension, count(*) AS n, quantile_cont(v, 0.25) AS q1,
         quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
  FROM vals GROUP BY sector, dimension),
marked AS (
  SELECT q.*, v, v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS inside
  FROM vals JOIN quarts q USING (sector, dimension))
""",
    select=f"""
SELECT sector, dimension, n, {r("q1", "q1")}, {r("median", "median")}, {r("q3", "q3")},
       {r("min(v) FILTER (WHERE inside)", "whisker_low")},
       {r("max(v) FILTER (WHERE inside)", "whisker_high")},
       count(*) FILTER (WHERE NOT inside) AS n_outliers
FROM marked GROUP BY sector, dimension, n, q1, median, q3""",
)
query(
    "r05_histogram",
    DIRTY_EVENTS_SQL,
    """
edges AS (SELECT min(value) AS lo, max(value) AS hi FROM dirty_events),
placed AS (
  SELECT CAST(least(floor((value - lo) * 20 / (hi - lo)), 19) AS INTEGER) AS bin, count(*) AS n
  FROM dirty_events CROSS JOIN edges WHERE value IS NOT NULL GROUP BY 1)
""",
    select=f"""
SELECT b.bin, {r("lo + b.bin * ((hi - lo) / 20)", "left_edge")},
       {r("lo + (b.bin + 1) * ((hi - lo) / 20)", "right_edge")}, coalesce(n, 0) AS n
FROM (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin) b CROSS JOIN edges
LEFT JOIN placed USING (bin)""",
)
query(
    "r08_compliance_grid",
    *GAP_CTES,
    select="""
SELECT specification, sector, coalesce(pct_pass, 0e0) AS pct_pass,
       CASE WHEN pct_pass IS NULL THEN 'n/a'
            ELSE printf('%.0f%%', pct_pass) || chr(10) || '(n=' || n || ')' END AS label
FROM verdicts""",
)
query(
    "r09_compliance_heat",
    *GAP_CTES,
    select="""
SELECT specification, sector, majority, CASE majority WHEN 'pass' THEN 1e0 WHEN 'fail' THEN 0e0
       ELSE 0.5e0 END AS heat FROM verdicts""",
)
query(
    "r10_truthiness",
    *SCORES,
    select="SELECT dataset_id, if_applicable AS shown, n_nulls <> 0 AS has_nulls FROM scores",
)
_sector_status = "\nUNION ALL ".join(
    f"SELECT sector, n, '{d}' AS dimension, {d}_mean AS value, "
    f"CASE WHEN {d}_mean >= {t}e0 THEN 'green' WHEN {d}_mean >= {t}e0 - 0.05e0 THEN 'amber' "
    "ELSE 'red' END AS status FROM summary"
    for d, t in (("completeness", 0.95), ("consistency", 0.95), ("uniqueness", 0.99))
)
query("r11_sector_status", *SCORES, SUMMARY, select=_sector_status)
_dataset_status = "\nUNION ALL ".join(
    f"SELECT dataset_id, '{d}' AS dimension, {r(f'coalesce({d}, 0e0)', 'plotted')}, "
    f"CASE WHEN {d} IS NULL THEN 'N/A' ELSE printf('%.1f%%', {d} * 100) END AS text, "
    f"CASE WHEN {d} >= 0.95e0 THEN 'green' WHEN {d} >= 0.8e0 THEN 'amber' ELSE 'red' END AS status "
    "FROM scores"
    for d in ("completeness", "consistency", "uniqueness", "accuracy", "timeliness")
)
query("r12_dataset_status", *SCORES, select=_dataset_status)
query(
    "r13_kappa_status",
    *AGREEMENT,
    select=f"""
SELECT dataset_id, {r("kappa", "kappa")}, printf('%.3f', kappa) AS text,
       CASE WHEN kappa >= 0.6e0 THEN 'green' WHEN kappa >= 0.4e0 THEN 'amber'
            ELSE 'red' END AS status
FROM agreement WHERE kappa IS NOT NULL""",
)
query(
    "r13_stability_status",
    *PRICE_SWEEP,
    STABILITY,
    select=f"""
SELECT {r("c", "contamination")}, {r("rho", "spearman")},
       CASE WHEN rho >= 0.9e0 THEN 'green' WHEN rho >= 0.7e0 THEN 'amber' ELSE 'red' END AS status
FROM stability""",
)
query(
    "r14_agreement_points",
    *AGREEMENT,
    select=f"""
SELECT dataset_id, 'events' AS sector, {r("kappa", "kappa")}, {r("jaccard", "jaccard")}
FROM agreement WHERE kappa IS NOT NULL""",
)


def _light(value: str) -> str:
    return (
        f"CASE WHEN {value} >= 0.95e0 THEN 'green' WHEN {value} >= 0.8e0 THEN 'amber' "
        "ELSE 'red' END"
    )


query(
    "r15_inspector",
    *SCORES,
    select=f"""
SELECT dataset_id, sector, drl_band,
       format('{{:,}}', CAST(rows AS BIGINT)) || ' × ' || cols AS shape,
       if_applicable AS shows_anomalies, {_light("completeness")} AS completeness_status,
       printf('%.1f%%', consistency * 100) AS consistency_text,
       {r("coalesce(accuracy, 0e0)", "accuracy_plotted")}
FROM scores WHERE dataset_id = 'src7'""",
)
_kpis = [
    ("Datasets audited", "n_datasets", None, None, None),
    ("Total rows ingested", "portfolio_total_rows", None, None, None),
    ("Total cells inspected", "portfolio_total_cells", None, None, None),
    ("Portfolio completeness (cells-weighted)", "portfolio_completeness_aggregate", 0.95, "min", "3.2"),
    ("Mean per-dataset completeness", "mean_per_dataset_completeness", 0.95, "min", "3.2"),
    ("Datasets meeting 95% completeness",
     "datasets_meeting_95pct_completeness / CAST(n_datasets AS DOUBLE)", 0.95, "min", "3.2"),
    ("Mean per-dataset consistency", "mean_per_dataset_consistency", 0.95, "min", "3.4"),
    ("Datasets meeting 95% consistency",
     "datasets_meeting_95pct_consistency / CAST(n_datasets AS DOUBLE)", 0.90, "min", "3.4"),
    ("Mean per-dataset uniqueness", "mean_per_dataset_uniqueness", 0.99, "min", "3.13"),
    ("Datasets with < 1% duplicates",
     "datasets_lt_1pct_duplicates / CAST(n_datasets AS DOUBLE)", 0.95, "min", "3.13"),
    ("Mean IF anomaly rate", "mean_if_anomaly_rate", 0.05, "max", "3.1"),
    ("Mean Cohen’s κ (IF vs DBSCAN)", "(SELECT avg(kappa) FROM agreement)", None, None, None),
    *[
        (f"Portfolio DRL distribution (Band {b})",
         f"(SELECT avg(CASE WHEN drl_band = 'Band {b}' THEN 1e0 ELSE 0e0 END) FROM scores)",
         None, None, None)
        for b in "ABC"
    ],
]


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


def _kpi_row(kpi, field, threshold, bound, spec) -> str:
    if threshold is None:
        judged = "'n/a'"
    elif bound == "max":
        judged = _verdict(f"-({field})", f"(-{threshold}e0)")
    else:
        judged = _verdict(f"({field})", f"{threshold}e0")
    limit = "NULL" if threshold is None else threshold
    return (
        f"SELECT '{kpi}' AS kpi, {r(f'CAST({field} AS DOUBLE)', 'value')}, "
        f"CAST({limit} AS DOUBLE) AS threshold, {_text(bound)} AS bound, "
        f"{_text(spec)} AS specification, {judged} AS verdict FROM headline"
    )


_kpi_rows = "\nUNION ALL ".join(_kpi_row(*k) for k in _kpis)
_taken = r"\b(pairs|kdist|eps_base|eps|core|noise|medians|filled|moments|matrix|cuts|flags|counts|agreed)\b"
query(
    "r16_kpi_table",
    *SCORES,
    HEADLINE,
    *[re.sub(_taken, r"event_\1", part) for part in AGREEMENT],
    select=_kpi_rows,
)

# The same reports over the forest's own scores and flags.
FOREST_FLAGS = FLAGS.replace(
    "quantile_cont(abs(b), 0.95) AS cut FROM matrix", "quantile_cont(score, 0.95) AS cut FROM forest_scores"
).replace("abs(b) > cut AS anomaly", "score > cut AS anomaly").replace("FROM matrix m", "FROM forest_scores m")
FOREST_AGREEMENT = [DIRTY_EVENTS_SQL, EVENT_MATRIX, forest("matrix"), density("matrix"), FOREST_FLAGS]


def _joined(ctes: list[str]) -> str:
    return ",\n".join(c.strip() for c in ctes)


for _new, _old, _from, _to in [
    ("a04_forest_stability", "a04_rank_stability", PRICE_SWEEP, FOREST_SWEEP),
    ("v01_forest_pivot", "v01_sweep_pivot", PRICE_SWEEP, FOREST_SWEEP),
    ("r02_forest_means", "r02_sweep_means", PRICE_SWEEP, FOREST_SWEEP),
    ("r13_forest_stability", "r13_stability_status", PRICE_SWEEP, FOREST_SWEEP),
    ("a07_forest_agreement", "a07_agreement", AGREEMENT, FOREST_AGREEMENT),
    ("a09_forest_means", "a09_agreement_means", AGREEMENT, FOREST_AGREEMENT),
    ("r13_forest_kappa", "r13_kappa_status", AGREEMENT, FOREST_AGREEMENT),
]:
    ORACLES[_new] = ORACLES[_old].replace(_joined(_from), _joined(_to))
query(
    "r14_agreement_register",
    *FOREST_AGREEMENT,
    select=f"""
SELECT dataset_id, 'events' AS sector, {r("kappa", "kappa")}, {r("jaccard", "jaccard")},
       x AS if_anom_count, y AS dbscan_noise_count, o AS overlap, kappa_interp
FROM agreement""",
)
query(
    "t01_by_kappa",
    *FOREST_AGREEMENT,
    select=f"""
SELECT dataset_id, 'events' AS sector, {r("kappa", "kappa")}, {r("jaccard", "jaccard")}
FROM agreement""",
)


def histogram(source: str, value: str, bins: int) -> dict[str, object]:
    return {
        "ctes": f"""
edges AS (
  SELECT CASE WHEN lo = hi THEN lo - 0.5e0 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5e0 ELSE hi END AS hi
  FROM (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}
        WHERE isfinite({value})) e),
placed AS (
  SELECT CAST(least(floor(({value} - lo) * {bins} / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
  FROM {source} CROSS JOIN edges WHERE isfinite({value}) GROUP BY 1)
""",
        "select": f"""
SELECT b.bin, {r(f"lo + b.bin * ((hi - lo) / {bins})", "left_edge")},
       {r(f"lo + (b.bin + 1) * ((hi - lo) / {bins})", "right_edge")}, coalesce(n, 0) AS n
FROM (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin) b CROSS JOIN edges
LEFT JOIN placed USING (bin)""",
    }


for _name, _ctes, _source, _value, _bins in [
    ("r05_composite_histogram", SCORES, "scores", "full_composite", 20),
    ("r05_kappa_histogram", FOREST_AGREEMENT, "agreement", "kappa", 12),
    (
        "r05_unfinite_histogram",
        [
            """
unfinite AS (
  SELECT CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('inf' AS DOUBLE)
              WHEN event_id % 13 = 0 THEN CAST('-inf' AS DOUBLE) WHEN event_id % 17 = 0 THEN NULL ELSE value END AS x
  FROM events)
"""
        ],
        "unfinite",
        "x",
        10,
    ),
]:
    _h = histogram(_source, _value, _bins)
    query(_name, *_ctes, _h["ctes"], select=_h["select"])

# Slices without a key are a dataset of their own.
NULL_KEYS = """
keyless AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN '<null>' WHEN event_id % 5 = 0 THEN '<<null>' ELSE coalesce(k, '') END AS dataset_id,
         user_id, value
  FROM (SELECT *, event_type AS k FROM events) e)
"""
query(
    "p01_null_slice",
    NULL_KEYS,
    select=f"""
SELECT dataset_id, {r("1 - (count(*) - count(user_id) + count(*) - count(value)) / (2e0 * count(*))", "completeness")},
       CAST(2 * count(*) - count(user_id) - count(value) AS BIGINT) AS n_nulls, CAST(2 * count(*) AS BIGINT) AS total_cells
FROM keyless GROUP BY dataset_id""",
)
query(
    "m02_uniqueness_wide",
    select=f"""
SELECT event_type AS dataset_id,
       {r("1 - (count(*) - count(DISTINCT (epoch_us(ts) // 2, user_id % 10))) / CAST(count(*) AS DOUBLE)", "uniqueness")},
       count(*) - count(DISTINCT (epoch_us(ts) // 2, user_id % 10)) AS duplicate_rows, count(*) AS total_rows
FROM events GROUP BY event_type""",
)

query(
    "f08_numeric_texts",
    select="""
SELECT c_mktsegment AS segment,
       count(*) FILTER (WHERE try_cast(split_part(c_name, '#', 2) AS DOUBLE) IS NOT NULL)
         AS n_numeric,
       count(*) FILTER (WHERE try_cast(c_mktsegment AS DOUBLE) IS NOT NULL) AS n_segment_numeric
FROM customer GROUP BY c_mktsegment""",
)
