"""DuckDB SQL for the queries that SQL can express."""

LLM_ORACLES: dict[str, str] = {}

LLM_ORACLES["op2_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM s
QUALIFY rank <= 20
"""

LLM_ORACLES["op5_source_mixing"] = """
WITH n AS (SELECT source, count(*) AS n_docs, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (
  SELECT source, w * ((SELECT sum(n_docs) FROM n) / (SELECT sum(w) FROM n)) / n_docs AS rate FROM n),
p AS (
  SELECT source, rate, greatest(1, CAST(ceil(rate / 16.0) AS INTEGER)) AS parts FROM r),
k AS (
  SELECT source, k, exp(-(rate / parts) + k * ln(rate / parts) - lgamma(k + 1.0)) AS mass
  FROM p, range(0, 101) AS t(k)),
c AS (
  SELECT source, list(c ORDER BY k) AS cumulative
  FROM (SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS c FROM k) GROUP BY source),
u AS (
  SELECT d.doc_id, d.source, part,
    CAST('0x' || substr(md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || part), 1, 13) AS BIGINT)
      / 4503599627370496.0 AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, range(1, p.parts + 1) AS t(part)),
m AS (
  SELECT u.doc_id, sum(len([x FOR x IN c.cumulative IF x <= u.u])) AS n
  FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY u.doc_id)
SELECT d.*, CAST(copy AS INTEGER) AS copy
FROM documents d JOIN m USING (doc_id), range(1, CAST(m.n AS BIGINT) + 1) AS t(copy)
"""

LLM_ORACLES["op9_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id,
    [instr('0123456789abcdef', substr(h || '0', i + 1, 1)) - 1 FOR i IN range(0, 41)] AS x
  FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((x[1 + (5 * j) // 4] * 16 + x[2 + (5 * j) // 4]) >> CAST(3 - (5 * j) % 4 AS INTEGER)) & 31), 1) FOR j IN range(0, 32)], '')
    AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""

LLM_ORACLES["op10_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM g
"""


def _crc32(text: str) -> str:
    """The crc32 of an ASCII expression, byte by byte and bit by bit."""
    bytes_ = f"[CAST(ascii(x) AS BIGINT) FOR x IN string_split({text}, '')]"
    bit = "CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END"
    byte = f"list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: {bit})"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda a, b: {byte}))"


def _edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """``state`` after an edit, if there is such a state."""
    lines = f"{state}.l" if line is None else f"list_append({state}.l, {line})"
    return f"CASE WHEN {state} IS NOT NULL THEN {{c: {state}.c + {cost}, a: {state}.a || '{letter}', l: {lines}}} END"


_INSERT_USER = ", ".join(_edit(x, "2", "I", "'user:'") for x in ("s0", "ss", "sa"))
_USER_FROM = ", ".join(
    f"CASE WHEN stays AND initial = 'u' THEN {_edit(x, 'extra', 'K', 'said')} END, "
    f"CASE WHEN stays THEN {_edit(x, '2 + extra', 'R', 'as_user')} END"
    for x in ("s0", "ss", "sa")
)

LLM_ORACLES["op12_conversation_repair"] = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
kinds AS (SELECT *, {_crc32("key")} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM placed),
rows_ AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CAST(fault = 'truncated' AS INT) AS extra,
    role || ':' || text AS said, 'user:' || text AS as_user, 'assistant:' || text AS as_assistant
  FROM faults),
search AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{c: 0, a: '', l: CAST([] AS VARCHAR[])}} AS s0,
    CAST(NULL AS STRUCT(c INT, a VARCHAR, l VARCHAR[])) AS ss, CAST(NULL AS STRUCT(c INT, a VARCHAR, l VARCHAR[])) AS su,
    CAST(NULL AS STRUCT(c INT, a VARCHAR, l VARCHAR[])) AS sa
  FROM conversations
  UNION ALL
  SELECT conv_id, i,
    {_edit("s0", "3", "D")},
    list_min([{_edit("ss", "3", "D")}, CASE WHEN stays AND initial = 's' THEN {_edit("s0", "extra", "K", "said")} END]),
    list_min([{_edit("su", "3", "D")}, {_USER_FROM}]),
    list_min([{_edit("sa", "3", "D")}, CASE WHEN stays AND initial = 'a' THEN {_edit("su", "extra", "K", "said")} END,
      CASE WHEN stays THEN {_edit("su", "2 + extra", "R", "as_assistant")} END])
  FROM (
    SELECT * REPLACE (list_min([sa, {_edit("su", "2", "I", "'assistant:'")}]) AS sa) FROM (
      SELECT w.conv_id, r.i, s0, ss, list_min([su, {_INSERT_USER}]) AS su, sa, stays, initial, extra, said, as_user, as_assistant
      FROM search w JOIN rows_ r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1))),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id),
ends AS (
  SELECT w.conv_id, list_min([s0, sa, {_edit("su", "2", "I", "'assistant:'")}]) AS best,
    coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM (SELECT conv_id, i, s0, ss, list_min([su, {_INSERT_USER}]) AS su, sa FROM search) w
  LEFT JOIN n ON w.conv_id IS NOT DISTINCT FROM n.conv_id
  WHERE w.i = coalesce(n.n, 0))
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate,
  CAST(truncated AS BIGINT) AS truncated, CAST(illegal AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost,
  best.a AS audit, sha256(array_to_string(best.l, chr(10))) AS repaired_sha256
FROM ends
"""

LLM_ORACLES["op13_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 20 AS f, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT v.c, 0 AS part, place, role, text FROM convs v JOIN turns t ON t.c = v.f AND t.place < v.h
  UNION ALL
  SELECT v.c, 1 AS part, place, role, text FROM convs v JOIN turns t ON t.c = v.c AND t.place >= v.h),
seq AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, place) AS d,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    length(role) || ':' || role || length(text) || ':' || text AS turn
  FROM rebuilt),
paths AS (
  SELECT c, d, words, md5(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM seq
  UNION ALL
  SELECT c, 0 AS d, 0 AS words, '' AS node FROM convs),
linked AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, lead(node) OVER (PARTITION BY c ORDER BY d) AS child
  FROM paths),
nodes AS (
  SELECT node, d, parent, min(c) AS conv_id, count(*) AS n_convs, count(DISTINCT child) AS n_children,
    max(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (child IS NULL), '')) AS ends
  FROM linked GROUP BY node, d, parent),
below AS (
  SELECT p.node, p.d, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.words) AS saved
  FROM nodes y JOIN paths p ON p.c = y.conv_id AND p.d <= y.d GROUP BY p.node, p.d)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN below b ON b.node = x.node AND b.d = x.d
LEFT JOIN nodes up ON up.node = x.parent AND up.d = x.d - 1
"""
