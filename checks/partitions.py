"""SQL that replays the seeded k-means over the profiles, its choice and its centroids."""

from __future__ import annotations

COUNTS = range(2, 9)


def _gap(a: str, b: str) -> str:
    """Squared distance of two points whose columns start alike."""
    return " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in "xyz")


def partitions(restarts: int = 10, rounds: int = 40, seed: int = 42, least: int = 3) -> str:
    """CTEs from ``profiles`` to ``labels``, ``candidates``, ``chosen`` and ``centroids``."""
    most = max(COUNTS)  # runs over these few profiles rest long before the last of the rounds
    uniform = (
        f"(CAST('0x' || substr(md5('{seed}/' || r || '/' || step || '/' || id), 1, 13) AS BIGINT) + 0.5e0)"
        " / 4503599627370496e0"
    )
    moved = ", ".join(
        f"round(coalesce(sum(w * {c}) FILTER (mine) / sum(w) FILTER (mine), any_value(c{c})), 12) AS c{c}" for c in "xyz"
    )
    place = ", ".join(f"round(c{c}, 9)" for c in "xyz")
    return f"""
points AS MATERIALIZED (
  SELECT x, y, z, min(dataset_id) AS id, CAST(count(*) AS DOUBLE) AS w FROM profiles GROUP BY x, y, z),
race AS (
  SELECT r, 0 AS step, id, x, y, z, w, 1e0 AS near, 0e0 AS sx, 0e0 AS sy, 0e0 AS sz
  FROM points, range(0, {restarts}) t(r)
  UNION ALL
  SELECT r, step + 1, id, x, y, z, w,
         CASE WHEN step = 0 THEN {_gap("", "n")} ELSE least(near, {_gap("", "n")}) END, nx, ny, nz
  FROM (
    SELECT *, first_value(x) OVER win AS nx, first_value(y) OVER win AS ny, first_value(z) OVER win AS nz,
           max(near) OVER (PARTITION BY r) AS widest
    FROM race WHERE step < {most}
    WINDOW win AS (PARTITION BY r ORDER BY CASE WHEN near > 0 THEN -ln({uniform}) / (w * near) END NULLS LAST, id)) e
  WHERE widest > 0),
seeds AS MATERIALIZED (SELECT DISTINCT r, step - 1 AS c, sx, sy, sz FROM race WHERE step > 0),
lloyd AS (
  SELECT 0 AS i, k, r, c, sx AS cx, sy AS cy, sz AS cz, 0e0 AS cost
  FROM seeds, range({min(COUNTS)}, {most + 1}) t(k) WHERE c < k
  UNION ALL
  SELECT i + 1, k, r, c, {moved}, coalesce(sum(w * d) FILTER (mine), 0e0)
  FROM (
    SELECT *, row_number() OVER (PARTITION BY k, r, id ORDER BY d, c) = 1 AS mine
    FROM (SELECT l.*, p.*, {_gap("p.", "l.c")} AS d FROM lloyd l CROSS JOIN points p WHERE i < {rounds}) e) f
  GROUP BY i, k, r, c),
rest AS MATERIALIZED (SELECT * FROM lloyd WHERE i = {rounds}),
runs AS (
  SELECT k, r, sum(cost) AS inertia FROM rest
  WHERE k < (SELECT count(*) FROM profiles) GROUP BY k, r),
best AS MATERIALIZED (
  SELECT k, r, inertia FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(inertia, 9), r) = 1),
centres AS MATERIALIZED (
  SELECT k, cx, cy, cz, row_number() OVER (PARTITION BY k ORDER BY {place}) - 1 AS cluster
  FROM rest JOIN best USING (k, r)),
labels AS MATERIALIZED (
  SELECT dataset_id, x, y, z, k, cluster
  FROM (SELECT p.*, k, cluster, {_gap("p.", "c.c")} AS d FROM profiles p CROSS JOIN centres c) e
  QUALIFY row_number() OVER (PARTITION BY dataset_id, k ORDER BY d, cluster) = 1),
reach AS (
  SELECT p.k, p.dataset_id, p.cluster, q.cluster AS other, count(*) AS n,
         sum(sqrt({_gap("p.", "q.")})) AS total
  FROM labels p JOIN labels q ON p.k = q.k GROUP BY p.k, p.dataset_id, p.cluster, q.cluster),
sides AS (
  SELECT k, dataset_id, max(CASE WHEN other = cluster THEN n END) AS size,
         max(CASE WHEN other = cluster AND n > 1 THEN total / (n - 1) END) AS a,
         min(CASE WHEN other <> cluster THEN total / n END) AS b
  FROM reach GROUP BY k, dataset_id),
fits AS MATERIALIZED (
  SELECT k, CASE WHEN count(b) = 0 THEN -1e0
    ELSE avg(CASE WHEN size = 1 OR greatest(a, b) = 0 THEN 0e0 ELSE (b - a) / greatest(a, b) END) END AS silhouette
  FROM sides GROUP BY k),
candidates AS MATERIALIZED (SELECT k, inertia, silhouette FROM best JOIN fits USING (k)),
chosen AS MATERIALIZED (
  SELECT k, silhouette FROM candidates
  ORDER BY CASE WHEN k >= {least} THEN 0 ELSE 1 END, round(silhouette, 9) DESC, k LIMIT 1),
centroids AS (SELECT cluster, cx, cy, cz FROM centres JOIN chosen USING (k))"""
