"""Exact top-k search by inner product, with a pivot table.

The distances of every vector to a set of pivots are stored once. By the
triangle inequality the distance of a query and a candidate is at least the
largest difference of their distances to a pivot, which bounds their inner
product from above. Rows form blocks around their nearest pivots, in rings of
distance; a query goes only to the blocks whose ranges of distances leave
room for a score it still needs. There, candidates are evaluated in falling
order of their own bounds until none reaches the query's k-th best score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import widened
from plumbline.session import settle

#: Pivots, chosen from a sample of at most PIVOT_SAMPLE vectors.
PIVOTS = 48
PIVOT_SAMPLE = 2048
#: Candidates of a block and queries of a group, about; both meet in one task.
BLOCK_ROWS = 4096
GROUP_QUERIES = 2048
#: Queries whose bounds a task holds at once, and candidates between two stops.
_QUERIES_AT_ONCE = 64
_STEP = 1024
#: Rings of distance around a pivot.
RINGS = 8
#: Blocks whose ranges a task of queries is compared with at once.
ROUTED_BLOCKS = 65_536
_EPS = 2.0**-52


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of every component; unusable vectors left out.

    Null vectors, and those with null, NaN or infinite components, take no
    part. A component that does not fit a long fails the job.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = lambda c: F.abs(F.lit(scale) * c) < float(1 << 63)
    wide = F.raise_error(F.lit("a scaled vector component does not fit a long")).cast("long")
    whole = F.transform(x, lambda c: F.when(fits(c), F.floor(F.lit(scale) * c)).otherwise(wide))
    return vectors.where(x.isNotNull() & usable).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v")
    )


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``sample`` far from one another: each is the farthest from those before."""
    if len(sample) == 0:
        return sample
    picked = [int(np.argmax((sample**2).sum(axis=1)))]
    nearest = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < min(count, len(sample)) and nearest.max() > 0:
        picked.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width; missing components are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype if len(flat) else np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, as integers: Python's if they may not fit a long."""
    largest = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    most = largest[0] * largest[1] * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a.astype(object) @ b.astype(object).T


def _longs(score: np.ndarray) -> np.ndarray:
    if score.dtype == object and any(not -(2**63) <= x < 2**63 for x in score.tolist()):
        raise OverflowError("an inner product among the best of a query does not fit a long")
    return score.astype(np.int64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _slack(d: np.ndarray, x2: np.ndarray, p2: np.ndarray, width: int) -> np.ndarray:
    """How far rounding may have moved distances (rows by pivots).

    Squares of distances are differences of sums of ``width`` products, so
    their error follows the lengths of both ends; the longer a pivot, the less
    its distances tell.
    """
    error = 4 * (width + 4) * _EPS * (x2[:, None] + p2[None])
    return error / np.maximum(np.maximum(d, np.sqrt(error)), 1e-300)


def with_pivot_distances(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """``rows`` (id, v) with ``d``, the distances to all pivots."""

    def kernel(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(np.float64)
            d = _distances(x, pivots)
            offsets = np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, d.reshape(-1))],
                names=[*batch.schema.names, "d"],
            )

    return rows.mapInArrow(kernel, widened(rows, "d array<double>"))


def _bounds(q2, x2, q_low, q_high, low, high) -> np.ndarray:
    """Largest inner products that ranges of distances to all pivots leave possible.

    ``q_low`` to ``q_high`` are those of queries, a row each, ``low`` to
    ``high`` of candidates, a column each.
    """
    apart = np.zeros((len(q_low), low.shape[1]))
    for p in range(len(low)):
        np.maximum(apart, q_low[:, p, None] - high[p][None], out=apart)
        np.maximum(apart, low[p][None] - q_high[:, p, None], out=apart)
    scale = q2[:, None] + x2[None]
    return (scale - np.square(apart)) / 2 + 16 * _EPS * scale + 1.0


def _search(queries: pa.Table, rows: pa.Table, k: int, p2: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """The best k of ``rows`` for every query, if they may be among its best k of all.

    Queries go in batches. A batch evaluates candidates in falling order of
    the largest bound that any of its queries has for them, and stops when
    that is below what all of them have found already.
    """
    q, x = _matrix(queries.column("v"), width), _matrix(rows.column("v"), width)
    q_ids, x_ids = queries.column("id").to_numpy(), rows.column("id").to_numpy()
    floor = queries.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
    qd, xd = _matrix(queries.column("d"), len(p2)), _matrix(rows.column("d"), len(p2))
    q2, x2 = (q.astype(np.float64) ** 2).sum(1), (x.astype(np.float64) ** 2).sum(1)
    q_slack, x_slack = _slack(qd, q2, p2, width), _slack(xd, x2, p2, width)
    low, high = (np.ascontiguousarray(x.T) for x in (xd - x_slack, xd + x_slack))
    parts = []
    for at in range(0, len(q), _QUERIES_AT_ONCE):
        batch = slice(at, at + _QUERIES_AT_ONCE)
        least = floor[batch].copy()
        bound = _bounds(q2[batch], x2, (qd - q_slack)[batch], (qd + q_slack)[batch], low, high)
        alive = np.flatnonzero((bound >= least[:, None]).any(axis=0))
        highest = bound[:, alive].max(axis=0)
        order = np.argsort(-highest, kind="stable")
        alive, highest = alive[order], highest[order]
        for start in range(0, len(alive), _STEP):
            if highest[start] < least.min():
                break
            chosen = alive[start : start + _STEP]
            score = _products(q[batch], x[chosen])
            other = q_ids[batch][:, None] != x_ids[chosen][None]
            rounded = score.astype(np.float64)  # in the order of the scores, as the floor is
            row, column = np.nonzero((rounded >= least[:, None]) & other)
            parts.append((at + row, x_ids[chosen[column]], score[row, column]))
            if len(chosen) > k:  # one of them may be the query itself
                least = np.maximum(least, np.partition(rounded, -k - 1, axis=1)[:, -k - 1])
    nothing = np.empty(0, np.int64)
    parts.append((nothing, nothing, nothing))
    row, found, score = (np.concatenate(p) for p in zip(*parts))
    if score.dtype == object:
        best = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], found[i])), np.int64)
    else:
        best = np.lexsort((found, -score, row))
    row, found, score = row[best].astype(np.int64), found[best], score[best]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return {"query_id": q_ids[row[kept]], "vec_id": found[kept], "score": _longs(score[kept])}


_FOUND = "query_id long, vec_id long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
    group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, exactly.

    ``is_query`` tells from the column ``id`` which rows are queries; the
    candidates are all rows with another id, ties going to the smaller id.
    Rows without an id take no part. Rows that share one are queries and
    candidates each: the k best pairs of rows with the query's id are listed.
    Vectors of different length compare as if filled up with zeros. A query
    with fewer candidates gets them all.
    """
    spark = vectors.sparkSession
    rows = settle(
        integer_vectors(vectors, id_col, vector_col, scale).where("id IS NOT NULL"), "vectors"
    )
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not shape.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, shape.width)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).toArrow()
    sample = _matrix(picked.column("v"), width)
    centres = choose_pivots(sample.astype(np.float64), pivots)
    p2 = (centres**2).sum(1)
    table = settle(_in_blocks(with_pivot_distances(rows, centres, width), block_rows), "pivot-table")
    queries = table.where(is_query).drop("block")
    sample_ids = picked.column("id").to_numpy()

    def first_scores(batches):
        """The k-th best score among the sampled rows: no better k-th can be lower."""
        for batch in batches:
            score = _products(_matrix(batch.column("v"), width), sample).astype(np.float64)
            score[batch.column("id").to_numpy()[:, None] == sample_ids[None]] = -np.inf
            at = min(k, score.shape[1])
            least = np.partition(score, -at, axis=1)[:, -at] if at == k else np.full(len(score), -np.inf)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(least, pa.float64())], names=[*batch.schema.names, "floor"]
            )

    ready = settle(
        queries.mapInArrow(first_scores, widened(queries, "floor double")), "queries"
    )
    routed = settle(_routes(ready, table, p2, width), "routes")
    # A block's queries go in groups, and the block to each of them.
    visits = routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / group_queries).alias("groups"))
    visits = settle(visits, "visits")
    spread_queries = (
        routed.join(visits, "block")
        .withColumn("grp", F.pmod(F.xxhash64(F.lit(2), "id"), F.col("groups")))
        .select("block", "grp", "id", "v", "d", "floor")
    )
    every_group = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))
    spread_rows = table.join(visits, "block").select("block", every_group.alias("grp"), "id", "v", "d")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        return pa.table(_search(left, right, k, p2, width))

    found = (
        spread_queries.groupBy("block", "grp")
        .cogroup(spread_rows.groupBy("block", "grp"))
        .applyInArrow(meet, _FOUND)
    )
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` with ``block``: the nearest pivot, a ring around it, and a share of the ring by hash.

    Rings are cut at sketched quantiles of the distance, one row for each
    pivot; a ring of any size is dealt to blocks of some ``block_rows`` rows.
    """
    near = settle(
        rows.withColumn("away", F.array_min("d")).withColumn(
            "pivot", F.array_position("d", F.col("away")).cast("int")
        ),
        "near-pivots",
    )
    cuts = [i / RINGS for i in range(1, RINGS)]
    sizes = near.groupBy("pivot").agg(
        F.percentile_approx("away", cuts, 1000).alias("cuts"), F.count(F.lit(1)).alias("n")
    )
    ring = F.size(F.filter("cuts", lambda c: F.col("away") > c))
    parts = F.ceil(F.col("n") / F.lit(RINGS * block_rows))
    share = F.pmod(F.xxhash64(F.lit(1), "id"), parts)
    # As many rows as there are pivots.
    return near.join(F.broadcast(sizes), "pivot").select(
        *rows.columns, F.xxhash64("pivot", ring, share).alias("block")
    )


def _routes(queries: DataFrame, table: DataFrame, p2: np.ndarray, width: int) -> DataFrame:
    """``queries`` once for each ``block`` of ``table`` that may hold one of their best.

    Ranges of ROUTED_BLOCKS blocks at a time are on the driver and in a task.
    """
    n = len(p2)

    def ranges(batches):
        for batch in batches:
            d, v = _matrix(batch.column("d"), n), _matrix(batch.column("v"), width).astype(np.float64)
            x2 = (v**2).sum(1)
            slack = _slack(d, x2, p2, width)
            found = {}
            keys = batch.column("block").to_numpy()
            for key in np.unique(keys).tolist():
                mine = keys == key
                found[key] = ((d - slack)[mine].min(0), (d + slack)[mine].max(0), x2[mine].max())
            names = ["block", "low", "high", "x2"]
            lows, highs, lengths = zip(*found.values()) if found else ((), (), ())
            columns = [pa.array(list(found), pa.int64())]
            columns += [pa.array([x.tolist() for x in y], pa.list_(pa.float64())) for y in (lows, highs)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths, pa.float64())], names=names)

    parts = table.select("block", "d", "v").mapInArrow(ranges, "block long, low array<double>, high array<double>, x2 double")
    least = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(n)]
    most = [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(n)]
    blocks = settle(parts.groupBy("block").agg(*least, *most, F.max("x2").alias("x2")), "block-ranges")
    slices = max(1, -(-blocks.count() // ROUTED_BLOCKS))
    routed = None
    for i in range(slices):
        some = blocks.where(F.pmod(F.xxhash64(F.lit(3), "block"), F.lit(slices)) == i).toArrow()
        ids = some.column("block").to_numpy()
        x2 = some.column("x2").to_numpy()
        low, high = (np.stack([some.column(f"{c}{p}").to_numpy() for p in range(n)]) for c in "lh")

        def route(batches, ids=ids, x2=x2, low=low, high=high):
            for batch in batches:
                for at in range(0, batch.num_rows, _QUERIES_AT_ONCE):
                    part = batch.slice(at, _QUERIES_AT_ONCE)
                    d, v = _matrix(part.column("d"), n), _matrix(part.column("v"), width).astype(np.float64)
                    q2 = (v**2).sum(1)
                    slack = _slack(d, q2, p2, width)
                    floor = part.column("floor").to_numpy(zero_copy_only=False)
                    bound = _bounds(q2, x2, d - slack, d + slack, low, high)
                    row, block = np.nonzero(bound >= floor[:, None])
                    for begin in range(0, len(row), _STEP):
                        chosen = slice(begin, begin + _STEP)
                        taken = part.take(pa.array(row[chosen]))
                        yield pa.RecordBatch.from_arrays(
                            [*taken.columns, pa.array(ids[block[chosen]], pa.int64())], names=[*batch.schema.names, "block"]
                        )

        found = queries.mapInArrow(route, widened(queries, "block long"))
        routed = found if routed is None else routed.unionByName(found)
    return routed
