"""The trie of conversation prefixes, with a count-min screen before the shuffle.

A node stands for the conversations that begin with the same turns. The digest
of a prefix is the sum of the digests of its turns with their places, so
prefixes of one conversation of any length are made in parallel. A count-min
sketch counts all prefix digests; it never counts too low, so an estimate of
one proves that a single conversation has the prefix, and then the rest of that
conversation's nodes are told from its rows alone. Only prefixes that may be
shared are shuffled and grouped exactly. Sums over subtrees go up the shared
nodes by pointer doubling, in as many rounds as their depth has binary digits.

Results in edge cases:

* a null role or text is empty; rows with a null conversation id take no part;
* a null turn comes first; rows of equal turn are ordered by the md5 of their
  role and text, and repeated rows are turns like any other;
* a conversation without turns is a member of the root and ends there;
* an empty table has no nodes, not even a root;
* texts are read whole once, by the digest; columns other than the four named
  are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_or_empty, widened
from plumbline.llm.ordered import MODULUS, in_order
from plumbline.session import settle

#: Turns that a conversation takes from another at most, and how far apart these are.
MAX_HEAD, FAMILY = 3, 20
#: Rows of the sketch, counters for each prefix, and counters of a row at most.
SKETCH_ROWS, CELLS_PER_PREFIX, MAX_CELLS = 3, 8, 1 << 23
#: Counters that travel together.
_BLOCK = 1 << 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_digests(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(c, turn, digest, words) of every row with a conversation id; all that is read of texts."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("c"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.md5(whole).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, at, digest, words) of rebuilt conversations, and (c, n_turns) of all.

    Conversation c begins with the first h turns of the first conversation of
    its family, c - c % 20, and goes on with its own turns from the h-th on; h
    is the crc32 of c modulo 4. Joins are on conversations or families; a long
    conversation meets one row there.
    """
    own = in_order(turns, "c", [F.col("turn").asc_nulls_first(), F.col("digest")], "trie-turns")
    family = F.col("c") - F.col("c") % FAMILY
    sizes = own.where("is_last").select("c", (F.col("place") + 1).alias("n"))
    firsts = sizes.where(F.col("c") % FAMILY == 0).select(F.col("c").alias("f"), F.col("n").alias("f_n"))
    head = F.least(F.col("h"), F.coalesce("f_n", F.lit(0).cast("long")))
    plan = settle(
        sizes.withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % (MAX_HEAD + 1))
        .withColumn("f", family)
        .join(firsts, "f", "left")
        .select("c", "f", "h", head.alias("head"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest")),
        "trie-plan",
    )
    # Where the first conversation has fewer turns than it should lend, all moves up.
    short = plan.where("head < h").select("c", (F.col("h") - F.col("head")).alias("missing"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % (MAX_HEAD + 1)
    tails = (
        own.where(F.col("place") >= h)
        .join(short, "c", "left")
        .select("c", (F.col("place") - F.coalesce("missing", F.lit(0))).alias("at"), "digest", "words")
    )
    lent = own.where((F.col("c") % FAMILY == 0) & (F.col("place") < MAX_HEAD)).select(
        F.col("c").alias("f"), F.col("place").alias("at"), "digest", "words"
    )
    heads = lent.join(plan.where("head > 0"), "f").where("at < head").select("c", "at", "digest", "words")
    return heads.unionByName(tails), plan.select("c", (F.col("head") + F.col("rest")).alias("n_turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, depth, k1, k2, p1, p2, words, is_last): digests of every prefix and of its parent's.

    ``turns`` are (c, at, digest, words), with ``at`` from 0 without a gap.
    """

    def lane(i: int) -> Column:
        return F.xxhash64(F.lit(i), F.col("at"), F.col("digest")).bitwiseAND(F.lit(MODULUS - 1))

    numbered = in_order(
        turns.withColumns({"d1": lane(1), "d2": lane(2)}).drop("digest"),
        "c",
        [F.col("at")],
        "trie-prefixes",
        ("d1", "d2"),
    )
    before = lambda i: (F.col(f"d{i}_run") - F.col(f"d{i}") + MODULUS) % MODULUS
    parents = {
        f"p{i}": F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(before(i)) for i in (1, 2)
    }
    return numbered.select(
        "c",
        (F.col("at") + 1).alias("depth"),
        F.col("d1_run").alias("k1"),
        F.col("d2_run").alias("k2"),
        *(v.alias(k) for k, v in parents.items()),
        "words",
        "is_last",
    )


def _cells(k1: np.ndarray, k2: np.ndarray, row: int, n_cells: int) -> np.ndarray:
    """Counters of digests in a row of the sketch."""
    mixed = (k1.astype(np.uint64) + np.uint64(2 * row + 1) * k2.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - n_cells.bit_length() + 1)).astype(np.int64)


def sketch(keys: DataFrame, n_cells: int) -> np.ndarray:
    """Count-min sketch of (k1, k2), SKETCH_ROWS x n_cells; counters stop at 2.

    Tasks send the counters that they touched, in blocks, and blocks are added
    up; the driver holds the sketch, MAX_CELLS * SKETCH_ROWS bytes at most.
    """
    block = min(_BLOCK, n_cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((SKETCH_ROWS, n_cells), np.uint8)
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for row in range(SKETCH_ROWS):
                cells, n = np.unique(_cells(k1, k2, row, n_cells), return_counts=True)
                own[row, cells] = np.minimum(own[row, cells] + np.minimum(n, 2), 2)
        flat = own.reshape(-1, block)
        for at in np.flatnonzero(flat.any(axis=1)).tolist():
            once, more = np.flatnonzero(flat[at] == 1), np.flatnonzero(flat[at] == 2)
            values = [pa.array([x.astype("<u2").tobytes()], pa.binary()) for x in (once, more)]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *values], names=["block", "once", "more"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(block, np.uint8)
        for once, more in zip(table.column("once"), table.column("more")):
            places = np.frombuffer(once.as_buffer(), "<u2")
            total[places] = np.minimum(total[places] + 1, 2)
            total[np.frombuffer(more.as_buffer(), "<u2")] = 2
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = keys.select("k1", "k2").mapInArrow(count, "block long, once binary, more binary")
    out = np.zeros((SKETCH_ROWS * n_cells // block, block), np.uint8)
    for row in parts.groupBy("block").applyInArrow(add, "block long, counts binary").toLocalIterator():
        out[row.block] = np.frombuffer(row.counts, np.uint8)
    return out.reshape(SKETCH_ROWS, n_cells)


def screened(keys: DataFrame, n_cells: int, counts: np.ndarray) -> DataFrame:
    """``keys`` and whether they (``single``) and their parents (``below_single``) are proven single.

    The parent of a first turn is the root, which never is.
    """
    schema = widened(keys, "single boolean, below_single boolean")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in (("k1", "k2"), ("p1", "p2")):
                k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (a, b))
                rows = [counts[row, _cells(k1, k2, row, n_cells)] for row in range(SKETCH_ROWS)]
                found.append(np.min(rows, axis=0) == 1)
            found[1] &= batch.column("depth").to_numpy(zero_copy_only=False) > 1
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=schema.names)

    return keys.mapInArrow(kernel, schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, c): ids in ascending order, joined by commas.

    A hash takes its bytes in order, so a node's ids pass through one task, in
    sorted batches; none is kept.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            ids = batch.column("c").to_pylist()
            changes = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            edges = [0, *changes.tolist(), len(ids)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                text = ",".join(map(str, ids[a:b])).encode()
                if key == (k1[a], k2[a]):
                    state.update(b"," + text)
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1[a], k2[a]), hashlib.sha256(text)
            if done:
                yield _digest_rows(done)
        if key is not None:
            yield _digest_rows([(*key, state.hexdigest())])

    dealt = ends.select("k1", "k2", "c").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "c")
    return dealt.mapInArrow(kernel, "k1 long, k2 long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    k1, k2, digest = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(digest, pa.string())],
        names=["k1", "k2", "ends_sha256"],
    )


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(k1, k2, values): sums of ``values`` over the subtrees of ``nodes``.

    ``nodes`` are (k1, k2, p1, p2, depth, values); a parent that is not among
    them must have depth 0. In round i a node's value is that of its
    descendants less than 2**i below, and its pointer goes 2**i up.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    up = {c: F.when(F.col("depth") > 1, F.col(p)) for c, p in (("a1", "p1"), ("a2", "p2"))}
    now = nodes.select("k1", "k2", *(v.alias(k) for k, v in up.items()), *values)
    reach = 1
    while reach < deepest:
        gifts = (
            now.where("a1 IS NOT NULL")
            .groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2"))
            .agg(*(F.sum(v).alias(f"_{v}") for v in values))
        )
        pointers = now.select(
            F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")
        )
        now = settle(
            now.join(gifts, ["k1", "k2"], "left")
            .join(pointers, ["a1", "a2"], "left")
            .select(
                "k1",
                "k2",
                F.col("b1").alias("a1"),
                F.col("b2").alias("a2"),
                *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values),
            ),
            "trie-subtrees",
        )
        reach *= 2
    return now.drop("a1", "a2")


def trie_nodes(turns: DataFrame, members: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """A row for every node of the trie of ``turns`` (c, at, digest, words).

    ``members`` (c, n_turns) are all conversations, those without turns too.
    """
    keys = prefixes(turns)
    n = keys.count()
    n_cells = 1 << max(4, min(max_cells.bit_length() - 1, (CELLS_PER_PREFIX * n).bit_length()))
    table = settle(screened(keys, n_cells, sketch(keys, n_cells)), "trie-screened")

    # Exact groups of the prefixes that may be shared.
    grouped = settle(
        table.where("NOT single")
        .groupBy("k1", "k2", "depth")
        .agg(
            F.count("*").alias("n_convs"),
            F.min("c").alias("conv_id"),
            *(F.first(c).alias(c) for c in ("p1", "p2", "words", "below_single")),
            F.max("is_last").alias("is_last"),
        ),
        "trie-groups",
    )
    shared = grouped.where("n_convs > 1")
    same = ["p1", "p2"]
    parents = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))

    # Nodes of one conversation that may hang on a shared node.
    alone = (
        table.where("single AND NOT below_single")
        .select("c", "depth", "p1", "p2", "is_last")
        .unionByName(
            grouped.where("n_convs = 1 AND NOT below_single").select(
                F.col("conv_id").alias("c"), "depth", "p1", "p2", "is_last"
            )
        )
    )
    tops = settle(
        alone.where("depth = 1")
        .withColumn("above", F.lit(None).cast("long"))
        .unionByName(alone.where("depth > 1").join(parents, same, "left").select(*alone.columns, "above")),
        "trie-tops",
    )
    hanging = tops.where("depth = 1 OR above IS NOT NULL")
    root = members.agg(
        F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.sum((F.col("n_turns") == 0).cast("int")).alias("ends")
    ).first()
    if not root["n_convs"]:
        return _nodes(tops.limit(0).selectExpr("c AS conv_id", "*"), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(""))

    def children(nodes: DataFrame, count: str) -> DataFrame:
        return nodes.groupBy(*same).agg(F.count("*").alias(count)).withColumnsRenamed({"p1": "k1", "p2": "k2"})

    counted = settle(
        shared.join(children(shared, "_shared"), ["k1", "k2"], "left")
        .join(children(hanging.where("depth > 1"), "_alone"), ["k1", "k2"], "left")
        .fillna(0, ["_shared", "_alone"])
        .withColumn("n_children", F.col("_shared") + F.col("_alone"))
        .withColumn("leaves", F.col("_alone") + (F.col("n_children") == 0).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("words")),
        "trie-shared",
    )
    whole = counted.agg(F.sum("leaves"), F.sum("saved"), F.sum((F.col("depth") == 1).cast("long"))).first()
    top_level = hanging.where("depth = 1").count()
    sums = subtree_sums(counted.select("k1", "k2", "p1", "p2", "depth", "leaves", "saved"), ["leaves", "saved"])
    ended = (
        table.where("NOT single AND is_last")
        .join(shared.where("is_last").select("k1", "k2"), ["k1", "k2"], "left_semi")
        .select("k1", "k2", "c")
        .unionByName(members.where("n_turns = 0").selectExpr("0L AS k1", "0L AS k2", "c"))
    )
    digests = settle(ends_digests(ended), "trie-ends")
    joint = (
        counted.drop("leaves", "saved", "is_last")
        .join(sums, ["k1", "k2"])
        .join(parents, same, "left")
        .join(digests, ["k1", "k2"], "left")
    )
    nothing, one = F.lit(0), F.lit(1)
    first = F.lit(root["conv_id"])
    of_joint = _nodes(
        joint,
        F.when(F.col("depth") == 1, first).otherwise(F.col("above")),
        F.col("n_convs"),
        F.col("n_children"),
        F.col("leaves"),
        F.col("saved"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)),
    )
    own_end = F.when(
        F.col("is_last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    ).otherwise(EMPTY_SHA256)
    goes_on = (~F.col("is_last")).cast("long")

    def of_one(nodes: DataFrame, above: Column) -> DataFrame:
        return _nodes(nodes, above, one, goes_on, one, nothing, own_end)

    own = F.col("conv_id")
    of_tops = of_one(
        tops.withColumnRenamed("c", "conv_id"),
        F.when(F.col("depth") == 1, first).otherwise(F.coalesce("above", own)),
    )
    of_tails = of_one(table.where("single AND below_single").withColumnRenamed("c", "conv_id"), own)
    of_strays = of_one(grouped.where("n_convs = 1 AND below_single"), own)
    n_children = (whole[2] or 0) + top_level
    ends = digests.where("k1 = 0 AND k2 = 0").first()
    at_root = members.sparkSession.range(1).select(first.alias("conv_id"), F.lit(0).alias("depth"))
    of_root = _nodes(
        at_root,
        F.lit(None),
        F.lit(root["n_convs"]),
        F.lit(n_children),
        F.lit((whole[0] or 0) + top_level if n_children else 1),
        F.lit(whole[1] or 0),
        F.lit(ends["ends_sha256"] if ends else EMPTY_SHA256),
    )
    return of_root.unionByName(of_joint).unionByName(of_tops).unionByName(of_tails).unionByName(of_strays)


def _nodes(
    nodes: DataFrame, above: Column, n_convs: Column, n_children: Column, n_leaves: Column, saved: Column, ends: Column
) -> DataFrame:
    """The columns of the result, from ``nodes`` with ``conv_id`` and ``depth``."""
    longs = {
        "conv_id": F.col("conv_id"),
        "depth": F.col("depth"),
        "parent_conv_id": above,
        "n_convs": n_convs,
        "n_children": n_children,
        "n_leaves": n_leaves,
        "saved_tokens": saved,
    }
    return nodes.select(*(v.cast("long").alias(k) for k, v in longs.items()), ends.alias("ends_sha256"))


def conversation_trie(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations (see :func:`rebuilt`)."""
    turns = settle(turn_digests(conversations, id_col, turn_col, role_col, text_col), "trie-digests")
    return trie_nodes(*rebuilt(turns), max_cells)
