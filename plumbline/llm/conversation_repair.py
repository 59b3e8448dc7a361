"""Repair of conversation structure by a rank-convergence parallel Viterbi search.

A repaired conversation's roles begin with the letters ``(s?(ua)+)?``. The
cheapest edits follow from cost vectors, one number for each state of that
pattern, that run backwards over the rows. Most conversations are repaired by
one pass in one task. A long one is cut into chunks: each chunk starts from a
guessed vector at its end, all at once; fix-up passes hand every chunk the
vector its successor found and rerun it until the new vectors differ from the
old ones only by a constant, which changes no decision. With all vectors
stitched, a trace runs forward and takes the least letter that keeps the cost;
its chunks guess their first state and are fixed up in the same way.

Results in edge cases:

* rows are taken by turn, nulls first, then by role and by SHA-256 of the text,
  all after the damage; a null conversation id is a conversation like any other;
* null roles and texts are one space, hence blank and of no legal role;
* repeated rows are duplicates of the first; ties of cost go to the audit that
  is least in ASCII, a shorter one before those that go on from it;
* a conversation that has lost all its rows has zeros, an empty audit and the
  hash of the empty string; an empty table has no rows;
* texts are read whole; columns other than the four named are ignored,
  whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.ordered import in_order
from plumbline.session import settle

#: A conversation with more rows than this, or more characters, is cut into
#: chunks of so many rows.
LONG_ROWS, LONG_CHARS = 4096, 1 << 23
SPACE = " \t\n\v\f\r"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1

# A row's code: its role's initial, and what is wrong with it.
S, U, A, OTHER = range(4)
BLANK, DUPLICATE, TRUNCATED = 4, 8, 16
GONE = BLANK | DUPLICATE  # such a row is deleted
_INITIALS = {"s": S, "u": U, "a": A}
LEGAL = {(S, U), (U, A), (A, U)}

# States: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}
#: Costs from each state when no row is left.
AT_END = (0, 2 * INSERT_COST, INSERT_COST, 0)
_NEVER = 1 << 40


def turned(state: int) -> int:
    """The state after an inserted or re-roled row: the user speaks unless it just did."""
    return AFTER_A if state == AFTER_U else AFTER_U


def kept(state: int, initial: int) -> int | None:
    """The state after a row that stays as it is, if it may."""
    if initial == U and state != AFTER_U:
        return AFTER_U
    if initial == A and state == AFTER_U:
        return AFTER_A
    if initial == S and state == START:
        return AFTER_S
    return None


@lru_cache(maxsize=1 << 16)
def step(code: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Costs before a row from those after it: (least, each above the least)."""
    cost = [DELETE_COST + x for x in after]
    if not code & GONE:
        extra = TRUNCATED_COST if code & TRUNCATED else 0
        for state in range(4):
            to = kept(state, code & 3)
            cost[state] = min(
                cost[state],
                extra + (after[to] if to is not None else _NEVER),
                extra + REROLE_COST + after[turned(state)],
            )
    # Inserts before the row; two of them lead back, so one round over u and a is all.
    u, a = cost[AFTER_U], cost[AFTER_A]
    cost[AFTER_U], cost[AFTER_A] = min(u, INSERT_COST + a), min(a, INSERT_COST + u)
    for state in (START, AFTER_S):
        cost[state] = min(cost[state], INSERT_COST + cost[AFTER_U])
    least = min(cost)
    return least, tuple(x - least for x in cost)


def normal(vector) -> tuple[int, ...]:
    least = min(vector)
    return tuple(x - least for x in vector)


def backward(codes, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Vectors at every place, up to a constant at each: before row 0 to after the last."""
    vectors = [normal(after)]
    for code in reversed(codes):
        vectors.append(step(code, vectors[-1])[1])
    vectors.reverse()
    return vectors


def fixed_up(codes, old: tuple[int, ...], new: tuple[int, ...], old_first: tuple[int, ...]) -> tuple[int, ...]:
    """The first vector from ``new`` at the end; the old one as soon as both runs agree."""
    old, new = normal(old), normal(new)
    for code in reversed(codes):
        if old == new:
            return old_first
        old, new = step(code, old)[1], step(code, new)[1]
    return new


def trace(codes, vectors, state: int) -> tuple[list[str], int]:
    """Letters of each row (inserts before it, then its own) and the state behind the last.

    ``vectors`` are normal; what a row's step adds to all costs comes from
    :func:`step` again.
    """
    letters = []
    for i, code in enumerate(codes):
        after = vectors[i + 1]
        least, before = step(code, after)
        mine = ""
        while True:
            to_go = least + before[state]
            if DELETE_COST + after[state] == to_go:
                mine += "D"
                break
            if INSERT_COST + least + before[turned(state)] == to_go:
                mine, state = mine + "I", turned(state)
                continue
            extra = TRUNCATED_COST if code & TRUNCATED else 0
            to = kept(state, code & 3)
            if to is not None and extra + after[to] == to_go:
                mine, state = mine + "K", to
            else:
                mine, state = mine + "R", turned(state)
            break
        letters.append(mine)
    return letters, state


def closing(state: int) -> int:
    """Inserts at the end that complete the pattern."""
    return {START: 0, AFTER_A: 0, AFTER_U: 1, AFTER_S: 2}[state]


def cost_of(codes, letters: list[str]) -> int:
    price = {"D": DELETE_COST, "K": 0, "R": REROLE_COST}
    total = 0
    for code, mine in zip(codes, letters):
        total += INSERT_COST * (len(mine) - 1) + price[mine[-1]]
        if code & TRUNCATED and mine[-1] != "D":
            total += TRUNCATED_COST
    return total


def spoken_by(codes, letters: list[str], state: int) -> Iterator[tuple[list[str], str | None]]:
    """For every row the roles inserted before it, and its own: ``""`` as it was, None if deleted."""
    for code, mine in zip(codes, letters):
        inserted = []
        for _ in mine[:-1]:
            state = turned(state)
            inserted.append(ROLES[state])
        own = None
        if mine[-1] == "R":
            state = turned(state)
            own = ROLES[state]
        elif mine[-1] == "K":
            state = kept(state, code & 3)
            own = ""
        yield inserted, own


def closing_roles(state: int) -> list[str]:
    """Roles inserted behind the last row."""
    roles = []
    for _ in range(closing(state)):
        state = turned(state)
        roles.append(ROLES[state])
    return roles


def row_codes(rows: list[tuple[str, str]]) -> bytes:
    """Codes of a whole conversation's rows (role, text), in order."""
    seen: set[tuple[str, str]] = set()
    codes = bytearray()
    for role, text in rows:
        end = text.rstrip(SPACE)
        if not end:
            fault = BLANK
        elif (role, text) in seen:
            fault = DUPLICATE
        else:
            fault = 0 if end[-1] in ".!?" else TRUNCATED
        seen.add((role, text))
        codes.append(_INITIALS.get(role[:1], OTHER) | fault)
    return bytes(codes)


def n_illegal(codes: bytes) -> int:
    return sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))


_RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
_FIELDS = [x.split()[0] for x in _RESULT.split(", ")]


def repair(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The result's fields for a whole conversation's rows (turn, role, text), in order."""
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    said = [(role, text) for _, role, text in rows]
    codes = row_codes(said)
    letters, state = trace(codes, backward(codes, AT_END), START)
    lines = []
    for (role, text), (inserted, own) in zip(said, spoken_by(codes, letters, START)):
        lines += [f"{x}:" for x in inserted]
        if own is not None:
            lines.append(f"{own or role}:{text}")
    lines += [f"{x}:" for x in closing_roles(state)]
    counts = [sum(bool(c & fault) for c in codes) for fault in (BLANK, DUPLICATE, TRUNCATED)]
    return (
        gaps,
        *counts,
        n_illegal(codes),
        cost_of(codes, letters) + INSERT_COST * closing(state),
        "".join(letters) + "I" * closing(state),
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def damaged(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that a row's id and turn call for.

    The crc32 of ``id:turn`` modulo 20 says what: 0 drops the row (no copies),
    1 empties the text, 2 takes its stops, 3 repeats the row, 4 makes it the
    user's. Nulls are one space, in the key too.
    """

    def whole(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(whole(id_col), F.lit(":"), whole(turn_col)).cast("binary")) % 20
    rows = conversations.select(
        F.col(f"`{id_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        whole(role_col).alias("role"),
        whole(text_col).alias("text"),
        kind.alias("kind"),
    )
    left = F.col("kind") != 0
    text = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    return rows.select(
        "conv_id",
        "turn",
        F.when(left, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(left, text).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(left.cast("int")).alias("copies"),
    )


def _short(rows: DataFrame) -> DataFrame:
    """Results of conversations that a task can hold, one after the other."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.sha2("text", 256)]
    dealt = rows.repartition("conv_id").sortWithinPartitions(*order)

    def results(done: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, *[pa.int64()] * 6, *[pa.string()] * 2]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*done), types)], names=["conv_id", *_FIELDS]
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, begun, id_type = None, [], False, None
        for batch in batches:
            done, id_type = [], batch.schema.field("conv_id").type
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now or not begun:
                    if begun:
                        done.append((now, *repair(held)))
                    now, held, begun = conv, [], True
                held.extend([(turn, role, text)] * copies)
            if done:
                yield results(done, id_type)
        if begun:
            yield results([(now, *repair(held))], id_type)

    return dealt.mapInArrow(kernel, f"conv_id {kind}, {_RESULT}")


def _long_codes(rows: DataFrame) -> DataFrame:
    """(k, place, code) of rows (k, place, role, text, d) in order; copies meet by digest."""
    firsts = rows.groupBy("k", "role", "d").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    repeated = firsts.where("n > 1").drop("n")
    initial = F.when(F.col("role").startswith("s"), S).when(F.col("role").startswith("u"), U)
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    fault = (
        F.when(end == "", BLANK)
        .when(F.col("place") > F.coalesce("first", "place"), DUPLICATE)
        .when(~end.isin(".", "!", "?"), TRUNCATED)
        .otherwise(0)
    )
    code = initial.when(F.col("role").startswith("a"), A).otherwise(OTHER) + fault
    return rows.join(repeated, ["k", "role", "d"], "left").select("k", "place", code.alias("code"))


def _chunked(codes: DataFrame, chunk_rows: int) -> DataFrame:
    """(k, chunk, codes, illegal, active): codes of ``chunk_rows`` consecutive rows in one
    value, and whether a row of them may stay."""

    def join(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("place")
        value = bytes(ordered.column("code").to_pylist())
        return pa.table(
            {
                "k": ordered.column("k")[:1],
                "chunk": ordered.column("chunk")[:1],
                "codes": pa.array([value], pa.binary()),
                "illegal": pa.array([n_illegal(value)], pa.int64()),
                "active": pa.array([any(not c & GONE for c in value)]),
            }
        )

    chunk = F.floor(F.col("place") / chunk_rows).cast("long")
    return (
        codes.withColumn("chunk", chunk)
        .groupBy("k", "chunk")
        .applyInArrow(join, "k long, chunk long, codes binary, illegal long, active boolean")
    )


_PASS = "k long, chunk long, codes binary, before long, behind long, given array<long>, found array<long>, changed boolean"


def _converged(state: DataFrame, neighbour: str, rerun, name: str) -> DataFrame:
    """Hand every chunk what its ``neighbour`` found and rerun it, until nothing changes.

    ``rerun(codes, old given, new given, old found)`` is what a chunk then finds.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                new, row["changed"] = row.pop("handed"), False
                if new is not None and new != row["given"]:
                    found = list(rerun(row["codes"], tuple(row["given"]), tuple(new), tuple(row["found"])))
                    row["changed"], row["given"], row["found"] = found != row["found"], new, found
            yield pa.RecordBatch.from_pylist(rows, schema=_pass_schema())

    while True:
        handed = state.select("k", F.col("chunk").alias(neighbour), F.col("found").alias("handed"))
        joined = state.drop("changed").join(handed, ["k", neighbour], "left")
        order = ["k", "chunk", "codes", "before", "behind", "given", "found", "handed"]
        state = settle(joined.select(order).mapInArrow(kernel, _PASS), name)
        if state.where("changed").isEmpty():
            return state


def _pass_schema() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema(
        [("k", pa.int64()), ("chunk", pa.int64()), ("codes", pa.binary()), ("before", pa.int64()),
         ("behind", pa.int64()), ("given", longs), ("found", longs), ("changed", pa.bool_())]
    )


def _first_vector(codes, given: tuple[int, ...]) -> list[int]:
    return list(backward(codes, given)[0])


def _searched(chunks: DataFrame) -> DataFrame:
    """(k, chunk, codes, behind, after, entry): vectors and states that fit together.

    Only chunks that have a row to keep take part: where all are deleted, a
    vector changes by a constant and a state not at all.
    """
    order = Window.partitionBy("k").orderBy("chunk")  # one row a chunk, without its codes
    active = chunks.where("active").drop("active", "illegal")
    links = active.select(
        "k", "chunk", F.lag("chunk").over(order).alias("before"), F.lead("chunk").over(order).alias("behind")
    )
    linked = active.join(links, ["k", "chunk"])

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["given"] = list(normal(AT_END))  # exact for the last chunk, a guess for others
                row["found"], row["changed"] = _first_vector(row["codes"], tuple(row["given"])), False
            yield pa.RecordBatch.from_pylist(rows, schema=_pass_schema())

    columns = ["k", "chunk", "codes", "before", "behind"]
    state = settle(linked.select(columns).mapInArrow(started, _PASS), "repair-backward")
    vectors = _converged(state, "behind", fixed_up, "repair-backward")

    # Forward: a chunk is given its first state and finds its last. The vector
    # behind it travels in front of its codes.
    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["codes"] = bytes(row["given"]) + row["codes"]
                row["given"] = [START if row["before"] is None else AFTER_A]
                row["found"] = _last_state(row["codes"], row["given"], None, None)
            yield pa.RecordBatch.from_pylist(rows, schema=_pass_schema())

    def again(codes, old, new, found):
        return _last_state(codes, new, None, None)

    forward = settle(vectors.mapInArrow(guessed, _PASS), "repair-forward")
    return _converged(forward, "before", again, "repair-forward")


def _last_state(value: bytes, given, _old, _found) -> list[int]:
    vectors = backward(value[4:], tuple(value[:4]))
    return [trace(value[4:], vectors, given[0])[1]]


def _edits(searched: DataFrame) -> DataFrame:
    """(k, chunk, audit, cost, own, inserted): letters of every chunk, and what its rows become."""
    schema = "k long, chunk long, audit string, cost long, own array<string>, inserted array<array<string>>"
    names = ["k", "chunk", "audit", "cost", "own", "inserted"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                codes, state = row["codes"][4:], row["given"][0]
                letters, _ = trace(codes, backward(codes, tuple(row["codes"][:4])), state)
                spoken = list(spoken_by(codes, letters, state))
                out.append(
                    (row["k"], row["chunk"], "".join(letters), cost_of(codes, letters),
                     [own for _, own in spoken], [inserted for inserted, _ in spoken])
                )
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))]
            columns = zip(*out) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types)], names=names)

    return searched.mapInArrow(kernel, schema)


def _hashes(lines: DataFrame) -> DataFrame:
    """(k, repaired_sha256) of (k, place, line): a hash takes its bytes in order, batch by batch."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for k, line in zip(batch.column("k").to_pylist(), batch.column("line").to_pylist()):
                if k == now:
                    state.update(b"\n" + line.encode())
                    continue
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = k, hashlib.sha256(line.encode())
        if now is not None:
            done.append((now, state.hexdigest()))
        keys, digests = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(digests, pa.string())], names=["k", "repaired_sha256"]
        )

    dealt = lines.repartition("k").sortWithinPartitions("k", "place")
    return dealt.mapInArrow(kernel, "k long, repaired_sha256 string")


def _long(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Results of conversations of any length, from rows that also carry their number ``k``."""
    kept_rows = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("d"), F.col("copy")]
    ordered = in_order(
        kept_rows.select("k", "turn", "role", "text", F.sha2("text", 256).alias("d"), "copy"), "k", order, "repair-rows"
    )
    codes = settle(_long_codes(ordered), "repair-codes")
    chunks = settle(_chunked(codes, chunk_rows), "repair-chunks")
    searched = _searched(chunks)
    edits = settle(_edits(searched), "repair-edits")

    # Chunks without a row to keep are deleted whole.
    audits = chunks.select("k", "chunk", F.length("codes").alias("n"), "illegal").join(
        edits.select("k", "chunk", "audit", "cost"), ["k", "chunk"], "left"
    ).select(
        "k",
        "chunk",
        "illegal",
        F.coalesce("audit", F.expr("repeat('D', n)")).alias("audit"),
        F.coalesce("cost", F.col("n") * DELETE_COST).alias("cost"),
    )
    tail = searched.where("behind IS NULL").select("k", F.col("found")[0].alias("state"))
    behind = F.when(F.col("state") == AFTER_U, F.array(F.lit("assistant"))).when(
        F.col("state") == AFTER_S, F.array(F.lit("user"), F.lit("assistant"))
    )
    closings = tail.select("k", behind.alias("roles")).where("roles IS NOT NULL")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"])
    whole = audits.groupBy("k").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(parts, "").alias("audit")
    )
    edge = chunks.select(
        "k",
        "chunk",
        F.expr("ascii(substring(codes, 1, 1)) % 4").alias("head"),
        F.expr("ascii(substring(codes, length(codes), 1)) % 4").alias("foot"),
    )
    following = F.lead("head").over(Window.partitionBy("k").orderBy("chunk"))  # one row a chunk
    legal = " OR ".join(f"(foot = {a} AND following = {b})" for a, b in sorted(LEGAL))
    seams = (
        edge.withColumn("following", following)
        .where(f"following IS NOT NULL AND NOT ({legal})")
        .groupBy("k")
        .agg(F.count("*").alias("seams"))
    )
    of_rows = codes.groupBy("k").agg(
        *(F.sum((F.col("code").bitwiseAND(F.lit(bit)) > 0).cast("long")).alias(name)
          for bit, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated")))
    )
    turn = F.col("turn").cast("decimal(20,0)")
    gaps = ordered.groupBy("k").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )

    by_row = edits.select(
        "k", "chunk", F.posexplode(F.arrays_zip("own", "inserted")).alias("i", "edit")
    ).select("k", (F.col("chunk") * chunk_rows + F.col("i")).alias("place"), "edit.own", "edit.inserted")
    said = F.concat(F.when(F.col("own") == "", F.col("role")).otherwise(F.col("own")), F.lit(":"), "text")
    titles = lambda roles: F.transform(roles, lambda x: F.concat(x, F.lit(":")))
    lines = (
        ordered.join(by_row, ["k", "place"])
        .where("own IS NOT NULL OR size(inserted) > 0")
        .select("k", "place", F.concat_ws("\n", titles("inserted"), said).alias("line"))
        .unionByName(
            closings.select("k", F.lit((1 << 63) - 1).alias("place"), F.concat_ws("\n", titles("roles")).alias("line"))
        )
    )
    return (
        rows.select("k", "conv_id")
        .distinct()
        .join(gaps, "k", "left")
        .join(of_rows, "k", "left")
        .join(whole, "k", "left")
        .join(seams, "k", "left")
        .join(closings, "k", "left")
        .join(settle(_hashes(lines), "repair-hashes"), "k", "left")
        .select(
            "conv_id",
            *(F.coalesce(x, F.lit(0)).alias(x) for x in ("gaps", "blank", "duplicate", "truncated")),
            (F.coalesce("illegal", F.lit(0)) + F.coalesce("seams", F.lit(0))).alias("illegal"),
            (F.coalesce("cost", F.lit(0)) + INSERT_COST * F.greatest(F.coalesce(F.size("roles"), F.lit(0)), F.lit(0))).alias("cost"),
            F.concat(F.coalesce("audit", F.lit("")), F.expr("repeat('I', coalesce(greatest(size(roles), 0), 0))")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )
    )


def repaired_conversations(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    long_rows: int = LONG_ROWS,
    long_chars: int = LONG_CHARS,
) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired text of every damaged conversation.

    The audit of a conversation is one value of the result, and its hash takes
    its text in order; all else of a long one is spread over tasks.
    """
    rows = damaged(conversations, id_col, turn_col, role_col, text_col)
    sizes = rows.groupBy("conv_id").agg(
        F.sum("copies").alias("n"), F.sum(F.col("copies") * F.coalesce(F.length("text"), F.lit(0))).alias("chars")
    )
    long = settle(
        sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars))
        .select(F.col("conv_id").alias("long_id"), F.monotonically_increasing_id().alias("k")),
        "repair-long",
    )
    if long.isEmpty():
        return _short(rows).withColumnRenamed("conv_id", id_col)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = _short(rows.join(long, same, "left_anti"))
    both = short.unionByName(_long(rows.join(long, same).drop("long_id"), long_rows))
    return both.withColumnRenamed("conv_id", id_col)
