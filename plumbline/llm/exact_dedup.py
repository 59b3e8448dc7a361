"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A normalised text is cut where its content says so. The distinct chunks of
the corpus are compared once, as whole strings, so that from then on a 64-bit
identifier stands for a chunk with certainty; a document becomes the ordered
list of its identifiers, and documents are equal when their lists are. A long
document crosses the network once, without the chunks that its map task has
seen already, however often the groups are used afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, text_or_empty
from plumbline.session import settle

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Code points of the shortest and longest chunk; between them a chunk ends
#: behind the first mark that closes a sentence or clause.
CHUNK_LENGTHS = (256, 2048)
CHUNK_END = r"[.!?;:。！？；：।؟]"


def normalised(column: str) -> Column:
    return F.regexp_replace(text_or_empty(column), WHITE_SPACE, "")


def chunks(text: Column, lengths: tuple[int, int] = CHUNK_LENGTHS) -> Column:
    """The chunks of ``text``, which joined give it back; none if it is empty."""
    least, most = lengths
    pattern = rf"(?s).{{{least},{most}}}?(?<={CHUNK_END})|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(
    rows: DataFrame,
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """``rows`` (uid, chunks, ...) with ``recipe``, equal for equal chunk lists only.

    Identifiers are hashes that the dictionary of distinct chunks proves to
    mean one chunk each. Where a hash stands for several chunks, the recipe
    also lists, by position, which of them is meant.
    """
    hashed = chunk_hash(F.col("chunk")).cast("long")
    dictionary = (
        rows.select(F.explode("chunks").alias("chunk")).select(hashed.alias("h"), "chunk").distinct()
    )
    clashes = settle(
        dictionary.groupBy("h").count().where("count > 1").select("h"), "clashing-hashes"
    )
    recipe = F.transform("chunks", lambda c: chunk_hash(c).cast("long"))
    if clashes.isEmpty():
        nothing = F.lit(None).cast("array<struct<pos:int,id:long>>")
        return rows.select(*rows.drop("chunks").columns, recipe.alias("recipe"), nothing.alias("meant"))
    rows = settle(rows, "chunked")  # both uses below must see the same uid
    listed = rows.select(*rows.drop("chunks").columns, recipe.alias("recipe"))
    told_apart = settle(
        dictionary.join(clashes, "h").withColumn("id", F.monotonically_increasing_id()),
        "clashing-chunks",
    )
    meant = (
        rows.select("uid", F.posexplode("chunks").alias("pos", "chunk"))
        .withColumn("h", hashed)
        .join(told_apart, ["h", "chunk"])
        .groupBy("uid")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("meant"))
    )
    return listed.join(meant, "uid", "left")


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and whether it stays.

    Texts are equal when identical after deleting white space; null counts as
    empty, and empty texts are equal to each other. The row with the most code
    points of original text stays, then the one with the smallest id (null
    last); of rows alike in both, exactly one. Returns ``uid`` (a number for
    the row), the id column, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` and ``n_points``. Other columns are not looked at.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(f"`{id_col}`").alias("id"),
        F.length(text_or_empty(text_col)).cast("long").alias("n_points"),
        normalised(text_col).alias("norm"),
    )
    listed = settle(
        recipes(
            rows.select(
                "uid",
                "id",
                "n_points",
                F.sha2("norm", 256).alias("text_sha256"),
                chunks(F.col("norm")).alias("chunks"),
            ),
            chunk_hash,
        ),
        "recipes",
    )
    meant = F.coalesce("meant", F.array().cast("array<struct<pos:int,id:long>>"))
    keyed = listed.withColumn("key", F.struct("recipe", meant.alias("meant")))
    best = F.struct(-F.col("n_points"), F.col("id").isNull(), F.col("id"), F.col("uid").alias("uid"))
    groups = settle(
        keyed.groupBy("key").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")),
        "groups",  # written, so that the join below can split the rows of a large group
    )
    return keyed.join(groups.hint("merge"), "key").select(
        "uid",
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        "text_sha256",
        "n_points",
    )


def without_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    uid = free_name(docs, "uid")
    numbered = settle(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    groups = duplicate_groups(
        numbered.select(
            F.struct(
                F.col(f"`{id_col}`").isNull().alias("last"),
                F.col(f"`{id_col}`").alias("id"),
                F.col(uid).alias("row"),
            ).alias("place"),
            F.col(f"`{text_col}`").alias("text"),
        ),
        "place",
    )
    dropped = groups.where("NOT kept").select(F.col("place.row").alias(uid))
    return numbered.join(dropped, uid, "left_anti").drop(uid)
