"""Connected components as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges``; root is the smallest one reachable.

    Each round takes the smallest root among a node and its neighbours, then
    follows that root's own root, until nothing changes. Rounds are written
    tables, which compress so well that their files say little of their size,
    so nothing is broadcast; roots shared by many nodes meet only in plain joins, which adaptive
    execution splits.
    """
    both = settle(
        edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
        .where("node <> other")
        .distinct(),
        "links",
    )
    state = settle(
        both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "roots"
    )
    while True:
        seen = (
            both.join(state.select(F.col("node").alias("other"), "root").hint("merge"), "other")
            .groupBy("node")
            .agg(F.min("root").alias("near"))
        )
        hooked = settle(
            state.join(seen.hint("merge"), "node").select(
                "node", F.col("root").alias("was"), F.least("root", "near").alias("root")
            ),
            "roots",
        )
        if hooked.where("root <> was").isEmpty():
            return state
        state = settle(
            hooked.alias("x")
            .join(hooked.alias("y").hint("merge"), F.col("x.root") == F.col("y.node"))
            .select("x.node", F.least("x.root", "y.root").alias("root")),
            "roots",
        )
