"""Token counts by an exact histogram of document lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tokenizing import TokenizerFile, token_lengths
from plumbline.session import settle

#: Lengths of a block of the running sums.
BLOCK = 4096


def length_histogram(
    docs: DataFrame, file: TokenizerFile, text_col: str = "text", end_id: int | None = None
) -> DataFrame:
    """(length, n_docs) of all documents; null texts are empty, of length 0."""
    return (
        token_lengths(docs, file, [], text_col, end_id)
        .groupBy(F.col("n_tokens").alias("length"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, what lies at and above it.

    Columns: length, n_docs, docs_from and tokens_from (documents of this
    length and more, and their tokens), n_tokens (all tokens) and
    tokens_within (what is left of all if every document is cut at this
    length). Sums run within blocks of lengths and over the blocks' totals,
    so no task sees all lengths.
    """
    rows = settle(
        histogram.withColumn("block", F.floor(F.col("length") / BLOCK)), "length-histogram"
    )
    docs, tokens = F.col("n_docs"), F.col("n_docs") * F.col("length")
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = rows.groupBy("block").agg(F.sum(docs).alias("docs"), F.sum(tokens).alias("tokens"))
    above = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_above"),
        F.sum("tokens").over(every).alias("n_tokens"),
    )
    here = Window.partitionBy("block").orderBy(F.col("length").desc())
    return (
        rows.join(above, "block")
        .withColumn("docs_from", F.sum(docs).over(here) + F.col("docs_above"))
        .withColumn("tokens_from", F.sum(tokens).over(here) + F.col("tokens_above"))
        .select(
            "length",
            "n_docs",
            "docs_from",
            "tokens_from",
            "n_tokens",
            (F.col("n_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("length")).alias(
                "tokens_within"
            ),
        )
    )


def totals_at(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, n_docs, n_tokens, docs_cut, tokens_within) for any context limits.

    The first length above a limit tells how many documents are cut there.
    """
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    everything = sums.agg(F.max("docs_from").alias("n_docs"), F.max("n_tokens").alias("n_tokens"))
    longer = (
        wanted.join(F.broadcast(wanted.select(F.col("limit").alias("l"))), F.col("limit") == F.col("l"))
        .join(sums, F.col("length") > F.col("limit"))
        .groupBy("limit")
        .agg(F.min_by(F.struct("docs_from", "tokens_from"), "length").alias("above"))
    )
    cut, gone = F.coalesce("above.docs_from", F.lit(0)), F.coalesce("above.tokens_from", F.lit(0))
    return (
        wanted.join(longer, "limit", "left")
        .join(F.broadcast(everything), F.lit(True))
        .select(
            "limit",
            F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
            F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            cut.alias("docs_cut"),
            (F.coalesce("n_tokens", F.lit(0)) - gone + cut * F.col("limit")).alias("tokens_within"),
        )
    )


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the smallest length that at least that share of documents does not exceed."""
    n = sums.agg(F.max("docs_from")).first()[0] or 0

    def length(share: float) -> Column:
        up_to = F.lit(n) - F.col("docs_from") + F.col("n_docs")
        return F.min(F.when(up_to >= share * n, F.col("length")))

    one = sums.agg(
        F.array(*(F.struct(F.lit(float(s)).alias("share"), length(s).alias("length")) for s in shares)).alias("q")
    )
    return one.select(F.inline("q"))
