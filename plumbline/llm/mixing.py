"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Every document draws how often it appears from a Poisson distribution whose
mean is the repetition rate of its source, by inverting the distribution at a
uniform number that a seeded hash of its id gives. Draws need no coordination,
repeat exactly, and expected counts meet the target weights.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free_name
from plumbline.session import settle

SEED = 42
#: Without explicit weights a source weighs its number of rows to this power.
SIZE_EXPONENT = 0.5
#: A larger mean is the sum of independent draws with a mean of this at most.
MEAN_PER_DRAW = 16.0
#: Terms of one draw's distribution; beyond them less than 1e-20 is left.
TERMS = 100


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def repetition_rates(
    docs: DataFrame,
    source_col: str = "source",
    weights: Mapping[str | None, float] | None = None,
    exponent: float = SIZE_EXPONENT,
    total: float | None = None,
) -> DataFrame:
    """(source, n_docs, rate): how often a document of each source shall appear.

    ``weights`` maps sources to target shares, up to a factor; sources it
    does not name get none. ``total`` is the expected number of rows of the
    mixture, by default that of ``docs``. A null source is a source.
    """
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs")
    )
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(exponent)))
    else:
        given = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "named string, weight double"
        )
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("named")), "left").select(
            "source", "n_docs", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    weighed = settle(weighed, "weights")
    sums = weighed.agg(F.sum("weight").alias("weight"), F.sum("n_docs").alias("n_docs")).first()
    per_weight = (total if total is not None else sums.n_docs or 0) / (sums.weight or 1.0)
    return weighed.select(
        "source", "n_docs", (F.col("weight") * float(per_weight) / F.col("n_docs")).alias("rate")
    )


def cumulative_poisson(mean: Column, terms: int = TERMS) -> Column:
    """Array of P(X <= k) for k from 0 to ``terms``."""
    zero = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all")
    )

    def step(have: Column, k: Column) -> Column:
        p = have["p"] * mean / k
        return F.struct(
            p.alias("p"), (have["c"] + p).alias("c"), F.concat(have["all"], F.array(have["c"] + p)).alias("all")
        )

    ks = F.sequence(F.lit(1), F.lit(terms)).cast("array<double>")
    return F.aggregate(ks, zero, step, lambda have: have["all"])


def mix(
    docs: DataFrame,
    rates: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: int = SEED,
    copy_col: str = "copy",
) -> DataFrame:
    """``docs`` with every row as often as it draws, in random order.

    All columns stay; ``copy_col`` (lengthened if there is such a column)
    counts a row's copies from 1. Rows with equal ids draw alike. A document
    with a rate of 0 does not appear.
    """
    copy_col = free_name(docs, copy_col)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_PER_DRAW)).cast("int")
    drawn, its_source, its_parts, its_table, order = (
        free_name(docs, name) for name in ("drawn", "drawn_source", "drawn_parts", "drawn_table", "drawn_order")
    )
    table = settle(
        rates.withColumn("parts", parts).select(
            F.col("source").alias(its_source),
            F.col("parts").alias(its_parts),
            cumulative_poisson(F.col("rate") / F.col("parts")).alias(its_table),
        ),
        "rates",
    )

    def one_draw(part: Column) -> Column:
        u = uniform(seed, F.col(f"`{id_col}`"), part)
        return F.size(F.filter(its_table, lambda c: c <= u))

    count = F.aggregate(
        F.sequence(F.lit(1), F.col(its_parts)), F.lit(0), lambda have, part: have + one_draw(part)
    )
    found = (
        docs.join(table, F.col(f"`{source_col}`").eqNullSafe(F.col(its_source)))
        .withColumn(drawn, count)
        .where(F.col(drawn) > 0)
        .withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(drawn))))
    )
    return (
        found.withColumn(order, F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(copy_col)))
        .select(*(f"`{c}`" for c in docs.columns), copy_col, order)
        .repartition(order)
        .sortWithinPartitions(order)
        .drop(order)
    )
