"""The quality dimensions: completeness, uniqueness, consistency, timeliness.

The public functions take a frame and a slicing column and return DataFrames.
The ``*_from`` functions work on an existing column statistics table, so an
audit that needs several dimensions reads its data once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.defaults import PARSE_THRESHOLD, SENTINELS
from plumbline.functions.cells import (
    date_like,
    is_numeric_type,
    is_sentinel,
    numeric_like,
    row_keys,
)
from plumbline.functions.scoring import days_behind, freshness, ratio
from plumbline.operators.profile import (
    column_stats,
    dataset_key,
    dataset_keys,
    long_cells,
    measured_columns,
)


def completeness_from(stats: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    columns = stats.select(
        "dataset_id",
        "col_idx",
        "col_name",
        "n_rows",
        "n_nulls",
        (1 - ratio(F.col("n_nulls"), F.col("n_rows"))).alias("completeness"),
    )
    totals = stats.groupBy("dataset_id").agg(
        F.sum("n_rows").alias("total_cells"), F.sum("n_nulls").alias("n_nulls")
    )
    zero = F.lit(0).cast("long")
    score = F.when(F.col("total_cells") > 0, 1 - ratio(F.col("n_nulls"), F.col("total_cells")))
    datasets = keys.join(totals, "dataset_id", "left").select(
        "dataset_id",
        F.coalesce(score, F.lit(0.0)).alias("completeness"),
        F.coalesce("n_nulls", zero).alias("n_nulls"),
        F.coalesce("total_cells", zero).alias("total_cells"),
    )
    return datasets, columns


def completeness(
    df: DataFrame,
    by: str | None = None,
    columns: list[str] | None = None,
    keys: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """1 − null cells / cells, per dataset and per column; 0.0 when empty."""
    keys = dataset_keys(df, by, keys)
    return completeness_from(column_stats(df, by, columns, clean=False), keys)


def uniqueness(
    df: DataFrame,
    by: str | None = None,
    columns: list[str] | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """1 − repeated rows / rows, where a repeat equals an earlier row in every
    measured column and nulls equal nulls; 0.0 when empty.

    Grouping is on the whole row: copies of one row merge on the map side, and
    different rows of one large dataset spread over all tasks.
    """
    keys = dataset_keys(df, by, keys)
    cells = row_keys(measured_columns(df, by, columns))
    counted = (
        df.groupBy(dataset_key(by), *cells)
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("dataset_id")
        .agg(F.sum("copies").alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows"))
    )
    return uniqueness_from(counted, keys)


def uniqueness_from(counted: DataFrame, keys: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    rows = F.coalesce("total_rows", zero)
    repeated = F.coalesce(F.col("total_rows") - F.col("distinct_rows"), zero)
    return keys.join(counted, "dataset_id", "left").select(
        "dataset_id",
        F.when(rows > 0, 1 - ratio(repeated, rows)).otherwise(0.0).alias("uniqueness"),
        repeated.alias("duplicate_rows"),
        rows.alias("total_rows"),
    )


def conformance(tested: bool = False) -> Column:
    """Share of a column's values that carry a real value of its type.

    Numeric columns conform fully and columns without values not at all. For
    text the score is the best of the numeric-parse, date-parse and
    clean-value rates. No default sentinel parses as a number or a date, so
    with those the clean-value rate is always that best; ``tested`` takes all
    three rates into account, for sentinels that do parse.
    """
    held = F.col("n_rows") - F.col("n_nulls")
    clean = ratio(F.col("n_clean"), held)
    best = F.greatest(clean, F.col("numeric_rate"), F.col("date_rate")) if tested else clean
    return F.when(F.col("is_numeric"), 1.0).when(held == 0, 0.0).otherwise(best)


def consistency_from(
    stats: DataFrame,
    keys: DataFrame,
    parse_threshold: float = PARSE_THRESHOLD,
    rates: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Consistency from column statistics; ``rates`` adds the parse rates."""
    if rates is not None:
        tested = rates.select("dataset_id", "col_idx", "numeric_rate", "date_rate")
        stats = stats.join(tested, ["dataset_id", "col_idx"])
    columns = stats.withColumn("conformance", conformance(rates is not None)).select(
        "dataset_id",
        "col_idx",
        "col_name",
        "conformance",
        (F.col("conformance") >= F.lit(parse_threshold)).alias("passes"),
    )
    share = columns.groupBy("dataset_id").agg(
        F.avg(F.col("passes").cast("double")).alias("consistency")
    )
    datasets = keys.join(share, "dataset_id", "left").select(
        "dataset_id", F.coalesce("consistency", F.lit(0.0)).alias("consistency")
    )
    return datasets, columns


def consistency(
    df: DataFrame,
    by: str | None = None,
    columns: list[str] | None = None,
    keys: DataFrame | None = None,
    *,
    parse_threshold: float = PARSE_THRESHOLD,
    sentinels: list[str] = SENTINELS,
) -> tuple[DataFrame, DataFrame]:
    """Share of columns whose conformance reaches the threshold; 0.0 when empty."""
    keys = dataset_keys(df, by, keys)
    stats = column_stats(df, by, columns, sentinels=sentinels)
    own = set(sentinels) - set(SENTINELS)
    rates = parse_rates(df, by, columns, sentinels=sentinels) if own else None
    return consistency_from(stats, keys, parse_threshold, rates)


def parse_rates(
    df: DataFrame,
    by: str | None = None,
    columns: list[str] | None = None,
    *,
    sentinels: list[str] = SENTINELS,
) -> DataFrame:
    """Numeric-parse, date-parse and clean-value rate of every column.

    A rate over no values is 1.0 for the two parse rates and 0.0 for the
    clean-value rate. The cells are tested in long form, one expression for
    all columns, and merged on the map side.
    """
    fields = measured_columns(df, by, columns)
    typed = [i for i, (_, kind) in enumerate(fields) if is_numeric_type(kind)]
    text = F.col("text")
    numeric = F.col("col_idx").isin(typed) if typed else F.lit(False)
    tested = (
        long_cells(df, by, [name for name, _ in fields])
        .groupBy("dataset_id", "col_idx")
        .agg(
            F.avg((numeric | numeric_like(text)).cast("double")).alias("numeric_rate"),
            F.avg(date_like(text).cast("double")).alias("date_rate"),
            F.avg((numeric | ~is_sentinel(text, sentinels)).cast("double")).alias("clean_rate"),
        )
    )
    return (
        column_stats(df, by, columns, clean=False)
        .select("dataset_id", "col_idx", "col_name")
        .join(tested, ["dataset_id", "col_idx"], "left")
        .fillna({"numeric_rate": 1.0, "date_rate": 1.0, "clean_rate": 0.0})
    )


def last_updates(df: DataFrame, timestamp: str, by: str | None = None) -> DataFrame:
    """Newest timestamp per dataset, the update proxy for tables."""
    return df.groupBy(dataset_key(by)).agg(F.max(f"`{timestamp}`").alias("last_update"))


def timeliness(
    updates: DataFrame,
    audit_date: str | Column,
    frequency_days: int | Column | None = None,
) -> DataFrame:
    """Freshness of ``updates`` (dataset_id, last_update) at the audit date.

    Lags count elapsed whole days. No update date scores 0.0 and is stale.
    """
    audit = audit_date if isinstance(audit_date, Column) else F.lit(audit_date).cast("timestamp")
    period = frequency_days
    if period is not None and not isinstance(period, Column):
        period = F.lit(period)
    lag = days_behind(F.col("last_update"), audit)
    known = F.coalesce(period, F.lit(365)) if period is not None else F.lit(365)
    return updates.select(
        "dataset_id",
        freshness(lag, period).alias("timeliness"),
        lag.alias("days_lag"),
        F.when(lag.isNotNull(), known).cast("long").alias("stated_frequency_days"),
        F.coalesce(lag > 2 * known, F.lit(True)).alias("stale"),
    )
