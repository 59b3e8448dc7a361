"""The standardised numeric matrix the anomaly models work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.defaults import MIN_ROWS
from plumbline.functions.cells import is_feature_type, present
from plumbline.operators.profile import dataset_key, measured_columns
from plumbline.operators.quantiles import exact_percentiles
from plumbline.session import settle


def feature_rows(
    df: DataFrame, row_id: str, by: str | None = None, columns: list[str] | None = None
) -> DataFrame:
    """(dataset_id, row_id, features) of the numeric columns, NaN as null."""
    fields = [f for f in measured_columns(df, by, columns) if is_feature_type(f[1])]
    values = [present(F.col(f"`{name}`"), kind).cast("double") for name, kind in fields]
    return df.select(
        dataset_key(by),
        F.col(f"`{row_id}`").cast("string").alias("row_id"),
        F.array(*values).cast("array<double>").alias("features"),
    )


def standardise(
    rows: DataFrame,
    width: int,
    *,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Impute, drop and z-score all feature rows.

    Medians fill nulls before rows with infinities are dropped, so infinities
    take part in the median, and a column without any value empties the whole
    matrix. Datasets with fewer than ``min_rows`` rows, before or after the
    drop, or without features have no rows in the result. Medians are exact
    for datasets of any size. The statistics are small written tables, so the
    planner knows that rows need not move to meet them.
    """
    finite = F.lit(float("inf"))
    at = [F.get(F.col("features"), F.lit(i)) for i in range(width)]
    rows = settle(rows.where(F.size("features") > 0), "feature-rows")
    sizes = rows.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("features")).alias("n_axes")
    )
    axes = rows.select("dataset_id", F.posexplode("features").alias("axis", "x"))
    middle = (
        exact_percentiles(axes, ["dataset_id", "axis"], [0.5])
        .groupBy("dataset_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("axis", F.col("percentiles")[0]))).alias("by_axis"))
    )
    medians = settle(
        sizes.where(F.col("n_rows") >= min_rows)
        .join(middle, "dataset_id", "left")
        .select(
            "dataset_id",
            F.transform(
                F.sequence(F.lit(0), F.col("n_axes") - 1), lambda i: F.try_element_at("by_axis", i)
            ).alias("medians"),
        ),
        "medians",
    )
    filled = (
        rows.join(medians, "dataset_id")
        .select(
            "dataset_id",
            "row_id",
            F.zip_with(
                "features",
                F.slice("medians", F.lit(1), F.size("features")),
                lambda x, m: F.coalesce(x, m),
            ).alias("features"),
        )
        .where(
            F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < finite))
        )
    )
    moments = settle(
        filled.groupBy("dataset_id")
        .agg(
            F.count(F.lit(1)).alias("n_records"),
            F.array(*[F.avg(x) for x in at]).alias("means"),
            F.array(*[F.stddev_pop(x) for x in at]).alias("spreads"),
        )
        .where(F.col("n_records") >= min_rows),
        "moments",
    )
    centred = F.zip_with(
        "features", F.slice("means", F.lit(1), F.size("features")), lambda x, m: x - m
    )
    scaled = F.zip_with(
        centred,
        F.slice("spreads", F.lit(1), F.size("features")),
        lambda x, s: x / F.when(s == 0, 1.0).otherwise(s),
    )
    return filled.join(moments, "dataset_id").select(
        "dataset_id",
        "row_id",
        scaled.alias("features"),
        "n_records",
        F.size("features").alias("n_features"),
    )


def numeric_matrix(
    df: DataFrame,
    row_id: str,
    by: str | None = None,
    columns: list[str] | None = None,
    *,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Standardised numeric matrix of every dataset, one row per kept record.

    ``row_id`` must be unique per dataset and stable across runs: it carries
    the row identity and decides which rows the forest's trees draw.
    """
    fields = [f for f in measured_columns(df, by, columns) if is_feature_type(f[1])]
    rows = feature_rows(df, row_id, by, columns)
    return standardise(rows, max(len(fields), 1), min_rows=min_rows)
