"""Scores against a table of compliance specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.defaults import DIMENSIONS, SPECIFICATIONS, VERDICT_WINDOW
from plumbline.functions.scoring import ratio, verdict


def specifications(spark: SparkSession, rows: list[tuple] = SPECIFICATIONS) -> DataFrame:
    """The specification table; ids are text, so 3.13 sorts before 3.2."""
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)], schemas.SPECIFICATIONS
    )


def gap_report(
    scores: DataFrame, specs: DataFrame | None = None, window: float = VERDICT_WINDOW
) -> DataFrame:
    """One record per dataset and specification, with value and verdict.

    Without ``specs`` the built-in handful of rows is broadcast; a table of
    the caller's is left to the planner, which checks its size.
    """
    if specs is None:
        specs = F.broadcast(specifications(scores.sparkSession))
    values = scores.select(
        "dataset_id", "sector", *[F.col(d).cast("double") for d in DIMENSIONS]
    ).unpivot(["dataset_id", "sector"], DIMENSIONS, "dimension", "value")
    return values.join(specs, "dimension").select(
        "dataset_id",
        "sector",
        "spec_order",
        "specification",
        "ndmo_name",
        "dimension",
        "value",
        "threshold",
        verdict(F.col("value"), F.col("threshold"), window).alias("verdict"),
    )


def sector_verdicts(gaps: DataFrame) -> DataFrame:
    """Majority verdict, count and pass share per specification and sector.

    Only datasets with a verdict count. Ties go to pass, then to fail.
    """
    counts = gaps.groupBy("spec_order", "specification", "ndmo_name", "sector").agg(
        F.count_if(F.col("verdict") != "n/a").alias("n"),
        F.count_if(F.col("verdict") == "pass").alias("n_pass"),
        F.count_if(F.col("verdict") == "fail").alias("n_fail"),
        F.count_if(F.col("verdict") == "borderline").alias("n_borderline"),
    )
    passed, failed, close = F.col("n_pass"), F.col("n_fail"), F.col("n_borderline")
    majority = (
        F.when(F.col("n") == 0, "n/a")
        .when((passed >= failed) & (passed >= close), "pass")
        .when(failed >= close, "fail")
        .otherwise("borderline")
    )
    return counts.select(
        "spec_order",
        "specification",
        "ndmo_name",
        "sector",
        majority.alias("majority"),
        "n",
        F.bround(100 * ratio(passed, F.col("n"), None), 1).alias("pct_pass"),
    )


def sector_matrix(gaps: DataFrame, sectors: list[str] | None = None) -> DataFrame:
    """The verdicts laid out wide: per sector ``s`` the columns s, s_n, s_pct_pass.

    Rows follow the specification table; sectors are in name order.
    """
    long = sector_verdicts(gaps)
    if sectors is None:
        sectors = sorted(r["sector"] for r in gaps.select("sector").distinct().collect())
    wide = (
        long.groupBy("spec_order", "specification", F.col("ndmo_name").alias("name"))
        .pivot("sector", sectors)
        .agg(
            F.first("majority").alias("majority"),
            F.first("n").alias("n"),
            F.first("pct_pass").alias("pct_pass"),
        )
    )
    columns = []
    for s in sectors:
        columns.append(F.coalesce(F.col(f"`{s}_majority`"), F.lit("n/a")).alias(s))
        columns.append(F.coalesce(F.col(f"`{s}_n`"), F.lit(0)).cast("long").alias(f"{s}_n"))
        columns.append(F.col(f"`{s}_pct_pass`").alias(f"{s}_pct_pass"))
    return wide.orderBy("spec_order").select("specification", "name", *columns)


def gap_register(gaps: DataFrame) -> DataFrame:
    """Every failing or borderline record, by verdict, sector and specification."""
    return (
        gaps.where(F.col("verdict").isin("fail", "borderline"))
        .orderBy("verdict", "sector", "specification", "dataset_id")
        .select(
            "dataset_id",
            "sector",
            "specification",
            "ndmo_name",
            "dimension",
            F.col("value").alias("observed"),
            "threshold",
            "verdict",
        )
    )
