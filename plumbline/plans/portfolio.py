"""Portfolio aggregates and sensitivity analyses over dataset scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.defaults import (
    AUDIT_DATE,
    BAND_CUTS,
    BAND_SPECIFICATIONS,
    BANDS,
    DIMENSIONS,
    INHERENT_DIMENSIONS,
)
from plumbline.functions.scoring import present_mean, ratio, readiness_band, weighted_mean


def composites(
    scores: DataFrame,
    weights: dict[str, float] | None = None,
    cuts: tuple[float, float] = BAND_CUTS,
) -> DataFrame:
    """Add the three-dimension and full composites and the readiness band."""
    full = weighted_mean({d: F.col(d) for d in DIMENSIONS}, weights)
    inherent = weighted_mean({d: F.col(d) for d in INHERENT_DIMENSIONS}, weights)
    return scores.withColumns(
        {"three_dim_composite": inherent, "full_composite": full}
    ).withColumn("drl_band", readiness_band(F.col("full_composite"), cuts))


def portfolio_completeness(scores: DataFrame) -> DataFrame:
    """Completeness over all cells of the portfolio; 0 without cells."""
    return scores.agg(
        F.sum("total_cells").alias("portfolio_total_cells"),
        F.sum("n_nulls").alias("portfolio_nulls"),
        _cell_completeness().alias("portfolio_completeness_aggregate"),
    )


def _cell_completeness() -> Column:
    cells = F.sum("total_cells")
    return F.when(cells > 0, 1 - ratio(F.sum("n_nulls"), cells)).otherwise(0.0)


def headline_measures(scores: DataFrame) -> DataFrame:
    """The scalar portfolio indicators, one row."""
    return scores.agg(
        F.count(F.lit(1)).alias("n_datasets"),
        F.sum("rows").alias("portfolio_total_rows"),
        F.sum("total_cells").alias("portfolio_total_cells"),
        _cell_completeness().alias("portfolio_completeness_aggregate"),
        F.avg("completeness").alias("mean_per_dataset_completeness"),
        F.stddev_samp("completeness").alias("sd_per_dataset_completeness"),
        F.count_if(F.col("completeness") >= F.lit(0.95)).alias(
            "datasets_meeting_95pct_completeness"
        ),
        F.avg("consistency").alias("mean_per_dataset_consistency"),
        F.stddev_samp("consistency").alias("sd_per_dataset_consistency"),
        F.count_if(F.col("consistency") >= F.lit(0.95)).alias(
            "datasets_meeting_95pct_consistency"
        ),
        F.avg("uniqueness").alias("mean_per_dataset_uniqueness"),
        F.count_if(F.col("uniqueness") >= F.lit(0.99)).alias("datasets_lt_1pct_duplicates"),
        F.count_if("if_applicable").alias("if_applicable_count"),
        F.avg("if_anomaly_rate").alias("mean_if_anomaly_rate"),
        F.count_if("db_applicable").alias("db_applicable_count"),
        F.avg("db_noise_rate").alias("mean_db_noise_rate"),
    )


def band_distribution(scores: DataFrame) -> DataFrame:
    """Datasets per band, most frequent first."""
    return (
        scores.groupBy("drl_band")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "drl_band")
    )


def headline(
    scores: DataFrame,
    *,
    agreement_means: DataFrame | None = None,
    stability: DataFrame | None = None,
    audit_date: str = AUDIT_DATE,
) -> DataFrame:
    """Everything a summary page needs in one row, nested parts as maps and arrays."""
    sensitivity = band_sensitivity(scores)
    summary = sector_summary(scores)
    fields = [c for c in summary.columns if c != "sector"]
    parts = [
        headline_measures(scores).withColumn("audit_date", F.lit(audit_date)),
        _as_map(band_distribution(scores), "drl_band", "n", "drl_band_distribution"),
        sensitivity.agg(
            F.array_sort(F.collect_list(F.struct(*sensitivity.columns))).alias("band_sensitivity"),
            F.array(F.min("pct_band_a"), F.max("pct_band_a")).alias("band_a_share_range_pct"),
        ),
        _as_map(
            summary.select("sector", F.struct(*fields).alias("measures")),
            "sector",
            "measures",
            "sector_summary",
        ),
    ]
    if stability is not None:
        parts.append(
            _as_map(
                stability.withColumn("contamination", F.col("contamination").cast("string")),
                "contamination",
                "spearman",
                "if_sweep_spearman",
            )
        )
    if agreement_means is not None:
        parts.append(agreement_means)
    keyed = [part.withColumn("_one", F.lit(1)) for part in parts]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def _as_map(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Fold a table with one row per sector, band or level into one map."""
    return table.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def _specification_scores(
    specs: list[tuple[str, list[str] | None]] = BAND_SPECIFICATIONS,
) -> list[tuple[str, str, Column]]:
    """(name, dimensions text, score) of each dimension set."""
    return [
        (name, "available", F.col("full_composite"))
        if dims is None
        else (name, "+".join(dims), present_mean([F.col(d) for d in dims]))
        for name, dims in specs
    ]


def band_sensitivity(
    scores: DataFrame, specs: list[tuple[str, list[str] | None]] = BAND_SPECIFICATIONS
) -> DataFrame:
    """Band counts under each dimension set, from one pass over the scores."""
    entries = [
        F.struct(
            F.lit(name).alias("specification"),
            F.lit(dims).alias("dimensions"),
            readiness_band(score).alias("band"),
        )
        for name, dims, score in _specification_scores(specs)
    ]
    n = F.count(F.lit(1))
    return (
        scores.select(F.inline(F.array(*entries)))
        .groupBy("specification", "dimensions")
        .agg(
            n.alias("n"),
            *[
                F.count_if(F.col("band") == band).alias(band.lower().replace(" ", "_"))
                for band in BANDS
            ],
            F.bround(100 * F.count_if(F.col("band") == BANDS[0]) / n, 1).alias("pct_band_a"),
        )
    )


def band_sensitivity_per_dataset(
    scores: DataFrame, specs: list[tuple[str, list[str] | None]] = BAND_SPECIFICATIONS
) -> DataFrame:
    """Score and band of every dataset under each dimension set, side by side."""
    columns = []
    for name, _, score in _specification_scores(specs):
        columns.append(F.bround(score, 4).alias(f"score_{name}"))
        columns.append(readiness_band(score).alias(f"band_{name}"))
    return scores.select("dataset_id", "sector", *DIMENSIONS, "full_composite", *columns)


def band_share_interval(sensitivity: DataFrame) -> DataFrame:
    """Lowest and highest share of the top band over the dimension sets."""
    return sensitivity.agg(
        F.min("pct_band_a").alias("band_a_min_pct"), F.max("pct_band_a").alias("band_a_max_pct")
    )


def sector_summary(scores: DataFrame) -> DataFrame:
    """Size and score statistics per sector, rounded half-even to 4 digits."""
    measures = {
        "completeness_mean": F.avg("completeness"),
        "completeness_sd": F.stddev_samp("completeness"),
        "completeness_min": F.min("completeness"),
        "completeness_max": F.max("completeness"),
        "consistency_mean": F.avg("consistency"),
        "consistency_sd": F.stddev_samp("consistency"),
        "uniqueness_mean": F.avg("uniqueness"),
        "if_anomaly_mean": F.avg("if_anomaly_rate"),
    }
    return (
        scores.groupBy("sector")
        .agg(
            F.count("dataset_id").alias("n"),
            *[F.bround(value, 4).alias(name) for name, value in measures.items()],
        )
        .orderBy("sector")
    )


def sector_dimension_table(
    scores: DataFrame, dimension: str, threshold: float = 0.95
) -> DataFrame:
    """Statistics of one dimension per sector, closed by a portfolio row."""
    value = F.col(dimension)
    reached = F.count_if(value >= F.lit(float(threshold)))
    return (
        scores.rollup("sector")
        .agg(
            F.grouping("sector").alias("is_total"),
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("sd"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            (100 * ratio(reached, F.count(F.lit(1)), None)).alias("pct_meeting"),
        )
        .withColumn(
            "sector", F.when(F.col("is_total") == 1, "Portfolio").otherwise(F.col("sector"))
        )
        .orderBy("is_total", "sector")
        .drop("is_total")
    )
