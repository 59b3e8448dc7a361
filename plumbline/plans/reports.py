"""Report tables: the queries behind charts and pages, without drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.defaults import BANDS, CONTAMINATIONS, DIMENSIONS, VERDICT_WINDOW
from plumbline.functions.scoring import (
    traffic_light,
    truthy,
    verdict,
    verdict_weight,
)
from plumbline.plans.portfolio import headline_measures

# The published portfolio indicators with their thresholds and
# specifications (KPI, measure, threshold, at least or at most, specification).
# Measures ending in _share are counts over datasets; the distribution of bands
# has a row per band.
PORTFOLIO_KPIS = [
    ("Datasets audited", "n_datasets", None, None, None),
    ("Total rows ingested", "portfolio_total_rows", None, None, None),
    ("Total cells inspected", "portfolio_total_cells", None, None, None),
    ("Portfolio completeness (cells-weighted)", "portfolio_completeness_aggregate", 0.95, "min", "3.2"),
    ("Mean per-dataset completeness", "mean_per_dataset_completeness", 0.95, "min", "3.2"),
    ("Datasets meeting 95% completeness", "completeness_share", 0.95, "min", "3.2"),
    ("Mean per-dataset consistency", "mean_per_dataset_consistency", 0.95, "min", "3.4"),
    ("Datasets meeting 95% consistency", "consistency_share", 0.90, "min", "3.4"),
    ("Mean per-dataset uniqueness", "mean_per_dataset_uniqueness", 0.99, "min", "3.13"),
    ("Datasets with < 1% duplicates", "uniqueness_share", 0.95, "min", "3.13"),
    ("Mean IF anomaly rate", "mean_if_anomaly_rate", 0.05, "max", "3.1"),
    ("Mean Cohen’s κ (IF vs DBSCAN)", "mean_if_dbscan_kappa", None, None, None),
    ("Portfolio DRL distribution (Band A)", "band_a_share", None, None, None),
    ("Portfolio DRL distribution (Band B)", "band_b_share", None, None, None),
    ("Portfolio DRL distribution (Band C)", "band_c_share", None, None, None),
]

BOX_DIMENSIONS = ["completeness", "consistency", "uniqueness", "if_anomaly_rate"]


# Sorted views -------------------------------------------------------------


def by_completeness(scores: DataFrame) -> DataFrame:
    return scores.select("dataset_id", "sector", "completeness").orderBy(
        F.desc_nulls_last("completeness"), "dataset_id"
    )


def by_anomaly_rate(scores: DataFrame) -> DataFrame:
    """Datasets the forest applied to, most anomalous first."""
    return (
        scores.where(truthy(F.col("if_applicable")) & F.col("if_anomaly_rate").isNotNull())
        .select("dataset_id", "sector", "if_anomaly_rate", "db_noise_rate")
        .orderBy(F.desc("if_anomaly_rate"), "dataset_id")
    )


def by_composite(scores: DataFrame) -> DataFrame:
    return scores.select("dataset_id", "sector", "full_composite", "drl_band").orderBy(
        F.desc_nulls_last("full_composite"), "dataset_id"
    )


def by_kappa(agreement: DataFrame) -> DataFrame:
    """Datasets by agreement of the detectors, undefined ones last."""
    return agreement.select("dataset_id", "sector", "kappa", "jaccard").orderBy(
        F.desc_nulls_last("kappa"), "dataset_id"
    )


def worst(scores: DataFrame, dimension: str, n: int = 5) -> DataFrame:
    """The n lowest datasets on one dimension."""
    return (
        scores.where(F.col(dimension).isNotNull())
        .select("dataset_id", "sector", F.col(dimension).alias("value"))
        .orderBy("value", "dataset_id")
        .limit(n)
    )


def sector_bands(scores: DataFrame) -> DataFrame:
    return scores.select("sector", "drl_band").distinct()


def sectors(scores: DataFrame) -> DataFrame:
    return scores.select("sector").distinct()


# Portfolio ----------------------------------------------------------------


def hierarchy(scores: DataFrame, root: str = "Portfolio") -> DataFrame:
    """Composite totals for portfolio → sector → sector and band → dataset."""
    level = F.grouping_id()
    band_node = F.concat("sector", F.lit(" // "), "drl_band")
    rolled = scores.rollup("sector", "drl_band", "dataset_id").agg(
        level.alias("level"), F.sum("full_composite").alias("total")
    )
    at = F.col("level")
    return rolled.select(
        F.when(at == 7, root)
        .when(at == 3, F.col("sector"))
        .when(at == 1, band_node)
        .otherwise(F.col("dataset_id"))
        .alias("id"),
        F.when(at == 7, root)
        .when(at == 3, F.col("sector"))
        .when(at == 1, F.col("drl_band"))
        .otherwise(F.col("dataset_id"))
        .alias("label"),
        F.when(at == 7, "")
        .when(at == 3, root)
        .when(at == 1, F.col("sector"))
        .otherwise(band_node)
        .alias("parent"),
        "total",
    )


def sector_radar(scores: DataFrame) -> DataFrame:
    """Mean of every dimension per sector, 0 where a sector has none."""
    return scores.groupBy("sector").agg(
        *[F.coalesce(F.avg(d), F.lit(0.0)).alias(d) for d in DIMENSIONS]
    )


def box_statistics(scores: DataFrame, dimensions: list[str] = BOX_DIMENSIONS) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers and outlier counts per sector and dimension."""
    values = (
        scores.select("sector", *[F.col(d).cast("double") for d in dimensions])
        .unpivot(["sector"], dimensions, "dimension", "value")
        .where("value is not null")
    )
    quartiles = (
        values.groupBy("sector", "dimension")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        )
        .select(
            "sector",
            "dimension",
            "n",
            F.col("q")[0].alias("q1"),
            F.col("q")[1].alias("median"),
            F.col("q")[2].alias("q3"),
        )
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        values.join(quartiles, ["sector", "dimension"])
        .groupBy("sector", "dimension", "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def histogram(table: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width counts over min..max, empty bins included, last bin closed.

    A constant column is centred in a range of width 1. Nulls and NaN are
    missing; infinities fit no bin of finite width and are left out.
    """
    finite = F.lit(float("inf"))
    values = table.select(F.col(column).cast("double").alias("value")).where(
        ~F.isnan("value") & (F.abs("value") < finite)
    )
    low, high = F.min("value"), F.max("value")
    flat = low == high
    edges = values.agg(
        F.when(flat, low - 0.5).otherwise(low).alias("low"),
        F.when(flat, high + 0.5).otherwise(high).alias("high"),
    ).withColumn("_one", F.lit(1))
    bucket = F.least(
        F.floor((F.col("value") - F.col("low")) * bins / (F.col("high") - F.col("low"))),
        F.lit(bins - 1),
    )
    counts = (
        values.withColumn("_one", F.lit(1))
        .join(F.broadcast(edges), "_one")
        .groupBy(bucket.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("high") - F.col("low")) / bins
    return (
        edges.where("low is not null")
        .select(
            F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
            width.alias("width"),
            "low",
        )
        .join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("left_edge"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("right_edge"),
            F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        )
    )


def kpi_table(
    scores: DataFrame,
    agreement: DataFrame | None = None,
    kpis: list[tuple] = PORTFOLIO_KPIS,
    window: float = VERDICT_WINDOW,
) -> DataFrame:
    """Portfolio indicators in long form; a verdict only where a threshold is set.

    An indicator bounded from above is judged by its mirror image. Without an
    ``agreement`` table of the detectors their mean kappa is null.
    """
    n = F.col("n_datasets")
    measures = headline_measures(scores).withColumns(
        {
            "completeness_share": F.col("datasets_meeting_95pct_completeness") / n,
            "consistency_share": F.col("datasets_meeting_95pct_consistency") / n,
            "uniqueness_share": F.col("datasets_lt_1pct_duplicates") / n,
            "_one": F.lit(1),
        }
    )
    bands = scores.agg(
        *[
            F.avg((F.col("drl_band") == band).cast("double")).alias(
                f"{band.lower().replace(' ', '_')}_share"
            )
            for band in BANDS
        ]
    ).withColumn("_one", F.lit(1))
    if agreement is None:
        measures = measures.withColumn("mean_if_dbscan_kappa", F.lit(None).cast("double"))
    else:
        kappa = agreement.agg(F.avg("kappa").alias("mean_if_dbscan_kappa"), F.lit(1).alias("_one"))
        measures = measures.join(kappa, "_one")
    entries = [
        F.struct(
            F.lit(kpi).alias("kpi"),
            F.col(field).cast("double").alias("value"),
            F.lit(threshold).cast("double").alias("threshold"),
            F.lit(bound).cast("string").alias("bound"),
            F.lit(spec).cast("string").alias("specification"),
        )
        for kpi, field, threshold, bound, spec in kpis
    ]
    sign = F.when(F.col("bound") == "max", -1.0).otherwise(1.0)
    judged = F.when(F.col("threshold").isNull(), "n/a").otherwise(
        verdict(F.col("value") * sign, F.col("threshold") * sign, window)
    )
    return (
        measures.join(bands, "_one")
        .select(F.inline(F.array(*entries)))
        .withColumn("verdict", judged)
    )


# Status colours -----------------------------------------------------------


def sector_status(summary: DataFrame) -> DataFrame:
    """Green, amber or red of the three inherent dimensions per sector."""
    cuts = [("completeness", 0.95), ("consistency", 0.95), ("uniqueness", 0.99)]
    entries = [
        F.struct(
            F.lit(name).alias("dimension"),
            F.col(f"{name}_mean").alias("value"),
            traffic_light(F.col(f"{name}_mean"), cut, cut - 0.05).alias("status"),
        )
        for name, cut in cuts
    ]
    return summary.select("sector", "n", F.inline(F.array(*entries)))


def _rounded_text(form: str, value: Column, digits: int, *more: Column) -> Column:
    """``value`` in print form, ties going to the even digit."""
    return F.format_string(form, F.bround(value, digits), *more)


def _percent(value: Column) -> Column:
    return F.coalesce(_rounded_text("%.1f%%", value * 100, 1), F.lit("N/A"))


def dataset_status(scores: DataFrame) -> DataFrame:
    """Value, text and colour of every dimension per dataset; missing is red."""
    long = scores.select("dataset_id", *[F.col(d).cast("double") for d in DIMENSIONS]).unpivot(
        ["dataset_id"], DIMENSIONS, "dimension", "value"
    )
    value = F.col("value")
    return long.select(
        "dataset_id",
        "dimension",
        F.coalesce(value, F.lit(0.0)).alias("plotted"),
        F.when(value.isNull(), "N/A").otherwise(_percent(value)).alias("text"),
        traffic_light(value, 0.95, 0.80).alias("status"),
    )


def kappa_status(agreement: DataFrame) -> DataFrame:
    return (
        agreement.where("kappa is not null")
        .select(
            "dataset_id",
            "kappa",
            _rounded_text("%.3f", F.col("kappa"), 3).alias("text"),
            traffic_light(F.col("kappa"), 0.6, 0.4).alias("status"),
        )
        .orderBy(F.desc("kappa"), "dataset_id")
    )


def stability_status(stability: DataFrame) -> DataFrame:
    return stability.select(
        "contamination",
        "spearman",
        traffic_light(F.col("spearman"), 0.9, 0.7).alias("status"),
    )


# Compliance ---------------------------------------------------------------


def compliance_grid(verdicts: DataFrame) -> DataFrame:
    """Pass share and cell label per specification and sector; 0 and n/a when empty."""
    share = F.col("pct_pass")
    text = _rounded_text("%.0f%%\n(n=%d)", share, 0, F.col("n").cast("int"))
    return verdicts.select(
        "specification",
        "sector",
        F.coalesce(share, F.lit(0.0)).alias("pct_pass"),
        F.when(share.isNull(), "n/a").otherwise(text).alias("label"),
    )


def compliance_heat(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        "specification", "sector", "majority", verdict_weight(F.col("majority")).alias("heat")
    )


# Detectors ----------------------------------------------------------------


def sweep_pivot(sweep: DataFrame, contaminations: list[float] = CONTAMINATIONS) -> DataFrame:
    """Anomaly rate in per cent, one row per dataset, one column per contamination."""
    wide = (
        sweep.where("applicable")
        .groupBy("dataset_id")
        .pivot("contamination", [float(c) for c in contaminations])
        .agg(F.first("anomaly_rate") * 100)
    )
    names = [f"c_{str(float(c)).replace('.', '_')}" for c in contaminations]
    return wide.toDF("dataset_id", *names)


def sweep_means(sweep: DataFrame) -> DataFrame:
    return sweep.groupBy("contamination").agg(F.avg("anomaly_rate").alias("mean_rate"))


def agreement_register(agreement: DataFrame) -> DataFrame:
    return agreement.select(
        "dataset_id",
        "sector",
        "kappa",
        "jaccard",
        "if_anom_count",
        "dbscan_noise_count",
        "overlap",
        "kappa_interp",
    ).orderBy(F.desc_nulls_last("kappa"), "dataset_id")


def agreement_points(agreement: DataFrame) -> DataFrame:
    return agreement.select("dataset_id", "sector", "kappa", "jaccard").dropna(
        subset=["kappa", "jaccard"]
    )


# Inspector ----------------------------------------------------------------


def inspect(
    scores: DataFrame, dataset_id: str, agreement: DataFrame | None = None
) -> DataFrame:
    """One dataset's record with its status per dimension as a map."""
    record = scores.where(F.col("dataset_id") == dataset_id)
    status = dataset_status(record).groupBy("dataset_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("dimension", F.struct("plotted", "text", "status")))
        ).alias("dimensions")
    )
    joined = record.join(status, "dataset_id").withColumn(
        "shape", F.format_string("%,d × %d", "rows", "cols")
    )
    if agreement is not None:
        joined = joined.join(
            agreement.select("dataset_id", "kappa", "jaccard", "kappa_interp"),
            "dataset_id",
            "left",
        )
    return joined.withColumn("shows_anomalies", truthy(F.col("if_applicable")))


# Clustering ---------------------------------------------------------------


def selection_series(meta: DataFrame) -> DataFrame:
    """(k, inertia, silhouette) of every candidate cluster count."""
    return meta.select(F.inline("candidates"))


def centroid_matrix(meta: DataFrame) -> DataFrame:
    """(cluster, feature, value) of the selected partition's centroids."""
    return (
        meta.select("feature_names", F.posexplode("centroids").alias("cluster", "centroid"))
        .select("cluster", F.arrays_zip("feature_names", "centroid").alias("pairs"))
        .select("cluster", F.inline("pairs"))
        .select("cluster", F.col("feature_names").alias("feature"), F.col("centroid").alias("value"))
    )
