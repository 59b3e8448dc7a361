"""Published portfolio results, recomputed from the golden score rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clustering
from plumbline.plans import compliance, portfolio, reports
from tests.golden import golden_scores


@pytest.fixture(scope="module")
def scores(spark):
    return golden_scores(spark).persist()


@pytest.fixture(scope="module")
def clusters(scores):
    return clustering.quality_clusters(scores)


def near(value):
    return pytest.approx(value, abs=1e-12)


def test_headline(scores):
    row = portfolio.headline_measures(scores).first()
    assert (row.n_datasets, row.portfolio_total_rows, row.portfolio_total_cells) == (
        31,
        56758,
        670726,
    )
    assert row.portfolio_completeness_aggregate == near(0.9063566940896879)
    assert row.mean_per_dataset_completeness == near(0.9048295507079641)
    assert row.sd_per_dataset_completeness == near(0.22415457037962358)
    assert row.datasets_meeting_95pct_completeness == 23
    assert row.mean_per_dataset_consistency == near(0.8865591397849463)
    assert row.sd_per_dataset_consistency == near(0.2877891253073355)
    assert row.datasets_meeting_95pct_consistency == 26
    assert row.mean_per_dataset_uniqueness == near(0.9640863702583468)
    assert row.datasets_lt_1pct_duplicates == 29
    assert (row.if_applicable_count, row.db_applicable_count) == (14, 14)
    assert row.mean_if_anomaly_rate == near(0.0495198711399031)
    assert row.mean_db_noise_rate == near(0.05095515343709572)


def test_nested_headline(scores):
    row = portfolio.headline(scores).first()
    assert row.drl_band_distribution == {"Band A": 27, "Band B": 3, "Band C": 1}
    assert row.band_a_share_range_pct == [80.6, 87.1]
    assert row.sector_summary["Health"]["completeness_sd"] == 0.3427


def test_band_sensitivity(scores):
    got = {r.specification: tuple(r)[3:] for r in portfolio.band_sensitivity(scores).collect()}
    assert got == {
        "as_reported_available_dims": (27, 3, 1, 87.1),
        "completeness_consistency": (25, 2, 4, 80.6),
        "completeness_consistency_uniqueness": (26, 3, 2, 83.9),
        "excl_timeliness_incl_accuracy": (26, 3, 2, 83.9),
    }


def test_sector_summary(scores):
    got = [tuple(r) for r in portfolio.sector_summary(scores).collect()]
    assert got == [
        ("Education", 6, 0.9582, 0.102, 0.75, 1.0, 1.0, 0.0, 1.0, 0.0422),
        ("Energy", 3, 0.9973, 0.0047, 0.9918, 1.0, 1.0, 0.0, 1.0, 0.0502),
        ("Health", 9, 0.8303, 0.3427, 0.0, 1.0, 0.8889, 0.3333, 0.8889, 0.0625),
        ("Investment", 13, 0.9105, 0.1876, 0.3434, 1.0, 0.8064, 0.3411, 0.9913, 0.0538),
    ]


def test_sector_dimension_table(scores):
    rows = portfolio.sector_dimension_table(scores, "completeness").collect()
    assert rows[-1].sector == "Portfolio" and rows[-1].n == 31
    assert round(rows[-1].pct_meeting, 1) == 74.2
    assert [round(r.pct_meeting, 1) for r in rows[:-1]] == [83.3, 100.0, 66.7, 69.2]


def test_sector_matrix(scores):
    matrix = compliance.sector_matrix(compliance.gap_report(scores))
    assert matrix.columns[:5] == [
        "specification",
        "name",
        "Education",
        "Education_n",
        "Education_pct_pass",
    ]
    got = [tuple(r) for r in matrix.collect()]
    assert got == [
        ("3.1", "Accuracy", "borderline", 5, 20.0, "borderline", 3, 0.0)
        + ("borderline", 1, 0.0, "borderline", 5, 20.0),
        ("3.2", "Completeness", "pass", 6, 83.3, "pass", 3, 100.0)
        + ("pass", 9, 66.7, "pass", 13, 69.2),
        ("3.4", "Consistency", "pass", 6, 100.0, "pass", 3, 100.0)
        + ("pass", 9, 88.9, "pass", 13, 69.2),
        ("3.5", "Validity", "pass", 6, 100.0, "pass", 3, 100.0)
        + ("pass", 9, 88.9, "pass", 13, 69.2),
        ("3.7", "Currency / Timeliness", "pass", 6, 100.0, "pass", 3, 100.0)
        + ("pass", 9, 100.0, "pass", 13, 100.0),
        ("3.13", "Uniqueness", "pass", 6, 100.0, "pass", 3, 100.0)
        + ("pass", 9, 88.9, "pass", 13, 92.3),
    ]


def test_gap_register_order(scores):
    rows = compliance.gap_register(compliance.gap_report(scores)).collect()
    assert len(rows) == 32
    assert [r.verdict for r in rows] == ["borderline"] * 13 + ["fail"] * 19
    # Specification ids sort as text: 3.13 before 3.2.
    health = [r.specification for r in rows if r.sector == "Health" and r.verdict == "fail"]
    assert health[:3] == ["3.13", "3.2", "3.2"]
    assert rows[0].dataset_id == "EDU-02" and rows[13].dataset_id == "EDU-01"


def test_cluster_costs(clusters):
    # Published costs of the best of ten fits, k = 2..8.
    published = {
        2: 33.72395006435305,
        3: 15.472202502495756,
        4: 5.531440233787576,
        5: 3.5101,
        6: 2.3421,
        7: 1.2602863854407572,
        8: 0.7780204343124093,
    }
    for k in (2, 3, 4, 7, 8):
        assert clusters.inertias[k] == pytest.approx(published[k], abs=1e-6)
    # Fits for 5 and 6 end in different local minima from seed to seed.
    for k in (5, 6):
        assert clusters.inertias[k] <= published[k] * 1.1


def test_selected_partition(clusters, scores):
    assert clusters.k_selected == 4
    assert clusters.silhouette == pytest.approx(0.7333597836778374, abs=1e-12)
    again = clustering.quality_clusters(scores.repartition(5))
    assert again.inertias == pytest.approx(clusters.inertias)


def test_silhouettes(clusters):
    published = {
        2: 0.8361985400197889,
        3: 0.7260994529927248,
        4: 0.7333597836778374,
        7: 0.7031,
        8: 0.6710,
    }
    for k, value in published.items():
        assert clusters.silhouettes[k] == pytest.approx(value, abs=1e-4)


def test_golden_partition_measures(scores):
    """The published partition's silhouette and the four-cluster partition itself."""
    four = clustering.quality_clusters(scores, [4])
    assert four.k_selected == 4
    assert four.silhouette == pytest.approx(0.7333597836778374, abs=1e-12)
    joined = four.labels.join(scores.select("dataset_id", "golden_cluster"), "dataset_id")
    pairs = joined.groupBy("cluster", "golden_cluster").count().collect()
    assert sorted(r["count"] for r in pairs) == [1, 3, 4, 23]
    points = clustering.profile_vectors(scores).join(
        scores.select("dataset_id", F.array("golden_cluster").alias("labels")), "dataset_id"
    )
    measured = clustering.euclidean_silhouettes(points, 31).first()
    assert measured.silhouette == pytest.approx(0.7333597836778374, abs=1e-12)


def test_centroids_and_series(clusters):
    meta = clusters.meta()
    assert reports.selection_series(meta).count() == 7
    assert reports.centroid_matrix(meta).count() == 3 * clusters.k_selected


def test_projection_variance(scores):
    points, shares = clustering.project_profiles(scores)
    assert shares[0] > shares[1] > 0 and sum(shares) <= 1 + 1e-12
    moments = points.agg(F.avg("pc1"), F.avg("pc2"), F.corr("pc1", "pc2")).first()
    assert [round(x, 9) + 0.0 for x in moments] == [0.0, 0.0, 0.0]
    spread = points.agg(F.var_pop("pc1"), F.var_pop("pc2")).first()
    assert spread[0] / 3 == pytest.approx(shares[0]) and spread[1] / 3 == pytest.approx(shares[1])


def test_hierarchy_totals(scores):
    nodes = {r.id: r for r in reports.hierarchy(scores).collect()}
    total = scores.agg(F.sum("full_composite")).first()[0]
    assert nodes["Portfolio"].total == pytest.approx(total)
    children = sum(n.total for n in nodes.values() if n.parent == "Portfolio")
    assert children == pytest.approx(total)


def test_histogram_counts_everything(scores):
    bins = reports.histogram(scores, "full_composite", 20).orderBy("bin").collect()
    values = [r.full_composite for r in scores.select("full_composite").collect()]
    counts, edges = np.histogram(values, bins=20)
    assert [b.n for b in bins] == counts.tolist() and sum(counts) == 31
    assert [b.left_edge for b in bins] == pytest.approx(edges[:-1])
    assert [b.right_edge for b in bins] == pytest.approx(edges[1:])


def test_kpi_verdicts(scores):
    got = {r.kpi: r.verdict for r in reports.kpi_table(scores).collect()}
    assert got["Mean per-dataset completeness"] == "borderline"
    assert got["Datasets meeting 95% completeness"] == "fail"
    assert got["Datasets with < 1% duplicates"] == "borderline"
    assert got["Mean IF anomaly rate"] == "pass"
    assert got["Datasets audited"] == "n/a"


def test_inspector(scores):
    row = reports.inspect(scores, "INV-13").first()
    assert row["shape"] == "28,038 × 15" and row.shows_anomalies
    assert row.dimensions["consistency"].status == "red"
    assert row.dimensions["completeness"].text == "100.0%"
    missing = reports.inspect(scores, "INV-02").first()
    assert missing.dimensions["accuracy"].text == "N/A"
