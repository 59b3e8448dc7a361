"""The whole chain on one frame."""

import pytest

from checks import views as v
from plumbline import schemas
from plumbline.plans.audit import Audit, audit
from plumbline.session import settle, shared_folder, tables_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def done(spark):
    events = v.dirty_events(spark, FOLDER)
    catalogue = events.selectExpr(
        "event_type dataset_id", "if(event_type = 'error', 'ops', 'use') sector", "event_type file_name"
    ).distinct()
    return audit(
        events, "row_id", "event_type", v.EVENT_COLUMNS,
        catalogue=catalogue, features=v.EVENT_FEATURES, timestamp="ts", audit_date="2024-03-01",
    )


def test_tables(done):
    assert done.scores.schema == schemas.DATASET_SCORES
    assert done.sweep.count() == 25
    assert {r.sector for r in done.agreement.collect()} == {"ops", "use"}
    assert done.sector_matrix.columns[2:5] == ["ops", "ops_n", "ops_pct_pass"]
    assert done.clusters.k_selected in (3, 4)
    assert done.clustered.columns == schemas.CLUSTERS.names
    row = done.headline.first()
    assert row.n_datasets == 5 and 0 < row.mean_if_dbscan_kappa < 1
    assert set(row.if_sweep_spearman) == {"0.02", "0.05", "0.075", "0.1", "0.15"}


def test_whole_frame_is_one_dataset(spark):
    orders = v.table(spark, FOLDER, "orders")
    done = audit(orders, "o_orderkey", features=["o_totalprice", "o_custkey"])
    row = done.scores.first()
    assert (row.dataset_id, row.rows, row.cols) == ("all", 1500, 6)
    assert row.timeliness is None and row.if_applicable and row.db_applicable


def test_settled_tables_live_in_the_shared_folder(spark):
    table = settle(spark.range(3), "t")
    assert tables_folder(spark).startswith(f"{shared_folder(spark)}/plumbline/")
    assert tables_folder(spark) in table.inputFiles()[0] and table.count() == 3


def test_closing_leaves_other_applications_alone(spark, monkeypatch):
    """Run as an application of its own: this session's tables are in use."""
    from plumbline import session

    theirs = settle(spark.range(4), "theirs")
    monkeypatch.setattr(session, "tables_folder", lambda s: f"{shared_folder(s)}/plumbline/closing")
    mine = settle(spark.range(3), "mine")
    path = mine.inputFiles()[0]
    Audit(mine, mine, mine, None, mine).close()
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not fs.exists(jvm.org.apache.hadoop.fs.Path(path))
    assert theirs.count() == 4
