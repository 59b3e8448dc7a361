"""Benchmark: headline jobs over whole tables, one JSON line on stdout.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks import views as v
from checks.session import local_session
from plumbline.operators import dimensions, isolation, matrix, profile
from plumbline.operators.agreement import detector_agreement
from plumbline.operators.clustering import quality_clusters
from plumbline.operators.density import DensityNoise
from plumbline.plans import compliance, portfolio, reports
from plumbline.plans.audit import audit, inherent_scores
from plumbline.plans.files import load_catalogue
from plumbline.session import settle
from checks.queries import _SECTOR_MAP, document_files

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def lineitem(spark, folder):
    return v.table(spark, folder, "lineitem").selectExpr(
        "*", f"concat_ws('-', {', '.join(LINE_KEY)}) AS row_id"
    )


def by_flag(spark, folder):
    names = v.table(spark, folder, "lineitem").selectExpr(
        "l_returnflag AS dataset_id", "'sales' AS sector", "l_returnflag AS file_name"
    )
    return names.distinct()


def inherent_lineitem(spark, folder):
    """Completeness, consistency and uniqueness of all order lines, by flag."""
    rows = v.table(spark, folder, "lineitem")
    run(inherent_scores(rows, by_flag(spark, folder), "l_returnflag"))


def classes_lineitem(spark, folder):
    run(profile.column_classes(lineitem(spark, folder), "row_id", "l_returnflag"))


def classes_documents(spark, folder):
    rows = v.dirty_documents(spark, folder)
    run(profile.column_classes(rows, "row_id", "source", v.DOCUMENT_COLUMNS))


def parse_rates_events(spark, folder):
    run(dimensions.parse_rates(v.dirty_events(spark, folder), "event_type", v.EVENT_COLUMNS))


def forest_sweep_lineitem(spark, folder):
    """One forest over the order lines by flag, cut at five contaminations."""
    rows = lineitem(spark, folder)
    numbers = settle(matrix.numeric_matrix(rows, "row_id", "l_returnflag", LINE_FEATURES), "m")
    scores = settle(isolation.isolation_scores(numbers), "s")
    keys = by_flag(spark, folder).select("dataset_id", "sector")
    sweep = isolation.contamination_sweep(scores, keys)
    run(reports.sweep_pivot(sweep))


def density_events(spark, folder):
    rows = v.dirty_events(spark, folder)
    numbers = settle(matrix.numeric_matrix(rows, "row_id", "event_type", v.EVENT_FEATURES), "m")
    keys = profile.dataset_keys(rows, "event_type")
    run(DensityNoise(numbers).summary(keys))


def density_lineitem(spark, folder):
    """All order lines by flag in three features."""
    rows = lineitem(spark, folder)
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    numbers = settle(matrix.numeric_matrix(rows, "row_id", "l_returnflag", features), "m")
    keys = by_flag(spark, folder).select("dataset_id")
    run(DensityNoise(numbers).summary(keys, clusters=False))


def audit_events(spark, folder):
    """The whole chain on the events by type: scores to headline."""
    done = audit(
        v.dirty_events(spark, folder), "row_id", "event_type", v.EVENT_COLUMNS,
        features=v.EVENT_FEATURES, timestamp="ts",
    )
    run(done.gap_register)
    run(done.headline)


def clusters_documents(spark, folder):
    """k-means of the sources' quality profiles for seven k, ten restarts each."""
    rows = v.dirty_documents(spark, folder)
    scores = settle(
        inherent_scores(rows, v.document_catalogue(spark, folder), "source", v.DOCUMENT_COLUMNS),
        "scores",
    )
    run(quality_clusters(scores).labels)


def agreement_events(spark, folder):
    rows = v.dirty_events(spark, folder)
    numbers = settle(matrix.numeric_matrix(rows, "row_id", "event_type", v.EVENT_FEATURES), "m")
    labels = isolation.anomaly_labels(settle(isolation.isolation_scores(numbers), "s"))
    run(detector_agreement(labels, DensityNoise(numbers).labels()))


def portfolio_documents(spark, folder):
    """Scores of all sources, then compliance, sensitivity and sector tables."""
    rows = v.dirty_documents(spark, folder)
    scores = settle(
        inherent_scores(
            rows, v.document_catalogue(spark, folder), "source", v.DOCUMENT_COLUMNS,
            updates=v.document_updates(spark, folder),
        ),
        "scores",
    )
    gaps = compliance.gap_report(scores)
    run(compliance.sector_matrix(gaps))
    run(compliance.gap_register(gaps))
    run(portfolio.headline(scores))
    run(portfolio.band_sensitivity_per_dataset(scores))
    run(reports.hierarchy(scores))
    run(reports.box_statistics(scores))


def load_files(spark, folder):
    """Scan, sniff, parse and profile the documents as delimited files."""
    run(load_catalogue(spark, document_files(spark, folder), _SECTOR_MAP).inventory())


JOBS = [
    inherent_lineitem,
    classes_lineitem,
    classes_documents,
    parse_rates_events,
    forest_sweep_lineitem,
    density_events,
    density_lineitem,
    agreement_events,
    audit_events,
    clusters_documents,
    portfolio_documents,
    load_files,
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    run(v.table(spark, folder, "lineitem"))
    document_files(spark, folder)
    seconds = {}
    for job in JOBS:
        start = time.time()
        job(spark, folder)
        seconds[job.__name__] = round(time.time() - start, 3)
        print(job.__name__, seconds[job.__name__], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "audit_jobs_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
