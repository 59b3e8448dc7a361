"""The golden score rows, read from the table in FIXTURES.md."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.portfolio import composites

_ROW = re.compile(r"^\| ((?:INV|HEA|EDU|ENE)-\d\d) \|(.*)\|$")


def _number(text: str) -> float | None:
    return None if text == "∅" else float(text)


def golden_scores(spark: SparkSession) -> DataFrame:
    rows = []
    text = (Path(__file__).parents[1] / "FIXTURES.md").read_text(encoding="utf-8")
    for line in text.splitlines():
        match = _ROW.match(line.strip())
        if not match:
            continue
        sector, *cells = [c.strip() for c in match.group(2).split("|")]
        scores = [_number(c) for c in cells[:5]]
        n_rows, n_cols, n_nulls = (int(c) for c in cells[5:8])
        classes = [int(c) for c in cells[8].split("/")]
        rows.append(
            (match.group(1), sector, *scores, n_rows, n_cols, n_nulls, *classes, int(cells[9]))
        )
    frame = spark.createDataFrame(
        rows,
        "dataset_id string, sector string, completeness double, consistency double, "
        "uniqueness double, accuracy double, db_noise_rate double, rows long, cols long, "
        "n_nulls long, numeric_cols long, categorical_cols long, date_cols long, "
        "freetext_cols long, golden_cluster int",
    )
    return composites(
        frame.withColumns(
            {
                "file_name": F.concat("dataset_id", F.lit(".csv")),
                "timeliness": F.lit(1.0),
                "if_anomaly_rate": 1 - F.col("accuracy"),
                "if_applicable": F.col("accuracy").isNotNull(),
                "db_applicable": F.col("db_noise_rate").isNotNull(),
                "total_cells": F.col("rows") * F.col("cols"),
            }
        )
    )
