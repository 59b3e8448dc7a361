"""Schemas of the tables the engine reads and writes."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _schema(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


_text, _long, _int, _real, _flag = (
    StringType(),
    LongType(),
    IntegerType(),
    DoubleType(),
    BooleanType(),
)

INVENTORY = _schema(
    ("dataset_id", _text),
    ("sector", _text),
    ("file_name", _text),
    ("file_path", _text),
    ("encoding", _text),
    ("delimiter", _text),
    ("rows", _long),
    ("cols", _long),
    ("total_cells", _long),
    ("size_kb", _real),
    ("sha256", _text),
    ("numeric_cols", _long),
    ("categorical_cols", _long),
    ("date_cols", _long),
    ("freetext_cols", _long),
    ("load_ok", _flag),
    ("error", _text),
)

DATASET_SCORES = _schema(
    ("dataset_id", _text),
    ("sector", _text),
    ("file_name", _text),
    ("completeness", _real),
    ("consistency", _real),
    ("uniqueness", _real),
    ("accuracy", _real),
    ("timeliness", _real),
    ("three_dim_composite", _real),
    ("full_composite", _real),
    ("drl_band", _text),
    ("if_applicable", _flag),
    ("if_anomaly_rate", _real),
    ("db_applicable", _flag),
    ("db_noise_rate", _real),
    ("rows", _long),
    ("cols", _long),
    ("total_cells", _long),
    ("n_nulls", _long),
)

SWEEP = _schema(
    ("dataset_id", _text),
    ("sector", _text),
    ("contamination", _real),
    ("anomaly_rate", _real),
    ("applicable", _flag),
)

AGREEMENT = _schema(
    ("applicable", _flag),
    ("kappa", _real),
    ("jaccard", _real),
    ("if_anom_count", _long),
    ("dbscan_noise_count", _long),
    ("overlap", _long),
    ("n_records", _long),
    ("dataset_id", _text),
    ("sector", _text),
    ("kappa_interp", _text),
)

CLUSTERS = StructType(
    DATASET_SCORES.fields
    + _schema(
        ("numeric_cols", _long),
        ("categorical_cols", _long),
        ("date_cols", _long),
        ("freetext_cols", _long),
        ("cluster", _int),
    ).fields
)

GAP_REGISTER = _schema(
    ("dataset_id", _text),
    ("sector", _text),
    ("specification", _text),
    ("ndmo_name", _text),
    ("dimension", _text),
    ("observed", _real),
    ("threshold", _real),
    ("verdict", _text),
)

SPECIFICATIONS = _schema(
    ("spec_order", _int),
    ("specification", _text),
    ("ndmo_name", _text),
    ("dimension", _text),
    ("threshold", _real),
)
