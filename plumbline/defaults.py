"""Default parameters and fixed value lists.

Every entry here is a public knob: operators take the same names as keyword
arguments and fall back to these values.
"""

# Cell texts that a delimited reader turns into null.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Cell texts that count as "no real value" in a text column.
SENTINELS = ["N/A", "n/a", "NA", "-", "--", "غير متاح", "Not Available", "?", ""]

# Compliance specifications (id, name, measured dimension, threshold).
SPECIFICATIONS = [
    ("3.1", "Accuracy", "accuracy", 0.95),
    ("3.2", "Completeness", "completeness", 0.95),
    ("3.4", "Consistency", "consistency", 0.95),
    ("3.5", "Validity", "consistency", 0.95),
    ("3.7", "Currency / Timeliness", "timeliness", 0.80),
    ("3.13", "Uniqueness", "uniqueness", 0.99),
]

# Sector, folder under the catalogue root, dataset id prefix.
SECTOR_FOLDERS = [
    ("Investment", "Investment", "INV"),
    ("Health", "health", "HEA"),
    ("Education", "education", "EDU"),
    ("Energy", "energy", "ENE"),
]

# Dimension sets of the band sensitivity analysis. None stands
# for the composite over whatever dimensions a dataset has.
BAND_SPECIFICATIONS = [
    ("as_reported_available_dims", None),
    ("completeness_consistency", ["completeness", "consistency"]),
    (
        "completeness_consistency_uniqueness",
        ["completeness", "consistency", "uniqueness"],
    ),
    (
        "excl_timeliness_incl_accuracy",
        ["completeness", "consistency", "uniqueness", "accuracy"],
    ),
]

DIMENSIONS = ["completeness", "consistency", "uniqueness", "accuracy", "timeliness"]
INHERENT_DIMENSIONS = ["completeness", "consistency", "uniqueness"]
COLUMN_CLASSES = ["numeric", "categorical", "date", "freetext"]
DELIMITERS = [",", ";", "\t", "|"]
BANDS = ["Band A", "Band B", "Band C"]

PARSE_THRESHOLD = 0.95
AUDIT_DATE = "2026-06-03"
UPDATE_FREQUENCY_DAYS = 365
BAND_CUTS = (0.85, 0.70)
VERDICT_WINDOW = 0.05

DATE_SHARE = 0.8
FREETEXT_RATIO = 0.5
FREETEXT_LENGTH = 20

SEED = 42
MIN_ROWS = 10
CONTAMINATION = 0.05
CONTAMINATIONS = [0.02, 0.05, 0.075, 0.10, 0.15]
TREES = 100
TREE_SAMPLE = 256
EPS_PERCENTILE = 0.90
EPS_FALLBACK = 0.5
EPS_MULTIPLIER = 1.0

CLUSTER_COUNTS = range(2, 9)
MIN_CLUSTERS = 3
RESTARTS = 10
