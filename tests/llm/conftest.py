import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples, with clashing extra columns."""

    def build(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if extra:
            df = df.selectExpr("*", "7 AS uid", "'x' AS fp", "1 AS copy", "0.5 AS score", "'k' AS recipe", "1 AS drawn")
        return df

    return build
