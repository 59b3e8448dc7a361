import hashlib
import random
import re

from pyspark.sql import functions as F

from plumbline.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(members), digest) for i, _ in members]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a  b  c"), (4, None), (5, ""), (6, " \t\n"), (7, "abd"),
    (8, "é　x"), (9, "é x"), (10, "éx"), (None, "abc"), (11, "a  b  c"),
]


def long_rows():
    rng = random.Random(5)
    base = " ".join("".join(rng.choices("abcdef.", k=rng.randint(1, 9))) for _ in range(4000))
    other = base[:9000] + "Z" + base[9001:]
    shifted = base.replace(" ", "\n")
    return [(20, base), (21, other), (22, shifted), (23, base + "."), (24, "x" * 30_000), (25, "x" * 30_000), (26, "x" * 30_001)]


def test_against_brute_force(docs_of):
    rows = ROWS + long_rows()
    df = exact_dedup.duplicate_groups(docs_of(rows))
    assert found(df) == brute(rows)
    kept = df.where("kept").groupBy("keep_id").count().collect()
    assert all(r["count"] == 1 for r in kept) and len(kept) == len({b[3] for b in brute(rows)})


def test_clashing_hashes_are_told_apart(docs_of):
    rows = ROWS + long_rows()
    weak = lambda c: F.length(c) % 3  # noqa: E731 - most chunks share an identifier
    assert found(exact_dedup.duplicate_groups(docs_of(rows), chunk_hash=weak)) == brute(rows)


def test_chunks_join_to_the_text(spark):
    texts = [t for _, t in long_rows()] + ["", "ab", "\U0001f600" * 3000, "a.\nb" * 900]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, parts in df.select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect():
        assert "".join(parts) == t and all(0 < len(p) <= 2048 for p in parts)


def test_one_row_of_repeated_rows_stays(docs_of):
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (None, "q"), (None, "q"), (3, None), (4, "z")]
    df = docs_of(rows)
    kept = exact_dedup.without_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, "a b"), (None, "q"), (3, None), (4, "z")], key=str
    )


def test_empty_table(docs_of):
    empty = docs_of([(1, "x")]).where("doc_id > 1")
    assert exact_dedup.duplicate_groups(empty).count() == 0
    assert exact_dedup.without_duplicates(empty).count() == 0
