"""Language profiles: bundles against a plain double loop, edge cases, held-out texts."""

import unicodedata
import zlib

import numpy as np
import pytest

from plumbline.llm import language_id as lid
from plumbline.llm.common import read_table
from plumbline.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


def plain_letters(text):
    text = unicodedata.normalize("NFC", text or "").lower()
    kept = [c if unicodedata.category(c)[0] in "LM" else " " for c in text]
    if not any(unicodedata.category(c)[0] == "L" for c in text):
        return ""
    return " " + " ".join("".join(kept).split(" ")).strip() + " "


def plain_bundle(text, dimensions):
    """Sum over sequences of products of rotated letter vectors, one by one."""
    import re

    letters = re.sub(" +", " ", plain_letters(text))
    total = np.zeros(dimensions)
    vector = {c: lid.letter_vectors(np.array([ord(c)]), dimensions)[0] for c in set(letters)}
    for i in range(len(letters) - 2):
        a, b, c = letters[i : i + 3]
        total += np.roll(vector[a], 2).astype(int) * np.roll(vector[b], 1) * vector[c]
    return total


TEXTS = [None, "", " \n", "12 + 3!", "a", "Ab", "the cat, the dog", "é é É", "日本語の文章", "क्षि हिन्दी", "x" * 500, "ﬃ İstanbul"]


@pytest.mark.parametrize("window,vectors", [(1 << 20, 4096), (7, 3)])
def test_bundles_are_those_of_a_plain_loop(monkeypatch, window, vectors):
    monkeypatch.setattr(lid, "_WINDOW", window)
    monkeypatch.setattr(lid, "_VECTORS_AT_ONCE", vectors)
    found = lid.bundles(TEXTS, 128)
    for row, text in zip(found, TEXTS):
        assert row.tolist() == plain_bundle(text, 128).tolist(), text


def test_letter_vectors_are_nearly_orthogonal():
    vectors = lid.letter_vectors(np.arange(97, 123)).astype(int)
    products = vectors @ vectors.T - lid.DIMENSIONS * np.eye(26, dtype=int)
    assert set(np.unique(vectors)) == {-1, 1}
    assert np.abs(products).max() < 0.2 * lid.DIMENSIONS


def test_edge_cases(docs_of):
    rows = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "12 !"), (None, "the the"), (6, "the dog"), (6, "the dog")]
    df = docs_of(rows).selectExpr("*", "'zz' AS lang_pred", "true AS held_out", "'q' AS digest")
    got = lid.document_languages(df).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [by_id[i][0].lang_pred for i in (2, 3, 4)] == ["und"] * 3
    assert [by_id[i][0].score for i in (2, 3, 4)] == [0.0] * 3
    assert by_id[1][0].lang_pred == by_id[None][0].lang_pred == "en"
    assert by_id[6][0] == by_id[6][1]
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id or "").encode()) % 5 == 0) for r in got)


def test_nothing_to_learn_from(spark, docs_of):
    df = docs_of([(1, "some words"), (2, None)]).drop("lang").selectExpr("*", "CAST(null AS string) AS lang")
    assert {(r.lang_pred, r.score) for r in lid.document_languages(df).collect()} == {("und", 0.0)}
    assert lid.document_languages(df.limit(0)).collect() == []


def test_ties_and_long_texts(spark):
    rows = [(i, "aaa bbb", x) for i, x in enumerate(["q", "p", "q", "p", "q"])] + [(9, "aaa " * 400_000, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = lid.train(df)
    assert profiles.languages == ("p", "q")
    one = lid.Profiles(("p", "q"), profiles.vectors[: 8 * lid.DIMENSIONS] * 2)
    assert one.predict(["aaa bbb"])[0] == ["p"]
    assert profiles.predict(["aaa " * 400_000])[0] == ["p"]


def test_results_do_not_depend_on_batches(spark):
    docs = read_table(spark, SF, "documents")
    profiles = lid.train(docs)
    assert lid.train(docs.repartition(7)) == profiles
    some = [r.text for r in docs.limit(40).collect()]
    names, scores = profiles.predict(some)
    alone = [profiles.predict([x]) for x in some]
    assert names == [x[0][0] for x in alone] and scores.tolist() == [x[1][0] for x in alone]


def test_copies_teach_once_and_the_limit_holds(spark):
    rows = [(i, "same text here", "en") for i in range(50)] + [(99, "other words there", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = lid.train(df.dropDuplicates(["text"]))
    assert lid.train(df).vectors == once.vectors
    assert lid.train(df, max_texts=1).vectors != once.vectors


def test_held_out_texts(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    got = LLM_QUERIES["op11_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.lang_pred == r.lang for r in rows)
    assert len(rows) > 150 and right / len(rows) > 0.97
