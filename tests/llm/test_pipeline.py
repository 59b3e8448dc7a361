"""The pipeline, stage by stage, against plain Python versions of its stages."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from checks.compare import _canonical, connect
from plumbline.llm import mixing, simhash, toxicity
from plumbline.llm.common import read_table
from plumbline.llm.oracles import LLM_ORACLES
from plumbline.llm.queries import LLM_QUERIES
from tests.llm.test_mixing import draw
from tests.llm.test_simhash import slow_classes, slow_fingerprint
from tests.llm.test_tokens import check_layout

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_against_sql(spark, name):
    got = LLM_QUERIES[name](spark, FOLDER).toPandas()
    want = connect(FOLDER).execute(LLM_ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _canonical(got) == _canonical(want)


def test_queries_are_registered():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in LLM_QUERIES} == set(range(1, 14))


def test_simhash_query_on_the_whole_table(spark):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in read_table(spark, FOLDER, "documents").collect()]
    expected = {i: (f"{f:016x}", c) for (i, f), c in zip(rows, slow_classes(rows))}
    got = LLM_QUERIES["op6_simhash_near_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == expected


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = read_table(spark, FOLDER, "documents")
    labels = {r.doc_id: r.toxic for r in read_table(spark, FOLDER, "labels").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]

    clean = stages["toxicity"](spark, docs, FOLDER)
    assert clean.columns == docs.columns
    kept = by_id(clean)
    scores = toxicity.toxicity_scores(docs, read_table(spark, FOLDER, "labels"))
    assert set(kept) == {r.doc_id for r in scores.collect() if r.predicted == 0}
    assert sum(i in kept for i, t in labels.items() if t == 0) >= 0.99 * sum(t == 0 for t in labels.values())

    distinct = stages["exact_dedup"](spark, clean, FOLDER)
    assert distinct.columns == docs.columns
    groups = {}
    for r in kept.values():
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", r.text), []).append(r)
    expected = {min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values()}
    assert set(by_id(distinct)) == expected

    unlike = stages["simhash_near_dedup"](spark, distinct, FOLDER)
    assert unlike.columns == docs.columns
    fps = [(i, slow_fingerprint(r.text)) for i, r in by_id(distinct).items()]
    assert set(by_id(unlike)) == set(slow_classes(fps))

    mixed = stages["source_mixing"](spark, unlike, FOLDER)
    assert mixed.columns == docs.columns
    rate = {r.source: r.rate for r in mixing.repetition_rates(unlike).collect()}
    counts = Counter({i: draw(i, rate[r.source]) for i, r in by_id(unlike).items()})
    assert Counter(r.doc_id for r in mixed.collect()) == +counts

    packed = stages["best_fit_packing"](spark, mixed, FOLDER).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == +counts
    check_layout([(r.sequence_id, r.offset, r.length) for r in packed], 1024)
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    digest = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert digest(whole) == digest(packed)
    assert simhash.MAX_DISTANCE == 2
