import random
import zlib

import numpy as np
import pytest

from plumbline.llm import toxicity
from plumbline.llm.common import read_table

FOLDER = "/root/testdata/sf0.1"


def test_machine_learns_pairs():
    """Each word doubles the odds, both together are toxic."""
    rng = random.Random(1)
    documents, toxic = [], []
    for _ in range(3000):
        words = rng.sample(range(100, 400), 10)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        documents.append(np.unique(words + [1] * a + [2] * b).astype(np.int32))
        toxic.append(float(a and b))
    machine = toxicity.fit(documents, np.array(toxic))
    place, w, v = machine.arrays()
    at = dict(zip(place.tolist(), range(len(place))))

    def z(terms):
        idx = [at[t] for t in terms if t in at]
        f = v[idx].astype(float)
        return machine.bias + w[idx].sum() + 0.5 * ((f.sum(0) ** 2) - (f**2).sum(0)).sum()

    assert z([1, 2]) > 0 > max(z([1]), z([2]), z([]))


def _mixed(n, rule, seed=1):
    """Documents of random words with words 1 and 2 in half of them, labelled by ``rule``."""
    rng = random.Random(seed)
    documents, toxic = [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        documents.append(np.unique(rng.sample(range(100, 400), 10) + [1] * a + [2] * b).astype(np.int32))
        toxic.append(float(rule(a, b)))
    return documents, np.array(toxic)


def _score(machine, terms):
    """The score by a plain sum over all pairs."""
    place, w, v = machine.arrays()
    at = dict(zip(place.tolist(), range(len(place))))
    known = [at[t] for t in terms if t in at]
    z = machine.bias + sum(float(w[i]) for i in known)
    for n, i in enumerate(known):
        for j in known[n + 1 :]:
            z += float(np.dot(v[i].astype(np.float64), v[j].astype(np.float64)))
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize("rule", [lambda a, b: a != b, lambda a, b: a == b])
def test_pairs_whose_words_say_nothing_alone(rule):
    documents, toxic = _mixed(3000, rule)
    machine = toxicity.fit(documents, toxic)
    held, truth = _mixed(600, rule, seed=2)
    right = np.mean([(_score(machine, d) >= 0.5) == t for d, t in zip(held, truth)])
    assert right > 0.99
    without = toxicity.Machine(machine.bias, machine.terms, machine.linear, b"\0" * len(machine.factors))
    assert np.mean([(_score(without, d) >= 0.5) == t for d, t in zip(held, truth)]) < 0.8


def test_insult_beside_a_mention():
    """An insult is toxic only beside the mention of a group, which is common in clean texts too."""
    rng = random.Random(7)
    documents, toxic = [], []
    for _ in range(4000):
        insult, mention = rng.random() < 0.1, rng.random() < 0.4
        words = rng.sample(range(100, 2000), 20)
        documents.append(np.unique(words + [1] * insult + [2] * mention).astype(np.int32))
        toxic.append(float(insult and mention))
    machine = toxicity.fit(documents, np.array(toxic))
    assert _score(machine, [1, 2]) > 0.8
    assert max(_score(machine, x) for x in ([1], [2], [], [150])) < 0.3


def test_scorer_is_the_sum_over_pairs():
    words = ["insult", "group", "good", "day", "other", "insulting"]
    rng = random.Random(3)
    texts = [" ".join([w for w in words if rng.random() < 0.5] + [f"w{i}x{k}" for k in range(12)]) for i in range(1500)]
    labels = np.array([float("insult" in x.split() and "group" in x.split()) for x in texts])
    machine = toxicity.fit([toxicity.document_terms(x) for x in texts], labels)
    assert np.frombuffer(machine.factors, np.float32).any()
    score = toxicity.Scorer(machine)
    for text in [*texts[:100], "", "unknown words"]:
        assert score(text) == pytest.approx(_score(machine, toxicity.document_terms(text).tolist()), abs=1e-12)


def test_labels_without_evidence_give_the_base_rate():
    documents = [np.array([i + 1], np.int32) for i in range(100)]
    for share in (0.25, 1.0):
        labels = (np.arange(100) < 100 * share).astype(float)
        machine = toxicity.fit(documents, labels)
        assert _score(machine, [5]) == _score(machine, []) == pytest.approx(min(share, 0.999))
    assert _score(toxicity.fit(documents, np.zeros(100)), [5]) < 1e-6


@pytest.fixture(scope="module")
def scores(spark):
    docs, labels = read_table(spark, FOLDER, "documents"), read_table(spark, FOLDER, "labels")
    return toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(scores):
    assert (scores.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scores.doc_id]).all()
    assert scores.score.between(0, 1).all() and (scores.predicted == (scores.score >= 0.5)).all()
    held = scores[scores.held_out & scores.toxic.notna()]
    assert (held.predicted == held.toxic).mean() > 0.975
    assert held[held.toxic == 1].predicted.mean() > 0.85  # some toxic texts hold no telling word
    assert held[held.toxic == 0].predicted.mean() < 0.005


def test_copies_teach_once():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 26, 200, np.int32))
    copies = [np.unique(np.concatenate((base, rng.integers(0, 1 << 26, 2, np.int32)))) for _ in range(50)]
    others = [np.unique(rng.integers(0, 1 << 26, 200, np.int32)) for _ in range(50)]
    kept = toxicity.without_copies(copies + others, np.array([1.0] * 50 + [0.0] * 50))
    assert sum(i < 50 for i in kept) < 12 and sum(i >= 50 for i in kept) == 50


def test_edges(spark, docs_of):
    filler = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"{'you stupid clown' if i % 2 else 'good day to all'} {filler(i)}") for i in range(200)]
    rows += [(500, None), (501, ""), (None, "stupid clown"), (502, "stupid clown " * 20_000), (3, f"you stupid clown {filler(3)}")]
    df = docs_of(rows)
    labels = spark.createDataFrame(
        [(i, 0, i % 2) for i in range(200)] + [(1, 0, 0), (None, 0, 1), (7, None, None)],
        "doc_id long, quality int, toxic int",
    )
    got = toxicity.toxicity_scores(df, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    by_id = {r.doc_id: r.predicted for r in got.collect()}
    assert [by_id[i] for i in (1, 2, 500, 501, None, 502)] == [1, 0, 0, 0, 1, 1]
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == 102


def test_without_labels_nothing_is_toxic(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs_of([(1, "a"), (2, None)])
    assert {(r.score < 1e-6, r.predicted) for r in toxicity.toxicity_scores(df, labels).collect()} == {(True, 0)}
    assert toxicity.without_toxic(df.where("doc_id > 2"), labels).count() == 0
