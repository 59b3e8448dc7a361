import hashlib
import math
from collections import Counter

import pytest

from plumbline.llm import mixing


def draw(doc_id, rate, seed=42):
    parts = max(1, math.ceil(rate / 16))
    mean, total = rate / parts, 0
    for part in range(1, parts + 1):
        text = f"{seed}:{'' if doc_id is None else doc_id}:{part}"
        u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-mean)
        k = 0
        while c <= u and k < 100:
            k += 1
            p *= mean / k
            c += p
            total += 1
    return total


def test_counts_are_the_draws(docs_of):
    rows = [(i, f"t{i}", "big" if i % 3 else ("small" if i % 2 else None)) for i in range(600)]
    df = docs_of(rows)
    rates = mixing.repetition_rates(df, weights={"big": 1.0, "small": 60.0, None: 0.5})
    rate = {r.source: r.rate for r in rates.collect()}
    assert sum(rate[r.source] * r.n_docs for r in rates.collect()) == pytest.approx(600)
    mixed = mixing.mix(df, rates)
    assert mixed.columns == [*df.columns, "_copy"]
    got = Counter(r.doc_id for r in mixed.collect())
    assert got == Counter({i: n for i, _, s in rows if (n := draw(i, rate[s]))})


def test_large_means_are_sums_of_draws(docs_of):
    df = docs_of([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], extra=False)
    rates = mixing.repetition_rates(df, weights={"x": 1.0}, total=5000)
    got = Counter(r.doc_id for r in mixing.mix(df, rates).collect())
    assert got == Counter({1: draw(1, 2500.0), 2: draw(2, 2500.0)})  # y has no weight
    assert all(abs(n - 2500) < 250 for n in got.values())


def test_default_weights_follow_size(docs_of):
    df = docs_of([(i, "t", "a" if i < 90 else "b") for i in range(100)])
    rate = {r.source: r.rate for r in mixing.repetition_rates(df).collect()}
    total = math.sqrt(90) + math.sqrt(10)
    assert rate["a"] == pytest.approx(100 * math.sqrt(90) / total / 90)
    assert rate["b"] == pytest.approx(100 * math.sqrt(10) / total / 10)


def test_repeats_and_shuffles(docs_of):
    df = docs_of([(i, "t", "a") for i in range(2000)])
    rates = mixing.repetition_rates(df)
    first = [r.doc_id for r in mixing.mix(df, rates).collect()]
    again = [r.doc_id for r in mixing.mix(df.repartition(5), rates).collect()]
    assert sorted(first) == sorted(again) and first != sorted(first)


def test_repeated_rows_null_ids_and_no_rows(docs_of):
    df = docs_of([(None, None, None), (4, "x", None), (4, "x", None)])
    rates = mixing.repetition_rates(df, total=30)
    rate = rates.first().rate
    got = Counter(r.doc_id for r in mixing.mix(df, rates).collect())
    assert got == Counter({None: draw(None, rate), 4: 2 * draw(4, rate)})
    empty = df.where("doc_id > 4")
    assert mixing.mix(empty, mixing.repetition_rates(empty)).count() == 0
