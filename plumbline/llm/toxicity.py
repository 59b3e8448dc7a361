"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: lower-case words and the stems they begin
with. The machine scores every term and every pair of terms, the latter
through short factor vectors, so that a word can weigh more beside another
one, such as an insult beside the mention of a group. A term has a weight of
its own if it alone says something about the label, and factors if a pair with
it says more than its two terms do. The machine is fitted to a bounded sample
of labelled documents; scoring reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, slices, text_or_empty, texts, widened
from plumbline.session import settle

#: Labelled documents that a fit uses at most, the smallest by hash of their id.
MAX_LABELLED = 12_000
#: Terms whose presence says less about the label have no weight: the least
#: log-likelihood ratio (twice the log of the odds that it says something).
MIN_EVIDENCE = 14.0
#: The same for what a pair says beyond its terms, of millions of pairs.
MIN_PAIR_EVIDENCE = 40.0
#: Pairs are sought among this many terms, those of the most toxic documents.
PAIR_TERMS = 2048
HASH_BITS = 26
STEM_LENGTHS = (4, 5)
FACTORS = 4
EPOCHS = 60
LEARNING_RATE = 0.4
LINEAR_DECAY, FACTOR_DECAY = 1e-4, 1e-5
FIRST_FACTORS = 0.2
#: Term sets that agree in all minima of one of the rows of hash orders count
#: as copies; of copies with one label, one is learned from.
COPY_ROWS, COPY_MINIMA = 2, 6
BATCH = 256
SEED = 42
FOLDS = 5

_WORD = re.compile(r"\w+")
_MEMO_WORDS = 150_000


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the crc32 of the id, as text, is divisible by the number of folds."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def word_terms(word: str) -> list[int]:
    """Hashes of a word and of its stems."""
    mask = (1 << HASH_BITS) - 1
    found = [zlib.crc32(word.encode("utf-8", "surrogatepass")) & mask]
    for n in STEM_LENGTHS:
        if len(word) > n:
            found.append(zlib.crc32(f"{word[:n]}*".encode("utf-8", "surrogatepass")) & mask)
    return found


def document_terms(text: str) -> np.ndarray:
    """Sorted distinct term hashes of a whole text."""
    words = set(_WORD.findall(text.lower()))
    return np.unique(np.fromiter((t for w in words for t in word_terms(w)), np.int32))


@dataclass(frozen=True)
class Machine:
    """Fitted weights: of the sorted ``terms``, linear and factors, as bytes."""

    bias: float
    terms: bytes
    linear: bytes
    factors: bytes

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (
            np.frombuffer(self.terms, np.int32),
            np.frombuffer(self.linear, np.float32),
            np.frombuffer(self.factors, np.float32).reshape(-1, FACTORS),
        )


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows that end before ``ends``."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def without_copies(documents: list[np.ndarray], toxic: np.ndarray) -> list[int]:
    """Places of the documents that are no near copy of an earlier one with the same label."""
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, (COPY_ROWS, COPY_MINIMA), np.uint64) * 2 + 1
    seen: set[tuple] = set()
    kept = []
    for i, terms in enumerate(documents):
        if not len(terms):
            continue
        mixed = (terms.astype(np.uint64) + np.uint64(1))[:, None, None] * factors
        marks = {(row, toxic[i], *minima) for row, minima in enumerate((mixed >> np.uint64(20)).min(axis=0).tolist())}
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return kept


def evidence(held_by: np.ndarray, held_by_toxic: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of presence and label, from document counts of terms."""
    n, share = len(toxic), toxic.sum() / len(toxic)
    total = np.zeros(len(held_by))
    for documents, of_them_toxic in ((held_by, held_by_toxic), (n - held_by, toxic.sum() - held_by_toxic)):
        for seen, expected in ((of_them_toxic, documents * share), (documents - of_them_toxic, documents * (1 - share))):
            total += np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0.0)
    return 2 * total


def _information(cells: list[tuple[np.ndarray, np.ndarray]], share: float) -> np.ndarray:
    """Log-likelihood ratio of cells (documents, toxic ones) against one share of toxic ones."""
    total = 0.0
    for n, ones in cells:
        for seen, expected in ((ones, n * share), (n - ones, n * (1 - share))):
            total = total + np.where(seen > 0.5, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0.0)
    return 2 * total


def paired_terms(place: np.ndarray, rows: np.ndarray, toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """Which of the terms belong to a pair that says more than its two terms.

    ``place`` and ``rows`` are terms and the documents that hold them. What a
    pair says is the log-likelihood ratio of the label in the four cases of
    its terms being there or not; of that the ratios of both terms are taken.
    """
    n, ones = len(toxic), toxic.sum()
    share = ones / n
    in_toxic = np.bincount(place, toxic[rows], n_terms)
    candidates = np.sort(np.lexsort((np.arange(n_terms), -in_toxic))[:PAIR_TERMS])
    column = np.full(n_terms, -1)
    column[candidates] = np.arange(len(candidates))
    held = column[place] >= 0
    table = np.zeros((n, len(candidates)), np.float32)
    table[rows[held], column[place[held]]] = 1
    alone = evidence(table.sum(0, dtype=np.float64), table[toxic > 0].sum(0, dtype=np.float64), toxic)
    each, each_toxic = table.sum(0, dtype=np.float64), table[toxic > 0].sum(0, dtype=np.float64)
    paired = np.zeros(n_terms, bool)
    for at in range(0, len(candidates), 256):
        part = slice(at, at + 256)
        both = (table[:, part].T @ table).astype(np.float64)
        both_toxic = (table[toxic > 0][:, part].T @ table[toxic > 0]).astype(np.float64)
        first = (each[part, None] - both, each_toxic[part, None] - both_toxic)
        second = (each[None] - both, each_toxic[None] - both_toxic)
        neither = (n - both - first[0] - second[0], ones - both_toxic - first[1] - second[1])
        more = _information([(both, both_toxic), first, second, neither], share) - alone[part, None] - alone[None]
        more[np.arange(len(more)), at + np.arange(len(more))] = 0
        i, j = np.nonzero(more >= MIN_PAIR_EVIDENCE)
        paired[candidates[at + i]] = paired[candidates[j]] = True
    return paired


def fit(documents: list[np.ndarray], toxic: np.ndarray) -> Machine:
    """Fit by mini-batch AdaGrad on the logistic loss; repeatable for equal input.

    If no term says anything, every score is the share of toxic examples.
    """
    chosen = without_copies(documents, toxic)
    documents, toxic = [documents[i] for i in chosen], toxic[chosen]
    if not len(documents) or not toxic.any():
        return Machine(-20.0, b"", b"", b"")
    share = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
    empty = Machine(float(np.log(share / (1 - share))), b"", b"", b"")
    flat = np.concatenate(documents)
    terms = np.unique(flat)
    place = np.searchsorted(terms, flat).astype(np.int32)
    del flat
    rows = np.repeat(np.arange(len(documents), dtype=np.int32), [len(d) for d in documents])
    paired = paired_terms(place, rows, toxic, len(terms))
    kept = paired | (evidence(np.bincount(place), np.bincount(place, toxic[rows]), toxic) >= MIN_EVIDENCE)
    if not kept.any():
        return empty
    new_place, paired = np.cumsum(kept) - 1, paired[kept]
    use = kept[place]
    place, rows, terms = new_place[place[use]], rows[use], terms[kept]
    sizes = np.bincount(rows, minlength=len(documents))
    ends = np.cumsum(sizes)
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(len(terms)), rng.normal(0, FIRST_FACTORS, (len(terms), FACTORS)) * paired[:, None]
    bias = empty.bias
    gw, gv, gb = np.full(len(terms), 1e-2), np.full((len(terms), FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(documents))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            n = sizes[chosen]
            stops = np.cumsum(n)
            idx = place[np.repeat(ends[chosen] - n - (stops - n), n) + np.arange(n.sum())]
            own = np.repeat(np.arange(len(chosen)), n)
            vi = v[idx]
            sv = _sums(vi, stops)
            z = bias + _sums(w[idx], stops) + 0.5 * (sv**2 - _sums(vi**2, stops)).sum(axis=1)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[chosen]
            local, at_local = np.unique(idx, return_inverse=True)
            dw = np.bincount(at_local, g[own], len(local)) / len(chosen) + LINEAR_DECAY * w[local]
            each = g[own, None] * (sv[own] - vi)
            dv = np.stack(
                [np.bincount(at_local, each[:, f], len(local)) for f in range(FACTORS)], axis=1
            ) / len(chosen) + FACTOR_DECAY * v[local]
            dv *= paired[local, None]
            gw[local] += dw**2
            gv[local] += dv**2
            gb += g.mean() ** 2
            w[local] -= LEARNING_RATE * dw / np.sqrt(gw[local])
            v[local] -= 0.2 * LEARNING_RATE * dv / np.sqrt(gv[local])
            bias -= LEARNING_RATE * g.mean() / np.sqrt(gb)
    matters = (np.abs(w) > 0.02) | (np.abs(v).max(axis=1) > 0.05)
    return Machine(
        float(bias),
        terms[matters].tobytes(),
        w[matters].astype(np.float32).tobytes(),
        v[matters].astype(np.float32).tobytes(),
    )


class Scorer:
    def __init__(self, machine: Machine):
        terms, self._linear, self._factors = machine.arrays()
        self._place = dict(zip(terms.tolist(), range(len(terms))))
        self._bias = machine.bias
        self._memo: dict[str, tuple[int, ...]] = {}

    def _known(self, word: str) -> tuple[int, ...]:
        found = self._memo.get(word)
        if found is None:
            if len(self._memo) > _MEMO_WORDS:
                self._memo.clear()
            get = self._place.get
            found = tuple(p for t in word_terms(word) if (p := get(t)) is not None)
            self._memo[word] = found
        return found

    def __call__(self, text: str) -> float:
        places: set[int] = set()
        for word in set(_WORD.findall(text.lower())):
            places.update(self._known(word))
        at = np.fromiter(sorted(places), np.int64, len(places))
        v = self._factors[at].astype(np.float64)
        z = self._bias + float(self._linear[at].astype(np.float64).sum())
        z += 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


@lru_cache(maxsize=1)
def _scorer(machine: Machine) -> Scorer:
    return Scorer(machine)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> Machine:
    """Fit on labelled documents that are not held out, ``max_labelled`` at most.

    Of several labels of an id the largest counts; null labels and ids do not.
    Without a toxic example every score is next to 0; where no term says
    anything, it is the share of toxic examples. One task holds the sample's
    term sets; of the texts it sees none.
    """
    marked = (
        labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias("id"))
        .agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("toxic"))
        .where(~held_out("id"))
        .orderBy(F.md5(F.col("id").cast("string")), "id")
        .limit(max_labelled)
    )
    marked = settle(marked, "training-labels")
    examples = docs.select(
        F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("_text")
    ).join(marked, "id")

    def to_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = [document_terms(x) for x in texts(part, "_text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), pa.array([x.tobytes() for x in found], pa.binary())],
                    names=["toxic", "terms"],
                )

    terms = settle(
        examples.select("toxic", "_text")
        .mapInArrow(to_terms, "toxic int, terms binary")
        .orderBy(F.md5("terms"), "toxic")
        .limit(max_labelled),
        "training-terms",
    )

    def one_fit(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("toxic").to_numpy(), np.array([zlib.crc32(x.as_buffer()) for x in table.column("terms")])))
        held = table.take(pa.array(order))
        machine = fit(
            [np.frombuffer(x.as_buffer(), np.int32) for x in held.column("terms")],
            held.column("toxic").to_numpy().astype(np.float64),
        )
        return pa.table({k: [v] for k, v in vars(machine).items()})

    fitted = (
        terms.withColumn("one", F.lit(0))
        .groupBy("one")
        .applyInArrow(one_fit, "bias double, terms binary, linear binary, factors binary")
        .collect()
    )
    if not fitted:
        return fit([], np.zeros(0))
    row = fitted[0]
    return Machine(row.bias, bytes(row.terms), bytes(row.linear), bytes(row.factors))


def scored(
    docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """``docs`` with a score between 0 and 1 for every whole text; null is empty."""
    names = docs.columns
    source = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)),
        text_or_empty(text_col).alias("_text"),
    )
    keep = [f"c{i}" for i in range(len(names))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(machine)
        for batch in batches:
            for part in slices(batch, "_text"):
                found = [score(x) for x in texts(part, "_text")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(found, pa.float64())],
                    names=[*keep, "score"],
                )

    out = source.mapInArrow(kernel, widened(source.select(*keep), "score double"))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keep, names)), F.col("score").alias(score_col))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``."""
    machine = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    return scored(rows.select(id_col, "text"), machine).select(
        id_col,
        held_out(id_col).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    machine = train(docs, labels, id_col, text_col)
    score = free_name(docs, "score")
    return scored(docs, machine, text_col, score).where(F.col(score) < 0.5).drop(score)
