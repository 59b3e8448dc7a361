"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ones and minus ones. A letter's place in a
letter sequence is marked by rotating its vector, the vectors of a sequence
are bound by multiplication, and a text is the sum (bundle) of the vectors of
all its sequences of three. A language's prototype bundles the texts known to
be in it; a text is in the language whose prototype has the largest cosine
with its own bundle. Vectors come from the code points alone, so any script
works and no alphabet is stored.

Results in edge cases:

* a null text, and one without any letter, is ``und`` with score 0;
* texts of any length are read whole, in windows of a bounded number of letters;
* equal texts get equal results, however often they occur; when learning, equal
  texts with one language count once;
* equal cosines go to the smallest language name; negative ones score 0;
* a null id counts as an empty one when the folds are told apart;
* without examples (an empty table, or no language given) every text is ``und``;
* columns other than the id, text and language are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import slices, texts, widened
from plumbline.session import settle

DIMENSIONS = 1024
#: Letters of a sequence.
GRAM = 3
#: Different texts that a language is learned from at most, the smallest by digest.
MAX_TEXTS = 4000
FOLDS = 5
UNKNOWN = "und"
#: Sequences looked at together, and different ones whose vectors are held at once.
_WINDOW = 1 << 20
_VECTORS_AT_ONCE = 4096
_BLANK = 32
#: Steps of a unit: prototypes add whole numbers, in any order alike.
_STEPS = 1 << 20


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the crc32 of the id, as text, is divisible by the number of folds."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """For every code point, 1 if it is a letter, 2 if it is a mark on one, else 0."""
    kind = {"L": 1, "M": 2}
    category = unicodedata.category
    return np.fromiter((kind.get(category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of the lower-case letters of ``text``, a blank for every run
    of other characters and at both ends; nothing if there is no letter."""
    composed = unicodedata.normalize("NFC", text or "").lower()
    codes = np.frombuffer(composed.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _is_letter()[codes]
    if not (kinds == 1).any():
        return np.empty(0, np.uint32)
    padded = np.full(len(codes) + 2, _BLANK, np.uint32)
    padded[1:-1] = np.where(kinds > 0, codes, _BLANK)
    kept = np.ones(len(padded), bool)
    kept[1:] = (padded[1:] != _BLANK) | (padded[:-1] != _BLANK)
    return padded[kept]


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of random signs for every code point: the bits of a counter's hash."""
    words = np.arange(dimensions // 64, dtype=np.uint64)
    x = (codes.astype(np.uint64)[:, None] << np.uint64(16)) + words + np.uint64(1)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - np.int8(1)


def _sequence_vectors(keys: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of letter sequences, given as numbers of 21 bits a letter."""
    letters = [(keys >> (21 * (GRAM - 1 - i)) & 0x1FFFFF).astype(np.uint32) for i in range(GRAM)]
    known, at = np.unique(np.concatenate(letters), return_inverse=True)
    vectors = letter_vectors(known, dimensions)
    bound = np.ones((len(keys), dimensions), np.int8)
    for i, place in enumerate(at.reshape(GRAM, -1)):
        bound *= np.roll(vectors, GRAM - 1 - i, axis=1)[place]
    return bound.astype(np.float32)


def bundles(some: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row for every text: the sum of the vectors of its letter sequences.

    Sums are whole numbers and do not depend on what else is in ``some``.
    """
    out = np.zeros((len(some), dimensions))
    codes = [letter_codes(x) for x in some]
    flat = np.concatenate([np.empty(0, np.uint32), *codes]).astype(np.int64)
    owner = np.repeat(np.arange(len(some)), [len(x) for x in codes])
    for start in range(0, len(flat) - GRAM + 1, _WINDOW):
        stop = min(start + _WINDOW, len(flat) - GRAM + 1)
        whole = owner[start:stop] == owner[start + GRAM - 1 : stop + GRAM - 1]
        keys = np.zeros(stop - start, np.int64)
        for i in range(GRAM):
            keys = keys << 21 | flat[start + i : stop + i]
        keys, row = keys[whole], owner[start:stop][whole]
        if not len(keys):
            continue
        first = int(row[0])
        row, n_rows = row - first, int(row[-1]) - first + 1
        known, at = np.unique(keys, return_inverse=True)
        for low in range(0, len(known), _VECTORS_AT_ONCE):
            part = known[low : low + _VECTORS_AT_ONCE]
            here = (at >= low) & (at < low + len(part)) if len(part) < len(known) else slice(None)
            counts = np.bincount(row[here] * len(part) + at[here] - low, minlength=n_rows * len(part))
            table = counts.reshape(n_rows, len(part)).astype(np.float32)
            # Below 2**24 in every place, hence exact.
            out[first : first + n_rows] += table @ _sequence_vectors(part, dimensions)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class Profiles:
    """Prototypes: languages in ascending order, and their vectors as bytes."""

    languages: tuple[str, ...]
    vectors: bytes
    dimensions: int = DIMENSIONS

    def predict(self, some: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages of texts and their cosines, no less than 0."""
        if not self.languages:
            return [UNKNOWN] * len(some), np.zeros(len(some))
        vectors = np.frombuffer(self.vectors, np.float64).reshape(-1, self.dimensions)
        found = bundles(some, self.dimensions)
        units = _unit(found)
        # Row by row: a product of matrices would round by what else is in them.
        cosines = np.stack([(units * v).sum(axis=1) for v in vectors], axis=1)
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(some)), best], 0.0, 1.0)
        spoken = found.any(axis=1)
        names = [self.languages[b] if s else UNKNOWN for b, s in zip(best, spoken)]
        return names, np.where(spoken, score, 0.0)


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_texts: int = MAX_TEXTS,
    dimensions: int = DIMENSIONS,
) -> Profiles:
    """Prototypes of the non-null languages of ``docs``.

    Of every language at most ``max_texts`` different texts are bundled, those
    with the smallest md5; each weighs the same, whatever its length. Tasks
    bundle what they hold, and only these sums, one for each task and
    language, are brought together.
    """
    known = docs.select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    digest = F.md5("text")
    smallest_first = Window.partitionBy("lang").orderBy("digest")
    limits = settle(
        known.select("lang", digest.alias("digest"))
        .distinct()
        .withColumn("place", F.row_number().over(smallest_first))
        .where(F.col("place") <= max_texts)
        .groupBy("lang")
        .agg(F.max("digest").alias("limit")),
        "language-limits",
    )
    # One row for each language, as the prototypes have.
    examples = (
        known.withColumn("digest", digest)
        .join(F.broadcast(limits), "lang")
        .where(F.col("digest") <= F.col("limit"))
        .dropDuplicates(["lang", "digest"])
    )

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                units = np.rint(_STEPS * _unit(bundles(texts(part, "text"), dimensions))).astype(np.int64)
                languages = part.column("lang").to_pylist()
                for language in set(languages):
                    mine = units[[x == language for x in languages]].sum(axis=0)
                    sums[language] = sums.get(language, 0) + mine
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[x].tobytes() for x in names], pa.binary())],
            names=["lang", "vector"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("vector")], axis=0)
        return pa.table({"lang": table.column("lang")[:1], "vector": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, vector binary"
    rows = (
        examples.select("lang", "text").mapInArrow(bundle, schema).groupBy("lang").applyInArrow(add, schema).collect()
    )
    rows = sorted(rows, key=lambda r: r.lang)
    sums = [np.frombuffer(r.vector, np.int64) for r in rows]
    vectors = np.stack(sums).astype(np.float64) if rows else np.zeros((0, dimensions))
    kept = vectors.any(axis=1)  # a language whose texts have no letter is not learned
    return Profiles(
        tuple(r.lang for r, k in zip(rows, kept) if k), _unit(vectors[kept]).tobytes(), dimensions
    )


def predicted(docs: DataFrame, profiles: Profiles, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` of every row of ``docs``."""
    source = docs.select(*keep, F.col(f"`{text_col}`").cast("string").alias("_text"))
    kept = source.columns[:-1]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                names, scores = profiles.predict(texts(part, "_text"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*kept, "lang_pred", "score"],
                )

    return source.mapInArrow(kernel, widened(source.select(*kept), "lang_pred string, score double"))


def document_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, learned from those not held out."""
    profiles = train(docs.where(~held_out(id_col)), text_col, lang_col)
    keep = [F.col(f"`{id_col}`").alias(id_col), held_out(id_col).alias("held_out")]
    return predicted(docs, profiles, keep, text_col)
