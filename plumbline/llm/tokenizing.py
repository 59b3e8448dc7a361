"""Encoding of whole texts with public tokenizer files, in Arrow batches."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_or_empty, texts, widened, windows

END_ID = 2
#: Words whose ids a Python worker remembers, as many again from before that.
MEMO_WORDS = 250_000
_MISSES_AT_ONCE = 4096


# White space that joins with what stands before it; only in words by themselves.
_OTHER_SPACE = re.compile(r"[^\S \n]")
# Letters in any version of Unicode that are one letter in lower case too and join with none beside them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
# A word of letters and the signs behind it, none of them a letter, number or white space.
_PLAIN = rf"^(?P<core>[{_LETTERS}]+)(?P<stop>[!-/:-@\[-`{{-~]*)$"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level files have for every byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_SPLIT = pa.struct([("core", pa.large_string()), ("stop", pa.large_string())])
# Line ends stay: they separate words.
_BYTE_LETTERS = {b: letter for b, letter in _byte_letters().items() if b != 10}


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer file and how its words may be encoded one by one.

    ``words`` is ``"spaced"`` if a word takes a single blank before it along
    and line ends stand for themselves (byte-level files), ``"separate"`` if
    white space is dropped, and None if texts must be encoded whole, which is
    right for every file. ``lower`` tells that case makes no difference.
    """

    path: str
    words: str | None = None
    lower: bool = False


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes.

    Most words of a text have been seen before, so a worker remembers the ids
    of words, and of words of plain letters without the signs behind them. New
    words of letters go to the file's model, which needs no search for their
    bounds; others are encoded many at a time, in one text with a mark between
    them that is a token of its own.
    """

    # White space runs in which words are not encoded one by one.
    _RUNS = ("  ", " \n", "\n ", "\n\n\n")

    def __init__(self, file: TokenizerFile, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(file.path)
        self.vocabulary_size = self._tokenizer.get_vocab_size()
        self._words, self._lower = file.words, file.lower
        self._memo_words = memo_words
        self._young: dict[str, bytes | None] = {}
        self._old: dict[str, bytes | None] = {}
        self._firsts: dict[str, bytes] = {}
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._mark = "\n" if file.words == "spaced" else "\x01"
        self._mark_id = self._ids(self._mark)
        self._model = self._tokenizer.model
        self._plain = self._merges_alike()

    def _ids(self, text: str) -> np.ndarray:
        found = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, "<u4")

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _spaced_text(self, text: str) -> str | None:
        """A text whose words, between single blanks, have the ids of ``text``
        one after the other; None if there is none."""
        if self._words is None or any(token in text for token in self._special):
            return None
        if self._words == "separate":
            return (text.lower() if self._lower and text.isascii() else text).replace("\n", " ")
        if any(run in text for run in self._RUNS) or text.endswith("\n\n"):
            return None
        return text.replace("\n", " \n")

    def _given(self, word: str) -> str:
        """``word`` with the white space it takes along."""
        return f" {word}" if self._words == "spaced" and word[:1] != "\n" else word

    def _merged(self, cores: list[str]) -> list[bytes]:
        """Ids of words of letters alone, each a token sequence of its own for the file's model.

        The text is prepared for all words at once; the library merges them.
        """
        blank = " " if self._words == "spaced" else ""
        given = "\n".join([blank + c for c in cores]).encode().decode("latin-1").translate(_BYTE_LETTERS)
        found = list(map(self._model.tokenize, given.split("\n")))
        raw = np.array([t.id for tokens in found for t in tokens], "<u4").tobytes()
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _merges_alike(self) -> bool:
        """Whether the file treats every letter of plain words as :meth:`_merged` does."""
        if not self._words or self._mark_id.size != 1:
            return False
        letters = [c for c in map(chr, range(0x250)) if re.match(f"[{_LETTERS}]", c)]
        probes = [*letters, "".join(letters), "".join(reversed(letters)), *map("".join, zip(letters, letters[1:]))]
        merged = self._merged(pc.utf8_lower(probes).to_pylist() if self._lower else probes)
        return merged == [self.whole(self._given(p)) for p in probes]

    def _learn(self, words: list[str]) -> None:
        if self._words == "separate":
            self._learn_alike(words, words, f"{self._mark} ", f" {self._mark} ", 4)
            return
        lines = [w for w in words if w[:1] == "\n"]
        others = [w for w in words if w[:1] != "\n"]
        self._learn_alike(others, [f" {w}" for w in others], "\n", "\n", 4)
        # The mark before these is the line end that they take along.
        self._learn_alike(lines, [w[1:] for w in lines], "\n", "\n", 0)

    def _learn_alike(
        self, words: list[str], given: list[str], before: str, between: str, skip: int
    ) -> None:
        """Learn ``words`` from the ids of ``given``, joined, without the mark's
        first ``skip`` bytes."""
        for at in range(0, len(words), _MISSES_AT_ONCE):
            part, some = words[at : at + _MISSES_AT_ONCE], given[at : at + _MISSES_AT_ONCE]
            text = before + between.join(some)
            marks = text.count(self._mark)
            if self._words == "spaced":
                alike = not _OTHER_SPACE.search(text) and len(text.split()) == len(some)
            else:
                alike = len(text.split()) == len(some) + marks
            if alike and marks == len(some):
                ids = self._ids(text)
                cuts = np.flatnonzero(ids == self._mark_id[0])
                if len(self._mark_id) == 1 and len(cuts) == len(some):
                    raw = ids.tobytes()
                    starts = (4 * cuts + skip).tolist()
                    ends = [*(4 * cuts[1:]).tolist(), len(raw)]
                    self._young.update(zip(part, [raw[a:b] for a, b in zip(starts, ends)]))
                    continue
            if len(part) > 1:  # find the words that do not stand by themselves
                middle = len(part) // 2
                self._learn_alike(part[:middle], some[:middle], before, between, skip)
                self._learn_alike(part[middle:], some[middle:], before, between, skip)
            else:
                self._learn_alone(part[0])

    def _learn_alone(self, word: str) -> None:
        core = word.removeprefix("\n") if self._words == "spaced" else word
        if self._words == "spaced" and core.strip() != core:
            self._young[word] = None  # joins with the white space around it
        else:
            self._young[word] = self.whole(self._given(word))

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of every text of a batch.

        Words are split, told apart and put together again by Arrow; Python
        sees each different word of a batch once, so large batches cost less.
        """
        out: list[bytes | None] = [None] * len(batch)
        places, firsts, rests = [], [], []
        for i, text in enumerate(batch):
            words = self._spaced_text(text)
            if words is None:
                out[i] = self.whole(text)
            elif self._words == "separate":
                places.append(i)
                rests.append(words)
            else:
                first, blank, rest = words.partition(" ")
                out[i] = self._first(first)
                if blank:
                    places.append(i)
                    rests.append(rest)
        split = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        ids, unsafe = self._word_ids(coded.dictionary)
        place = coded.indices.to_numpy()
        sizes = np.diff(ids.offsets.to_numpy())
        raw = ids.take(coded.indices).flatten().to_numpy().tobytes()
        ends = 4 * np.concatenate(([0], np.cumsum(sizes[place], dtype=np.int64)))
        edges = ends[split.offsets.to_numpy()].tolist()
        for i, a, b in zip(places, edges, edges[1:]):
            out[i] = (out[i] or b"") + raw[a:b]
        if len(unsafe):
            held = np.searchsorted(split.offsets.to_numpy(), np.flatnonzero(np.isin(place, unsafe)), side="right")
            for k in np.unique(held).tolist():
                out[places[k - 1]] = self.whole(batch[places[k - 1]])
        return out

    def _word_ids(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """A list of ids for each of ``words``, and which of them make their text unsafe to split.

        Words of plain letters are put together from those and the signs behind.
        """
        n = len(words)
        split = pc.extract_regex(words, _PLAIN) if self._plain else pa.nulls(n, _SPLIT)
        is_plain = split.is_valid().to_numpy(zero_copy_only=False)
        plain, others = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        cores, stops = (x.take(pa.array(plain)) for x in split.flatten())
        cores = (pc.utf8_lower(cores) if self._lower else cores).dictionary_encode()
        stops = stops.dictionary_encode()
        self._turn()
        ids = self._known(cores.dictionary.to_pylist(), self._learn_plain)
        first_stop = len(ids)
        ids += [self._first(x) for x in stops.dictionary.to_pylist()]
        first_other = len(ids)
        found = self._known(words.take(pa.array(others)).to_pylist(), self._learn)
        ids += [x or b"" for x in found]
        unsafe = others[[x is None for x in found]] if None in found else others[:0]
        # Every word is two of these: letters and signs, or itself and the nothing at the end.
        parts = np.full((n, 2), len(ids))
        parts[plain, 0] = cores.indices.to_numpy()
        parts[plain, 1] = first_stop + stops.indices.to_numpy()
        parts[others, 0] = first_other + np.arange(len(others))
        starts = np.cumsum([0, *map(len, ids), 0]) // 4
        flat = pa.array(np.frombuffer(b"".join(ids), "<u4"))
        pairs = pa.LargeListArray.from_arrays(starts, flat).take(pa.array(parts.ravel()))
        return pa.LargeListArray.from_arrays(pairs.offsets.to_numpy()[::2], pairs.values), unsafe

    def _first(self, word: str) -> bytes:
        """Ids of a text's first word, which has no white space before it."""
        known = self._firsts.get(word)
        if known is None:
            if len(self._firsts) > self._memo_words // 8:
                self._firsts.clear()
            known = self._firsts[word] = self.whole(word) if word else b""
        return known

    def _turn(self) -> None:
        if len(self._young) > self._memo_words:
            self._young, self._old = {}, self._young

    def _known(self, words: list[str], learn: Callable[[list[str]], None]) -> list[bytes | None]:
        """The ids of ``words``, which are different; those that nothing is known of are learned."""
        learn([w for w in words if w not in self._young and not self._recalled(w)])
        return list(map(self._young.__getitem__, words))

    def _recalled(self, word: str) -> bool:
        if word not in self._old:
            return False
        self._young[word] = self._old[word]
        return True

    def _learn_plain(self, cores: list[str]) -> None:
        for at in range(0, len(cores), _MISSES_AT_ONCE):
            part = cores[at : at + _MISSES_AT_ONCE]
            self._young.update(zip(part, self._merged(part)))


@lru_cache(maxsize=4)
def encoder(file: TokenizerFile) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(file)


def vocabulary_size(file: TokenizerFile) -> int:
    return encoder(file).vocabulary_size


def encoded(
    docs: DataFrame,
    file: TokenizerFile,
    keep: list[str],
    text_col: str = "text",
    end_id: int | None = END_ID,
    id_bytes: int = 4,
) -> DataFrame:
    """The ``keep`` columns, ``ids`` (little-endian, unsigned) and ``n_tokens``.

    Null texts are empty; ``end_id`` follows every text, if there is one.
    Ids below 65,536 fit ``id_bytes`` of 2.
    """
    source = docs.select(*keep, text_or_empty(text_col).alias("_text"))
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file).encode
        for part in windows(batches, "_text"):
            ids = [x + end for x in encode(texts(part, "_text"))]
            lengths = pa.array([len(x) // 4 for x in ids], pa.int64())
            if id_bytes == 2:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(ids, pa.binary()), lengths],
                names=[*keep, "ids", "n_tokens"],
            )

    return source.mapInArrow(
        kernel, widened(source.select(*keep), "ids binary, n_tokens long")
    )


def token_lengths(
    docs: DataFrame, file: TokenizerFile, keep: list[str], text_col: str = "text", end_id: int | None = END_ID
) -> DataFrame:
    """The ``keep`` columns and ``n_tokens``."""
    return encoded(docs, file, keep, text_col, end_id).select(*keep, F.col("n_tokens"))
