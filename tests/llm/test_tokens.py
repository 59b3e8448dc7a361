import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import packing, token_counts, token_files
from plumbline.llm.common import windows
from plumbline.llm.queries import BYTE_BPE, WORD_BPE
from plumbline.llm.tokenizing import Encoder, TokenizerFile

TEXTS = [
    "", None, " ", "  ", "\n", "a", " a", "a ", "a\n", "\na", "a b", "a  b", "a \nb", "a\n\nb", "a\tb \t c",
    "It's they'll we've  DON'T", "x1 22 333", "É é ß Σας ΣΑΣ", "é ́ x", " a b", "a\x1cb \x1d c",
    "日本語 テキスト", "😀 👩‍👩‍👧 ok", "a<|endoftext|> b", "<|startoftext|>x <|endoftext|>", "tab\tand\r\nline\r\n",
    "word " * 3000, "antidisestablishment" * 400, "  a b 　c",
]


def ids_of(file, text, end=True):
    t = Tokenizer.from_file(file.path)
    return t.encode(text or "", add_special_tokens=False).ids + [2] * end


@pytest.mark.parametrize("file", [BYTE_BPE, WORD_BPE], ids=["byte", "word"])
def test_words_one_by_one_give_the_ids_of_the_whole(file):
    encoder = Encoder(file, memo_words=50)
    plain = Tokenizer.from_file(file.path)
    for _ in range(2):
        got = encoder.encode([t or "" for t in TEXTS])
        for text, ids in zip(TEXTS, got):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text

    for text in ("s\n\n\tx", "a\n\n\x85b", "1\n\n\u3000c d", "x\t\n y", "x \ty z\t w", "q\r\n\r\nr s", "İ. İ, x"):
        ids = np.frombuffer(encoder.encode([text, "a b c"])[0], "<u4").tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids, text

    pool = st.text(alphabet=" \n\t\r \x1c\x85　ab1é'sΣ.,!日😀́<|>", max_size=30)

    @settings(max_examples=400, deadline=None, database=None)
    @given(pool)
    def check(text):
        ids = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids

    check()


SIGNS = [a + b for a in ("", *".,!?;:'") for b in ("", "...", "%%%", "&&&", "''", "_)", "]`{~", '"')]


@pytest.mark.parametrize("file", [BYTE_BPE, WORD_BPE], ids=["byte", "word"])
def test_words_share_what_is_known_of_their_letters(file):
    cores = ["Word", "beßsch", "Ünder", "ĳssel", "Ǆungla", "queêier", "isn", "Ⱥbc", "ŉord"]
    # Behind each: what is no plain word, though it starts like one.
    odd = ["isn't", "x1", "İst.", "naïve\u0308", "abc\u0301.", "日本.", "'s", "word.word", "×.", "ªb", "a\u02b0."]
    text = " ".join(["start", *odd, *(c + s for s in SIGNS for c in cores)])
    encoder, whole = Encoder(file), Tokenizer.from_file(file.path)
    for given in (text, text.replace(" ", "\n"), text.upper()):
        got = encoder.encode([given, "", "a b", given])
        assert np.frombuffer(got[0], "<u4").tolist() == whole.encode(given, add_special_tokens=False).ids
        assert got[3] == got[0] and got[1] == b""
    fresh = Encoder(file)
    fresh.encode([text])
    assert len(fresh._young) <= len(cores) + len(odd) + 1


def test_windows_hold_every_row_once_within_bounds():
    rows = ["x" * n for n in (5, 0, 30, 7, 7, 7, 200, 1)] + [None, "y"]
    batches = [pa.RecordBatch.from_pydict({"i": [k], "t": pa.array([x], pa.string())}) for k, x in enumerate(rows)]
    got = list(windows(iter(batches + [pa.concat_batches(batches)]), "t", 4, 40))
    assert [x for w in got for x in w.column("t").to_pylist()] == rows * 2
    assert all(w.num_rows <= 4 and sum(len(x or "") for x in w.column("t").to_pylist()) <= 40 for w in got if w.num_rows > 1)
    assert len(got) < 2 * len(rows)


ROWS = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (6, "same id"), (6, "same id")]


# Packing ------------------------------------------------------------------


@given(st.lists(st.integers(1, 63), max_size=60))
@settings(max_examples=150, deadline=None, database=None)
def test_best_fit_takes_the_fullest_bin(fills):
    fills = sorted(fills, reverse=True)
    expected, rooms = [], []
    for i, f in enumerate(fills):
        fits = [r for r in rooms if r[0] >= f]
        if fits:
            least = min(r[0] for r in fits)
            at = [k for k, r in enumerate(rooms) if r[0] == least]
            assert at
            rooms[at[0]][0] -= f
            rooms[at[0]][1].append(i)
        else:
            rooms.append([64 - f, [i]])
    got = packing.best_fit(fills, 64)
    assert sorted(sum(got, [])) == list(range(len(fills)))
    assert Counter(sum(fills[i] for i in b) for b in got) == Counter(64 - r[0] for r in rooms)


def check_layout(rows, capacity):
    spans = {}
    for sequence, offset, length in rows:
        spans.setdefault(sequence, []).append((offset, length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def test_packing_in_rounds_is_gapless_and_tight(spark):
    rng = random.Random(2)
    lengths = [min(1024, int(rng.expovariate(1 / 250)) + 1) for _ in range(4000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long").repartition(4)
    for group_items, slack in ((100_000, 1.01), (150, 1.06)):
        got = packing.pack(items, 1024, group_items).collect()
        assert sorted(r.pid for r in got) == list(range(4000))
        used = check_layout([(r.sequence_id, r.offset, lengths[r.pid]) for r in got], 1024)
        assert used <= slack * -(-sum(lengths) // 1024) + 1
    light = spark.createDataFrame([(i, 300) for i in range(64)], "pid long, length long")
    assert packing.pack(light, 1024, 1).select("sequence_id").distinct().count() <= 32


def test_packed_documents(docs_of):
    got = packing.packed_documents(docs_of(ROWS), BYTE_BPE).collect()
    expected = Counter()
    for i, text in ROWS:
        ids = ids_of(BYTE_BPE, text)
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            expected[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    check_layout([(r.sequence_id, r.offset, r.length) for r in got], 1024)


def test_sequences_hold_the_pieces(docs_of):
    packed = packing.packed_documents(docs_of(ROWS[5:15]), BYTE_BPE, capacity=16)
    packed = packed.persist()
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        part = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert part.tolist() == np.frombuffer(r.ids, "<u4").tolist()
    packed.unpersist()


def test_packing_nothing(docs_of):
    assert packing.packed_documents(docs_of([(1, "x")]).where("doc_id > 1"), BYTE_BPE).count() == 0


# Token files --------------------------------------------------------------


def slow_best_cost(counts, most):
    """Cost of the best code of limited length, by trying all sorted length vectors."""
    counts = sorted(counts, reverse=True)
    best = None

    def extend(at, last, room, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if at == len(counts):
            best = cost
            return
        for size in range(last, most + 1):
            if room >= 2 ** (most - size) * (len(counts) - at) or room >= 2 ** (most - size):
                extend(at + 1, size, room - 2 ** (most - size), cost + size * counts[at])

    extend(0, 1, 2**most, 0)
    return best


@given(st.lists(st.integers(1, 200), min_size=2, max_size=7), st.integers(3, 5))
@settings(max_examples=60, deadline=None, database=None)
def test_code_lengths_are_optimal(counts, most):
    lengths = token_files.code_lengths(np.array(counts), most)
    assert lengths.max() <= most and sum(2.0 ** -lengths.astype(float)) <= 1
    assert int((lengths.astype(int) * np.array(counts)).sum()) == slow_best_cost(counts, most)


def test_code_round_trip():
    rng = np.random.default_rng(1)
    for ids in (
        np.zeros(5, np.uint32),
        rng.zipf(1.3, 70_000).clip(0, 49_000).astype(np.uint32),
        rng.integers(0, 40_000, 300).astype(np.uint32),
        np.empty(0, np.uint32),
    ):
        seen, counts = np.unique(np.concatenate((ids, [7])).astype(np.uint32), return_counts=True)
        code = token_files.Code(seen, token_files.code_lengths(counts))
        bits, checkpoints = code.encode(ids)
        assert code.decode(bits, checkpoints, len(ids)).tolist() == ids.tolist()
        for k in range(0, len(checkpoints), 37):  # from any checkpoint on
            rest = code.decode(bits, checkpoints[k:], len(ids) - 64 * k)
            assert rest.tolist() == ids[64 * k :].tolist()


def test_files_give_back_all_ids(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(docs_of(ROWS), path, WORD_BPE)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    at, order = 0, []
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
        order.append(-1 if r.doc_id is None else r.doc_id)
    assert order == sorted(order)
    expected = Counter((i, tuple(ids_of(WORD_BPE, t))) for i, t in ROWS)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == expected


def test_files_of_nothing(spark, docs_of, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(docs_of([(1, "x")]).where("doc_id > 1"), path, WORD_BPE)
    assert token_files.read_token_files(spark, path).count() == 0


# Counts -------------------------------------------------------------------


def test_histogram_answers(docs_of, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 8)
    lengths = [len(ids_of(BYTE_BPE, t, end=False)) for _, t in ROWS]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs_of(ROWS), BYTE_BPE)).persist()
    by_length = {r.length: r for r in sums.collect()}
    assert set(by_length) == set(lengths)
    for n, r in by_length.items():
        assert r.n_docs == lengths.count(n)
        assert r.docs_from == sum(x >= n for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= n)
        assert r.n_tokens == sum(lengths)
        assert r.tokens_within == sum(min(x, n) for x in lengths)
    for r in token_counts.totals_at(sums, [0, 1, 3, 7, 1000, 10**6]).collect():
        assert r.tokens_within == sum(min(x, r.limit) for x in lengths)
        assert r.docs_cut == sum(x > r.limit for x in lengths)
        assert (r.n_docs, r.n_tokens) == (len(lengths), sum(lengths))
    for r in token_counts.quantiles(sums, [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        ranked = sorted(lengths)
        need = r.share * len(ranked)
        assert r.length == min(x for x in ranked if sum(y <= x for y in ranked) >= need)
    sums.unpersist()


def test_counts_of_nothing(docs_of):
    empty = docs_of([(1, "x")]).where("doc_id > 1")
    sums = token_counts.suffix_sums(token_counts.length_histogram(empty, BYTE_BPE))
    assert sums.count() == 0
    row = token_counts.totals_at(sums, [5]).first()
    assert (row.n_docs, row.n_tokens, row.docs_cut, row.tokens_within) == (0, 0, 0, 0)


def test_files_without_known_words_are_encoded_whole():
    plain = Encoder(TokenizerFile(BYTE_BPE.path))
    assert np.frombuffer(plain.encode(["a  b c"])[0], "<u4").tolist() == ids_of(BYTE_BPE, "a  b c", end=False)
