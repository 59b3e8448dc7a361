import random

import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.operators.components import components


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(fps):
    """fps: list of (key, fingerprint); class of each place by its smallest key."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    smallest = {}
    for i, (key, _) in enumerate(fps):
        smallest[root(i)] = min(smallest.get(root(i), key), key)
    return [smallest[root(i)] for i in range(len(fps))]


TEXTS = [
    "", None, " \t\n ", "one", "ONE", "two words", "Two\x0bWords", "a b c", "a  b\tc", "É b c", "é b c", "a\x1cb c d",
    "a b c d", "the quick brown fox jumps over the lazy dog " * 40, "the quick brown fox jumps over the lazy dog " * 39,
    "x " * 5000, "word" * 20_000,
]


def test_fingerprints_and_classes(docs_of):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = list(TEXTS)
    for _ in range(20):
        words = rng.choices(vocabulary, k=400)
        for _ in range(4):
            texts.append(" ".join(words))
            words[rng.randrange(400)] = "changed"
    rows = list(enumerate(texts, 1))
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    expected = {i: (f, c) for (i, f), c in zip(fps, slow_classes(fps))}
    got = simhash.near_duplicate_classes(docs_of(rows)).select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("hex"), "component_id"
    )
    assert {r.doc_id: (int(r.hex, 16), r.component_id) for r in got.collect()} == expected
    assert all(len(r.hex) == 16 for r in got.collect())


def clouds(seed=1, size=400):
    """Random fingerprints and dense clouds, where cells are crowded and paths long."""
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(size)} | {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1}
    for centre in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(size):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    walk = rng.getrandbits(64)
    for b in range(0, 62, 2):
        fps.add(walk)
        walk ^= 3 << b
    return sorted(fps)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_join_what_is_within_two_bits(spark):
    fps = clouds()
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    keys = [(signed(x), x) for x in fps]
    expected = dict(zip([k for k, _ in keys], slow_classes(keys)))
    for pairs_up_to in (2, 24, 10_000):
        links = simhash.fingerprint_links(df, pairs_up_to).collect()
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
        rooted = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert {x: rooted.get(x, x) for x in expected} == expected


def test_one_of_each_class(docs_of):
    rows = [(5, "a b c"), (2, "A b  c"), (2, "A b  c"), (9, None), (None, "q r s"), (7, ""), (None, "q r S")]
    df = docs_of(rows)
    kept = simhash.one_of_each_class(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept.collect()) == [("2", "a b  c"), ("7", ""), ("None", "q r s")]


def test_empty_table(docs_of):
    empty = docs_of([(1, "x")]).where("doc_id > 1")
    assert simhash.near_duplicate_classes(empty).count() == 0
    assert simhash.one_of_each_class(empty).count() == 0


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1400)}}
