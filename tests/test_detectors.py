"""Matrix, forest, density and agreement against brute force and invariants."""

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import agreement, density, isolation, matrix, profile
from plumbline.session import settle

SCHEMA = "k string, id long, x double, y double, z double"


def points(spark, n=400, seed=3, copies=0, width=3):
    """Two blobs and scattered points; optionally a third are copies of one point."""
    rng = np.random.default_rng(seed)
    rows = np.vstack(
        [
            rng.normal(0, 0.3, (n // 2, 3)),
            rng.normal(3, 0.5, (n // 2 - 20, 3)),
            rng.uniform(-6, 9, (20, 3)),
            np.tile([[0.1, 0.2, 0.3]], (copies, 1)),
        ]
    )
    data = [("a", i, *map(float, row)) for i, row in enumerate(rows)]
    names = ["x", "y", "z"][:width]
    return spark.createDataFrame(data, SCHEMA).select("k", "id", *names), names


def build(df, names, **kw):
    return matrix.numeric_matrix(df, "id", "k", names, **kw)


def collect(numbers):
    rows = sorted(numbers.collect(), key=lambda r: r.row_id)
    return [r.row_id for r in rows], np.array([list(r.features) for r in rows])


def brute_force(x, multiplier=1.0):
    """Noise flags, eps and cluster count by the textbook definitions."""
    n, width = x.shape
    minpts = max(2 * width, 4)
    dist = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    kth = np.sort(dist, axis=1)[:, minpts - 1]
    eps = np.percentile(kth, 90) * multiplier
    eps = eps if eps > 0 else 0.5
    near = dist <= eps
    core = near.sum(axis=1) >= minpts
    noise = ~core & ~(near & core[None, :]).any(axis=1)
    label, groups = np.full(n, -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = groups
                todo += list(np.flatnonzero(near[j] & core & (label < 0)))
        groups += 1
    return noise, eps, groups


@pytest.mark.parametrize(
    "n, copies, width, multiplier",
    [(420, 0, 2, 1.0), (420, 210, 2, 1.0), (1500, 0, 3, 1.0), (302, 0, 1, 1.0), (420, 0, 2, 0.5)]
    + [(4000, 2000, 2, 1.0), (60, 900, 2, 1.0)],
)
def test_density_matches_brute_force(spark, n, copies, width, multiplier):
    df, names = points(spark, n, copies=copies, width=width)
    numbers = build(df, names).persist()
    ids, x = collect(numbers)
    noise, eps, groups = brute_force(x, multiplier)
    found = density.DensityNoise(numbers, eps_multiplier=multiplier)
    flags = {r.row_id: r.noise for r in found.labels().collect()}
    assert [flags[i] for i in ids] == noise.tolist()
    row = found.summary(spark.createDataFrame([("a",)], "dataset_id string")).first()
    assert row.eps_used == pytest.approx(eps, rel=1e-9)
    assert row.n_clusters == groups
    assert row.noise_rate == pytest.approx(noise.mean())
    assert row.minpts == max(2 * width, 4) and row.n_records == len(ids)


@pytest.mark.parametrize("copies", [0, 500])
def test_density_in_many_small_blocks(spark, monkeypatch, copies):
    """Hundreds of blocks in three features; once half of the rows are alike."""
    monkeypatch.setattr(density, "_BLOCK", 2)
    df, names = points(spark, 500, copies=copies)
    order, x = collect(build(df, names))
    noise, eps, groups = brute_force(x)
    found = density.DensityNoise(build(df, names))
    assert found.vectors.select("block").distinct().count() > 150
    got = {r.row_id: r.noise for r in found.labels().collect()}
    assert [got[i] for i in order] == list(noise)
    assert found.eps.first().eps == pytest.approx(eps)
    assert found.cluster_counts().first().n_clusters == groups


def test_density_needs_more_rows_than_minpts(spark):
    df = spark.range(12).select(
        F.lit("a").alias("k"), "id", *[(F.rand(i) * 9).alias(f"f{i}") for i in range(6)]
    )
    numbers = build(df, [f"f{i}" for i in range(6)])
    keys = spark.createDataFrame([("a",)], "dataset_id string")
    row = density.DensityNoise(numbers).summary(keys).first()
    assert row.applicable is False and row.noise_rate is None and row.n_clusters == 0


def test_results_do_not_depend_on_partitioning(spark):
    df, names = points(spark, 600)
    seen = set()
    for parts in (1, 4, 16):
        numbers = build(df.repartition(parts), names).persist()
        scores = isolation.isolation_scores(numbers)
        noise = density.DensityNoise(numbers).labels()
        seen.add(
            (
                tuple(sorted((r.row_id, round(r.score, 12)) for r in scores.collect())),
                tuple(sorted((r.row_id, r.noise) for r in noise.collect())),
            )
        )
    assert len(seen) == 1


def test_forest_rate_identity_and_planted_outliers(spark):
    df, names = points(spark, 500)
    planted = spark.createDataFrame([("a", 9000 + i, 40.0 + i, -40.0, 40.0) for i in range(3)], SCHEMA)
    df = df.unionByName(planted)
    numbers = build(df, names).persist()
    scores = isolation.isolation_scores(numbers).persist()
    top = [r.row_id for r in scores.orderBy(F.desc("score")).limit(3).collect()]
    assert set(top) == {"9000", "9001", "9002"}
    n = scores.count()
    keys = spark.createDataFrame([("a",), ("none",)], "dataset_id string")
    sweep = isolation.contamination_sweep(scores, keys).collect()
    for row in sweep:
        if row.dataset_id == "none":
            assert (row.anomaly_rate, row.applicable) == (None, False)
        else:
            assert row.anomaly_rate == pytest.approx(
                np.ceil(round((n - 1) * row.contamination, 9)) / n
            )
    summary = isolation.anomaly_summary(isolation.anomaly_labels(scores), numbers, keys)
    got = {r.dataset_id: r for r in summary.collect()}
    assert got["none"].applicable is False and got["none"].n_records == 0
    assert got["a"].accuracy_proxy == pytest.approx(1 - got["a"].anomaly_rate)
    assert got["a"].n_features == 3 and 0.3 < got["a"].anomaly_score_mean < 0.6


def test_trees_draw_alike_from_all_rows(spark):
    """Few rows are drawn, every tree takes its sample, no row is favoured; small datasets give all."""
    large = spark.range(4000).selectExpr(
        "'a' dataset_id", "CAST(id AS STRING) row_id", "array(CAST(id AS DOUBLE)) features", "4000 n_records"
    )
    small = spark.range(90).selectExpr(
        "'b' dataset_id", "CAST(id AS STRING) row_id", "array(CAST(id AS DOUBLE)) features", "90 n_records"
    )
    both = large.unionByName(small)
    drawn = isolation.tree_rows(both, trees=60, sample=50).toPandas()
    sizes = drawn.groupby(["dataset_id", "tree"])["row_id"].agg(["size", "nunique"])
    assert len(sizes) == 120 and (sizes == 50).all().all()
    a = drawn[drawn["dataset_id"] == "a"]
    times = a["row_id"].value_counts().reindex([str(i) for i in range(4000)], fill_value=0)
    assert times.var() == pytest.approx(60 * (50 / 4000) * (1 - 50 / 4000), rel=0.1)
    assert a["row_id"].astype(int).mean() == pytest.approx(1999.5, abs=70)
    together = a.merge(a, on="row_id").query("tree_x < tree_y").groupby(["tree_x", "tree_y"]).size()
    assert together.sum() / (60 * 59 / 2) == pytest.approx(50 * 50 / 4000, rel=0.15)
    assert isolation.tree_rows(both, trees=1, sample=500).count() == 590
    again = isolation.tree_rows(both.repartition(5), trees=60, sample=50).toPandas()
    key = ["dataset_id", "tree", "row_id"]
    assert sorted(map(tuple, drawn[key].to_numpy())) == sorted(map(tuple, again[key].to_numpy()))


def test_forest_ignores_affine_rescaling(spark):
    df, names = points(spark, 300)
    scaled = df.select("k", "id", *[(F.col(n) * 8 - 2).alias(n) for n in names])
    one = {r.row_id: r.score for r in isolation.isolation_scores(build(df, names)).collect()}
    two = {r.row_id: r.score for r in isolation.isolation_scores(build(scaled, names)).collect()}
    agree = sum(abs(one[i] - two[i]) < 1e-9 for i in one)
    assert agree >= 0.98 * len(one)


def test_forest_of_identical_rows(spark):
    df = spark.range(40).select(F.lit("a").alias("k"), "id", F.lit(1.0).alias("x"))
    scores = isolation.isolation_scores(build(df, ["x"]))
    assert scores.select("score").distinct().count() == 1
    assert isolation.anomaly_labels(scores).where("anomaly").count() == 0


def test_scoring_splits_large_datasets(spark):
    df = spark.range(40_000).select(
        F.lit("a").alias("k"), "id", F.randn(1).alias("x"), F.randn(2).alias("y")
    )
    numbers = build(df, ["x", "y"]).persist()
    scores = isolation.isolation_scores(numbers)
    assert scores.select("row_id").distinct().count() == 40_000
    extreme = numbers.withColumn("r", F.abs(F.col("features")[0]) + F.abs(F.col("features")[1]))
    assert scores.join(extreme, ["dataset_id", "row_id"]).stat.corr("score", "r") > 0.7


def test_matrix_steps(spark):
    inf, nan = float("inf"), float("nan")
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, None, nan, inf, -inf]
    df = spark.createDataFrame([("a", i, v, True, 7) for i, v in enumerate(values)],
                               "k string, id long, x double, flag boolean, c int")
    _, x = collect(matrix.numeric_matrix(df, "id", "k", ["x", "flag", "c"]))
    # Infinities take part in the median (5.5), then their rows go.
    kept = np.array([*range(1, 11), 5.5, 5.5])
    expected = (kept - kept.mean()) / kept.std()
    assert sorted(x[:, 0]) == pytest.approx(sorted(expected))
    assert x.shape == (12, 2) and set(x[:, 1]) == {0.0}


@pytest.mark.parametrize("n, rows", [(9, 0), (10, 10)])
def test_matrix_needs_ten_rows(spark, n, rows):
    df = spark.range(n).select(F.lit("a").alias("k"), "id", F.col("id").cast("double").alias("x"))
    assert build(df, ["x"]).count() == rows


def test_all_null_column_empties_the_matrix(spark):
    df = spark.range(30).selectExpr("'a' k", "id", "double(id) x", "cast(null as double) y")
    assert build(df, ["x", "y"]).count() == 0
    assert build(df, ["x"]).count() == 30


def test_no_numeric_column(spark):
    df = spark.range(30).selectExpr("'a' k", "id", "'t' t")
    assert matrix.numeric_matrix(df, "id", "k", ["t"]).count() == 0


def test_every_row_of_a_large_dataset_is_judged(spark):
    df = spark.range(60_000).selectExpr(
        "'a' k", "id", "double(id * 7919 % 60000) x", "double(id * 104729 % 59999) y"
    )
    numbers = settle(build(df, ["x", "y"]), "large")
    assert numbers.count() == 60_000 and numbers.first().n_records == 60_000
    scores = isolation.isolation_scores(numbers)
    assert scores.where("score is not null").select("row_id").distinct().count() == 60_000
    noise = density.DensityNoise(numbers).labels()
    assert noise.where("noise is not null").select("row_id").distinct().count() == 60_000


def test_trees_draw_the_smallest_digests(spark):
    df = spark.range(3000).selectExpr("'a' k", "id", "double(id) x")
    numbers = build(df, ["x"])
    drawn = isolation.tree_rows(numbers, trees=11, sample=64)
    got = {}
    for r in drawn.collect():
        got.setdefault(r.tree, set()).add(r.row_id)
    share = isolation.lots_wanted(64) / 3000
    chances = np.cumsum([comb(11, k) * share**k * (1 - share) ** (11 - k) for k in range(11)])
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    lots = {t: [] for t in range(11)}
    for i in range(3000):
        digest = md5(f"42/{i}")
        number = int((chances <= int(digest[:13], 16) / 2**52).sum())
        first, step = int(digest[13:20], 16) % 11, 1 + int(digest[20:27], 16) % 10
        for j in range(number):
            lots[(first + j * step) % 11].append(str(i))
    for t in range(11):
        assert got[t] == set(sorted(lots[t], key=lambda i: md5(f"42:{t}:{i}"))[:64])


def test_agreement_edges(spark):
    def table(name, *flags):
        return spark.createDataFrame(
            [("a", str(i), f) for i, f in enumerate(flags)], f"dataset_id string, row_id string, {name} boolean"
        )

    none = agreement.detector_agreement(table("anomaly", False, False), table("noise", False, False))
    row = none.first()
    assert (row.kappa, row.jaccard, row.kappa_interp) == (None, 0.0, "n/a")
    same = agreement.detector_agreement(table("anomaly", True, False), table("noise", True, False))
    assert (same.first().kappa, same.first().jaccard) == (1.0, 1.0)
    uneven = agreement.detector_agreement(table("anomaly", True), table("noise", True, False))
    assert uneven.count() == 0


def test_published_agreement_counts(spark):
    # Counts and measures of two published datasets.
    counted = spark.createDataFrame(
        [("p", 28, 50, 28, 559), ("q", 2, 0, 0, 29)],
        "dataset_id string, if_anom_count long, dbscan_noise_count long, overlap long, n_records long",
    )
    got = {r.dataset_id: r for r in agreement.agreement_measures(counted).collect()}
    assert got["p"].kappa == pytest.approx(0.6985932062153817) and got["p"].jaccard == 0.56
    assert (got["q"].kappa, got["q"].kappa_interp) == (0.0, "slight")


def test_rank_stability_constant_side(spark):
    rows = [(d, c, 0.1 if c == 0.02 else i / 10) for i, d in enumerate("abc") for c in (0.02, 0.05)]
    sweep = spark.createDataFrame(rows, "dataset_id string, contamination double, anomaly_rate double")
    got = {
        r.contamination: r.spearman
        for r in isolation.rank_stability(sweep, 0.05, [0.02, 0.05]).collect()
    }
    assert got == {0.02: None, 0.05: 1.0}


def test_keys_of_a_whole_frame(spark):
    assert profile.dataset_keys(spark.range(3), None).first().dataset_id == "all"


def test_agreement_of_repeated_and_missing_rows(spark):
    def table(flag, rows):
        return spark.createDataFrame(rows, f"dataset_id string, row_id string, {flag} boolean")

    left = [("a", "1", True), ("a", "1", False), ("a", "2", None), ("b", "1", True), ("b", "2", False), ("c", None, True), ("c", "1", True), (None, "1", True), ("d", "1", True)]
    right = [("a", "1", True), ("a", "1", True), ("a", "2", True), ("b", "1", None), ("b", "2", True), ("c", None, True), ("c", "1", True), (None, "1", True), ("e", "1", True)]
    found = agreement.detector_agreement(table("anomaly", left), table("noise", right)).collect()
    assert [(r.dataset_id, r.if_anom_count, r.dbscan_noise_count, r.overlap, r.n_records) for r in found] == [("b", 1, 1, 0, 2)]


def test_agreement_meets_rows_once(spark):
    flags = spark.range(100).selectExpr("'d' AS dataset_id", "string(id) AS row_id", "id % 3 = 0 AS anomaly")
    found = agreement.detector_agreement(flags, flags.withColumnRenamed("anomaly", "noise"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Range") == 2


def test_points_at_home_do_not_move_again(spark):
    rng = np.random.default_rng(5)
    rows = [("d", str(i), [float(x), float(y)]) for i, (x, y) in enumerate(rng.normal(size=(6000, 2)))]
    df = spark.createDataFrame(rows, "dataset_id string, row_id string, features array<double>")
    numbers = df.selectExpr("*", "6000 AS n_records", "2 AS n_features")
    names, settle = [], density.settle
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(density, "settle", lambda frame, name, by=None: (names.append((name, frame)), settle(frame, name, by))[1])
        noise = density.DensityNoise(numbers)
    local = next(frame for name, frame in names if name == "neighbours")
    assert names and "placed-vectors" not in [name for name, _ in names]  # written once, at the end
    assert local.count() == 6000  # a row a point, with its list
    assert local.where("leaves").count() < 3000
    lists = [(r.vec_id, [n.dist for n in r.near]) for r in density.nearest_neighbours(noise.vectors).collect()]
    points = np.array([r[2] for r in rows])
    for vec, near in lists[::97]:
        want = np.sort(np.sqrt(((points - points[int(vec)]) ** 2).sum(axis=1)))[:4]
        assert np.allclose(near, want)


def test_large_blocks_compare_few_pairs(monkeypatch):
    """Lists inside a block and from outside are those of all pairs, at a small part of their distances."""
    rng, made, found = np.random.default_rng(6), [0], density._Groups._found
    n, weights = 20_000, rng.integers(1, 3, 20_000)
    x = rng.normal(size=(n, 2))
    block = pa.table(
        {
            "dataset_id": ["d"] * n,
            "vec_id": [str(i) for i in range(n)],
            "block": [1] * n,
            "minpts": [4] * n,
            "weight": weights,
            "features": pa.array(x.tolist()),
        }
    )

    def counted(groups, asking, which):
        made[0] += asking.shape[0] * asking.shape[1] * groups.members.shape[1]
        return found(groups, asking, which)

    monkeypatch.setattr(density._Groups, "_found", counted)
    rows = density._search_block(block).to_pylist()
    assert made[0] < n * n / 50 and sorted(int(r["vec_id"]) for r in rows) == list(range(n))
    for row in rows[::199]:
        away = np.sqrt(((x - x[int(row["vec_id"])]) ** 2).sum(axis=1))
        order = np.argsort(away)
        reach = away[order][np.argmax(np.cumsum(weights[order]) >= 4)]
        assert row["reach"] == pytest.approx(reach)
        near = [(p["dist"], int(p["id"])) for p in row["near"] if p["dist"] <= reach]
        assert [i for _, i in near] == [i for i in order if away[i] <= reach]
    asking = block.slice(0, 50).append_column("reach", pa.array(np.full(50, 0.05)))
    lists = {r["vec_id"]: [p["dist"] for p in r["near"]] for r in density._search_visitors(asking, block).to_pylist()}
    for i in range(50):
        away = np.sort(np.sqrt(((x - x[i]) ** 2).sum(axis=1)))
        assert lists[str(i)] == pytest.approx([a for a in away[:4] if a <= 0.05])


def test_blocks_are_large_and_few_points_leave_them(spark):
    rng = np.random.default_rng(7)
    data = [("d", str(i), [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(40_000, 2)))]
    df = spark.createDataFrame(data, "dataset_id string, row_id string, features array<double>")
    vectors = density.weighted_vectors(df.selectExpr("*", "40000 AS n_records", "2 AS n_features"))
    assert vectors.select("block").distinct().count() <= 16
    blocks = vectors.drop("path").groupBy("dataset_id", "block")
    leaving = blocks.applyInArrow(density._search_block, density._LOCAL).where("leaves").count()
    assert leaving < 40_000 / 8


def test_trees_are_walked_as_by_hand():
    rng = np.random.default_rng(8)
    depth, psi, feature, cut, path = isolation._grow(rng.normal(size=(5, 64, 2)), 42, "k")
    x, nodes = rng.normal(size=(5000, 2)), 2 ** (depth + 1)
    scores = isolation._score(x, depth, psi, feature, cut, path)
    for i in range(0, 5000, 97):
        total = 0.0
        for tree in range(5):
            node = 1
            while (axis := feature[tree * nodes + node]) >= 0:
                node = 2 * node + int(x[i, axis] > cut[tree * nodes + node])
            total += path[tree * nodes + node]
        assert scores[i] == pytest.approx(2.0 ** (-total / 5 / isolation._expected_path(np.array([psi]))[0]))


def test_no_table_of_rows_by_trees_is_walked():
    """What is taken from the forest while rows walk is one tree's, not every tree's for every row."""
    import tracemalloc

    rng = np.random.default_rng(9)
    forest = isolation._grow(rng.normal(size=(100, 64, 2)), 42, "k")
    x = rng.normal(size=(1024, 2))
    tracemalloc.start()
    isolation._score(x, *forest)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 1024 * 100 * 8
