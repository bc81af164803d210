"""Embedding metrics on clusters with known structure, and block pairs against plain numpy."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motefield.catalog import load
from motefield.catalog.registry import QUERIES
from motefield.functions.tails import chi2_upper, incomplete_beta, t_quantile, t_two_sided
from motefield.operators import embeddings as ops
from motefield.operators import joins as jo
from motefield.operators import pairs
from motefield.operators import prototypes as pr
from motefield.operators import similarity as sim
from motefield.operators.pairs import map_with_table, small_table
from motefield.operators.scoring import score


def table(spark, x, labels):
    rows = [(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id long, cls int, feature array<double>")


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(5, 1, (30, 10)), rng.normal(-5, 1, (60, 10))])
    y = np.repeat([0, 1], [30, 60])
    return x, y, table(spark, x, y)


def all_distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def test_separated_clusters(clusters):
    _, _, df = clusters
    got = {r["metric"]: r["value"] for r in ops.class_separation(df).collect()}
    assert got["davies_bouldin"] < 1 and got["silhouette"] > 0.5 and got["separation_ratio"] > 2


def test_pair_moments_match_numpy_for_any_block_size(clusters):
    x, y, df = clusters
    d, upper = all_distances(x), np.triu(np.ones((90, 90), bool), 1)
    same = y[:, None] == y[None]
    for partitions in (1, 7):
        got = {r["same"]: r for r in ops.pair_moments(df.repartition(partitions)).collect()}
        for flag in (True, False):
            want = d[upper & (same == flag)]
            assert got[flag]["n_pairs"] == want.size
            assert got[flag]["mean_distance"] == pytest.approx(want.mean())
            assert got[flag]["std_distance"] == pytest.approx(want.std())


def test_near_duplicates_keep_their_distance(spark):
    x = np.array([[1000.0, 1000.0], [1000.0, 1000.0 + 1e-7], [1000.0, 1000.0]])
    got = ops.pair_moments(table(spark, x, [0, 0, 0])).first()
    assert got["mean_distance"] == pytest.approx(all_distances(x)[np.triu_indices(3, 1)].mean(), rel=1e-6)


def test_one_class_and_single_rows(spark):
    x = np.random.default_rng(3).normal(size=(6, 3))
    one = table(spark, x, [0] * 6)
    assert ops.davies_bouldin(one).first()[0] == 0.0
    assert ops.silhouette(one).first()[0] == 0.0
    assert ops.separation(one).first()["separation_ratio"] == 1.0
    assert ops.silhouette(table(spark, x, range(6))).first()[0] == 0.0
    assert ops.diversity(table(spark, x[:1], [0]), "variance").first()[0] == 0.0
    assert ops.diversity(table(spark, x[:1], [0]), "pairwise").first()[0] == 0.0


def test_overlap_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (40, 4)), rng.normal(0.5, 1, (30, 4)), rng.normal(30, 1, (20, 4)), np.zeros((1, 4))])
    y = np.repeat([0, 1, 2, 3], [40, 30, 20, 1])
    got = {(r["i"], r["j"]): r["overlap"] for r in ops.mahalanobis_overlap(table(spark, x, y)).collect()}
    assert len(got) == 16
    for i in range(3):
        inv = np.linalg.inv(np.cov(x[y == i].T) + 1e-6 * np.eye(4))
        for j in range(3):
            delta = x[y == j].mean(0) - x[y == i].mean(0)
            want = 1.0 if i == j else chi2_upper(float(delta @ inv @ delta), 4)
            assert got[i, j] == pytest.approx(want, abs=1e-9)
    assert got[0, 2] < 0.01 and got[0, 1] > 0.1
    assert all(got[3, j] == 0 and got[j, 3] == 0 for j in range(4))


def test_diversity_determinant(clusters):
    x, _, df = clusters
    want = np.linalg.slogdet(np.cov(x.T) + 1e-10 * np.eye(10))[1]
    assert ops.diversity(df, "determinant").first()[0] == pytest.approx(want)


def test_tails():
    assert chi2_upper(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert chi2_upper(7.814727903, 3) == pytest.approx(0.05, abs=1e-9)
    assert chi2_upper(55.75847928, 40) == pytest.approx(0.05, abs=1e-8)
    assert t_two_sided(2.262157163, 9) == pytest.approx(0.05, abs=1e-9)
    assert t_quantile(0.975, 9) == pytest.approx(2.262157163, abs=1e-8)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)


def test_affinity_is_symmetric_and_complete(clusters):
    x, _, df = clusters
    aff = sim.pairwise_affinity(df, block_rows=16)
    rows = aff.collect()
    assert len(rows) == 90 * 89 // 2 and all(r["id1"] < r["id2"] for r in rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    assert max(abs(r["affinity"] - cos[r["id1"], r["id2"]]) for r in rows) < 1e-12
    assert sim.completeness(df, aff, 90).first()["complete"]
    assert sim.directed(aff).count() == 90 * 89


def test_normalisation_is_skipped_for_a_flat_matrix(spark):
    flat = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5)], "id1 string, id2 string, affinity double")
    assert {r["affinity"] for r in sim.normalize_affinity(sim.directed(flat)).collect()} == {0.5}


def test_top_k_with_small_blocks_is_exact(clusters):
    x, y, df = clusters
    rows = df.withColumnRenamed("cls", "run")
    got = sim.top_k_similar(rows, rows, 3, block_rows=8).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -np.inf)
    cos[y[:, None] != y[None]] = -np.inf
    for q, part in got.groupby("query_id"):
        assert sorted(part["id"]) == sorted(np.argsort(-cos[q])[:3])
    assert len(got) == 270


def test_table_beyond_the_bound_gives_the_same_result(clusters):
    _, _, df = clusters

    def kernel(left, right):
        import pandas as pd

        return pd.DataFrame({"id": np.repeat(left["id"], len(right)), "cls": np.tile(right["cls"], len(left))})

    right = df.select(F.col("id").cast("int").alias("cls"))
    left = df.select("id")
    assert small_table(right, 10) is None
    small = map_with_table(left, right, kernel, "id long, cls int")
    large = map_with_table(left, right, kernel, "id long, cls int", bound=10, block_rows=20)
    assert small.count() == large.count() == 8100 and large.distinct().count() == 8100


def test_prototype_closed_form_matches_the_fold(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(400, 5)), np.where(rng.random(400) < 0.6, 1, rng.integers(-1, 4, 400))
    got = {r["cls"]: r["prototype"] for r in pr.prototypes(table(spark, x, y), "id").collect()}
    want = {}
    for row, c in zip(x, y):
        if c >= 0:
            want[c] = 0.7 * row + 0.3 * want[c] if c in want else row
    assert set(got) == set(want)
    assert all(np.allclose(got[c], want[c], atol=1e-12) for c in want)


def test_second_prototypes_can_be_continued(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(120, 4)), rng.integers(-1, 3, 120)
    df = table(spark, x, y)
    whole = {r["cls"]: r for r in pr.prototypes_v2(df, "id", "id").collect()}
    first = pr.prototypes_v2(df.filter("id < 50"), "id", "id")
    parts = {r["cls"]: r for r in pr.prototypes_v2(df.filter("id >= 50"), "id", "id", state=first).collect()}
    assert set(whole) == set(parts) == {0, 1, 2}
    for c in whole:
        assert np.allclose(whole[c]["prototype"], parts[c]["prototype"]) and whole[c]["last_step"] == parts[c]["last_step"]
        assert np.linalg.norm(whole[c]["prototype"]) == pytest.approx(1.0)


def _plain_fold(steps, rows):
    state = None
    for step, row in zip(steps, rows):
        row = row / np.linalg.norm(row)
        m = pr.momentum_at(float(step))
        state = row if state is None else m * state + (1 - m) * row
        state = state / np.linalg.norm(state)
    return state


def _opposing(n, rng):
    """Rows that keep a wide angle to the prototype of momentum one half, so that errors grow by a few hundredths a row."""
    state = np.array([1.0, 0.0, 0.0, 0.0])
    rows = [state]
    for _ in range(n - 1):
        aside = rng.normal(size=4)
        aside -= (aside @ state) * state
        row = np.cos(2.15) * state + np.sin(2.15) * aside / np.linalg.norm(aside)
        rows.append(row)
        state = (state + row) / np.linalg.norm(state + row)
    return np.array(rows)


@pytest.mark.parametrize("segment, warm, repeats", [(40, 15, 3), (100, 60, 3), (37, 5, 0), (4096, 448, 3)])
def test_parallel_fold_equals_the_ordered_one(spark, segment, warm, repeats):
    rng = np.random.default_rng(8)
    opposing, hot = _opposing(250, rng), rng.normal(size=(900, 4)) + 0.3
    rows = [(0, 0, f"{i}", r.tolist()) for i, r in enumerate(opposing)] + [(1, 6000 + i, "x", r.tolist()) for i, r in enumerate(hot)] + [(2, 5, "a", [0.0, 3.0, 0.0, 4.0]), (-1, 1, "b", [1.0] * 4)]
    df = spark.createDataFrame(rows, "cls int, step long, id string, feature array<double>").repartition(5)
    got = {r["cls"]: r for r in pr.prototypes_v2(df, "step", "id", segment_rows=segment, warm_rows=warm, repeats=repeats).collect()}
    want = {0: _plain_fold([0] * 250, opposing), 1: _plain_fold(range(6000, 6900), hot), 2: np.array([0.0, 0.6, 0.0, 0.8])}
    assert set(got) == set(want)
    for c in want:
        assert np.allclose(got[c]["prototype"], want[c], atol=1e-9, rtol=0)
    assert got[1]["last_step"] == 6899 and got[2]["last_step"] == 5


def test_seams_tell_segments_that_need_their_start(spark):
    schema = "cls int, seg long, start array<double>, end array<double>, gain double, last_step long"
    ends = [
        (0, 0, None, [1.0, 0.0], 0.0, 1), (0, 1, [1.0, 0.0], [0.0, 1.0], 9.0, 2),  # equal: closed whatever the gain
        (1, 0, None, [1.0, 0.0], 0.0, 1), (1, 1, [1.0, 1e-9], [0.0, 1.0], -20.0, 2),  # near, and forgotten
        (2, 0, None, [1.0, 0.0], 0.0, 1), (2, 1, [1.0, 1e-9], [0.0, 1.0], 0.5, 2),  # near, and grows
        (3, 0, None, [1.0, 0.0], 0.0, 1), (3, 1, [0.0, 1.0], [0.0, 1.0], -90.0, 2),  # far: the gain says nothing
        (4, 0, None, [1.0, 0.0], 0.0, 1), (4, 1, [1.0, 1e-9], [0.0, 1.0], float("inf"), 2),
    ]
    assert sorted(r["cls"] for r in pr._open_seams(spark.createDataFrame(ends, schema)).collect()) == [2, 3, 4]


def test_agreement_with_a_table_beyond_the_bound(spark, clusters, monkeypatch):
    x, y, _ = clusters
    df = table(spark, x, np.arange(90) % 4 - 1)
    aff = spark.createDataFrame([(0, 1, 0.3), (1, 2, 0.8)], "id1 int, id2 int, affinity double")
    near = {(r["c1"], r["c2"]): (r["n_pairs"], r["mean_l1"]) for r in sim.affinity_agreement(df, aff).collect()}
    monkeypatch.setattr(sim, "TARGET_BOUND", 0)
    far = {(r["c1"], r["c2"]): (r["n_pairs"], r["mean_l1"]) for r in sim.affinity_agreement(df, aff).collect()}
    assert set(near) == set(far) and len(near) == 10
    assert all(near[k][0] == far[k][0] and near[k][1] == pytest.approx(far[k][1]) for k in near)


def test_block_pairs_send_strips_and_small_sums():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[200:] = x[:100]
    left, right = (pd.DataFrame({"id": ids, "cls": ids % 3, "feature": list(x[ids])}) for ids in (np.arange(150), np.arange(150, 300)))
    frames = list(ops.distance_kernel("id", "feature", "cls")(left, right, False))
    assert sum(len(f) for f in frames) == 2 * 150 * 3  # a row once for each class, not once for each strip
    sizes = [part.stop - part.start for part, _ in pairs.strips(10_000, 1 << 20, False)]
    assert set(sizes) == {1}  # a strip is bounded in pairs, not in rows
    runs = list(pairs.class_runs(np.array([0, 3, 5, 9]), 12, 3))
    assert [(r.start, r.stop) for _, r in runs] == [(0, 9), (9, 12)]


def test_separation_sends_sums_of_block_pairs_and_no_rows(spark):
    x = np.random.default_rng(11).normal(size=(200, 5))
    y = np.arange(200) % 3
    df = table(spark, x, y)
    sums = ops.pair_sums(df)
    assert sums.count() <= 2 * sums.rdd.getNumPartitions() and sums.count() < 200
    whole, rows = ({r["same"]: r for r in ops.moments_of(s).collect()} for s in (sums, ops.distance_sums(df)))
    assert set(whole) == set(rows) == {True, False}
    for flag, row in rows.items():
        assert whole[flag]["n_pairs"] == row["n_pairs"] == ((y[:, None] == y) == flag)[np.triu_indices(200, 1)].sum()
        assert np.allclose(whole[flag][2:], row[2:])
    assert ops.mean_distance_of(sums).first()[0] == pytest.approx(all_distances(x)[np.triu_indices(200, 1)].mean())
    # A row without a class is neither within nor between.
    some = df.withColumn("cls", F.when(F.col("id") >= 50, F.col("cls")))
    counts = {r["same"]: r["n_pairs"] for r in ops.pair_moments(some).collect()}
    assert counts == {r["same"]: r["n_pairs"] for r in ops.moments_of(ops.distance_sums(some)).collect()} and counts[True] + counts[False] == 150 * 149 // 2


@pytest.mark.parametrize("name", ["distances", "extremes", "cosines"])
def test_a_block_pair_takes_memory_by_rows_not_by_pairs(name):
    peaks = []
    for n in (2048, 8192):
        x = np.random.default_rng(12).normal(size=(2 * n, 8))
        left, right = (pd.DataFrame({"id": ids, "cls": ids % 3, "feature": list(x[ids])}) for ids in (np.arange(n), np.arange(n, 2 * n)))
        kernel = {"distances": ops.distance_kernel("id", "feature", "cls"), "extremes": sim.extremes_kernel(10, ("most", "least"), "id", "feature")}.get(
            name, lambda a, b, same: sim._cosines(a, b, same, "feature")
        )
        tracemalloc.start()
        for _ in kernel(left, right, False):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 8 * n * n / 4  # a quarter of one matrix of all pairs
    assert peaks[1] < 4 * peaks[0]  # 16 times the pairs


def test_reductions_of_all_pairs_equal_those_of_the_table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 6))
    x[40:80] = x[:40]
    df = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "id long, cls int, feature array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.triu_indices(90, 1)
    cos = np.clip((unit[i] * unit[j]).sum(axis=1), -1, 1)
    row = sim.all_pairs_summary(df).first()
    assert row["n_pairs"] == 4005 and np.allclose([row["min_affinity"], row["max_affinity"], row["mean_affinity"], row["std_affinity"]], [cos.min(), cos.max(), cos.mean(), cos.std()])
    assert sum(r["n_pairs"] for r in sim.all_pairs_histogram(df, 20).collect()) == 4005
    assert sim.completeness(df, sim.pair_counts(df)).first().asDict() == {"n_features": 90, "n_pairs": 4005, "complete": True}
    assert sorted(r["id"] for r in sim.paired_ids(df).collect()) == list(range(90))
    # 40 pairs of equal rows are ties: the smaller ids win.
    assert [(r["id1"], r["id2"], r["affinity"]) for r in sim.all_pairs_ranked(df, 10).collect()] == [(n, n + 40, 1.0) for n in range(10)]
    least = sorted((r["affinity"], r["id1"], r["id2"]) for r in sim.all_pairs_extremes(df, 5).filter("side = 'least'").collect())
    assert np.allclose([a for a, _, _ in least], np.sort(cos)[:5])


def test_known_pairs_are_left_out_without_a_join_of_all_pairs(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "id long, feature array<double>")
    known = spark.createDataFrame([(i, j, -2.0) for i in range(0, 60, 3) for j in range(i + 1, 60)] + [(5, 1000, -2.0)], "id1 long, id2 long, affinity double")
    gaps = jo.missing_pairs(df, known)
    assert {tuple(r) for r in gaps.select("id1", "id2").collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3}
    assert "BroadcastHashJoin" not in gaps._jdf.queryExecution().toString() and "Join" not in gaps._jdf.queryExecution().toString()
    aff = sim.pairwise_affinity(df, existing=known)
    assert aff.count() == 60 * 59 // 2 + 1 and aff.filter("affinity = -2").count() == known.count()


def test_written_pairs_of_a_block_pair_come_in_the_order_of_their_affinity(spark, tmp_path):
    x = np.random.default_rng(13).normal(size=(400, 64))
    rows = [(i, [float(v) for v in r], i % 4) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    load()
    parts = QUERIES["f2_pairwise_affinity"](spark, str(tmp_path)).rdd.glom().collect()
    found = {(r["id1"], r["id2"]): r["affinity"] for part in parts for r in part}
    unit = x.astype("float32").astype("float64")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert len(found) == sum(len(part) for part in parts) == 400 * 399 // 2
    assert all(abs(v - unit[i] @ unit[j]) < 1e-6 for (i, j), v in found.items())
    n = pairs.block_count(spark.range(400), None, None, pairs.PAIR_ROWS)
    falls = sum(a["affinity"] > b["affinity"] for part in parts for a, b in zip(part, part[1:]))
    assert falls < n * (n + 1) // 2  # equal values lie together in a file
    # Tiles and frames are bounded, whatever the blocks.
    left, right = (pd.DataFrame({"id": ids, "feature": list(x[ids])}) for ids in (np.arange(100), np.arange(100, 400)))
    sizes = [len(f) for f in sim._affinities(left, right, False, "id", "feature", True)]
    assert sum(sizes) == 100 * 300 and max(sizes) <= sim.FRAME_PAIRS


@pytest.mark.parametrize("kind", ["long", "string"])
def test_known_pairs_travel_packed(spark, kind):
    rng = np.random.default_rng(14)
    name = int if kind == "long" else "n{:04d}".format
    ids = [name(i) for i in range(300)]
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in ids], f"id {kind}, feature array<double>")
    every = [(ids[i], ids[j]) for i in range(300) for j in range(i + 1, 300)]
    named = {every[i] for i in np.flatnonzero(rng.random(len(every)) < 0.5)}
    # Pairs that come twice, the other way round, with ids that are not in the table, or without an id.
    odd = [*list(named)[:50], *[(b, a) for a, b in every[:500:7] if (a, b) not in named], (ids[0], name(5000)), (name(5001), name(5000)), (None, ids[1]), (ids[1], None)]
    known = spark.createDataFrame([(a, b, -2.0) for a, b in [*named, *odd]], f"id1 {kind}, id2 {kind}, affinity double").repartition(5)
    gaps = [tuple(r) for r in jo.missing_pairs(df, known).select("id1", "id2").collect()]
    assert len(gaps) == len(set(gaps)) and set(gaps) == set(every) - named
    aff = sim.pairwise_affinity(df, existing=known, by_value=True)
    assert aff.count() == known.count() + len(gaps) and {(r["id1"], r["id2"]) for r in aff.filter("affinity <> -2").collect()} == set(gaps)
    # Less than four bytes for a pair leave the tasks that hold the known pairs, ids and all; two ids alone take sixteen.
    packs = pairs._packed(known, dict(df.dtypes)["id"], 1).filter("size(__p) > 2").collect()
    assert sum(len(r["__gaps"]) + 8 * (len(r["__p"]) + len(r["__q"])) for r in packs) < 4 * len(named)
    assert pairs._packed(known.limit(0), dict(df.dtypes)["id"], 1).count() == 0


def test_missing_pairs_take_little_when_written(spark, tmp_path):
    ids = spark.range(3000)
    known = ids.selectExpr("id AS id1", "id + 1 AS id2").filter("id1 % 5 = 0")
    jo.missing_pairs(ids, known).coalesce(4).write.parquet(f"{tmp_path}/gaps")
    gaps = spark.read.parquet(f"{tmp_path}/gaps")
    n = 3000 * 2999 // 2 - 600
    assert gaps.count() == gaps.distinct().count() == n and gaps.filter("id1 >= id2 OR id1 % 5 = 0 AND id2 = id1 + 1").isEmpty()
    assert sum(p.stat().st_size for p in tmp_path.glob("gaps/*.parquet")) < 0.26 * n  # the same few ids come again and again


def test_outputs_of_many_encoder_calls_stay_with_their_rows(spark):
    def encoder():
        return lambda v: (v.reshape(len(v), -1)[:, :2], v.reshape(len(v), -1)[:, :1], v.reshape(len(v), -1)[:, :4], v.max(axis=(1, 2, 3)))

    rows = [(i, [2, 2, 2] if i % 2 else [1, 2, 3], [float(i)] * (8 if i % 2 else 6)) for i in range(30)]
    df = spark.createDataFrame(rows, "vol long, shape array<int>, data array<double>").coalesce(1)
    got = score(df, encoder, 4).collect()
    assert sorted((r["vol"], r["global_weight"], r["embedding"][1]) for r in got) == [(i, float(i), float(i)) for i in range(30)]
    assert [r["vol"] for r in got] == [*range(0, 30, 2), *range(1, 30, 2)]
