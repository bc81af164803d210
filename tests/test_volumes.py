"""Volume operators against numpy, shell correlation properties, pick boxes against slices."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motefield.operators import joins as jo
from motefield.operators import structures as st
from motefield.operators import volume_metrics as vm
from motefield.operators import volumes as ops
from motefield.operators.scoring import score


def packed(spark, volumes, col="data"):
    rows = [(i, [int(s) for s in v.shape], [float(x) for x in v.ravel()]) for i, v in enumerate(volumes)]
    return spark.createDataFrame(rows, f"vol int, shape array<int>, {col} array<double>")


@pytest.fixture(scope="module")
def cubes():
    rng = np.random.default_rng(0)
    return [rng.normal(size=(6, 6, 6)), np.full((6, 6, 6), 2.5), np.zeros((6, 6, 6)), rng.normal(size=(4, 6, 5))]


def arrays(df, col="data"):
    return {r["vol"]: np.asarray(r[col]) for r in df.collect()}


def test_constant_volumes_by_rule(spark, cubes):
    df = packed(spark, cubes)
    for method in ("z-score", "min-max", "percentile"):
        assert not np.any(arrays(ops.normalize(df, method, "dataset"))[1])
        assert not np.any(arrays(ops.normalize(df, method, "dataset"))[2])
    back = arrays(ops.denormalize(ops.normalize(df, "none")))
    assert all(np.array_equal(back[i], v.ravel()) for i, v in enumerate(cubes))
    restored = arrays(ops.denormalize(ops.normalize(df, "min-max", "dataset")))
    assert np.allclose(restored[0], cubes[0].ravel())


def test_long_and_packed_forms_agree(spark, cubes):
    long = ops.to_voxels(packed(spark, cubes)).toPandas()
    for row in long.sample(60, random_state=1).itertuples():
        assert row.v == cubes[row.vol][row.z, row.y, row.x]
    assert len(long) == sum(v.size for v in cubes)


def test_mean_volume_of_a_skewed_group(spark):
    rng = np.random.default_rng(1)
    cubes = [rng.normal(size=(3, 3, 3)) for _ in range(40)]
    df = packed(spark, cubes).withColumn("g", (F.col("vol") >= 30).cast("int"))
    got = {r["g"]: r["data"] for r in ops.mean_volume(df, ["g"]).collect()}
    assert np.allclose(got[0], np.mean(cubes[:30], axis=0).ravel()) and np.allclose(got[1], np.mean(cubes[30:], axis=0).ravel())


def test_augment_is_repeatable_and_varied(spark, cubes):
    df = packed(spark, cubes)
    a, b, c = arrays(ops.augment(df, 1)), arrays(ops.augment(df.repartition(3), 1)), arrays(ops.augment(df, 2))
    assert all(np.array_equal(a[i], b[i]) for i in a)
    assert any(not np.array_equal(a[i], c[i]) for i in a)


def test_fsc_of_identical_volumes(spark):
    rng = np.random.default_rng(2)
    v, w = rng.normal(size=(16, 16, 16)), rng.normal(size=(16, 16, 16))
    df = packed(spark, [v, v, v], "data_a").join(packed(spark, [v, v + 0.1 * w, w], "data_b").drop("shape"), "vol")
    curve = vm.fsc_curve(df, 10.0).toPandas()
    assert (curve[curve["vol"] == 0]["fsc"] > 0.99).all() and (curve[curve["vol"] == 1]["fsc"] > 0.9).all()
    got = {r["vol"]: r["resolution"] for r in vm.fsc_resolution(vm.fsc_curve(df, 10.0), ["vol"]).collect()}
    assert got[0] == pytest.approx(16 * 10 / (2.0 * 7)) and got[2] >= got[0]
    masked = vm.fsc_curve(df, 10.0, mask=(5.0, 2.0)).toPandas()
    assert (masked[masked["vol"] == 0]["fsc"] > 0.99).all()
    pair = {r["vol"]: r for r in vm.pair_metrics(df).collect()}
    assert pair[0]["mse"] == 0 and pair[0]["psnr"] == float("inf") and pair[0]["correlation"] == pytest.approx(1.0) and pair[0]["ssim"] == pytest.approx(1.0)
    assert vm.wedge_error(df).filter("vol = 0").first()["wedge_error"] == 0.0


def test_curve_with_one_shell_and_all_above(spark):
    rows = [(1, 1, 0.9, 80.0), (2, 1, 0.9, 80.0), (2, 2, 0.8, 40.0), (3, 1, 0.2, 80.0), (3, 2, 0.7, 40.0), (4, 1, 0.8, 80.0), (4, 2, 0.2, 40.0), (5, 1, 0.9, 80.0), (5, 2, 0.1, 40.0), (5, 3, 0.8, 20.0)]
    curve = spark.createDataFrame(rows, "vol int, shell int, fsc double, resolution double")
    got = {r["vol"]: r["resolution"] for r in vm.fsc_resolution(curve, ["vol"]).collect()}
    assert got == pytest.approx({1: 80.0, 2: 40.0, 3: 80.0, 4: 60.0, 5: 40.0})


def test_augmented_volumes_follow_plan_and_seed(spark):
    """Turn, noise by the seed of the volume, contrast and brightness, one after the other; the noise has the planned deviation."""
    rng = np.random.default_rng(31)
    volumes = rng.normal(3.0, 2.0, size=(6, 12, 12, 12))
    df = packed(spark, volumes)
    config = {"noise_prob": 1.0, "contrast_prob": 0.5, "rotation_prob": 0.7}
    plan = {r["vol"]: r for r in ops.augment_plan(df.select("vol"), 5, **config).collect()}
    got = {r["vol"]: np.asarray(r["data"]).reshape(r["shape"]) for r in ops.augment(df, 5, **config).collect()}
    assert set(got) == set(range(6)) and any(plan[i]["turns"] for i in plan) and all(plan[i]["noise"] > 0 for i in plan)
    for i, volume in enumerate(volumes):
        p = plan[i]
        turned = np.rot90(volume, k=p["turns"], axes=(0, 1))
        source = np.random.Generator(np.random.Philox(int.from_bytes(hashlib.md5(f"{i}|5".encode()).digest()[:8], "big")))
        noise = source.normal(0.0, p["noise"] * volume.std(), volume.shape)
        noisy = turned + noise
        want = p["contrast"] * (noisy - noisy.mean()) + noisy.mean() + p["brightness"] * noisy.std()
        assert np.allclose(got[i], want, atol=1e-12)
        assert noise.std() == pytest.approx(p["noise"] * volume.std(), rel=0.08)


def test_constant_pair_has_no_correlation(spark, cubes):
    df = packed(spark, [cubes[1]], "data_a").join(packed(spark, [cubes[0]], "data_b").drop("shape"), "vol")
    assert vm.pair_metrics(df).first()["correlation"] == 0.0


def test_smoothing_keeps_the_mass(spark):
    matrix = st.smoothing_matrix(12, 1.3)
    assert np.allclose(matrix.sum(axis=1), 1.0) and np.allclose(matrix.sum(axis=0), 1.0)


def test_boxes_equal_slices(spark):
    rng = np.random.default_rng(3)
    tomogram, box, edge = rng.normal(size=(16, 8, 24)), 6, 8
    chunks = [(0, z, y, x, [float(v) for v in tomogram[z * 8 : z * 8 + 8, y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].ravel()]) for z in range(2) for y in range(1) for x in range(3)]
    chunk_df = spark.createDataFrame(chunks, "run int, cz int, cy int, cx int, data array<double>")
    size = spark.createDataFrame([(0, 16, 8, 24)], "run int, nz int, ny int, nx int")
    points = [(0, i, float(p[0]), float(p[1]), float(p[2])) for i, p in enumerate(rng.uniform(-20, 260, (3000, 3)))]
    picks = jo.pick_voxels(spark.createDataFrame(points, "run int, pick_id long, x double, y double, z double"), F.lit(10.0))
    got = {r["pick_id"]: np.asarray(r["data"]) for r in jo.extract_boxes(picks, size, chunk_df, box, edge).collect()}
    want = {}
    for _, i, x, y, z in points:
        cz, cy, cx = (int(c / 10.0) - box // 2 for c in (z, y, x))
        if min(cz, cy, cx) >= 0 and cz + box <= 16 and cy + box <= 8 and cx + box <= 24:
            want[i] = tomogram[cz : cz + box, cy : cy + box, cx : cx + box].ravel()
    assert set(got) == set(want) and len(want) > 5
    assert all(np.allclose(got[i], want[i]) for i in want)


def test_nearest_pick_is_exact_far_away_and_crowded(spark):
    rng = np.random.default_rng(8)
    crowd = np.r_[rng.normal(0, 0.2, (300, 3)), rng.uniform(-50, 50, (30, 3))].round(2)
    points = np.r_[rng.normal(0, 1, (60, 3)), rng.uniform(-90, 90, (40, 3))].round(2)
    pick_rows = [(0, i, *[float(v) for v in p]) for i, p in enumerate(crowd)] + [(1, 999, 0.0, 0.0, 0.0)]
    point_rows = [(0, i, *[float(v) for v in p]) for i, p in enumerate(points)] + [(1, 500, 80.0, 0.0, 0.0)]
    picks = spark.createDataFrame(pick_rows, "run int, pick_id long, x double, y double, z double")
    asked = spark.createDataFrame(point_rows, "run int, point_id long, x double, y double, z double")
    got = jo.nearest_pick(asked, picks, cell=4.0, block_rows=64).toPandas().set_index("point_id")
    d = np.sqrt(((points[:, None] - crowd[None]) ** 2).sum(-1))
    assert len(got) == 101 and got.loc[500, "distance"] == 80.0
    for i in range(100):
        assert got.loc[i, "distance"] == pytest.approx(d[i].min())
        assert got.loc[i, "pick_id"] == d[i].argmin()


@pytest.mark.parametrize("tile_rows, boxes, cell", [(40, 1 << 18, None), (25, 0, None), (70_000, 1 << 18, 0.5), (16, 10, 30.0)])
def test_nearest_pick_by_tiles(spark, tile_rows, boxes, cell):
    """Crowds, far points, ties, a line, one place repeated, and coordinates that are no numbers."""
    rng = np.random.default_rng(9)
    nan, inf = float("nan"), float("inf")
    clouds = [np.r_[rng.normal(0, 0.1, (200, 3)), rng.uniform(-50, 50, (60, 3))], np.c_[np.arange(80.0), np.zeros(80), np.zeros(80)], np.zeros((30, 3)), rng.integers(0, 4, (300, 3)).astype(float)]
    picks = [(run, 1000 * run + i, *p.tolist()) for run, cloud in enumerate(clouds) for i, p in enumerate(cloud)] + [(9, 1, nan, 0.0, 0.0), (8, 2, inf, 0.0, 0.0), (None, 3, 0.0, 0.0, 0.0), (0, 99_999, None, 0.0, 0.0)]
    points = [(run, 1000 * run + i, *p.tolist()) for run in range(4) for i, p in enumerate(np.r_[rng.normal(0, 2, (30, 3)), rng.uniform(-300, 300, (15, 3)), rng.integers(0, 4, (15, 3)), [[0, 0, 0]]])]
    points += [(7, 1, 0.0, 0.0, 0.0), (0, 90_000, nan, 0.0, 0.0), (0, 90_001, None, 0.0, 0.0), (None, 5, 0.0, 0.0, 0.0)]
    frames = [spark.createDataFrame(rows, f"run int, {name} long, x double, y double, z double") for rows, name in ((points, "point_id"), (picks, "pick_id"))]
    got = {(r["run"], r["point_id"]): (r["pick_id"], r["distance"]) for r in jo.nearest_pick(*frames, cell=cell, block_rows=20, tile_rows=tile_rows, boxes=boxes).collect()}
    want = {}
    for run, cloud in enumerate(clouds):
        for r, i, *p in points[: 61 * 4]:
            if r == run:
                d2 = ((np.array(p)[None, :] - cloud) ** 2)[:, 0] + ((np.array(p)[None, :] - cloud) ** 2)[:, 1] + ((np.array(p)[None, :] - cloud) ** 2)[:, 2]
                want[run, i] = (1000 * run + int(d2.argmin()), float(np.sqrt(d2.min())))
    assert got == want


def test_boxes_are_cut_where_the_chunks_lie(spark):
    """A bucketed store is joined without an exchange of its voxels, small lists without one at all."""
    rng = np.random.default_rng(3)
    tomogram = rng.normal(size=(16, 16, 16))
    chunks = [(0, z, y, x, [float(v) for v in tomogram[z * 8 : z * 8 + 8, y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].ravel()]) for z in range(2) for y in range(2) for x in range(2)]
    chunk_df = spark.createDataFrame(chunks, "run int, cz int, cy int, cx int, data array<double>")
    size = spark.createDataFrame([(0, 16, 16, 16)], "run int, nz int, ny int, nx int")
    picks = spark.createDataFrame([(0, i, *[int(c) for c in p]) for i, p in enumerate(rng.integers(3, 13, (200, 3)))], "run int, pick_id long, vz int, vy int, vx int")
    want = {r["pick_id"]: r["data"] for r in jo.extract_boxes(picks, size, chunk_df, 6, 8).collect()}
    assert len(want) == 200 and all(np.array_equal(want[r["pick_id"]], tomogram[r["vz"] - 3 : r["vz"] + 3, r["vy"] - 3 : r["vy"] + 3, r["vx"] - 3 : r["vx"] + 3].ravel()) for r in picks.collect())
    store = jo.write_chunk_store(chunk_df, f"chunks_{uuid.uuid4().hex}", 4)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = jo.extract_boxes(picks, size, store, 6, 8)
        text = plan(cut)
        assert "Bucketed: true" in text and "SortMergeJoin" in text
        scan = next(i for i, line in enumerate(text.split("\n")) if "Bucketed: true" in line)
        above = text.split("\n")[:scan]
        join = max(i for i, line in enumerate(above) if "SortMergeJoin" in line)
        side = [line for line in above[join:] if "Exchange" in line]
        assert len(side) <= 1  # the lists', not the store's
        assert {r["pick_id"]: r["data"] for r in cut.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan(jo.extract_boxes(picks, size, chunk_df, 6, 8))


def test_rendered_splats_match_a_plain_sum(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"set_id": np.repeat([0, 1], 5), "splat_id": np.tile(np.arange(5), 2), "w": rng.random(10), "sigma": 0.5 + rng.random(10), **{a: rng.uniform(0, 4, 10) for a in "xyz"}})
    got = {r["set_id"]: np.asarray(r["data"]).reshape(4, 5, 6) for r in st.render_splats(spark.createDataFrame(frame), (4, 5, 6)).collect()}
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in (4, 5, 6)], indexing="ij"), -1)
    for s in (0, 1):
        want = sum(r.w * np.exp(-0.5 * (np.linalg.norm(grid - [r.x, r.y, r.z], axis=-1) / r.sigma) ** 2) for r in frame[frame["set_id"] == s].itertuples())
        assert np.allclose(got[s], want)


def test_boxes_keep_nan_and_never_mix_tomograms(spark):
    keys, nan = ["run", "tomo_type"], float("nan")
    chunks = [(0, kind, z, 0, 0, [value + z] * 64) for kind, value in (("a", 1.0), ("b", 7.0)) for z in range(3) if (kind, z) != ("b", 2)]
    chunks[0] = (0, "a", 0, 0, 0, [nan] + [1.0] * 63)
    chunk_df = spark.createDataFrame(chunks, "run int, tomo_type string, cz int, cy int, cx int, data array<double>")
    size = spark.createDataFrame([(0, k, 12, 4, 4) for k in "ab"], "run int, tomo_type string, nz int, ny int, nx int")
    picks = spark.createDataFrame([(0, k, n, v, 2, 2) for k in "ab" for n, v in ((1, 2), (2, 4), (3, 8))], "run int, tomo_type string, pick_id int, vz int, vy int, vx int")
    got = {(r["tomo_type"], r["pick_id"]): np.asarray(r["data"]) for r in jo.extract_boxes(picks, size, chunk_df, 4, 4, keys=keys).collect()}
    assert np.isnan(got["a", 1]).sum() == 1 and set(got) == {("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)}
    assert set(got["a", 2]) == {1.0, 2.0} and set(got["b", 2]) == {7.0, 8.0}
    holes = jo.incomplete_picks(picks, size, chunk_df, 4, 4, keys).collect()
    assert [(r["tomo_type"], r["pick_id"]) for r in holes] == [("b", 3)]


def test_boxes_of_several_shapes_are_scored_together(spark):
    rows = [(1, [1.0] * 8, [2, 2, 2]), (2, [2.0] * 12, [1, 3, 4]), (3, [3.0] * 12, [4, 3, 1]), (4, [4.0] * 8, [2, 2, 2])]
    df = spark.createDataFrame(rows, "vol int, data array<double>, shape array<int>").coalesce(1)

    def encoder():
        return lambda v: (v.mean(axis=(1, 2, 3))[:, None], np.zeros((len(v), 1)), np.full((len(v), 1), v.shape[3]), np.full(len(v), v.shape[1]))

    got = {r["vol"]: (r["embedding"], r["pose"], r["global_weight"]) for r in score(df, encoder).collect()}
    assert got == {1: ([1.0], [2.0], 2.0), 2: ([2.0], [4.0], 1.0), 3: ([3.0], [1.0], 4.0), 4: ([4.0], [2.0], 2.0)}
    with pytest.raises(Exception, match="validate"):
        score(spark.createDataFrame([(1, None, [2, 2, 2])], df.schema), encoder).collect()
