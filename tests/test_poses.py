"""Rotations and splat alignment by their algebraic properties."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motefield.functions import rotations as rot
from motefield.operators import poses as ops
from motefield.operators import splats as sp


def random_rotations(n, seed=0):
    q = np.random.default_rng(seed).normal(size=(n, 4))
    w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    return np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
                     2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1)


def frame_of(spark, pred, true):
    rows = [(i, [float(v) for v in p], [float(v) for v in t]) for i, (p, t) in enumerate(zip(pred, true))]
    return spark.createDataFrame(rows, "id int, r_pred array<double>, r_true array<double>")


def test_round_trips_for_all_branches(spark):
    half_turns = np.array([[1, 0, 0, 0, -1, 0, 0, 0, -1], [-1, 0, 0, 0, 1, 0, 0, 0, -1], [-1, 0, 0, 0, -1, 0, 0, 0, 1], [1, 0, 0, 0, 1, 0, 0, 0, 1]], float)
    m = np.concatenate([random_rotations(50), half_turns])
    df = frame_of(spark, m, m)
    c = F.col("r_pred")
    for name, there_and_back in {
        "quaternion": rot.quaternion_to_matrix(rot.matrix_to_quaternion(c)), "axis angle": rot.axis_angle_to_matrix(rot.matrix_to_axis_angle(c)), "euler": rot.euler_to_matrix(rot.matrix_to_euler(c)),
    }.items():
        got = np.array([r[0] for r in df.orderBy("id").select(there_and_back).collect()])
        assert np.allclose(got, m, atol=1e-7), name


def test_missing_poses_are_identities(spark):
    df = spark.sql("SELECT CAST(NULL AS array<double>) AS a UNION ALL SELECT array(1.5D, 0D, 0D, 0D) UNION ALL SELECT array(1D, 2D)")
    assert all(r[0] == list(rot.IDENTITY) for r in df.select(rot.axis_angle_to_matrix(F.col("a"))).collect())
    axis = spark.sql("SELECT array(1D,0D,0D,0D,1D,0D,0D,0D,1D) AS m").select(rot.matrix_to_axis_angle(F.col("m"))).first()[0]
    assert axis == [0.0, 1.0, 0.0, 0.0]


def test_geodesic_is_a_metric(spark):
    a, b, c = random_rotations(30, 1), random_rotations(30, 2), random_rotations(30, 3)
    df = frame_of(spark, a, b).withColumn("r3", F.lit(None))
    dist = {}
    for name, (p, q) in {"ab": (a, b), "ba": (b, a), "bc": (b, c), "ac": (a, c), "aa": (a, a)}.items():
        dist[name] = np.array([r["error"] for r in ops.rotation_errors(frame_of(spark, p, q)).orderBy("id").collect()])
    assert np.allclose(dist["ab"], dist["ba"]) and np.all(dist["ac"] <= dist["ab"] + dist["bc"] + 1e-9)
    assert np.all(dist["aa"] < 1e-5) and df.count() == 30


def test_global_rotation_is_recovered(spark):
    true, turn = random_rotations(40, 4).reshape(-1, 3, 3), random_rotations(1, 5)[0].reshape(3, 3)
    df = frame_of(spark, (turn.T @ true).reshape(-1, 9), true.reshape(-1, 9))
    rotation, rmsd = ops.global_rotation(df)
    assert np.allclose(rotation, turn, atol=1e-9) and rmsd < 1e-6
    assert ops.alignment_summary(df).first()["max_angular_error"] < 1e-4
    got = {r["metric"]: r["value"] for r in ops.rotation_metrics(df, "id").collect()}
    errors = [r["error"] for r in ops.rotation_errors(df).collect()]
    assert got["median_geodesic_error"] == pytest.approx(np.median(errors))
    # A global rotation on the left cancels in relative poses.
    assert got["mean_relative_error"] < 1e-4


def test_rmsd_of_noisy_poses(spark):
    a, b = random_rotations(25, 6).reshape(-1, 3, 3), random_rotations(25, 7).reshape(-1, 3, 3)
    rotation, rmsd = ops.global_rotation(frame_of(spark, a.reshape(-1, 9), b.reshape(-1, 9)))
    columns = np.concatenate([m.T for m in (rotation @ a) - b])
    assert rmsd == pytest.approx(np.sqrt((columns**2).sum(axis=1).mean()))
    assert np.linalg.det(rotation) == pytest.approx(1.0)


def splat_frame(points, w, set_id=0, label=0):
    return pd.DataFrame({"label": label, "set_id": set_id, "splat_id": np.arange(len(w)), "x": points[:, 0], "y": points[:, 1], "z": points[:, 2], "sigma": 1.0, "w": w})


def test_principal_axes_match_numpy(spark):
    rng = np.random.default_rng(8)
    points, w = rng.normal(size=(80, 3)) * [3, 2, 1], rng.random(80)
    row = sp.weighted_pca(spark.createDataFrame(splat_frame(points, w))).first()
    values, vectors = np.linalg.eigh(np.cov(points.T, aweights=w))
    axes = np.asarray(row["axes"]).reshape(3, 3)
    assert np.allclose(row["eigenvalues"], values[::-1]) and np.linalg.det(axes) == pytest.approx(1.0)
    assert np.allclose(np.abs((axes * vectors[:, ::-1]).sum(axis=0)), 1.0)


def test_selection_falls_back_to_the_sphere(spark):
    rng = np.random.default_rng(9)
    points, w = rng.normal(size=(60, 3)), rng.random(60)
    df = spark.createDataFrame(splat_frame(points, w))
    inside = np.linalg.norm(points, axis=1) < 1.5
    heavy = w > np.percentile(w, 50)
    assert sp.select_splats(df, 1.5, (0, 0, 0), 50.0).count() == (inside & heavy).sum() >= 10
    assert sp.select_splats(df, 1.5, (0, 0, 0), 99.0).count() == inside.sum()


def test_alignment_finds_a_rotated_copy(spark):
    rng = np.random.default_rng(10)
    points, w = rng.normal(size=(120, 3)) * [4, 2.5, 1], 0.5 + rng.random(120)
    points -= np.average(points, axis=0, weights=w)
    template = spark.createDataFrame(splat_frame(points, w)).drop("set_id")
    same = spark.createDataFrame(splat_frame(points, w, set_id=1))
    best = sp.align_sets_pca(same, template, "label", radii=(30.0, 40.0), center=(0, 0, 0), percentile=0.0).first()
    assert best["score"] < 1e-9 and np.allclose(np.asarray(best["rotation"]).reshape(3, 3), np.eye(3), atol=1e-9)
    turn = random_rotations(1, 11)[0].reshape(3, 3)
    moved = spark.createDataFrame(splat_frame(points @ turn.T + 0.1, w, set_id=2))
    found = sp.align_sets_pca(moved, template, "label", radii=(30.0, 40.0), center=(0, 0, 0), percentile=0.0).first()
    # Principal axes leave the signs of two axes open, so the copy is found up to a half turn.
    product = np.asarray(found["rotation"]).reshape(3, 3) @ turn
    u = np.linalg.eigh(np.cov(points.T, aweights=w))[1]
    assert np.allclose(np.abs(u.T @ product @ u), np.eye(3), atol=1e-2)
    assert sp.chamfer(same, same).first()["chamfer"] == 0.0


def test_point_sets_are_aligned_with_translation(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for s in range(3):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        turn, shift = q * np.sign(np.linalg.det(q)), rng.normal(size=3) * 1e4
        p = rng.normal(size=(40, 3))
        want[s] = (turn, shift)
        rows += [(s, *map(float, a), *map(float, turn @ a + shift)) for a in p]
    rows.append((9, 1.0, 2.0, 3.0, 2.0, 2.0, 2.0))
    df = spark.createDataFrame(rows, "set_id int, px double, py double, pz double, qx double, qy double, qz double")
    got = {r["set_id"]: r for r in ops.align_points(df).collect()}
    for s, (turn, shift) in want.items():
        assert np.allclose(np.array(got[s]["rotation"]).reshape(3, 3), turn, atol=1e-6) and np.allclose(got[s]["translation"], shift, rtol=1e-6) and got[s]["rmsd"] < 1e-3
    assert got[9]["n"] == 1 and got[9]["rmsd"] == 0.0


def test_eigenvectors_in_columns(spark):
    """Random, equal, double, flat, zero, tiny and huge matrices; values fall, axes are right-handed and rebuild the matrix."""
    from motefield.functions.eigen import symmetric_eigen, symmetric_eigenvalues

    rng = np.random.default_rng(12)
    mats = [m + m.T for m in rng.normal(size=(40, 3, 3))]
    turns = [np.linalg.qr(m)[0] for m in rng.normal(size=(12, 3, 3))]
    shapes = [(2, 2, 1), (3, 1, 1), (1, 1, 1), (1, 0, 0), (1, 1, 0), (0, 0, 0), (5, 5 - 1e-9, 1), (1e-12, 0, 0), (1e12, 1, 1e-3), (1, -1, 0), (-1, -1, -2), (2, 1, 1 - 1e-13)]
    mats += [t @ np.diag(d) @ t.T for t, d in zip(turns, shapes)] + [np.diag(d).astype(float) for d in shapes]
    cells = [tuple(float(m[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))) for m in mats]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)] + [(-1, None, 0.0, 0.0, 1.0, 0.0, 1.0)], "id int, xx double, xy double, xz double, yy double, yz double, zz double")
    rows = {r["id"]: r for r in symmetric_eigen(df).collect()}
    assert rows[-1]["eigenvalues"] is None and rows[-1]["axes"] is None
    alone = {r["id"]: [r["a"], r["b"], r["c"]] for r in symmetric_eigenvalues(df, ("xx", "xy", "xz", "yy", "yz", "zz"), "abc").collect()}
    assert alone[-1] == [None] * 3
    for i, (xx, xy, xz, yy, yz, zz) in enumerate(cells):
        m = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])
        size = max(np.abs(m).max(), 1e-300)
        values, axes = np.array(rows[i]["eigenvalues"]), np.array(rows[i]["axes"]).reshape(3, 3)
        assert np.allclose(values / size, np.linalg.eigvalsh(m)[::-1] / size, atol=1e-9)
        assert np.allclose(np.array(alone[i]) / size, values / size, atol=1e-7)
        assert np.allclose(axes @ axes.T, np.eye(3), atol=1e-9) and np.linalg.det(axes) > 0
        assert np.allclose(axes @ np.diag(values) @ axes.T / size, m / size, atol=1e-9)
        assert all(axes[np.abs(axes[:, k]).argmax(), k] > 0 for k in (0, 1))
