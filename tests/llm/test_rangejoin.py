"""Metric range join against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from motefield.llm import rangejoin

SCHEMA = "vec_id long, embedding array<float>, label int, node string, group string, home int, least long"


def plain(rows, cosine=0.98):
    """Links, components and kept flags of ``(vec_id, embedding, label)`` by all pairs."""
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    units = [np.array(r[1], np.float32).astype(float) if good else None for r, good in zip(rows, ok, strict=True)]
    units = [u / np.sqrt(u @ u) if u is not None else None for u in units]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, "n", "g", 0, 0) for r in rows], SCHEMA)
    return sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rangejoin.similar_vectors(df, **options).collect()], key=repr)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    rows = []
    for label, size in ((1, 400), (2, 90), (3, 2)):
        centres = rng.normal(size=(6, 12))
        for i in range(size):
            noise = (0.0, 0.002, 0.03, 0.06, 0.2)[i % 5]
            rows.append((len(rows), (centres[i % 6] * (1 + i % 3) + noise * rng.normal(size=12)).astype(np.float32).tolist(), label))
    rows += [(1000 + i, rows[0][1], 1) for i in range(40)] + [(7, rows[7][1], 1), (2000, rows[0][1], None), (2001, rows[0][1][:6], 1)]
    return rows


@pytest.mark.parametrize("cell, block", [(20, 7), (60, 4096), (150, 16)])
def test_equals_all_pairs(spark, clustered, cell, block):
    assert got(spark, clustered, cell=cell, block=block) == plain(clustered)


def test_chain_and_uniform(spark):
    turn = [(i, [math.cos(0.15 * i), math.sin(0.15 * i)], 1) for i in range(30)]
    assert got(spark, turn, cell=4) == plain(turn)
    rng = np.random.default_rng(1)
    flat = [(i, rng.normal(size=3).astype(np.float32).tolist(), i % 2) for i in range(300)]
    assert got(spark, flat, cell=10) == plain(flat)
    assert got(spark, flat, cell=25, cosine=0.9) == plain(flat, 0.9)


def test_odd_vectors(spark):
    x = [1.0, 2.0, 3.0]
    rows = [
        (1, x, 1), (1, x, 1), (2, [2.0, 4.0, 6.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 3.0], 1), (7, [1.0, float("nan"), 3.0], 1),
        (8, [float("inf"), 2.0, 3.0], 1), (9, x, None), (None, x, 1), (10, [1e-30, 2e-30, 3e-30], 1), (11, [1e30, 2e30, 3e30], 1), (12, [-0.0, 1.0], 2), (13, [0.0, 1.0], 2), (None, x, 3), (None, x, 3),
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


def test_string_ids_and_labels(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0], "x|y"), ("a", [1.0, 0.001], "x|y"), ("c", [1.0, 0.0], "x")], "vec_id string, embedding array<double>, label string")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rangejoin.similar_vectors(df).collect()} == {"a": (1, "a"), "b": (1, "a"), "c": (0, "c")}


def test_whole_cells_are_counted_without_comparing(spark, monkeypatch):
    """A tight cluster larger than its cells links through counts and lines only."""
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(8) + 1e-4 * rng.normal(size=8)).astype(np.float32).tolist(), 1) for i in range(300)]
    seen = []
    whole = rangejoin.Cells.cases

    def cases(self, group, x, home):
        every, visit = whole(self, group, x, home)
        seen.append((int(every.sum()), int(visit.sum())))
        return every, visit

    assert got(spark, rows, cell=10) == plain(rows)
    pivots = rangejoin.Pivots([{"node": bytes([i]) * 16, "group": "g", "vector": (np.array(r[1]) / np.linalg.norm(r[1])).tobytes()} for i, r in enumerate(rows[:5])])
    cells = rangejoin.Cells(pivots, [{"group": "g", "home": i, "n": 3, "w": 3, "radius": 0.01} for i in range(5)], 0.2)
    cases(cells, "g", pivots.vectors["g"], np.arange(5))
    assert seen[0] == (10, 0)
