"""Reports on pose tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.functions.rotations import geodesic, matrix_product, matrix_to_euler
from motefield.operators.clean import exact_percentiles
from motefield.operators.pairs import map_block_pairs, stack
from motefield.session import only_row


def rotation_errors(df: DataFrame, predicted: str = "r_pred", true: str = "r_true") -> DataFrame:
    """Add the angle between prediction and truth, in degrees."""
    return df.withColumn("error", F.degrees(geodesic(F.col(predicted), F.col(true))))


def relative_errors(df: DataFrame, id_col: str, predicted: str = "r_pred", true: str = "r_true") -> DataFrame:
    """Mean and deviation of the error of the relative rotation over all pairs i < j.

    The trace of (Pi' Pj)' (Ti' Tj) is the product of Pi Ti' with Pj Tj' summed
    over the elements, so a pair of blocks is one matrix product and only sums leave a task.
    """
    turned = df.select(id_col, matrix_product(F.col(predicted), F.col(true), transpose_b=True).alias("__pt"))

    def kernel(left: pd.DataFrame, right: pd.DataFrame, keep: np.ndarray | None) -> pd.DataFrame:
        trace = np.clip(stack(left["__pt"]) @ stack(right["__pt"]).T, -1.0, 3.0)
        error = np.degrees(np.arccos((trace - 1.0) / 2.0))
        used = error.ravel() if keep is None else error[keep]
        return pd.DataFrame({"n": [used.size], "s": [used.sum()], "q": [np.square(used).sum()]})

    sums = map_block_pairs(turned, id_col, ["__pt"], kernel, "n long, s double, q double")
    mean = F.sum("s") / F.sum("n")
    spread = F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0)))
    return sums.agg(F.coalesce(mean, F.lit(0.0)).alias("mean_relative_error"), F.coalesce(spread, F.lit(0.0)).alias("std_relative_error"))


def rotation_metrics(df: DataFrame, id_col: str, predicted: str = "r_pred", true: str = "r_true", degrees: bool = True) -> DataFrame:
    """Long report ``(metric, value)`` of geodesic errors and relative errors, in degrees or radians."""
    errors = rotation_errors(df, predicted, true)
    names = {"mean": F.avg("error"), "std": F.stddev_pop("error"), "max": F.max("error"), "min": F.min("error")}
    wide = errors.agg(*[c.alias(f"{n}_geodesic_error") for n, c in names.items()])
    long = _long(wide)
    median = exact_percentiles(errors.select(id_col, "error"), [], "error", [0.5], [id_col]).select(F.lit("median_geodesic_error").alias("metric"), "value")
    report = long.unionByName(median).unionByName(_long(relative_errors(df, id_col, predicted, true)))
    return report if degrees else report.withColumn("value", F.radians("value"))


def _long(wide: DataFrame) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in wide.columns]))
    return wide.select(rows.alias("m")).select("m.*")


def global_rotation(df: DataFrame, predicted: str = "r_pred", true: str = "r_true") -> tuple[np.ndarray, float]:
    """Rotation that maps the predicted onto the true rotations best, and its RMSD over the matrix columns.

    The cross-covariance is nine sums in one aggregate; the decomposition
    happens on that single row.
    """
    p, q = F.col(predicted), F.col(true)
    terms = {f"h{a}{b}": sum(F.get(p, 3 * a + c) * F.get(q, 3 * b + c) for c in range(3)) for a in range(3) for b in range(3)}
    row = only_row(df.agg(*[F.sum(v).alias(k) for k, v in terms.items()], F.count(F.lit(1)).alias("n")))
    cross = np.array([[row[f"h{a}{b}"] for b in range(3)] for a in range(3)])
    u, _, vt = np.linalg.svd(cross)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    rotation = vt.T @ flip @ u.T
    square = 2.0 * 3.0 * row["n"] - 2.0 * float(np.sum(rotation * cross.T))
    return rotation, float(np.sqrt(max(square, 0.0) / (3.0 * row["n"])))


def align_points(df: DataFrame, set_col: str = "set_id", p: Sequence[str] = ("px", "py", "pz"), q: Sequence[str] = ("qx", "qy", "qz")) -> DataFrame:
    """``(set_id, n, rotation, translation, rmsd)``: the rigid motion that maps the points p of each set onto q best.

    Centroids and centred covariances are one aggregate for each set; the 3x3
    decomposition happens on that row. A set of one point is only shifted.
    """
    cross = {f"c{i}{j}": F.covar_pop(p[i], q[j]) for i in range(3) for j in range(3)}
    size = sum(F.var_pop(c) for c in (*p, *q))
    means = {f"{name}{i}": F.avg(c) for name, cols in (("p", p), ("q", q)) for i, c in enumerate(cols)}
    sums = df.groupBy(set_col).agg(F.count(F.lit(1)).alias("n"), size.alias("size"), *[c.alias(k) for k, c in {**cross, **means}.items()])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"rotation": [], "translation": [], "rmsd": []}
            for row in batch.to_dict("records"):
                h = np.array([[row[f"c{i}{j}"] for j in range(3)] for i in range(3)])
                u, s, vt = np.linalg.svd(h)
                sign = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
                turn = vt.T @ np.diag([1.0, 1.0, sign]) @ u.T
                from_, to = (np.array([row[f"{c}{i}"] for i in range(3)]) for c in "pq")
                out["rotation"].append(turn.ravel())
                out["translation"].append(to - turn @ from_)
                out["rmsd"].append(float(np.sqrt(max(row["size"] - 2.0 * (s[0] + s[1] + sign * s[2]), 0.0))))
            yield batch[[set_col, "n"]].assign(**out)

    return sums.mapInPandas(solve, f"`{set_col}` {dict(df.dtypes)[set_col]}, n long, rotation array<double>, translation array<double>, rmsd double")


def align_rotations(df: DataFrame, predicted: str = "r_pred", true: str = "r_true") -> tuple[DataFrame, float]:
    """Rows with the prediction turned by the global rotation and the remaining error in degrees, and the RMSD."""
    rotation, rmsd = global_rotation(df, predicted, true)
    turn = F.array(*[F.lit(float(v)) for v in rotation.ravel()])
    aligned = df.withColumn("aligned", matrix_product(turn, F.col(predicted)))
    return aligned.withColumn("error", F.degrees(geodesic(F.col("aligned"), F.col(true)))), rmsd


def alignment_summary(df: DataFrame, predicted: str = "r_pred", true: str = "r_true") -> DataFrame:
    """RMSD and angle statistics after global alignment."""
    aligned, rmsd = align_rotations(df, predicted, true)
    return aligned.agg(
        F.lit(rmsd).alias("rmsd"), F.avg("error").alias("mean_angular_error"), F.stddev_pop("error").alias("std_angular_error"),
        F.max("error").alias("max_angular_error"), F.min("error").alias("min_angular_error"),
    )


def alignment_stats(df: DataFrame, rotation: str = "r_pred", true: str | None = "r_true") -> DataFrame:
    """Mean, deviation and range of the Euler angles and of the angle to the ground truth, per quantity."""
    euler = matrix_to_euler(F.col(rotation))
    parts = [F.struct(F.lit(f"euler_{a}").alias("quantity"), F.get(euler, i).alias("v")) for i, a in enumerate("xyz")]
    if true is not None:
        parts.append(F.struct(F.lit("angular_diff").alias("quantity"), F.degrees(geodesic(F.col(rotation), F.col(true))).alias("v")))
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return long.groupBy("quantity").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
