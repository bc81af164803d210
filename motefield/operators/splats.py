"""Weighted point sets: selection, principal axes, alignment, comparison.

Sets come as a long table ``(set_id, splat_id, x, y, z, sigma, w)``. Sums over a
set are plain aggregates; 3x3 decompositions are column expressions on one row per set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.eigen import symmetric_eigen, symmetric_eigenvalues
from motefield.operators.structures import pack_splats

# Fewest points kept by both filters, default sphere radii and weight percentile, weight of a significant splat.
MIN_POINTS = 10
RADII = (15.0, 18.0, 20.0)
WEIGHT_PERCENTILE = 70.0
SIGNIFICANT_WEIGHT = 0.01
#: Points that axes need at least.
AXES_POINTS = 3


def in_sphere(radius, center: Sequence[float]) -> Column:
    radius = radius if isinstance(radius, Column) else F.lit(float(radius))
    return F.sqrt(sum((F.col(a) - float(c)) * (F.col(a) - float(c)) for a, c in zip("xyz", center))) < radius


def select_splats(splats: DataFrame, radius, center: Sequence[float], percentile: float = WEIGHT_PERCENTILE, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Splats inside the sphere and above the weight percentile of their set; the sphere alone if too few remain."""
    marked = splats.withColumn("__in", in_sphere(radius, center))
    cuts = splats.groupBy(*keys).agg(F.percentile("w", percentile / 100.0).alias("__cut"))
    both = marked.join(cuts, list(keys)).withColumn("__both", F.col("__in") & (F.col("w") > F.col("__cut")))
    counts = both.groupBy(*keys).agg(F.count_if("__both").alias("__n"))
    chosen = both.join(counts, list(keys)).filter(F.when(F.col("__n") < MIN_POINTS, F.col("__in")).otherwise(F.col("__both")))
    return chosen.drop("__in", "__cut", "__both", "__n")


_MOMENTS = ("xx", "xy", "xz", "yy", "yz", "zz")


def weighted_moments(splats: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Count, weight sums, centroid and centred second moments (divided by the weight sum) per set."""
    total = F.sum("w")
    centers = splats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), total.alias("w_sum"), F.sum(F.col("w") * F.col("w")).alias("w2_sum"),
        *[(F.sum(F.col("w") * F.col(a)) / total).alias(f"c{a}") for a in "xyz"],
    )
    centred = splats.join(centers.select(*keys, "cx", "cy", "cz"), list(keys))
    moments = centred.groupBy(*keys).agg(*[
        (F.sum(F.col("w") * (F.col(m[0]) - F.col(f"c{m[0]}")) * (F.col(m[1]) - F.col(f"c{m[1]}"))) / total).alias(m) for m in _MOMENTS
    ])
    return centers.join(moments, list(keys))


def weighted_pca(splats: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Weighted centroid, covariance (reliability weights), eigenvalues falling and a right-handed set of axes.

    ``axes`` holds the eigenvectors as columns of a row-major 3x3 matrix. A set
    of one point has no covariance, and so neither values nor axes.
    """
    factor = F.try_divide(F.col("w_sum"), F.col("w_sum") - F.try_divide(F.col("w2_sum"), F.col("w_sum")))
    cov = weighted_moments(splats, keys).select(*keys, "n", "cx", "cy", "cz", *[(F.col(m) * factor).alias(m) for m in _MOMENTS])
    return symmetric_eigen(cov, _MOMENTS)


def _weighted_mean(values: np.ndarray, weights: np.ndarray) -> float:
    return float((values * weights).sum() / weights.sum())


def distance_strips(a: np.ndarray, b: np.ndarray, strip: int = 256) -> Iterator[np.ndarray]:
    """Distances of a few points of ``a`` at a time to all of ``b``, so that memory grows with one set only."""
    for start in range(0, len(a), strip):
        yield np.sqrt(((a[start : start + strip, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def chamfer_of(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> float:
    """Mean of the two weighted mean distances to the nearest point of the other set."""
    if not len(a) or not len(b):
        return float("inf")
    there, back = [], np.full(len(b), np.inf)
    for d in distance_strips(a, b):
        there.append(d.min(axis=1))
        back = np.minimum(back, d.min(axis=0))
    return (_weighted_mean(np.concatenate(there), wa) + _weighted_mean(back, wb)) / 2.0


def paired_sets(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row per pair of sets, both packed as arrays (a set is bounded by the decoder that made it)."""
    left = pack_splats(a, on).select(*on, *[F.col(c).alias(f"{c}_a") for c in ("x", "y", "z", "sigma", "w")])
    right = pack_splats(b, on).select(*on, *[F.col(c).alias(f"{c}_b") for c in ("x", "y", "z", "sigma", "w")])
    return left.join(right, list(on))


def _points(row, side: str) -> np.ndarray:
    return np.stack([np.asarray(getattr(row, f"{a}_{side}"), dtype=float) for a in "xyz"], axis=1)


def _over_pairs(pairs: DataFrame, on: Sequence[str], fn, outputs: dict[str, str]) -> DataFrame:
    types = dict(pairs.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in on] + [f"`{c}` {t}" for c, t in outputs.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [fn(row) for row in batch.itertuples()]
            yield batch[list(on)].assign(**{name: [r[i] for r in rows] for i, name in enumerate(outputs)})

    return pairs.mapInPandas(run, schema)


def chamfer(a: DataFrame, b: DataFrame, on: Sequence[str] = ("set_id",)) -> DataFrame:
    """Weighted chamfer distance of the sets that share the join columns."""

    def score(row) -> tuple:
        return (chamfer_of(_points(row, "a"), _points(row, "b"), np.asarray(row.w_a), np.asarray(row.w_b)),)

    return _over_pairs(paired_sets(a, b, on), on, score, {"chamfer": "double"})


def compare_sets(a: DataFrame, b: DataFrame, on: Sequence[str] = ("set_id",), threshold: float = SIGNIFICANT_WEIGHT) -> DataFrame:
    """Smallest and mean centroid distance of significant splats; mean and largest weight and width differences."""

    def run(row) -> tuple:
        keep_a, keep_b = np.asarray(row.w_a) > threshold, np.asarray(row.w_b) > threshold
        low = mean = None
        if keep_a.any() and keep_b.any():
            parts = [(float(d.min()), float(d.sum())) for d in distance_strips(_points(row, "a")[keep_a], _points(row, "b")[keep_b])]
            low, mean = min(p[0] for p in parts), sum(p[1] for p in parts) / int(keep_a.sum() * keep_b.sum())
        dw, ds = np.abs(np.asarray(row.w_a) - row.w_b), np.abs(np.asarray(row.sigma_a) - row.sigma_b)
        return low, mean, float(dw.mean()), float(dw.max()), float(ds.mean()), float(ds.max())

    names = ("min_centroid_distance", "mean_centroid_distance", "weight_diff_mean", "weight_diff_max", "sigma_diff_mean", "sigma_diff_max")
    return _over_pairs(paired_sets(a, b, on), on, run, {n: "double" for n in names})


def structural_metrics(splats: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Centre of mass, radius of gyration, principal moments and shape numbers per set.

    With moments m1 >= m2 >= m3: asphericity is m3 - (m1 + m2) / 2 and
    acylindricity m2 - m1, so both are at most zero.
    """
    kept = [*keys, "n", "w_sum", "cx", "cy", "cz"]
    solved = symmetric_eigenvalues(weighted_moments(splats, keys), _MOMENTS, ("m1", "m2", "m3")).select(*kept, "m1", "m2", "m3")
    return solved.select(
        *kept, F.sqrt(F.greatest(F.col("m1") + F.col("m2") + F.col("m3"), F.lit(0.0))).alias("radius_of_gyration"), "m1", "m2", "m3",
        (F.col("m3") - (F.col("m1") + F.col("m2")) / 2).alias("asphericity"), (F.col("m2") - F.col("m1")).alias("acylindricity"),
    )


def align_sets_pca(
    splats: DataFrame, template: DataFrame, on: str, radii: Sequence[float] = RADII, center: Sequence[float] = (24.0, 24.0, 24.0), percentile: float = WEIGHT_PERCENTILE
) -> DataFrame:
    """Rotate every set onto the template of its group by principal axes; the radius with the best chamfer score wins.

    All radii are tried in one plan: filters, axes and scores carry the radius
    as a key column. ``template`` has one set per value of ``on``. Fewer than
    three points have no axes of their own, so a radius that selects fewer on
    either side is not tried.
    """
    radius = F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius")
    mine = splats.select("*", radius)
    theirs = template.select("*", radius)
    # The fall-back to the sphere alone applies to both sets of a pair, so the counts of both decide.
    a, b = (_candidates(df, center, percentile, keys) for df, keys in ((mine, (on, "set_id", "radius")), (theirs, (on, "radius"))))
    pair_counts = (
        a.groupBy(on, "set_id", "radius").agg(F.count_if("__both").alias("na"))
        .join(b.groupBy(on, "radius").agg(F.count_if("__both").alias("nb")), [on, "radius"])
        .select(on, "set_id", "radius", ((F.col("na") < MIN_POINTS) | (F.col("nb") < MIN_POINTS)).alias("__loose"))
    )
    keep = F.when(F.col("__loose"), F.col("__in")).otherwise(F.col("__both"))
    key = [on, "set_id", "radius"]
    side_a = a.join(pair_counts, key).filter(keep)
    side_b = b.join(pair_counts, [on, "radius"], "inner").filter(keep)
    columns = ["cx", "cy", "cz", "axes"]
    axes_a = weighted_pca(side_a.select(*key, "x", "y", "z", "w"), key).filter(F.col("n") >= AXES_POINTS).select(*key, *[F.col(c).alias(f"{c}_a") for c in columns])
    axes_b = weighted_pca(side_b.select(*key, "x", "y", "z", "w"), key).filter(F.col("n") >= AXES_POINTS).select(*key, *[F.col(c).alias(f"{c}_b") for c in columns])
    turned = axes_a.join(axes_b, key)

    points = ("x", "y", "z", "sigma", "w")
    packed_a = pack_splats(splats, (on, "set_id")).select(on, "set_id", *[F.col(c).alias(f"{c}_a") for c in points])
    packed_b = pack_splats(template, (on,)).select(on, *[F.col(c).alias(f"{c}_b") for c in points])
    pairs = turned.withColumnsRenamed({"axes_a": "u_a", "axes_b": "u_b"}).join(packed_a, [on, "set_id"]).join(packed_b, on)
    middle = np.asarray(center, dtype=float)

    def selected(points_: np.ndarray, w: np.ndarray, radius_: float) -> tuple[np.ndarray, np.ndarray]:
        near = np.linalg.norm(points_ - middle, axis=1) < radius_
        return near, near & (w > np.percentile(w, percentile))

    def score(row) -> tuple:
        u_a, u_b = np.asarray(row.u_a).reshape(3, 3), np.asarray(row.u_b).reshape(3, 3)
        rotation = u_b @ u_a.T
        moved = (_points(row, "a") - np.array([row.cx_a, row.cy_a, row.cz_a])) @ rotation.T + np.array([row.cx_b, row.cy_b, row.cz_b])
        fixed, wa, wb = _points(row, "b"), np.asarray(row.w_a, dtype=float), np.asarray(row.w_b, dtype=float)
        near_a, both_a = selected(moved, wa, row.radius)
        near_b, both_b = selected(fixed, wb, row.radius)
        if both_a.sum() < MIN_POINTS or both_b.sum() < MIN_POINTS:
            both_a, both_b = near_a, near_b
        return chamfer_of(fixed[both_b], moved[both_a], wb[both_b], wa[both_a]), rotation.ravel()

    scored = _over_pairs(pairs, key, score, {"score": "double", "rotation": "array<double>"})
    # Radii that fit equally well but for rounding tie, and the smallest one wins.
    best = scored.groupBy(on, "set_id").agg(F.min(F.struct(F.round("score", 9).alias("near"), "radius", "score", "rotation")).alias("b"))
    return best.select(on, "set_id", "b.radius", "b.score", "b.rotation")


def _candidates(df: DataFrame, center: Sequence[float], percentile: float, keys: Sequence[str]) -> DataFrame:
    cuts = df.groupBy(*keys).agg(F.percentile("w", percentile / 100.0).alias("__cut"))
    marked = df.join(cuts, list(keys)).withColumn("__in", in_sphere(F.col("radius"), center))
    return marked.withColumn("__both", F.col("__in") & (F.col("w") > F.col("__cut"))).select(*keys, "x", "y", "z", "w", "__in", "__both")


def to_voxel_coords(splats: DataFrame, size: float, padding: float = 9.0, order: Sequence[int] = (1, 0, 2)) -> DataFrame:
    """Map coordinates from -1..1 of the padded box to voxels of the box, and permute the axes."""
    span = (size + 2.0 * padding) / 2.0
    moved = {out: (F.col("xyz"[src]) + 1.0) * span - padding for out, src in zip("xyz", order)}
    return splats.withColumns({f"__{k}": v for k, v in moved.items()}).drop("x", "y", "z").withColumnsRenamed({f"__{k}": k for k in "xyz"})


def significant_splats(splats: DataFrame, threshold: float = SIGNIFICANT_WEIGHT, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    return splats.groupBy(*keys).agg(F.count_if(F.col("w") > threshold).alias("n_significant"))
