"""Statistics and transforms of dense volumes.

A volume is one row: ``data`` (row-major array) and ``shape`` (three ints).
Work on single volumes runs inside Arrow batches and moves no data between
tasks; only work across volumes (means over groups) explodes to voxels, where
partial aggregation shrinks the rows before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.hashing import uniform

# Floor added to scales, percentile ranges of the two normalisation rules, augmentation defaults.
SCALE_FLOOR = 1e-6
PERCENTILES = {"volume": (1.0, 99.0), "dataset": (2.0, 98.0)}
AUGMENT_DEFAULTS = {
    "rotation_prob": 0.5,
    "noise_prob": 0.7,
    "contrast_prob": 0.7,
    "noise_std_range": (0.05, 0.2),
    "contrast_range": (0.7, 1.3),
    "brightness_range": (-0.1, 0.1),
}

SLICE_VOXELS = 1_000_000  # voxels handled at a time, so that large boxes do not pile up in a Python worker


def per_volume(df: DataFrame, fn: Callable, outputs: dict[str, str], inputs: Sequence[str] = ("data",), extra: Sequence[str] = ()) -> DataFrame:
    """Replace or add columns by ``fn(*volumes, *extra values)``, one tuple per row.

    A narrow map over Arrow batches; columns not named are passed through.
    """
    kept = [c for c in df.columns if c not in outputs]
    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{c}` {k}" for c, k in outputs.items()])

    def apply(batch: pd.DataFrame) -> pd.DataFrame:
        shapes = [tuple(int(s) for s in shape) for shape in batch["shape"]]
        volumes = [[np.asarray(v, dtype=np.float64).reshape(s) for v, s in zip(batch[c], shapes)] for c in inputs]
        rows = [fn(*args) for args in zip(*volumes, *[batch[c] for c in extra])]
        out = batch[kept].copy()
        for i, (name, kind) in enumerate(outputs.items()):
            values = [row[i] for row in rows]
            if kind == "array<double>":
                values = [np.asarray(v, dtype=np.float64).ravel() for v in values]
            out[name] = pd.Series(values, index=out.index, dtype=object if kind.startswith("array") else None)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                step = max(1, SLICE_VOXELS // max(1, len(batch[inputs[0]].iloc[0])))
                for start in range(0, len(batch), step):
                    yield apply(batch.iloc[start : start + step])

    return df.mapInPandas(run, schema)


def to_voxels(df: DataFrame, col: str = "data", out: str = "v") -> DataFrame:
    """Long form ``(..., z, y, x, v)`` of packed volumes."""
    ny, nx = F.col("shape")[1], F.col("shape")[2]
    exploded = df.select(*[c for c in df.columns if c != col], F.posexplode(col).alias("pos", out))
    return exploded.select(
        *[c for c in exploded.columns if c not in ("pos", out, "shape")],
        F.floor(F.col("pos") / (ny * nx)).cast("int").alias("z"),
        F.pmod(F.floor(F.col("pos") / nx), ny).cast("int").alias("y"),
        F.pmod(F.col("pos"), nx).cast("int").alias("x"),
        out,
    )


def packed_by_position(cells: DataFrame, keys: Sequence[str], value: str = "v", out: str = "data") -> DataFrame:
    """Pack ``(keys, pos, value)`` back into one array per key; a group is one volume."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", value)))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda c: c[value]).alias(out))


STATS = {
    "mean": "double", "std": "double", "min": "double", "max": "double", "median": "double",
    "p1": "double", "p5": "double", "p95": "double", "p99": "double", "n_voxels": "int",
}


def volume_stats(df: DataFrame) -> DataFrame:
    """Mean, population deviation, range and percentiles of each volume."""

    def stats(v: np.ndarray) -> tuple:
        p1, p5, median, p95, p99 = np.percentile(v, [1, 5, 50, 95, 99])
        return (v.mean(), v.std(), v.min(), v.max(), median, p1, p5, p95, p99, v.size)

    return per_volume(df, stats, STATS).drop("data")


def normalize(df: DataFrame, method: str = "z-score", rule: str = "volume") -> DataFrame:
    """Normalised volumes with the ``(center, scale)`` they were normalised with.

    Rule ``volume`` adds a small floor to the scale; rule ``dataset`` divides by
    the scale itself and leaves constant volumes at zero.
    """
    if method not in ("z-score", "min-max", "percentile", "none"):
        raise ValueError(f"unknown method {method}")

    def run(v: np.ndarray) -> tuple:
        if method == "none" or (rule == "dataset" and not v.any()):
            return v, 0.0, 1.0
        if method == "z-score":
            center, scale = v.mean(), v.std()
        else:
            low, high = (v.min(), v.max()) if method == "min-max" else np.percentile(v, PERCENTILES[rule])
            center, scale = low, high - low
        if rule == "volume":
            out = (v - center) / (scale + SCALE_FLOOR)
        elif scale > 0:
            out = (v - center) / scale
        else:
            out = v - center if method == "z-score" else np.zeros_like(v)
        if method == "percentile":
            out = np.clip(out, 0.0, 1.0)
        return out, float(center), float(scale)

    return per_volume(df, run, {"data": "array<double>", "center": "double", "scale": "double"})


def denormalize(df: DataFrame) -> DataFrame:
    """Undo ``normalize`` with the stored center and scale."""
    return df.withColumn("data", F.transform("data", lambda v: v * F.col("scale") + F.col("center")))


def center_crop(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Cut the centre of each volume; axes already small enough stay as they are."""

    def run(v: np.ndarray) -> tuple:
        take = tuple(slice((n - t) // 2, (n - t) // 2 + t) if n > t else slice(None) for n, t in zip(v.shape, shape))
        out = v[take]
        return out, list(out.shape)

    return per_volume(df, run, {"data": "array<double>", "shape": "array<int>"})


def projections(df: DataFrame, agg: str = "sum") -> DataFrame:
    """Projection along each axis, scaled to [0, 1]; a flat projection is 0. One row per (volume, axis)."""

    def run(v: np.ndarray) -> tuple:
        out = []
        for axis in range(3):
            flat = getattr(np, agg)(v, axis=axis)
            low, high = flat.min(), flat.max()
            out.append(((flat - low) / (high - low) if high > low else np.zeros_like(flat)).ravel())
        return tuple(out)

    names = [f"__p{axis}" for axis in range(3)]
    wide = per_volume(df, run, {n: "array<double>" for n in names}).drop("data", "shape")
    rows = F.explode(F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(n).alias("image")) for axis, n in enumerate(names)]))
    return wide.withColumn("__r", rows).select(*[c for c in wide.columns if c not in names], "__r.axis", "__r.image")


def pool_features(df: DataFrame, k: int = 8, voxel_size: float = 1.0) -> DataFrame:
    """Average pooling over k*k*k blocks as one feature vector, divided by the voxel size."""
    factor = 1.0 / voxel_size if voxel_size > 0 else 1.0

    def run(v: np.ndarray) -> tuple:
        n = [s // k for s in v.shape]
        blocks = v[: n[0] * k, : n[1] * k, : n[2] * k].reshape(n[0], k, n[1], k, n[2], k)
        return (blocks.mean(axis=(1, 3, 5)).ravel() * factor,)

    return per_volume(df, run, {"feature": "array<double>"}).drop("data", "shape")


def radius_grid(shape: Sequence[int]) -> np.ndarray:
    """Distance of each voxel from the voxel at ``shape // 2``."""
    axes = np.ogrid[tuple(slice(0, n) for n in shape)]
    return np.sqrt(sum((a - n // 2) ** 2.0 for a, n in zip(axes, shape)))


def soft_sphere(shape: Sequence[int], radius: float, edge: float) -> np.ndarray:
    """1 inside the radius, a Gaussian flank over the edge, 0 beyond it."""
    r = radius_grid(shape)
    flank = np.exp(-((r - radius) ** 2) / (2.0 * (edge / 3.0) ** 2))
    return np.where(r <= radius, 1.0, np.where(r < radius + edge, flank, 0.0))


def soft_mask(df: DataFrame, radius: float, edge: float) -> DataFrame:
    return per_volume(df, lambda v: (v * soft_sphere(v.shape, radius, edge),), {"data": "array<double>"})


def gradient_size(v: np.ndarray) -> np.ndarray:
    """Length of the gradient: central differences, one-sided at the ends."""
    return np.sqrt(sum(np.square(g) for g in np.gradient(v)))


def edge_strength(df: DataFrame) -> DataFrame:
    return per_volume(df, lambda v: (float(gradient_size(v).mean()),), {"edge_strength": "double"}).drop("data", "shape")


def local_histogram(df: DataFrame, bins: int = 32, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Share of the zero-padded 3x3x3 neighbourhood of each voxel that falls in each bin.

    Rows ``(..., pos, bin, share)`` with a share above zero; the last bin is
    closed, values outside the range are in no bin.
    """

    def window_sum(a: np.ndarray) -> np.ndarray:
        for axis in range(3):
            a = sum(np.take(a, range(s, s + a.shape[axis] - 2), axis=axis) for s in range(3))
        return a

    def run(v: np.ndarray) -> tuple:
        padded = np.pad(v, 1)
        slot = np.minimum(np.floor((padded - low) / (high - low) * bins).astype(int), bins - 1)
        inside = (padded >= low) & (padded <= high)
        pos, where, share = [], [], []
        for b in np.unique(slot[inside]):
            count = window_sum(((slot == b) & inside).astype(np.int32)).ravel()
            hit = np.nonzero(count)[0]
            pos.append(hit)
            where.append(np.full(len(hit), b))
            share.append(count[hit] / 27.0)
        if not pos:
            return [], [], []
        return np.concatenate(pos).astype(np.int32), np.concatenate(where).astype(np.int32), np.concatenate(share)

    packed = per_volume(df, run, {"pos": "array<int>", "bin": "array<int>", "share": "array<double>"}).drop("data", "shape")
    keys = [c for c in packed.columns if c not in ("pos", "bin", "share")]
    return packed.select(*keys, F.inline(F.arrays_zip("pos", "bin", "share")))


def augment_plan(df: DataFrame, seed, id_col: str = "vol", **config) -> DataFrame:
    """Random choices of each augmentation as columns, from hashes of the id: re-runs agree.

    ``turns`` quarter turns, noise deviation relative to the volume deviation,
    contrast factor and brightness offset; neutral values where a step is not taken.
    """
    cfg = {**AUGMENT_DEFAULTS, **config}

    def draw(name: str) -> Column:
        return uniform(f"{seed}{name}", F.col(id_col))

    def between(name: str, bounds: Sequence[float]) -> Column:
        return F.lit(float(bounds[0])) + draw(name) * F.lit(float(bounds[1] - bounds[0]))

    contrast = draw("c") < cfg["contrast_prob"]
    return df.withColumns({
        "turns": F.when(draw("r") < cfg["rotation_prob"], F.floor(draw("k") * 3).cast("int") + 1).otherwise(F.lit(0)),
        "noise": F.when(draw("n") < cfg["noise_prob"], between("s", cfg["noise_std_range"])).otherwise(F.lit(0.0)),
        "contrast": F.when(contrast, between("f", cfg["contrast_range"])).otherwise(F.lit(1.0)),
        "brightness": F.when(contrast, between("b", cfg["brightness_range"])).otherwise(F.lit(0.0)),
    })


def augment(df: DataFrame, seed, id_col: str = "vol", **config) -> DataFrame:
    """Apply the plan: turns in the first two axes, Gaussian noise, contrast and brightness about the mean.

    The noise generator is seeded per volume, so a lost task repeats the same noise.
    """

    def run(v: np.ndarray, key, turns, noise, contrast, brightness) -> tuple:
        v = np.rot90(v, k=int(turns), axes=(0, 1))
        if noise > 0:
            digest = hashlib.md5(f"{key}|{seed}".encode()).digest()
            source = np.random.Generator(np.random.Philox(int.from_bytes(digest[:8], "big")))
            v = v + source.normal(0.0, noise * v.std(), v.shape)
        mean, std = v.mean(), v.std()
        return (contrast * (v - mean) + mean + brightness * std, list(v.shape))

    planned = augment_plan(df, seed, id_col, **config)
    plan = ["turns", "noise", "contrast", "brightness"]
    return per_volume(planned, run, {"data": "array<double>", "shape": "array<int>"}, extra=[id_col, *plan]).drop(*plan)


def match_stats(df: DataFrame, source_col: str = "source") -> DataFrame:
    """Give each volume the mean and deviation of the source volume in the same row."""

    def run(v: np.ndarray, source: np.ndarray) -> tuple:
        std = v.std()
        v = (v - v.mean()) / std if std > 0 else v
        return (v * source.std() + source.mean(),)

    return per_volume(df, run, {"data": "array<double>"}, inputs=("data", source_col))


#: Bytes of sums a task holds before it hands them on.
SUM_BYTES = 64 << 20


def voxel_sums(df: DataFrame, keys: Sequence[str], col: str = "data") -> DataFrame:
    """``(keys, pos, n, s)``: voxel sums per group. Volumes are added as arrays inside each task; only the sums are exploded."""
    types = dict(df.dtypes)
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, list] = {}
        held = 0

        def emit() -> pd.DataFrame:
            rows = [(*k, n, s) for k, (n, s) in totals.items()]
            totals.clear()
            return pd.DataFrame(rows, columns=[*names, "n", "s"])

        for batch in batches:
            for key, volume in zip(batch[names].itertuples(index=False, name=None), batch[col], strict=True):
                volume = np.asarray(volume, dtype=np.float64)
                if key in totals:
                    totals[key][0] += 1
                    totals[key][1] += volume
                else:
                    totals[key] = [1, volume.copy()]
                    held += volume.nbytes
            if held > SUM_BYTES:
                yield emit()
                held = 0
        if totals:
            yield emit()

    schema = ", ".join(f"`{k}` {types[k]}" for k in names) + ", n long, s array<double>"
    sums = df.select(*names, col).mapInPandas(run, schema)
    cells = sums.select(*names, "n", F.posexplode("s").alias("pos", "s"))
    return cells.groupBy(*names, "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def mean_voxels(df: DataFrame, keys: Sequence[str], col: str = "data") -> DataFrame:
    """Voxel-wise mean per group as ``(keys, pos, v)``."""
    return voxel_sums(df, keys, col).select(*keys, "pos", (F.col("s") / F.col("n")).alias("v"))


def mean_volume(df: DataFrame, keys: Sequence[str], col: str = "data") -> DataFrame:
    return packed_by_position(mean_voxels(df, keys, col), keys)
