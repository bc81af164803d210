"""Quality of single volumes, of pairs of volumes, shell correlation and convergence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.hashing import normal
from motefield.operators.ranking import rank_by_value
from motefield.operators.volumes import gradient_size, packed_by_position, per_volume, radius_grid, soft_sphere, voxel_sums

# Constants of the structural similarity, fewest samples of a shell, resolution without any shell.
SSIM_C1 = 1e-4
SSIM_C2 = 9e-4
MIN_SHELL_SAMPLES = 10
DEFAULT_RESOLUTION = 240.0

QUALITY = ("mean_intensity", "std_intensity", "dynamic_range", "active_fraction", "contrast", "edge_strength", "snr_db")
PAIR = ("mse", "psnr", "correlation", "ssim")


def quality_of(v: np.ndarray, mask: np.ndarray | None = None) -> tuple:
    inside = v.ravel() if mask is None else v[mask > 0]
    mean, std = inside.mean(), inside.std()
    active = np.count_nonzero(np.abs(inside) > 0.1 * std) / inside.size
    contrast = std / abs(mean) if abs(mean) > 1e-10 else 0.0
    slope = gradient_size(v)
    edge = slope.mean() if mask is None else slope[mask > 0].mean()
    snr = 10.0 * np.log10(np.mean(inside**2) / std**2) if std > 0 else float("inf")
    return tuple(float(m) for m in (mean, std, inside.max() - inside.min(), active, contrast, edge, snr))


def volume_quality(df: DataFrame, mask_col: str | None = None) -> DataFrame:
    """Quality metrics of each volume, inside the mask column if one is named."""
    inputs = ("data",) if mask_col is None else ("data", mask_col)
    return per_volume(df, quality_of, {m: "double" for m in QUALITY}, inputs=inputs).drop(*inputs, "shape")


def pair_of(a: np.ndarray, b: np.ndarray) -> tuple:
    mse = float(np.mean((a - b) ** 2))
    peak = max(np.abs(a).max(), np.abs(b).max())
    psnr = float(20.0 * np.log10(peak / np.sqrt(mse))) if mse > 0 else float("inf")
    da, db = a - a.mean(), b - b.mean()
    va, vb, cov = np.mean(da * da), np.mean(db * db), np.mean(da * db)
    corr = float(cov / np.sqrt(va * vb)) if va > 0 and vb > 0 else 0.0
    light = (2.0 * np.mean(a * b) + SSIM_C1) / (np.mean(a * a) + np.mean(b * b) + SSIM_C1)
    ssim = light * (2.0 * cov + SSIM_C2) / (va + vb + SSIM_C2)
    return mse, psnr, corr, float(np.clip(ssim, 0.0, 1.0))


def pair_metrics(df: DataFrame, a: str = "data_a", b: str = "data_b") -> DataFrame:
    """Squared error, peak signal-to-noise ratio, correlation and global SSIM of two volumes per row."""
    return per_volume(df, pair_of, {m: "double" for m in PAIR}, inputs=(a, b)).drop(a, b, "shape")


def normalized_mse(df: DataFrame, n_voxels: int, a: str = "data_a", b: str = "data_b") -> DataFrame:
    """Squared error summed over all volumes, divided by the number of volumes and the volume size."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return df.agg((F.sum(square) / (F.count(F.lit(1)) * F.lit(n_voxels))).alias("normalized_mse"))


def spectral_shells(df: DataFrame, offset: float, a: str = "data_a", b: str = "data_b", mask: tuple[float, float] | None = None) -> DataFrame:
    """Cross power, powers and sample count per frequency shell, one row per (volume, shell).

    Shell i holds radii in ``[i - offset, i + 1 - offset)``. The transform stays
    inside the task; only about n/2 rows per volume leave it.
    """

    def run(x: np.ndarray, y: np.ndarray) -> tuple:
        if mask is not None:
            sphere = soft_sphere(x.shape, *mask)
            x, y = x * sphere, y * sphere
        fx, fy = np.fft.fftshift(np.fft.fftn(x)), np.fft.fftshift(np.fft.fftn(y))
        count = min(n // 2 for n in x.shape)
        shell = np.floor(radius_grid(x.shape) + offset).astype(int).ravel()
        used = shell < count
        sums = [
            np.bincount(shell[used], weights=p.ravel()[used], minlength=count)
            for p in ((fx * np.conj(fy)).real, np.abs(fx) ** 2, np.abs(fy) ** 2, np.ones(x.shape))
        ]
        return np.arange(count, dtype=np.int32), *sums

    names = ["shell", "cross", "power_a", "power_b", "samples"]
    outputs = {n: "array<int>" if n == "shell" else "array<double>" for n in names}
    wide = per_volume(df, run, outputs, inputs=(a, b)).drop(a, b)
    keys = [c for c in wide.columns if c not in names]
    return wide.select(*keys, F.inline(F.arrays_zip(*names)))


def _correlation():
    scale = F.sqrt(F.col("power_a") * F.col("power_b"))
    return F.when(scale > 0, F.col("cross") / scale).otherwise(F.lit(0.0))


def fsc_curve(df: DataFrame, voxel: float, mask: tuple[float, float] | None = None) -> DataFrame:
    """Fourier shell correlation at shells 1..R-1 of width 1; shells with too few samples are left out."""
    shells = spectral_shells(df, 0.5, mask=mask).filter((F.col("shell") >= 1) & (F.col("samples") >= MIN_SHELL_SAMPLES))
    kept = [c for c in shells.columns if c not in ("shape", "cross", "power_a", "power_b", "samples")]
    return shells.select(*kept, _correlation().alias("fsc"), (F.col("shape")[2] * F.lit(voxel) / (2.0 * F.col("shell"))).alias("resolution"))


def fsc_resolution(curve: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Resolution where the curve crosses the threshold.

    Interpolated when the last shell above is next to the first shell below;
    else the first shell below; the finest shell when none is below and the
    coarsest when none is above. A curve has at most n/2 shells.
    """
    packed = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("shell", "fsc", "resolution"))).alias("__c"))
    count = F.size("__c")
    places = F.sequence(F.lit(0), count - 1)
    above = F.array_max(F.filter(places, lambda i: F.get("__c", i)["fsc"] >= threshold))
    below = F.array_min(F.filter(places, lambda i: F.get("__c", i)["fsc"] < threshold))
    marked = packed.withColumns({"__n": count, "__above": above, "__below": below})
    hi, lo = F.get("__c", F.col("__above")), F.get("__c", F.col("__below"))
    part = (F.lit(threshold) - hi["fsc"]) / (lo["fsc"] - hi["fsc"])
    crossing = hi["resolution"] + part * (lo["resolution"] - hi["resolution"])
    value = (
        F.when((F.col("__n") == 1) | F.col("__above").isNull(), F.get("__c", F.lit(0))["resolution"])
        .when(F.col("__below").isNull(), F.get("__c", F.col("__n") - 1)["resolution"])
        .when(F.col("__below") == F.col("__above") + 1, crossing)
        .otherwise(lo["resolution"])
    )
    return marked.select(*keys, value.alias("resolution"))


def fsc_simple(df: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Variant with shells ``[i, i+1)``: the curve, and the first frequency below the threshold (else the last)."""
    shells = spectral_shells(df, 0.0).filter("samples > 0")
    curve = shells.select(*keys, "shell", _correlation().alias("fsc"), (F.col("shell") + 0.5).alias("frequency"))
    first = F.min(F.when(F.col("fsc") < threshold, F.col("frequency")))
    return curve, curve.groupBy(*keys).agg(F.coalesce(first, F.max("frequency")).alias("resolution"))


# Fixed value: how sharply the weight falls at the edge of the wedge.
WEDGE_STEEPNESS = 100.0


def wedge_mask(n: int, angle: float = 90.0, floor: float = 0.3) -> np.ndarray:
    """Weight of each frequency of the half spectrum: low in the missing wedge, falling with the frequency."""
    kz, ky, kx = np.meshgrid(np.fft.fftfreq(n), np.fft.fftfreq(n), np.fft.rfftfreq(n), indexing="ij")
    tilt = np.where(kz == 0, np.pi / 2.0, np.arctan2(np.abs(kx), np.abs(kz)))
    gate = 1.0 - 1.0 / (1.0 + np.exp(-np.clip(WEDGE_STEEPNESS * (np.deg2rad(angle / 2.0) - tilt), -700, 700)))
    return (floor + (1.0 - floor) * gate) * np.exp(-np.sqrt(kx**2 + ky**2 + kz**2))


def wedge_error(df: DataFrame, angle: float = 90.0, floor: float = 0.3, a: str = "data_a", b: str = "data_b") -> DataFrame:
    """Weighted squared difference of the half spectra of two cubes."""

    def run(x: np.ndarray, y: np.ndarray) -> tuple:
        mask = wedge_mask(x.shape[0], angle, floor)
        delta = np.abs(np.fft.rfftn(x - y)) * mask
        return (float(np.sum(delta**2) / (mask.sum() * x.size)),)

    return per_volume(df, run, {"wedge_error": "double"}, inputs=(a, b)).drop(a, b, "shape")


def convergence(df: DataFrame, reference: DataFrame, counts: Sequence[int], key: str, order_col: str, voxel: float, mask=None) -> DataFrame:
    """Mean of the first n volumes of each group against its reference, for each n the group can fill.

    Ranks are taken on ids alone. A volume is added once, to the slice between
    two counts it falls in; sums of slices, a few rows for each voxel, add up to the means.
    """
    counts = sorted({int(c) for c in counts})
    ranked = rank_by_value(df.select(key, order_col), [key], order_col, group_size="__n").filter(F.col("rn") <= max(counts))
    piece = F.lit(None).cast("int")
    for c in reversed(counts):
        piece = F.when(F.col("rn") <= c, F.lit(c)).otherwise(piece)
    sliced = df.join(ranked, [key, order_col]).withColumn("n", piece).filter(F.col("n") <= F.col("__n"))
    upto = Window.partitionBy(key, "pos").orderBy("c")
    sums = voxel_sums(sliced.withColumnRenamed("n", "c"), [key, "c"]).select(key, F.col("c").alias("n"), "pos", (F.sum("s").over(upto) / F.sum("n").over(upto)).alias("v"))
    means = packed_by_position(sums, [key, "n"], out="data_a")
    pairs = means.join(reference.select(key, "shape", F.col("data").alias("data_b")), key)
    resolution = fsc_resolution(fsc_curve(pairs, voxel, mask), [key, "n"])
    return pair_metrics(pairs).join(resolution, [key, "n"])


def summary_at_max(report: DataFrame, key: str, n_col: str = "n") -> DataFrame:
    """The report row with the largest n per group."""
    rest = [c for c in report.columns if c not in (key, n_col)]
    return report.groupBy(key).agg(F.max(n_col).alias(n_col), *[F.max_by(c, n_col).alias(c) for c in rest])


def resample_spread(df: DataFrame, copies: int, noise: float, seed, id_col: str = "vol") -> DataFrame:
    """Voxel-wise mean and population variance over noisy copies of each volume; the first copy is clean.

    The noise comes from hashes of (volume, voxel, copy): no shuffle, and a
    repeated task gives the same numbers. Needs the deviation of the volume in
    column ``std``.
    """
    voxels = df.select(id_col, "std", F.posexplode("data").alias("pos", "v"))
    shifted = F.transform(F.sequence(F.lit(1), F.lit(copies - 1)), lambda c: F.lit(noise) * F.col("std") * normal(seed, F.col(id_col), F.col("pos"), c))
    made = voxels.withColumn("d", F.array_append(shifted, F.lit(0.0)))
    total = F.aggregate("d", F.lit(0.0), lambda s, d: s + d) / copies
    square = F.aggregate("d", F.lit(0.0), lambda s, d: s + (d - F.col("m")) * (d - F.col("m"))) / copies
    return made.withColumn("m", total).select(id_col, "pos", (F.col("v") + F.col("m")).alias("mean"), square.alias("variance"))
