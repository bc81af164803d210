"""Atom tables and splat sets: summary rows and density volumes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.volumes import per_volume

# Full width at half maximum per unit of sigma; reach of the smoothing kernel in sigmas.
FWHM_PER_SIGMA = 2.355
KERNEL_REACH = 4.0


def structure_info(atoms: DataFrame, key: str = "structure") -> DataFrame:
    """Atoms, chains, mass, centre of mass, extent, radius of gyration and diameter per structure, in one aggregate.

    The radius comes from centred moments, so it holds far from the origin too.
    """
    mass = F.sum("mass")
    place = array_to_vector(F.array(*[F.col(a).cast("double") for a in "xyz"]))
    moments = Summarizer.metrics("mean", "variance").summary(place, F.col("mass").cast("double"))
    extent = {a: F.max(a) - F.min(a) for a in "xyz"}
    info = atoms.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_atoms"), mass.alias("mass"), F.sum(F.col("mass") * F.col("mass")).alias("__ww"), moments.alias("__m"), *[extent[a].alias(f"extent_{a}") for a in "xyz"]
    )
    chains = atoms.groupBy(key).agg(F.count_distinct("chain").cast("int").alias("n_chains"))
    center, spread = vector_to_array("__m.mean"), vector_to_array("__m.variance")
    # the variance divides by the weight less its share of squares; undo that to get the mean square
    square = sum(F.get(spread, i) for i in range(3)) * (1 - F.col("__ww") / (F.col("mass") * F.col("mass")))
    info = info.withColumns({**{f"center_{a}": F.get(center, i) for i, a in enumerate("xyz")}, "radius_of_gyration": F.sqrt(F.greatest(square, F.lit(0.0)))}).drop("__m", "__ww")
    longest = F.greatest("extent_x", "extent_y", "extent_z")
    return info.withColumns({"max_extent": longest, "diameter_nm": longest / 10, "mass_kda": F.col("mass") / 1000}).join(chains, key)


def rasterize(atoms: DataFrame, box: int, voxel: float, key: str = "structure") -> DataFrame:
    """Mass density on a grid, ``(key, i, j, k, density)``: centred by mass, shared over eight corners.

    Atoms outside the box are dropped. Every atom adds to eight cells; the sums
    are combined before the shuffle, so a structure with a third of all atoms
    is no hot spot.
    """
    mass = F.sum("mass")
    centers = atoms.groupBy(key).agg(*[(F.sum(F.col("mass") * F.col(a)) / mass).alias(f"c{a}") for a in "xyz"])
    placed = atoms.join(centers, key).select(key, "mass", *[((F.col(a) - F.col(f"c{a}")) / voxel + box / 2).alias(a) for a in "xyz"])
    for a in "xyz":
        placed = placed.filter((F.col(a) >= 0) & (F.col(a) < box - 1))
    corners = F.explode(F.array(*[F.array(F.lit(d >> 2), F.lit(d >> 1 & 1), F.lit(d & 1)) for d in range(8)])).alias("d")
    split = placed.select(key, "mass", *[F.floor(a).cast("int").alias(f"i{a}") for a in "xyz"], *[(F.col(a) - F.floor(a)).alias(f"f{a}") for a in "xyz"], corners)
    weight = F.col("mass")
    for n, a in enumerate("xyz"):
        weight = weight * (F.lit(1.0) - F.abs(F.col("d")[n] - F.col(f"f{a}")))
    cells = split.select(key, *[(F.col(f"i{a}") + F.col("d")[n]).alias(out) for n, (a, out) in enumerate(zip("xyz", "ijk"))], weight.alias("w"))
    return cells.groupBy(key, "i", "j", "k").agg(F.sum("w").alias("density"))


def pack_density(cells: DataFrame, box: int, key: str = "structure") -> DataFrame:
    """Dense volume per structure from its occupied cells (at most one per voxel)."""
    pos = (F.col("i") * box + F.col("j")) * box + F.col("k")
    filled = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(pos.alias("pos"), "density"))).alias("m"))
    sparse = filled.select(key, F.map_keys("m").alias("pos"), F.map_values("m").alias("value"), F.array(*[F.lit(box)] * 3).alias("shape"))
    types = dict(cells.dtypes)

    def run(batches):
        for batch in batches:
            data = []
            for pos_, value in zip(batch["pos"], batch["value"]):
                dense = np.zeros(box**3)
                dense[np.asarray(pos_, dtype=np.int64)] = value
                data.append(dense)
            yield pd.DataFrame({key: batch[key], "shape": batch["shape"], "data": data})

    return sparse.mapInPandas(run, f"{key} {types[key]}, shape array<int>, data array<double>")


def smoothing_matrix(n: int, sigma: float) -> np.ndarray:
    """Matrix of a truncated Gaussian filter along one axis, with the signal mirrored at its ends."""
    reach = int(KERNEL_REACH * sigma + 0.5)
    offsets = np.arange(-reach, reach + 1)
    kernel = np.exp(-0.5 * (offsets / sigma) ** 2)
    kernel /= kernel.sum()
    place = np.mod(np.arange(n)[:, None] + offsets[None, :], 2 * n)
    place = np.where(place < n, place, 2 * n - 1 - place)
    out = np.zeros((n, n))
    np.add.at(out, (np.arange(n)[:, None], place), kernel[None, :])
    return out


def smooth(df: DataFrame, sigma: float) -> DataFrame:
    """Gaussian smoothing of each volume: one matrix product per axis, no data movement."""
    if sigma <= 0:
        return df

    def run(v: np.ndarray) -> tuple:
        a, b, c = (smoothing_matrix(n, sigma) for n in v.shape)
        return (np.einsum("iz,jy,kx,zyx->ijk", a, b, c, v, optimize=True),)

    return per_volume(df, run, {"data": "array<double>"})


def resolution_sigma(resolution: float, voxel: float) -> float:
    return resolution / (FWHM_PER_SIGMA * voxel)


def scale_to_unit(df: DataFrame) -> DataFrame:
    """Min-max scaling of each volume; constant volumes stay as they are."""

    def run(v: np.ndarray) -> tuple:
        low, high = v.min(), v.max()
        return ((v - low) / (high - low) if high > low else v,)

    return per_volume(df, run, {"data": "array<double>"})


def atom_density(atoms: DataFrame, box: int, voxel: float, resolution: float, key: str = "structure") -> DataFrame:
    """Atoms to a smoothed density scaled to [0, 1]."""
    return scale_to_unit(smooth(pack_density(rasterize(atoms, box, voxel, key), box, key), resolution_sigma(resolution, voxel)))


def _axis_profile(centers: np.ndarray, grid: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    return np.exp(-((grid[None, :] - centers[:, None]) ** 2) / (2.0 * sigma[:, None] ** 2))


def pack_splats(splats: DataFrame, keys: Sequence[str] = ("set_id",), columns: Sequence[str] = ("x", "y", "z", "sigma", "w")) -> DataFrame:
    """One row per set with its splats as arrays, ordered by splat id. A set is the output of one decoder call."""
    ordered = F.array_sort(F.collect_list(F.struct("splat_id", *columns)))
    packed = splats.groupBy(*keys).agg(ordered.alias("s"))
    return packed.select(*keys, *[F.col("s")[c].alias(c) for c in columns])


def render_splats(splats: DataFrame, shape: Sequence[int], keys: Sequence[str] = ("set_id",), rotation: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Sum of w * exp(-(d / sigma)^2 / 2) on the voxel grid (first axis x, as the centroids are stored).

    A Gaussian is a product over the axes, so a set is rendered by one
    contraction of three (splats, n) profiles instead of splats * voxels rows.
    """
    turn = None if rotation is None else np.asarray(rotation, dtype=float)

    def run(x, y, z, sigma, w) -> np.ndarray:
        at = np.stack([x, y, z])
        at = at if turn is None else turn @ at
        profiles = [_axis_profile(c, np.arange(n, dtype=float), sigma) for c, n in zip(at, shape)]
        return np.einsum("s,sa,sb,sc->abc", w, *profiles, optimize=True)

    return _render(pack_splats(splats, keys), keys, shape, run)


def render_splats_clamped(splats: DataFrame, shape: Sequence[int], sigma_range: Sequence[float], keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Rendering on the grid from -1 to 1 with weights, widths and the result clamped."""
    low, high = sigma_range

    def run(x, y, z, sigma, w) -> np.ndarray:
        width = np.clip(sigma * (high - low) + low, 1e-6, 1.0)
        profiles = [_axis_profile(c, np.linspace(-1.0, 1.0, n), width) for c, n in zip((x, y, z), shape)]
        return np.clip(np.einsum("s,sa,sb,sc->abc", np.clip(w, 0.0, 1.0), *profiles, optimize=True), 0.0, 1.0)

    return _render(pack_splats(splats, keys), keys, shape, run)


def _render(packed: DataFrame, keys: Sequence[str], shape: Sequence[int], run) -> DataFrame:
    types = dict(packed.dtypes)
    names = ("x", "y", "z", "sigma", "w")
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", shape array<int>, data array<double>"

    def paint(batches):
        for batch in batches:
            data = [run(*[np.asarray(v, dtype=float) for v in row]).ravel() for row in zip(*[batch[c] for c in names])]
            yield batch[list(keys)].assign(shape=[list(shape)] * len(batch), data=data)

    return packed.mapInPandas(paint, schema)
