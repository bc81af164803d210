"""Atoms to a normalised affinity matrix: density, pooled features, pairs, background rule, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.similarity import background_rows, directed, normalize_affinity, pairwise_affinity
from motefield.operators.structures import atom_density
from motefield.operators.volumes import pool_features


def structure_features(atoms: DataFrame, box: int, voxel: float, resolution: float, pool: int) -> DataFrame:
    """Pooled density per structure, as ``(id, feature)``."""
    density = atom_density(atoms, box, voxel, resolution)
    return pool_features(density, pool, voxel).select(F.col("structure").alias("id"), "feature")


def similarity_matrix(atoms: DataFrame, box: int = 48, voxel: float = 10.0, resolution: float = 20.0, pool: int = 8, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The affinity table of all structures, and its normalised directed matrix."""
    pairs = pairwise_affinity(structure_features(atoms, box, voxel, resolution, pool), existing=existing)
    return pairs, normalize_affinity(background_rows(directed(pairs)))
