"""Combined evaluation of embeddings, reconstructed volumes and poses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.embeddings import class_separation, distance_sums, diversity, mean_distance_of
from motefield.operators.poses import rotation_metrics
from motefield.operators.volume_metrics import PAIR, QUALITY, pair_of, quality_of
from motefield.operators.volumes import per_volume
from motefield.session import written


def volume_report(pairs: DataFrame) -> DataFrame:
    """Quality of each volume of a pair table together with its distance to the ground truth."""
    outputs = {m: "double" for m in (*QUALITY, *PAIR)}
    return per_volume(pairs, lambda a, b: (*quality_of(a), *pair_of(a, b)), outputs, inputs=("data_a", "data_b")).drop("data_a", "data_b", "shape")


def over_volumes(report: DataFrame, metrics) -> DataFrame:
    """Mean and population deviation of each metric over the volumes, long form."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).alias("v")) for m in metrics]))
    stats = report.select(cells.alias("c")).groupBy("c.name").agg(F.avg("c.v").alias("mean"), F.stddev_pop("c.v").alias("std"))
    both = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{s}_"), "name").alias("metric"), F.col(s).alias("value")) for s in ("mean", "std")]))
    return stats.select(both.alias("m")).select("m.*")


def evaluate(embeddings: DataFrame | None = None, pairs: DataFrame | None = None, rotations: DataFrame | None = None, rotation_id: str = "vec_id") -> DataFrame:
    """One long report ``(part, metric, value)`` of whatever tables are given."""
    parts = []
    if embeddings is not None:
        sums = written(distance_sums(embeddings), "distances")
        parts.append(("embedding", class_separation(embeddings, sums=sums)))
        for method, value in (("variance", diversity(embeddings, "variance")), ("pairwise", mean_distance_of(sums))):
            parts.append(("diversity", value.select(F.lit(method).alias("metric"), F.col("diversity").alias("value"))))
    if pairs is not None:
        parts.append(("reconstruction", over_volumes(volume_report(pairs), (*QUALITY, *PAIR))))
    if rotations is not None:
        parts.append(("pose", rotation_metrics(rotations, rotation_id)))
    out = None
    for name, df in parts:
        named = df.select(F.lit(name).alias("part"), "metric", "value")
        out = named if out is None else out.unionByName(named)
    return out
