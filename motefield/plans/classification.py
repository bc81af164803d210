"""Comparison of two embedding sources and their fusion by cross-validated classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.classification import (
    N_FOLDS,
    SEED,
    class_improvement,
    cross_validate,
    fold_accuracy,
    fuse,
    improvement_report,
    mean_average_precision,
    per_class_metrics,
    predictions,
    spread_over_folds,
)
from motefield.operators.joins import align_tables
from motefield.operators.sampling import balance
from motefield.session import written


def compare_sources(
    first: DataFrame, second: DataFrame, fusion: str = "average", balanced: bool = False, k: int = N_FOLDS, seed=SEED, max_iter: int = 100
) -> dict[str, DataFrame]:
    """Tables ``(id, cls, feature)`` of two sources to a set of reports.

    Rows are aligned class by class, classified alone and fused over the same
    folds, and compared: ``summary`` per method, ``per_class`` per method,
    ``improvement`` of the fusion over the second source and its ``class_improvement``.
    """
    a = first.select(F.col("id").alias("id_a"), "cls", F.col("feature").alias("a"))
    b = second.select(F.col("id").alias("id_b"), "cls", F.col("feature").alias("b"))
    pairs = align_tables(a, b, "cls", "id_a", "id_b", seed).withColumn("id", F.concat_ws("|", "cls", "pair_rank"))
    rows = written(balance(pairs, "cls", "id", seed) if balanced else pairs, "aligned")
    methods = {"first": F.col("a"), "second": F.col("b"), "fused": fuse(F.col("a"), F.col("b"), fusion)}
    scores = written(cross_validate(rows, methods, "cls", "id", k, seed, max_iter), "scores")
    maps, classes, summary = {}, {}, None
    for name in methods:
        own = scores.filter(F.col("method") == name).drop("method")
        maps[name], classes[name] = mean_average_precision(own), per_class_metrics(own)
        accuracy = spread_over_folds(fold_accuracy(predictions(own)), "accuracy").select(F.lit(name).alias("method"), "mean_accuracy", "std_accuracy")
        line = accuracy.join(spread_over_folds(maps[name], "map").withColumn("method", F.lit(name)), "method")
        summary = line if summary is None else summary.unionByName(line)
    per_class = None
    for name, table in classes.items():
        part = table.withColumn("method", F.lit(name))
        per_class = part if per_class is None else per_class.unionByName(part)
    return {
        "scores": scores,
        "summary": summary,
        "per_class": per_class,
        "improvement": improvement_report(maps["second"], maps["fused"]),
        "class_improvement": class_improvement(classes["second"], classes["fused"]),
    }
