"""Metric logs ``(epoch, step, key, value)``: last values per epoch, snapshots, curriculum timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.operators.sampling import stage_of

# Endings of duplicated metric names, steps between snapshots.
IGNORED_SUFFIXES = ("_step", "_epoch")
SNAPSHOT_EVERY = 25


def own_metrics(log: DataFrame) -> DataFrame:
    """Log rows whose name is not a per-step or per-epoch duplicate."""
    keep = ~F.col("key").endswith(IGNORED_SUFFIXES[0]) & ~F.col("key").endswith(IGNORED_SUFFIXES[1])
    return log.filter(keep)


def last_per_epoch(log: DataFrame) -> DataFrame:
    """Last value of each metric in each epoch, long form; of equal steps the largest value. One aggregate with partial maxima."""
    last = own_metrics(log).groupBy("epoch", "key").agg(F.max(F.struct("step", "value")).alias("s"))
    return last.select("epoch", "key", "s.step", "s.value")


def epoch_metrics(log: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Wide row per epoch; a metric that starts late is empty in earlier rows. Known names save a pass over the log."""
    last = last_per_epoch(log)
    pivoted = last.groupBy("epoch").pivot("key", list(keys)) if keys else last.groupBy("epoch").pivot("key")
    return pivoted.agg(F.max_by("value", "step"))


def fill_forward(df: DataFrame, order_col: str, columns: Sequence[str], block: int = 4096) -> DataFrame:
    """Replace nulls by the last value before them, over an order of any length.

    The order is cut into blocks of ``block`` numbers. The last value of each
    block, a small table, is carried over the blocks; rows are filled inside
    their block. No task holds the whole order.
    """
    cut = df.withColumn("__b", F.floor(F.col(order_col) / block))
    ends = cut.groupBy("__b").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c) for c in columns])
    before = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__b", *[F.last(c, ignorenulls=True).over(before).alias(f"__c_{i}") for i, c in enumerate(columns)])
    inside = Window.partitionBy("__b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = cut.join(carried, "__b", "left").withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__c_{i}")) for i, c in enumerate(columns)
    })
    return filled.select(*df.columns)


def metric_snapshots(log: DataFrame, keys: Sequence[str], every: int = SNAPSHOT_EVERY) -> DataFrame:
    """State of all metrics at each logged multiple of ``every`` steps and at each epoch end.

    Log rows are first reduced to the last value per snapshot slot; only the
    slots are filled forward.
    """
    ends = log.groupBy("epoch").agg(F.max("step").alias("end"))
    joined = log.join(ends, "epoch")
    slot = F.least((F.ceil(F.col("step") / every) * every).cast("long"), F.col("end"))
    slotted = joined.withColumn("slot", slot)
    wide = slotted.groupBy("slot").agg(
        F.max((F.col("step") == F.col("slot")).cast("int")).alias("__real"),
        *[F.max_by("value", F.when(F.col("key") == k, F.col("step"))).alias(k) for k in keys],
    )
    return fill_forward(wide, "slot", keys).filter("__real = 1").drop("__real").withColumnRenamed("slot", "step")


def curriculum_timeline(epochs: DataFrame, durations: Sequence[int | None], epoch: str = "epoch") -> DataFrame:
    """Stage of each epoch and the epochs left in it; null in an open stage."""
    starts, ends, at = [], [], 0
    for d in durations:
        starts.append(at)
        at += d or 0
        ends.append(None if d is None else at)
    end: Column = F.element_at(F.array(*[F.lit(e).cast("int") for e in ends]), F.col("stage") + 1)
    return epochs.withColumn("stage", stage_of(F.col(epoch), durations)).withColumn("remaining_epochs", end - F.col(epoch))
