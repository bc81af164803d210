"""Class prototypes kept up to date on a stream of embedding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.operators.prototypes import ALPHA, apply_segment, ema_segment, prototypes_v2
from motefield.session import scratch_path
from motefield.streaming.state import VersionedState

STATE_SCHEMA = "cls int, n long, last_order long, prototype array<double>"
STEP_STATE = "cls int, last_step long, prototype array<double>, late long"


def merge_segment(state: DataFrame, segment: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """State after one micro-batch: two small tables, one row per class, joined by class."""
    before = state.select("cls", F.col("n").alias("n_before"), F.col("last_order").alias("order_before"), F.col("prototype").alias("p_before"))
    both = before.join(segment.withColumnsRenamed({"n": "n_new", "last_order": "order_new"}), "cls", "full")
    after = apply_segment(F.col("p_before"), F.col("n_new"), F.col("tail"), F.col("first"), alpha)
    return both.select(
        "cls",
        (F.coalesce("n_before", F.lit(0)) + F.coalesce("n_new", F.lit(0))).cast("long").alias("n"),
        F.greatest("order_before", "order_new").cast("long").alias("last_order"),
        F.when(F.col("n_new").isNull(), F.col("p_before")).otherwise(after).alias("prototype"),
    )


def run_prototype_stream(rows: DataFrame, order_col: str, state_path: str, checkpoint: str, alpha: float = ALPHA) -> str:
    """Fold a stream of ``(cls, <order_col>, feature)`` rows and return the path of the last state.

    A micro-batch is reduced to one segment per class with ordinary parallel
    aggregates, so a hot class is no bottleneck, and merged with the state of
    its classes; what changed is appended (``VersionedState``), so a repeated
    batch changes nothing.
    """
    state = VersionedState(rows.sparkSession, state_path, STATE_SCHEMA, ["cls"])

    def fold(batch: DataFrame, batch_id: int) -> None:
        segment = ema_segment(batch, order_col, alpha=alpha)
        known = state.before(batch_id).join(segment.select("cls"), "cls", "left_semi")
        state.write(merge_segment(known, segment, alpha), batch_id)

    query = rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    after = state.next_batch()
    path = f"{state_path}/last/batch={after - 1}"
    state.before(after).write.mode("overwrite").parquet(path)
    return path


def prototype_stream(spark: SparkSession, rows: DataFrame, order_col: str, alpha: float = ALPHA) -> DataFrame:
    """Run the stream over what is available and return the final prototypes."""
    last = run_prototype_stream(rows, order_col, scratch_path(spark, "prototypes"), scratch_path(spark, "prototypes-checkpoint"), alpha)
    return spark.read.schema(STATE_SCHEMA).parquet(last)


def merge_steps(state: DataFrame, rows: DataFrame, warmup: int = 0) -> DataFrame:
    """State ``(cls, last_step, prototype, late)`` after one micro-batch of ``(cls, step, feature)`` rows.

    Rows below the last step of their class are counted as late; the others are
    folded in step order by ``prototypes_v2``, which spreads a class over many tasks.
    """
    known = state.select("cls", "last_step", "late")
    dated = rows.filter(F.col("step") >= warmup).join(known.select("cls", F.col("last_step").alias("__last")), "cls", "left")
    missed = F.coalesce(F.col("step") < F.col("__last"), F.lit(False))
    late = dated.filter(missed).groupBy("cls").agg(F.count(F.lit(1)).alias("missed"))
    folded = prototypes_v2(dated.filter(~missed).drop("__last"), "step", "step", state=state)
    both = folded.join(known.select("cls", "late"), "cls", "left").join(late, "cls", "left")
    return both.select("cls", "last_step", "prototype", (F.coalesce("late", F.lit(0)) + F.coalesce("missed", F.lit(0))).cast("long").alias("late"))


def step_prototype_stream(spark: SparkSession, rows: DataFrame, warmup: int = 0, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Prototypes with step-dependent momentum from a stream of ``(cls, step, feature)`` rows, and how many rows came late.

    Steps never go back from one micro-batch to the next; a row below the last
    step of its class is not folded in the wrong place but counted as late. A
    micro-batch is folded by ``prototypes_v2`` on the state of its classes, so a
    hot class is no bottleneck, and what changed is appended. Rows of equal class and step are folded in any fixed order.
    With ``out`` and ``checkpoint`` another call goes on where the last one
    ended; without them the run stands alone.
    """
    out, checkpoint = out or scratch_path(spark, "step-prototypes"), checkpoint or scratch_path(spark, "step-prototypes-checkpoint")
    state = VersionedState(spark, out, STEP_STATE, ["cls"])

    def fold(batch: DataFrame, batch_id: int) -> None:
        clean = batch.filter("cls >= 0").select("cls", F.col("step").cast("long").alias("step"), "feature")
        known = state.before(batch_id).join(clean.select("cls").distinct(), "cls", "left_semi")
        state.write(merge_steps(known, clean, warmup), batch_id)

    query = rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return state.latest()
