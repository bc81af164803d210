"""Last value of each metric per day, kept up to date on a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.operators.metric_log import last_per_epoch
from motefield.streaming.state import VersionedState

SCHEMA = "epoch int, key string, step long, value double"
KEYS = ["epoch", "key"]


def epoch_metric_stream(spark: SparkSession, log: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Stream of ``(ts, step, key, value)`` to the last value per (day, metric), long form.

    The state has one row for each (day, metric). A micro-batch reads the rows
    of its own days and metrics, merges its last values into them, and appends
    what that gives (``VersionedState``), so rows of any lateness count and the
    result equals the batch one. Calling it again with the same paths goes on
    where the last call ended.
    """
    state = VersionedState(spark, out, SCHEMA, KEYS)
    rows = log.select(F.unix_date(F.to_date("ts")).alias("epoch"), "key", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        own = last_per_epoch(batch)
        touched = own.select(*[F.col(k).alias(f"__{k}") for k in KEYS])
        same = F.col("epoch").eqNullSafe(F.col("__epoch")) & F.col("key").eqNullSafe(F.col("__key"))
        known = state.before(batch_id).join(touched, same, "left_semi")
        state.write(last_per_epoch(own.unionByName(known)), batch_id)

    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return state.latest().select("epoch", "key", "step", "value")
