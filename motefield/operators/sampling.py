"""Seeded samples and weights. All order comes from hashes of ids, so results do not depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.hashing import order_hash, uniform
from motefield.functions.labels import BACKGROUND
from motefield.operators.ranking import first_per_group, rank_by_hash, rank_by_value
from motefield.session import only_row


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per group."""
    return first_per_group(df, keys, order, n)


def _keep(df: DataFrame, chosen: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ids were chosen. Ranks are taken on the ids alone, so wide rows (volumes) are not sorted."""
    return df.join(chosen.select(*ids), list(ids), "left_semi")


def even_sample(df: DataFrame, keys: Sequence[str], order_col: str, n: int) -> DataFrame:
    """n rows per group at evenly spaced places of its order; groups of at most n rows stay whole.

    ``order_col`` is unique within a group.
    """
    ids = [*keys, order_col]
    ranked = rank_by_value(df.select(*ids), keys, order_col, group_size="__n")
    place, last = F.col("rn") - 1, F.greatest(F.col("__n") - 1, F.lit(1))
    step = F.floor((place * (n - 1) + last - 1) / last)
    hit = (step <= n - 1) & (F.floor(step * last / (n - 1)) == place) if n > 1 else place == 0
    return _keep(df, ranked.filter((F.col("__n") <= n) | hit), ids)


def balance(df: DataFrame, key: str, id_col: str, seed) -> DataFrame:
    """As many rows of every class as the smallest class has, without replacement."""
    smallest = only_row(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")))["n"] or 0
    ranked = rank_by_hash(df.select(key, id_col), [key], [id_col], seed)
    return _keep(df, ranked.filter(F.col("rn") <= smallest), [key, id_col])


def stage_table(stages: DataFrame) -> DataFrame:
    """Start and end epoch of each stage of a curriculum spec; an open stage ends nowhere."""
    spans = stages.groupBy("stage").agg(F.max("duration").alias("duration"))
    before = Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)  # one row per stage
    start = F.coalesce(F.sum("duration").over(before), F.lit(0))
    return spans.select("stage", start.alias("start_epoch"), (start + F.col("duration")).alias("end_epoch"))


def stage_of(epoch: Column, durations: Sequence[int | None]) -> Column:
    """Stage of an epoch: the first whose cumulative duration exceeds it, stage 0 if none does.

    A curriculum has a handful of stages, so this is a column expression, not a join.
    """
    out, end = None, 0
    for stage, duration in enumerate(durations):
        if duration is None:
            return F.lit(stage) if out is None else out.otherwise(F.lit(stage))
        end += duration
        out = F.when(epoch < end, F.lit(stage)) if out is None else out.when(epoch < end, F.lit(stage))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def class_quota(df: DataFrame, weights: DataFrame, key: str = "sample_id") -> DataFrame:
    """Size and weight of the classes that both the table and the stage have."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("class_size"))
    return counts.join(weights.select(key, "weight"), key)


def sample_weights(df: DataFrame, weights: DataFrame, key: str = "sample_id") -> DataFrame:
    """Stage weight shared evenly inside each class and normalised to 1; uniform if no class matches."""
    quota = class_quota(df, weights, key)
    row = only_row(quota.agg(F.sum("weight").alias("total")))
    if not row["total"]:
        return df.withColumn("sample_weight", F.lit(1.0 / max(df.count(), 1)))
    share = F.col("weight") / F.col("class_size") / F.lit(row["total"])
    return df.join(quota, key, "left").withColumn("sample_weight", F.coalesce(share, F.lit(0.0))).drop("class_size", "weight")


def epoch_quota(df: DataFrame, weights: DataFrame, n: int, key: str = "sample_id") -> DataFrame:
    """Draws per class: the whole part of its share of n, then its share of what is left.

    What is left is shared by weight, whole parts first and the last few draws
    by largest fraction: the expectation of a random split, without randomness.
    """
    quota = class_quota(df, weights, key)
    total = only_row(weights.agg(F.sum("weight").alias("t")))["t"] or 1.0
    parts = quota.withColumn("base", F.floor(F.col("weight") / F.lit(total) * n).cast("long"))
    present = only_row(parts.agg(F.sum("base").alias("b"), F.sum("weight").alias("w")))
    rest = n - (present["b"] or 0)
    share = F.lit(rest) * F.col("weight") / F.lit(present["w"] or 1.0)
    parts = parts.withColumn("base", F.col("base") + F.floor(share)).withColumn("fraction", F.round(share - F.floor(share), 9))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("fraction").desc(), key)  # one row per class
    bonus = F.when(F.row_number().over(order) <= F.lit(n) - F.sum("base").over(Window.partitionBy(F.lit(0))), 1).otherwise(0)
    return parts.select(key, "class_size", (F.col("base") + bonus).alias("quota"))


def draw_numbers(quota: DataFrame, chunk: int = 10000) -> DataFrame:
    """One row per draw, numbered from 1 in each class; large quotas are unrolled by many tasks."""
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / chunk))
    spread = quota.filter("quota > 0").withColumn("__c", F.explode(chunks)).repartition("__c")
    first = F.col("__c") * chunk + 1
    last = F.least(F.col("__c") * chunk + chunk, F.col("quota"))
    return spread.withColumn("draw", F.explode(F.sequence(first, last))).drop("__c")


def draw_with_replacement(df: DataFrame, quota: DataFrame, keys: Sequence[str], id_col: str, seed) -> DataFrame:
    """Rows drawn by seeded index from each class; (class, index) is the join key, so classes spread out."""
    numbers = draw_numbers(quota)
    pick = F.floor(uniform(seed, *[F.col(k) for k in keys], F.col("draw")) * F.col("class_size")) + 1
    indexed = numbers.withColumn("rn", pick).select(*keys, "draw", "rn")
    return indexed.join(rank_by_value(df, keys, id_col), [*keys, "rn"]).drop("rn")


def epoch_sample(df: DataFrame, weights: DataFrame, n: int, seed, id_col: str = "id", key: str = "sample_id") -> DataFrame:
    """n draws of one epoch with replacement, with ``shuffle_key`` as the epoch order."""
    drawn = draw_with_replacement(df, epoch_quota(df, weights, n, key), [key], id_col, seed)
    return drawn.withColumn("shuffle_key", order_hash(f"{seed}s", F.col(key), F.col("draw")))


def panel_sample(df: DataFrame, keys: Sequence[str], id_col: str, k: int, seed) -> DataFrame:
    """k rows per group: without replacement where the group has k rows, else with replacement."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("class_size"))
    sized = df.join(counts, list(keys))
    order = [order_hash(seed, F.col(id_col)), F.col(id_col)]
    large = first_per_group(sized.filter(F.col("class_size") >= k), keys, order, k).drop("class_size")
    small = sized.filter(F.col("class_size") < k).drop("class_size")
    quota = counts.filter(F.col("class_size") < k).withColumn("quota", F.lit(k).cast("long"))
    drawn = draw_with_replacement(small, quota, keys, id_col, seed).drop("draw")
    return large.unionByName(drawn.select(*large.columns))


def sample_groups(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """All rows of n randomly chosen groups."""
    chosen = df.select(key).distinct().orderBy(order_hash(seed, F.col(key)), key).limit(n)
    return df.join(chosen, key, "left_semi")


def first_and_random_groups(df: DataFrame, key: str, first: int, extra: int, seed) -> DataFrame:
    """Keys of the first groups by name and of random others, for overview panels."""
    names = df.select(key).distinct()
    head = names.orderBy(key).limit(first)
    rest = names.join(head, key, "left_anti").orderBy(order_hash(seed, F.col(key)), key).limit(extra)
    return head.withColumn("part", F.lit("first")).unionByName(rest.withColumn("part", F.lit("random")))


def sample_files(df: DataFrame, key: str, file_col: str, seed) -> DataFrame:
    """One random file (or level) per group."""
    return df.select(key, file_col).distinct().groupBy(key).agg(F.min_by(file_col, F.struct(order_hash(seed, F.col(file_col)), F.col(file_col))).alias(file_col))


def mix_background(df: DataFrame, background: DataFrame, ratio: float, seed, id_col: str = "id", cls: str = "cls") -> DataFrame:
    """Replace a share of the rows by background rows with class -1; ``source_id`` names the row used."""
    n = only_row(background.agg(F.count(F.lit(1)).alias("n")))["n"]
    replaced = uniform(seed, F.col(id_col)) < ratio if n else F.lit(False)
    marked = df.withColumn("__r", replaced)
    kept = marked.filter("NOT __r").select(id_col, cls, F.col(id_col).alias("source_id"))
    index = (F.floor(uniform(f"{seed}b", F.col(id_col)) * n) + 1).alias("rn")
    pool = rank_by_value(background.select(F.col(id_col).alias("source_id")), [], "source_id")
    swapped = marked.filter("__r").select(id_col, index).join(pool, "rn").select(id_col, F.lit(-1).cast(dict(df.dtypes)[cls]).alias(cls), "source_id")
    return kept.unionByName(swapped)


def sample_n(df: DataFrame, id_col: str, n: int, seed) -> DataFrame:
    """n random rows without replacement; the original order column stays usable."""
    return _keep(df, rank_by_hash(df.select(id_col), [], [id_col], seed).filter(F.col("rn") <= n), [id_col])


def is_object(col: str = "molecule_id") -> Column:
    return F.col(col).isNotNull() & (F.col(col) != BACKGROUND)
