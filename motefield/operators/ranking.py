"""Ranks and running sums inside groups of any size.

A plain ``row_number() over (partition by class order by ...)`` sorts a whole
class in one task. Here every group is cut into ordered buckets first (leading
digits of a hash, or sampled ranges): rows are ranked inside (group, bucket), and the bucket totals, a small table, give the
offset of each bucket. Results are exact and a class holding a third of all
rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.hashing import order_hash
from motefield.session import written

_BUCKET = "__bucket"


def _over_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    running: dict[str, str],
    group_size: str | None,
) -> DataFrame:
    """Rank rows of ``df`` (which carries an ordered bucket column) inside ``keys``."""
    keys = list(keys)
    cells = df.groupBy(*keys, _BUCKET).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s_{name}") for name, c in running.items()]
    )
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *keys,
        _BUCKET,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        *[F.coalesce(F.sum(f"__s_{name}").over(before), F.lit(0)).alias(f"__o_{name}") for name in running],
        *([F.sum("__n").over(whole).alias(group_size)] if group_size else []),
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Null keys and null buckets are groups too, so the join is null-safe.
    cells_of = {c: f"__k_{c}" for c in (*keys, _BUCKET)}
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in cells_of.items()])
    joined = df.join(offsets.withColumnsRenamed(cells_of), match).drop(*cells_of.values())
    ranked = joined.withColumn(out, F.row_number().over(inside) + F.col("__off"))
    for name, column in running.items():
        ranked = ranked.withColumn(name, F.sum(column).over(upto) + F.col(f"__o_{name}"))
    return ranked.drop(_BUCKET, "__off", *[f"__o_{name}" for name in running])


def rank_by_hash(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed, out: str = "rn", hex_digits: int = 3, group_size: str | None = None
) -> DataFrame:
    """1-based rank of each row in its group, in seeded hash order of its id.

    The leading hex digits of the hash are the bucket: they are uniform, so
    no data pass is needed to choose the cuts.
    """
    digest = order_hash(seed, *[F.col(c) for c in ids])
    hashed = df.withColumn("__h", digest).withColumn(_BUCKET, F.substring("__h", 1, hex_digits))
    order = [F.col("__h"), *[F.col(c) for c in ids]]
    return _over_buckets(hashed, keys, order, out, {}, group_size).drop("__h")


def rank_by_value(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    ties: Sequence[str] = (),
    descending: bool = False,
    out: str = "rn",
    running: dict[str, str] | None = None,
    buckets: int | None = None,
    group_size: str | None = None,
) -> DataFrame:
    """1-based rank by a column of any sortable type, with running sums of other columns on request.

    The buckets are ranges of (keys, column, ties), cut at sampled quantiles:
    one value held by a third of the rows is split by its ties, and nulls like
    any value. There are as many as the session has shuffle partitions, or
    ``buckets``. The bucketed rows are written once, so that counting and
    ranking see the same cuts.
    """
    order = [F.col(column).desc() if descending else F.col(column).asc(), *[F.col(c) for c in ties]]
    sorting = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(buckets, *sorting) if buckets else df.repartitionByRange(*sorting)
    cut = written(ranged.withColumn(_BUCKET, F.spark_partition_id()), "ranges")
    return _over_buckets(cut, keys, order, out, running or {}, group_size)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group for a small ``n``.

    Spark pushes the rank limit below the shuffle, so each task sends at most
    ``n`` rows per group however large the group is.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n).drop("__rn")
