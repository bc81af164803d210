"""Seeded order and seeded random numbers that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(seed, *ids: Column) -> Column:
    """md5 of the ids and the seed, joined by '|': the shuffle order used by every sampler."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in ids], F.lit(str(seed))))


def uniform_of(digest: Column, start: int = 1) -> Column:
    """Uniform number in [0, 1) from eight hex digits of a digest."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(seed, *ids: Column) -> Column:
    return uniform_of(order_hash(seed, *ids))


def normal(seed, *ids: Column) -> Column:
    """Standard normal number by the Box-Muller transform of two halves of one digest."""
    digest = order_hash(seed, *ids)
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform_of(digest, 1)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform_of(digest, 9))
