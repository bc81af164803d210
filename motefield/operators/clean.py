"""Validation, labels, counts and small reports on particle tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.labels import BACKGROUND, canonical_label, is_background
from motefield.session import only_row, written

# Class index of background and unknown rows; ratio above which classes count as imbalanced.
NO_CLASS = -1
IMBALANCE_RATIO = 3.0


def has_columns(df: DataFrame, required: Sequence[str]) -> bool:
    """Whether a source carries the required columns; sources without them are skipped whole."""
    return set(required) <= set(df.columns)


def reject_reason(data: Column, shape: Column) -> Column:
    """Why a volume cannot be used; null for a good one."""
    voxels = F.aggregate(shape.cast("array<long>"), F.lit(1).cast("long"), lambda a, b: a * b)
    return (
        F.when(shape.isNull() | (F.size(shape) != 3), "bad_shape")
        .when(data.isNull(), "missing_data")
        .when(F.size(data) != voxels, "length_mismatch")
    )


def validate(df: DataFrame, data_col: str = "data", shape_col: str = "shape") -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their reason; both are filters of one scan."""
    judged = df.withColumn("reason", reject_reason(F.col(data_col), F.col(shape_col)))
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def decode_volumes(df: DataFrame, col: str = "subvolume", dtype: str = "float32") -> DataFrame:
    """Turn byte buffers into arrays, once at ingest; undecodable buffers become null."""
    fields = ", ".join(f"`{c}` {'array<double>' if c == col else t}" for c, t in df.dtypes)
    width = np.dtype(dtype).itemsize

    def decode(raw):
        if raw is None or len(raw) % width:
            return None
        return np.frombuffer(raw, dtype=dtype).astype("float64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{col: [decode(raw) for raw in batch[col]]})

    return df.mapInPandas(run, fields)


def encode_volumes(df: DataFrame, col: str = "data", dtype: str = "float32") -> DataFrame:
    """Turn arrays into byte buffers, the compact form of the training files."""
    fields = ", ".join(f"`{c}` {'binary' if c == col else t}" for c, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{col: [None if v is None else np.asarray(v, dtype=dtype).tobytes() for v in batch[col]]})

    return df.mapInPandas(run, fields)


def canonicalize(df: DataFrame, col: str, aliases: DataFrame, out: str = "label") -> DataFrame:
    """Canonical labels with an alias table ``(variant, name)`` of any size."""
    plain = df.withColumn(out, canonical_label(F.col(col), {}))
    joined = plain.join(aliases, F.col(out) == F.col("variant"), "left")
    return joined.withColumn(out, F.coalesce("name", out)).drop("variant", "name")


def class_table(df: DataFrame, mapping: DataFrame, col: str = "molecule_id") -> DataFrame:
    """One row per label: its pdb id from ``mapping (name, pdb_id)`` and its class index.

    Works on the distinct labels only; the index is the rank of the pdb id
    among the pdb ids in use, -1 for labels without one.
    """
    names = df.filter(~is_background(F.col(col))).select(F.col(col).alias("name")).distinct().join(mapping, "name", "left")
    ids = names.filter("pdb_id IS NOT NULL").select("pdb_id").distinct()
    ranks = ids.withColumn("cls", F.row_number().over(Window.orderBy("pdb_id")) - 1)  # one row per class
    return names.join(ranks, "pdb_id", "left").select("name", "pdb_id", F.coalesce("cls", F.lit(NO_CLASS)).alias("cls"))


def class_index(df: DataFrame, mapping: DataFrame, col: str = "molecule_id") -> DataFrame:
    """Add the class index; background, unknown and unmapped labels get -1."""
    table = class_table(df, mapping, col).select(F.col("name").alias("__name"), "cls")
    joined = df.join(table, F.col(col) == F.col("__name"), "left")
    return joined.withColumn("cls", F.coalesce("cls", F.lit(NO_CLASS))).drop("__name")


def unmapped_labels(df: DataFrame, mapping: DataFrame, col: str = "molecule_id") -> DataFrame:
    return class_table(df, mapping, col).filter("pdb_id IS NULL").select("name")


def ordered_class(label: Column, order: Sequence[str]) -> Column:
    """Class index by position in a given order; labels outside it get -1."""
    return (F.coalesce(F.array_position(F.array(*[F.lit(o) for o in order]), label), F.lit(0)) - 1).cast("int")


def filter_structures(df: DataFrame, ids: DataFrame | None = None, col: str = "molecule_id", background: bool = False) -> DataFrame:
    """Rows of the requested ids, or of all names that look like a pdb id (four characters, digit first)."""
    objects = df.filter(~is_background(F.col(col)))
    kept = objects.filter(F.col(col).rlike("^[0-9].{3}$")) if ids is None else objects.join(ids.select(F.col("id").alias(col)), col, "left_semi")
    return kept.unionByName(df.filter(is_background(F.col(col)))) if background else kept


def missing_structures(df: DataFrame, ids: DataFrame, col: str = "molecule_id") -> DataFrame:
    return ids.select("id").distinct().join(df.select(F.col(col).alias("id")), "id", "left_anti")


def structure_counts(df: DataFrame, col: str = "molecule_id") -> DataFrame:
    """Rows per structure, largest first; null counts as background."""
    counts = df.groupBy(F.coalesce(F.col(col), F.lit(BACKGROUND)).alias("structure")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "structure")


def source_counts(df: DataFrame, col: str = "source_type") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, col: str = "cls") -> DataFrame:
    """Share per class, ratio of the largest to the smallest class, flag above the fixed ratio."""
    whole = Window.partitionBy(F.lit(0))  # over one row per class
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.max("n").over(whole) / F.min("n").over(whole)
    return counts.select(col, "n", (F.col("n") / F.sum("n").over(whole)).alias("share"), ratio.alias("ratio"), (ratio > IMBALANCE_RATIO).alias("imbalanced"))


def snr_levels(df: DataFrame, id_col: str = "id", molecule: str = "molecule_id", snr: str = "snr") -> DataFrame:
    """First row of each molecule at each signal-to-noise level."""
    return df.filter(F.col(snr).isNotNull() & ~is_background(F.col(molecule))).groupBy(molecule, snr).agg(F.min(id_col).alias("first_id"))


def most_levels(levels: DataFrame, molecule: str = "molecule_id", snr: str = "snr") -> DataFrame:
    """The molecule seen at most levels."""
    counts = levels.groupBy(molecule).agg(F.countDistinct(snr).alias("n_levels"))
    return counts.orderBy(F.col("n_levels").desc(), molecule).limit(1)


def level_range(levels: DataFrame, gap: float = 2.0, molecule: str = "molecule_id", snr: str = "snr") -> DataFrame:
    """Lowest and highest level per molecule with their rows, where they lie at least ``gap`` apart."""
    ends = levels.groupBy(molecule).agg(
        F.min(snr).alias("low_snr"), F.max(snr).alias("high_snr"), F.min_by("first_id", snr).alias("low_id"), F.max_by("first_id", snr).alias("high_id")
    )
    return ends.filter(F.col("high_snr") - F.col("low_snr") >= gap)


def spread_levels(levels: DataFrame, k: int = 6, molecule: str = "molecule_id", snr: str = "snr") -> DataFrame:
    """At most ``k`` levels per molecule, evenly spaced over its sorted levels, always with the highest."""
    ordered = levels.groupBy(molecule).agg(F.array_sort(F.collect_set(snr)).alias("all"))  # levels, not rows
    count = F.size("all")
    spaced = F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: F.get("all", F.floor(i * count / (k - 1)).cast("int")))
    chosen = F.when(count <= k, F.col("all")).otherwise(F.array_append(spaced, F.get("all", count - 1)))
    return ordered.select(molecule, F.explode(F.array_distinct(chosen)).alias(snr))


#: Leading bits counted first, bits counted in each later pass, and rows that one last pass may take with all bits left.
FIRST_BITS, MORE_BITS, FEW_ROWS = 20, 20, 1 << 20


def _with_bits(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``__b``: an integer that sorts like the double ``__v``, NaN last; the two zeros become one."""
    kinds = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["__v double", "__b long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(len(keys)).to_numpy(zero_copy_only=False) + 0.0
            v[np.isnan(v)] = np.nan
            bits = v.view(np.int64)
            bits = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(v, pa.float64(), from_pandas=False), pa.array(bits)], [*keys, "__v", "__b"])

    return rows.select(*keys, "__v").mapInArrow(run, kinds)


def exact_percentiles(df: DataFrame, keys: Sequence[str], col: str, shares: Sequence[float], ties: Sequence[str] = (), few: int = FEW_ROWS) -> DataFrame:
    """Linearly interpolated percentiles of groups of any size, as ``(keys, share, value)``.

    Radix select: a pass counts the values of each group by the leading bits of
    an integer that sorts like them, and the running counts tell in which
    bucket a wanted position lies. Only rows of those buckets are counted again,
    by their next bits, until a bucket is one value, or all buckets together are
    ``few`` rows, which one pass finishes. So rows are neither sorted nor
    written, equal values are one bucket, and a task holds counts, never a
    group. Null values are left out, NaN is the greatest, and the two zeros are
    equal; nothing depends on ``ties``. A group without values has no rows.
    """
    keys = list(keys)
    values = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("__v"))
    shift = 64 - FIRST_BITS
    # A table of few rows is counted by its values at once, which is the last pass without the ones before it.
    at_once = only_row(values.agg(F.count(F.lit(1)).alias("n")))["n"] <= few
    rows = values if at_once else _with_bits(values, keys)

    def running(counts: DataFrame, within: list[str], order: str) -> Column:
        return F.sum("__n").over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(order))

    counts = rows.groupBy(*keys, (F.col("__v") if at_once else F.shiftright("__b", shift)).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    counted = counts.select(*keys, "__p", "__n", running(counts, keys, "__p").alias("__upto"), total.alias("__total"))
    places = [(float(s), side, F.lit(float(s)) * (F.col("__total") - 1)) for s in shares for side in (0, 1)]
    wanted = F.array(*[
        F.struct(F.lit(s).alias("share"), F.lit(side).alias("side"), (place - F.floor(place)).alias("part"), F.least(F.floor(place).cast("long") + side, F.col("__total") - 1).alias("at"))
        for s, side, place in places
    ])
    here = F.filter(wanted, lambda w: (w["at"] < F.col("__upto")) & (w["at"] >= F.col("__upto") - F.col("__n")))
    found = counted.withColumn("w", F.explode(here))
    carried = [*keys, "share", "side", "part", "__p", "__at", "__n"]
    found = found.select(*keys, "w.share", "w.side", "w.part", "__p", (F.col("w.at") - F.col("__upto") + F.col("__n")).alias("__at"), "__n")
    if at_once:
        found = found.withColumn("__v", F.col("__p"))
    else:
        targets = written(found, "targets")
    while not at_once:
        buckets = targets.select(*keys, "__p", "__n").distinct()
        left = only_row(buckets.agg(F.sum("__n").alias("n")))["n"] or 0
        below = 0 if left <= few else max(0, shift - MORE_BITS)
        other = {c: f"__o_{c}" for c in (*keys, "__p")}
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()])
        inside = rows.withColumn("__p", F.shiftright("__b", shift)).join(buckets.select(*other).withColumnsRenamed(other), same, "left_semi")
        counts = inside.groupBy(*keys, "__p", F.shiftright("__b", below).alias("__q")).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__v"))
        counts = counts.select(*keys, "__p", "__q", "__n", "__v", running(counts, [*keys, "__p"], "__q").alias("__upto"))
        at = targets.drop("__n").withColumnsRenamed(other)
        hit = counts.join(at, same & (F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("__n")))
        found = hit.select(*keys, "share", "side", "part", F.col("__q").alias("__p"), (F.col("__at") - F.col("__upto") + F.col("__n")).alias("__at"), "__n", "__v")
        if below == 0:
            break
        targets, shift = written(found.select(*carried), "targets"), below
    low, high = (F.max(F.when(F.col("side") == side, F.col("__v"))) for side in (0, 1))
    part = F.max("part")
    return found.groupBy(*keys, "share").agg((low + F.when(part > 0, part * (high - low)).otherwise(F.lit(0.0))).alias("value"))


def density_summary(df: DataFrame, keys: Sequence[str], col: str = "density", ties: Sequence[str] = ()) -> DataFrame:
    """Five-number summary of per-volume mean densities, one row per group."""
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    long = exact_percentiles(df, keys, col, list(names), ties)
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in names.items()])


def sanitize_metrics(metrics: Column) -> Column:
    """Metric map with safe names: empty names and non-scalar (JSON object or list) values dropped."""
    scalar = F.map_filter(metrics, lambda k, v: (k != "") & ~F.coalesce(F.trim(v.cast("string")).rlike(r"^[\[{]"), F.lit(False)))
    clean = F.transform_keys(scalar, lambda k, v: F.regexp_replace(k, "[^a-zA-Z0-9_]", "_"))
    return F.transform_keys(clean, lambda k, v: F.when(k.rlike("^[0-9]"), F.concat(F.lit("m_"), k)).otherwise(k))


def derive_structure(meta: Column, sample_id: Column) -> Column:
    """Structure from metadata, else the first part of the sample id."""
    return F.coalesce(F.nullif(meta, F.lit("")), F.try_element_at(F.split(sample_id, "_"), F.lit(1)))


def derive_run(meta: Column, sample_id: Column) -> Column:
    """Run from metadata, else the second part of the sample id, else 'unknown'."""
    return F.coalesce(F.nullif(meta, F.lit("")), F.try_element_at(F.split(sample_id, "_"), F.lit(2)), F.lit("unknown"))


def path_head(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(1))


def near_snr(df: DataFrame, target: float, tolerance: float, col: str = "snr") -> DataFrame:
    return df.filter(F.abs(F.col(col) - target) <= tolerance)
