"""Joins of runs, tomograms, picks, volumes and embedding tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.operators import similarity
from motefield.operators.pairs import cogroup_blocks, small_table
from motefield.operators.ranking import rank_by_hash
from motefield.session import scratch_path, written


def join_coordinates(coords: DataFrame, embeddings: DataFrame, required: bool = False) -> DataFrame:
    """Coordinates whose 'output/' path names an embedding row; optionally an error if there is none."""
    keyed = coords.withColumn("filepath", F.concat(F.lit("output/"), F.col("filepath")))
    joined = keyed.join(embeddings, "filepath")
    if required and joined.isEmpty():
        raise ValueError("no coordinate matches an embedding row")
    return joined


def align_tables(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str, seed=171717) -> DataFrame:
    """Pair rows of two tables class by class, in random order, as many as the smaller side has.

    The join key is (class, rank), which is unique, so a large class does not
    end up in one task.
    """
    left = rank_by_hash(a, [key], [a_id], seed, out="pair_rank")
    right = rank_by_hash(b, [key], [b_id], f"{seed}b", out="pair_rank")
    return left.join(right, [key, "pair_rank"])


def align_by_id(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str) -> DataFrame:
    """Pair rows of two tables that are the same particle: equal class and equal id."""
    return a.join(b.withColumnRenamed(key, "__key"), (F.col(key) == F.col("__key")) & (F.col(a_id) == F.col(b_id))).drop("__key")


def common_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).intersect(b.select(col))


def lookup_ids(ids: DataFrame, table: DataFrame, col: str = "id") -> DataFrame:
    """Rows of the table named by ``ids``, ignoring case."""
    wanted = ids.select(F.lower("id").alias("__w"))
    return table.join(wanted, F.lower(F.col(col)) == F.col("__w"), "left_semi")


def missing_ids(ids: DataFrame, table: DataFrame, col: str = "id") -> DataFrame:
    """Requested ids the table does not have, ignoring case."""
    known = table.select(F.lower(F.col(col)).alias("__k"))
    return ids.select("id").distinct().join(known, F.lower("id") == F.col("__k"), "left_anti")


def missing_pairs(features: DataFrame, aff: DataFrame) -> DataFrame:
    """Unordered pairs of ids that have no affinity yet, found block by block."""
    return similarity.missing_pairs(features, aff)


def unfinished(runs: DataFrame, done: DataFrame, col: str = "run") -> DataFrame:
    """Runs that are not in the output yet."""
    return runs.join(done.select(col), col, "left_anti")


def best_spacing(spacings: DataFrame, target: float, tolerance: float) -> DataFrame:
    """Closest voxel spacing per run; the first listed one wins a tie. One partial aggregate, no sort."""
    off = F.abs(F.col("size") - target)
    best = spacings.filter(off <= tolerance).groupBy("run").agg(F.min(F.struct(off.alias("off"), "ord", "size")).alias("b"))
    return best.select("run", F.col("b.ord").alias("ord"), F.col("b.size").alias("size"))


def runs_without_spacing(spacings: DataFrame, target: float, tolerance: float) -> DataFrame:
    return spacings.select("run").distinct().join(best_spacing(spacings, target, tolerance), "run", "left_anti")


def preferred_tomogram(tomograms: DataFrame, wanted: Column) -> DataFrame:
    """First tomogram per run whose type is wanted, else the first listed."""
    rank = F.when(wanted, F.lit(0)).otherwise(F.lit(1))
    best = tomograms.groupBy("run").agg(F.min(F.struct(rank.alias("rank"), "ord", "tomo_type")).alias("b"))
    return best.select("run", F.col("b.ord").alias("ord"), F.col("b.tomo_type").alias("tomo_type"))


def pick_voxels(picks: DataFrame, spacing: Column) -> DataFrame:
    """Pick coordinates in voxels, truncated towards zero."""
    return picks.select("*", *[(F.col(a) / spacing).cast("int").alias(f"v{a}") for a in "zyx"])


def boxes_inside(picks: DataFrame, tomograms: DataFrame, box: int, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Picks whose box ``[p-h, p+h)`` lies inside the volume of the same keys, with the box corner."""
    half = box // 2
    inside = picks.join(tomograms.select(*keys, "nz", "ny", "nx"), list(keys))
    for a in "zyx":
        inside = inside.filter((F.col(f"v{a}") >= half) & (F.col(f"v{a}") + half <= F.col(f"n{a}")))
    return inside.select("*", *[(F.col(f"v{a}") - half).alias(f"{a}0") for a in "zyx"]).drop("nz", "ny", "nx")


#: Picks cut out of one copy of a chunk at most, on average.
PICKS_PER_CHUNK = 256


def _touched(picks: DataFrame, tomograms: DataFrame, box: int, edge: int, keys: Sequence[str]) -> DataFrame:
    """One row for every chunk that a pick's box overlaps; at most eight when ``edge >= box``."""
    placed = boxes_inside(picks, tomograms, box, keys).select(*keys, "pick_id", "z0", "y0", "x0")
    for a in "zyx":
        first, last = F.floor(F.col(f"{a}0") / edge), F.floor((F.col(f"{a}0") + box - 1) / edge)
        placed = placed.withColumn(f"c{a}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return placed


def _cut(chunk: np.ndarray, corner: Sequence[int], index: Sequence[int], box: int, edge: int) -> tuple[list[int], np.ndarray]:
    """Part of a box that one chunk covers: its place in the box and its values."""
    place, take = [], []
    for low, i in zip(corner, index, strict=True):
        start, stop = max(low, i * edge), min(low + box, (i + 1) * edge)
        place += [start - low, stop - low]
        take.append(slice(start - i * edge, stop - i * edge))
    return place, chunk[tuple(take)].ravel()


def incomplete_picks(picks: DataFrame, tomograms: DataFrame, chunks: DataFrame, box: int, edge: int, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Picks whose box lies inside the volume but needs a chunk that isn't there. Reads no voxels."""
    cell = [*keys, "cz", "cy", "cx"]
    return _touched(picks, tomograms, box, edge, keys).join(chunks.select(*cell), cell, "left_anti").select(*keys, "pick_id").distinct()


def write_chunk_store(chunks: DataFrame, table: str, buckets: int, keys: Sequence[str] = ("run",), path: str | None = None) -> DataFrame:
    """Save chunks as a table bucketed and sorted by tomogram and place, and read it.

    Boxes are cut out of such a store where it lies: a join on the place needs
    no exchange of the voxels, whatever the number of picks. The files lie at
    ``path``, by default below the shared folder.
    """
    cell = [*keys, "cz", "cy", "cx"]
    spark = chunks.sparkSession
    files = chunks.repartition(buckets, *cell).write.bucketBy(buckets, cell[0], *cell[1:]).sortBy(cell[0], *cell[1:])
    files.mode("overwrite").option("path", path or scratch_path(spark, table)).saveAsTable(table)
    return spark.table(table)


#: Bytes of box parts in one batch that leaves a task.
PART_BYTES = 16 << 20
#: What a task keeps for a piece beside its values: two arrays and their headers. Most pieces of small boxes are a few voxels.
PIECE_BYTES = 400


def _lists(parts: list[np.ndarray], dtype: type) -> pa.ListArray:
    ends = np.cumsum([0, *[len(p) for p in parts]])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.from_numpy_dtype(dtype), from_pandas=False))


def extract_boxes(
    picks: DataFrame, tomograms: DataFrame, chunks: DataFrame, box: int, edge: int, normalize: bool = False, keys: Sequence[str] = ("run",)
) -> DataFrame:
    """Cut the box of every pick out of chunked tomograms; ``keys`` name a tomogram.

    The spatial join is an equi join: each pick lists the chunks its box
    touches, the picks of a chunk are gathered into lists of a few hundred, and
    a chunk is read once for each list. The lists are written first, so their
    size is known: small ones travel to the chunks, larger ones are shuffled,
    and the chunks stay where they are if they are a ``write_chunk_store``.
    Only the overlapping parts are shuffled to the pick. A box that isn't
    covered completely is left out (see ``incomplete_picks``); NaN voxels are
    values like any others. Needs columns ``pick_id, vz, vy, vx`` beside the
    keys; a pick id is unique within them.
    """
    keys = list(keys)
    cell = [*keys, "cz", "cy", "cx"]
    touched = written(_touched(picks, tomograms, box, edge, keys), "touched")
    counted = touched.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / PICKS_PER_CHUNK).cast("int").alias("__lists"))
    placed = touched.join(counted, cell).withColumn("__list", F.pmod(F.xxhash64("pick_id"), F.col("__lists")))
    gathered = written(placed.groupBy(*cell, "__list").agg(F.collect_list(F.struct("pick_id", "z0", "y0", "x0")).alias("__picks")), "lists")
    types = dict(picks.dtypes)
    named = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "pick_id"])
    n = len(keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, parts, ids, held = [], [], [], [], 0

            def made() -> pa.RecordBatch:
                own = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(n)]
                pick = pa.concat_arrays(ids)
                return pa.RecordBatch.from_arrays([*own, pick, _lists(places, np.int32), _lists(parts, np.float64)], [*keys, "pick_id", "place", "part"])

            index = list(zip(*[batch.column(n + i).to_pylist() for i in range(3)], strict=True))
            for row in range(batch.num_rows):
                chunk = batch.column(n + 4)[row].values.to_numpy(zero_copy_only=False).reshape(edge, edge, edge)
                here = batch.column(n + 3)[row].values
                corners = zip(*[here.field(a).to_pylist() for a in ("z0", "y0", "x0")], strict=True)
                for corner in corners:
                    place, part = _cut(chunk, corner, index[row], box, edge)
                    places.append(np.array(place, np.int32))
                    parts.append(part)
                    held += part.nbytes + PIECE_BYTES
                rows += [row] * len(here)
                ids.append(here.field("pick_id"))
                if held > PART_BYTES:
                    yield made()
                    rows, places, parts, ids, held = [], [], [], [], 0
            if rows:
                yield made()

    pieces = gathered.join(chunks, cell).select(*cell, "__picks", F.col("data").cast("array<double>").alias("data")).mapInArrow(cut, f"{named}, place array<int>, part array<double>")
    grouped = pieces.groupBy(*keys, "pick_id").agg(F.collect_list(F.struct("place", "part")).alias("parts"), F.sum(F.size("part")).alias("covered"))

    def paste(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(n + 1):
                volume = np.empty((box, box, box))
                places, values = parts.values.field("place"), parts.values.field("part")
                for place, part in zip(places, values, strict=True):
                    z0, z1, y0, y1, x0, x1 = place.values.to_numpy()
                    volume[z0:z1, y0:y1, x0:x1] = part.values.to_numpy(zero_copy_only=False).reshape(z1 - z0, y1 - y0, x1 - x0)
                if normalize:
                    std = volume.std()
                    volume = (volume - volume.mean()) / (std if not std <= 1e-6 else 1.0)
                out.append(volume.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], _lists(out, np.float64)], [*keys, "pick_id", "data"])

    boxes = grouped.filter(F.col("covered") == box**3).select(*keys, "pick_id", "parts").mapInArrow(paste, f"{named}, data array<double>")
    return boxes.withColumn("shape", F.array(*[F.lit(box)] * 3))


def filter_picks(picks: DataFrame, **wanted) -> DataFrame:
    """Picks whose metadata columns have the wanted values; plain predicates that reach the scan."""
    for col, values in wanted.items():
        picks = picks.filter(F.col(col).isin(values) if isinstance(values, (list, tuple, set)) else F.col(col) == values)
    return picks


#: Bits of a coordinate on the curve, picks of a leaf inside a tile, and points searched at once.
CURVE_BITS, LEAF, SEARCHED = 20, 64, 512
#: Boxes of tiles that may travel with the tasks (64 bytes each); more are joined by run.
BOXES = 1 << 18
_AXES = ["x", "y", "z"]


def _spread(v: Column) -> Column:
    """The bits of a number of 21 bits, two apart."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def pick_tiles(picks: DataFrame, group: str = "run", tile_rows: int = 65_536, cell: float | None = None) -> DataFrame:
    """Picks packed along a space-filling curve: rows of at most ``tile_rows`` neighbours of one run, with their bounds.

    Columns: run, ``tile``, ``lo_x .. hi_z``, coordinates of one pick (``at_x ..``), and arrays ``x, y, z, pick_id`` in curve
    order. Places that repeat keep their lowest id. ``cell`` is the finest edge of the curve, a millionth of a run's extent if not given.
    """
    real = [F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf")) for a in _AXES]
    placed = picks.filter(reduce(and_, real)).groupBy(group, *_AXES).agg(F.min("pick_id").alias("pick_id"))
    spans = picks.filter(reduce(and_, real)).groupBy(group).agg(*[F.min(a).alias(f"__lo_{a}") for a in _AXES], F.greatest(*[F.max(a) - F.min(a) for a in _AXES]).alias("__span"))
    most = (1 << CURVE_BITS) - 1
    edge = F.lit(float(cell)) if cell is not None else F.greatest(F.col("__span") / most, F.lit(1e-300))
    steps = [_spread(F.least(F.floor((F.col(a) - F.col(f"__lo_{a}")) / edge), F.lit(most)).cast("long")) for a in _AXES]
    curve = steps[0].bitwiseOR(F.shiftleft(steps[1], 1)).bitwiseOR(F.shiftleft(steps[2], 2))
    coded = placed.join(spans, group).withColumn("__code", curve).select(group, "__code", *_AXES, "pick_id")
    ordered = coded.repartitionByRange(group, "__code", "pick_id").sortWithinPartitions(group, "__code", "pick_id")
    types = dict(picks.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None

        def tile(part: pd.DataFrame) -> pa.RecordBatch:
            xyz = [part[a].to_numpy(np.float64) for a in _AXES]
            columns = [pa.array([part[group].iloc[0]], schema.field(group).type), *[pa.array([f(v)]) for v in xyz for f in (np.min, np.max)], *[pa.array([v[0]]) for v in xyz], *[pa.array([v]) for v in xyz]]
            return pa.RecordBatch.from_arrays([*columns, pa.array([part["pick_id"].tolist()], pa.list_(schema.field("pick_id").type))], names)

        for batch in batches:
            schema = batch.schema
            frame = batch.to_pandas()
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            held = None
            for key, part in frame.groupby(group, sort=False):
                if held is not None and len(held):
                    yield tile(held)
                while len(part) > tile_rows:
                    yield tile(part.iloc[:tile_rows])
                    part = part.iloc[tile_rows:]
                held = part
        if held is not None and len(held):
            yield tile(held)

    names = [group, *[f"{e}_{a}" for a in _AXES for e in ("lo", "hi")], *[f"at_{a}" for a in _AXES], *_AXES, "pick_id"]
    kinds = ", ".join([f"`{group}` {types[group]}", *[f"{c} double" for c in names[1:10]], *[f"{a} array<double>" for a in _AXES], f"pick_id array<{types['pick_id']}>"])
    packed = ordered.select(group, *_AXES, "pick_id").filter(F.col(group).isNotNull()).mapInArrow(pack, kinds)
    return written(packed.withColumn("tile", F.monotonically_increasing_id()), "tiles")


def _gaps(here: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, never above that to any pick inside, rounding included."""
    return sum(np.maximum(0.0, np.maximum(lo[None, :, i] - here[:, None, i], here[:, None, i] - hi[None, :, i])) ** 2 for i in range(3))


def _squares(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    return sum((here[..., i] - there[..., i]) ** 2 for i in range(3))


def reachable_tiles(here: np.ndarray, boxes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of points and of boxes that may hold their nearest pick: no further than some pick that is known."""
    lo, hi, at = (boxes[[f"{e}_{a}" for a in _AXES]].to_numpy(np.float64) for e in ("lo", "hi", "at"))
    bound = _squares(here[:, None, :], at[None, :, :]).min(axis=1)
    return np.nonzero(_gaps(here, lo, hi) <= bound[:, None])


def search_tile(here: np.ndarray, picks: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and number of each point's nearest pick, ties to the lower rank; leaves that can't hold it are left out."""
    starts = np.arange(0, len(picks), LEAF)
    lo, hi = np.minimum.reduceat(picks, starts, axis=0), np.maximum.reduceat(picks, starts, axis=0)
    by_rank = np.argsort(rank)

    def looked(points: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        member = np.minimum(starts[leaf][:, None] + np.arange(LEAF), len(picks) - 1)
        d2 = _squares(points[:, None, :], picks[member])
        least = d2.min(axis=1)
        return least, np.where(d2 == least[:, None], rank[member], len(picks)).min(axis=1)

    best, chosen = np.empty(len(here)), np.empty(len(here), np.int64)
    for start in range(0, len(here), SEARCHED):
        part = here[start : start + SEARCHED]
        gap = _gaps(part, lo, hi)
        first = gap.argmin(axis=1)
        least, named = looked(part, first)
        open_ = gap <= least[:, None]
        open_[np.arange(len(part)), first] = False
        rows, leaves = np.nonzero(open_)
        found = [(np.arange(len(part)), least, named)]
        for at in range(0, len(rows), 8192):
            some = rows[at : at + 8192]
            found.append((some, *looked(part[some], leaves[at : at + 8192])))
        rows, d2, named = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((named, d2, rows))
        one = order[np.r_[True, np.diff(rows[order]) > 0]]
        best[start : start + len(part)], chosen[start : start + len(part)] = d2[one], named[one]
    return best, by_rank[chosen]


def nearest_pick(
    points: DataFrame, picks: DataFrame, cell: float | None = None, group: str = "run", block_rows: int = 8192, tile_rows: int = 65_536, boxes: int = BOXES
) -> DataFrame:
    """Nearest pick of the same run for each point ``(run, point_id, x, y, z)``; the lowest id wins a tie.

    Branch and bound in two steps. Picks are packed into tiles along a
    space-filling curve (``pick_tiles``); a point goes to those tiles of its
    run whose box is no further than a pick that is known. In a tile the same
    bound leaves out leaves of a few dozen picks. Tiles hold a bounded number
    of picks, and the points of a tile are cut into blocks, so a run of any
    size is many tasks. Points of runs without picks, and points or picks with a
    coordinate that is null or not finite, take no part.
    """
    types = dict(points.dtypes)
    tiles = pick_tiles(picks, group, tile_rows, cell)
    bounds = [group, "tile", *[f"{e}_{a}" for a in _AXES for e in ("lo", "hi", "at")]]
    asked = points.select(group, "point_id", *_AXES).filter(reduce(and_, [F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf")) for a in _AXES]))
    schema = f"`{group}` {types[group]}, point_id {types['point_id']}, x double, y double, z double, tile long"
    table = small_table(tiles.select(*bounds), boxes)

    def candidates(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for start in range(0, len(left), SEARCHED):
            part = left.iloc[start : start + SEARCHED]
            rows, at = reachable_tiles(part[_AXES].to_numpy(np.float64), right)
            parts.append(part.iloc[rows].assign(tile=right["tile"].to_numpy()[at]))
        return pd.concat(parts)[[group, "point_id", *_AXES, "tile"]]

    if table is not None:
        of_run = dict(list(table.groupby(group)))

        def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for run, part in batch.groupby(group):
                    if run in of_run:
                        yield candidates(part, of_run[run])

        near = asked.mapInPandas(sent, schema)
    else:
        near = cogroup_blocks(asked, tiles.select(*bounds), [group], "point_id", "tile", candidates, schema)
    near = written(near, "candidates")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tile = right.iloc[0]
        ids = np.asarray(tile["pick_id"])
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        d2, at = search_tile(left[_AXES].to_numpy(np.float64), np.stack([np.asarray(tile[a], np.float64) for a in _AXES], axis=1), rank)
        return pd.DataFrame({group: left[group].to_numpy(), "point_id": left["point_id"].to_numpy(), "d2": d2, "pick_id": ids[at]})

    found = cogroup_blocks(
        near, tiles.select(group, "tile", *_AXES, "pick_id"), [group, "tile"], "point_id", "tile", nearest,
        f"`{group}` {types[group]}, point_id {types['point_id']}, d2 double, pick_id {dict(picks.dtypes)['pick_id']}", block_rows,
    )
    best = found.groupBy(group, "point_id").agg(F.min(F.struct("d2", "pick_id")).alias("b"))
    return best.select(group, "point_id", F.col("b.pick_id").alias("pick_id"), F.sqrt("b.d2").alias("distance"))
