"""All unordered pairs of a table, computed block against block.

Rows get a block from a hash of their id, so blocks are balanced whatever the
classes look like. Every row is sent to the block pairs it takes part in; one
task handles one pair of blocks with matrix arithmetic, strip by strip, and
sends on what a strip gives (pairs, when pairs are the result, or sums over
them) before it takes the next, so a task keeps two blocks and one strip.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.session import only_row

STRIP = 256

#: Pairs of one strip, so that its matrices stay small however long the other block is.
STRIP_PAIRS = 1 << 20

#: Bytes of vectors in one block, so that wide rows make small blocks and narrow rows are sent to few of them.
BLOCK_BYTES = 32 << 20

#: Rows of a block, and fewer where pairs are the result: what leaves a task is then much more than what comes in, and is better dealt out.
BLOCK_ROWS, PAIR_ROWS = 16384, 4096

#: Pairs known already that are packed at once before they are sent.
KNOWN_PAIRS = 1 << 20


def block_count(df: DataFrame, block_rows: int | None, vec_col: str | None = None, most: int = BLOCK_ROWS) -> int:
    """Blocks of about ``block_rows`` rows (or ``BLOCK_BYTES``, and ``most`` rows), and at least as many block pairs as there are task slots."""
    width = F.max(F.size(vec_col)) if vec_col else F.lit(64)
    row = only_row(df.agg(F.count(F.lit(1)).alias("n"), width.alias("width")))
    rows = row["n"]
    block_rows = block_rows or min(most, max(256, BLOCK_BYTES // (8 * max(row["width"] or 1, 1))))
    slots = df.sparkSession.sparkContext.defaultParallelism
    least = math.ceil(math.sqrt(2 * slots))
    return max(1, math.ceil(rows / block_rows), min(least, rows // 64))


def strips(left: int, right: int, same: bool, rows: int = STRIP, most: int = STRIP_PAIRS) -> Iterator[tuple[slice, np.ndarray | None]]:
    """Strips of the left block, each with a boolean matrix that leaves every unordered pair once where a block meets itself."""
    step = max(1, min(rows, most // max(right, 1)))
    for start in range(0, left, step):
        end = min(start + step, left)
        yield slice(start, end), np.arange(start, end)[:, None] < np.arange(right)[None, :] if same else None


def unknown_strips(
    left: int, right: int, same: bool, unknown: Callable[[slice], np.ndarray] | None, rows: int = STRIP, most: int = STRIP_PAIRS
) -> Iterator[tuple[slice, np.ndarray | None]]:
    """``strips`` whose matrix leaves only the pairs that ``unknown`` tells, if it is given."""
    for part, keep in strips(left, right, same, rows, most):
        fresh = unknown(part) if unknown else None
        yield part, keep if fresh is None else fresh if keep is None else keep & fresh


def _copies(df: DataFrame, id_col: str, columns: Sequence[str], n: int) -> DataFrame:
    """Every row once for each pair of blocks it takes part in."""
    placed = df.select(id_col, *columns).withColumn("__b", F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int"))
    sent = placed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "*", F.least("__b", "__o").alias("__lo"), F.greatest("__b", "__o").alias("__hi")
    )
    return sent.drop("__o")


def _dealt_out(df: DataFrame, n: int) -> DataFrame:
    # So many partitions, as adaptive execution would join the small ones, and with them the work of many block pairs.
    return df.repartition(min(n * (n + 1), 4000), "__lo", "__hi")


def _two_blocks(key: tuple, group: pd.DataFrame, id_col: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The blocks of a pair in the order of their ids, so that a repeated task does the same arithmetic."""
    group = group.sort_values(id_col, kind="stable")
    left = group[group["__b"] == key[0]].reset_index(drop=True)
    return left, left if key[0] == key[1] else group[group["__b"] == key[1]].reset_index(drop=True)


def map_blocks(
    df: DataFrame,
    id_col: str,
    columns: Sequence[str],
    kernel: Callable[[pd.DataFrame, pd.DataFrame, bool], Iterator[pd.DataFrame]],
    schema: str,
    block_rows: int | None = None,
    blocks: int | None = None,
    most: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``kernel(left block, right block, same)`` to every pair of blocks; each frame it yields leaves the task at once.

    ``same`` says that a block meets itself.
    """
    arrays = [c for c in columns if dict(df.dtypes)[c].startswith("array")]
    n = blocks or block_count(df, block_rows, arrays[0] if arrays else None, most)

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = _two_blocks(key, pd.concat(list(batches), ignore_index=True), id_col)
        sent = False
        if len(left) and len(right):
            for part in kernel(left, right, key[0] == key[1]):
                if len(part):
                    sent = True
                    yield part
        if not sent:
            yield pd.DataFrame(columns=names)

    names = [field.strip().split(" ")[0] for field in schema.split(",")]
    return _dealt_out(_copies(df, id_col, columns, n), n).groupBy("__lo", "__hi").applyInPandas(run, schema)


def map_block_pairs(
    df: DataFrame,
    id_col: str,
    columns: Sequence[str],
    kernel: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray | None], pd.DataFrame],
    schema: str,
    block_rows: int | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Apply ``kernel(left, right, keep)`` to strips of every pair of blocks.

    ``keep`` is a boolean matrix that leaves each unordered pair once when a
    block meets itself, and None when two different blocks meet.
    """

    def by_strips(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        for rows, keep in strips(len(left), len(right), same):
            yield kernel(left.iloc[rows], right, keep)

    return map_blocks(df, id_col, columns, by_strips, schema, block_rows, blocks)


#: Cells (row and class, or class and class) that a task adds up at once.
CELLS = 1 << 19


def class_sorted(block: pd.DataFrame, class_col: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The rows in the order of their class, the classes, and where each of them starts."""
    block = block.sort_values(class_col, kind="stable").reset_index(drop=True)
    return block, *np.unique(block[class_col].to_numpy(), return_index=True)


def class_runs(first: np.ndarray, rows: int, width: int) -> Iterator[tuple[slice, slice]]:
    """Runs of at most ``width`` classes of sorted rows: the classes and their rows."""
    ends = np.append(first, rows)
    for start in range(0, len(first), width):
        end = min(start + width, len(first))
        yield slice(start, end), slice(int(ends[start]), int(ends[end]))


def _packed(known: DataFrame, kind: str, n: int) -> DataFrame:
    """Pairs ``(id1, id2)`` packed for the pair of blocks they belong to: the ids on either side and the cells of their matrix.

    Cells are sent as compressed gaps, so a pair takes a few bits where many of a block pair are known, in place of two ids.
    """
    ends = known.select(*[F.col(c).cast(kind).alias(c) for c in ("id1", "id2")]).filter(F.col("id1") <= F.col("id2"))
    one, other = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c in ("id1", "id2"))
    ordered = one <= other
    ends = ends.select(
        F.least(one, other).alias("__lo"), F.greatest(one, other).alias("__hi"),
        F.when(ordered, F.col("id1")).otherwise(F.col("id2")).alias("__p"), F.when(ordered, F.col("id2")).otherwise(F.col("id1")).alias("__q"),
    )

    def coded(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = pa.Table.from_batches(held)
        lo, hi, p, q = (chunk[c].combine_chunks() for c in ("__lo", "__hi", "__p", "__q"))
        key = lo.to_numpy().astype(np.int64) * n + hi.to_numpy()
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        for start, end in zip(starts, np.append(starts[1:], len(key)), strict=True):
            at = order[start:end]
            left, right = (ids.take(pa.array(at)).dictionary_encode() for ids in (p, q))
            cells = left.indices.to_numpy().astype(np.int64) * len(right.dictionary) + right.indices.to_numpy()
            gaps = np.diff(np.unique(cells), prepend=0)
            gaps = gaps.astype(np.min_scalar_type(gaps.max()))
            sides = [pa.ListArray.from_arrays(pa.array([0, len(x.dictionary)], pa.int32()), x.dictionary) for x in (left, right)]
            yield pa.RecordBatch.from_arrays(
                [lo.take(pa.array(at[:1])), hi.take(pa.array(at[:1])), *sides, pa.array([zlib.compress(gaps.tobytes(), 1)], pa.binary()), pa.array([gaps.itemsize], pa.int32())], names
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= KNOWN_PAIRS:
                yield from coded(held)
                held, rows = [], 0
        if rows:
            yield from coded(held)

    names = ["__lo", "__hi", "__p", "__q", "__gaps", "__width"]
    return ends.mapInArrow(pack, f"__lo int, __hi int, __p array<{kind}>, __q array<{kind}>, __gaps binary, __width int")


def _known_cells(packs: list[tuple], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of two blocks' sorted ids are known."""
    there = np.zeros((len(left), len(right)), bool)
    for p, q, gaps, width in packs:
        rows, cols = np.divmod(np.cumsum(np.frombuffer(zlib.decompress(gaps), f"u{int(width)}"), dtype=np.int64), len(q))
        places, real = [], []
        for ids, mine in ((np.asarray(p, left.dtype), left), (np.asarray(q, right.dtype), right)):
            places.append(np.minimum(np.searchsorted(mine, ids), len(mine) - 1))
            real.append(mine[places[-1]] == ids)
        inside = real[0][rows] & real[1][cols]
        there[places[0][rows[inside]], places[1][cols[inside]]] = True
    return there


def map_unknown_pairs(
    df: DataFrame,
    id_col: str,
    columns: Sequence[str],
    known: DataFrame,
    kernel: Callable[[pd.DataFrame, pd.DataFrame, bool, Callable[[slice], np.ndarray] | None], Iterator[pd.DataFrame]],
    schema: str,
    block_rows: int | None = None,
) -> DataFrame:
    """Apply ``kernel(left block, right block, same, unknown)`` to every pair of blocks, like ``map_blocks``.

    ``unknown(rows)`` tells for a strip of the left block which pairs are not among the pairs ``(id1, id2)`` of ``known``; it
    is None where none is known. Known pairs go packed to the block pair they belong to, and all others are made there and
    never shuffled. A task keeps two blocks, a matrix of one byte for each of their pairs, and a strip; ``columns`` are arrays.
    """
    n = block_count(df, block_rows and min(block_rows, PAIR_ROWS), columns[0] if columns else None, PAIR_ROWS)
    kinds = dict(df.dtypes)
    packed = _packed(known, kinds[id_col], n)
    extra = packed.columns[2:]
    copies = _copies(df, id_col, columns, n).select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in packed.dtypes if c in extra])
    # An id stands in for the rows' own, as numbers with nulls would come as floats.
    sent = packed.select(F.get("__p", 0).alias(id_col), *[F.lit(None).cast(kinds[c]).alias(c) for c in columns], F.lit(-1).alias("__b"), "__lo", "__hi", *extra)

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, packs = [], []
        for batch in batches:
            own = batch["__b"] >= 0
            rows.append(batch.loc[own, [id_col, *columns, "__b"]])
            packs += zip(*[batch.loc[~own, c] for c in extra], strict=True)
        left, right = _two_blocks(key, pd.concat(rows, ignore_index=True), id_col)
        same, is_sent = key[0] == key[1], False
        if len(left) and len(right):
            unknown = None
            if packs:
                (l_ids, a), (r_ids, b) = (np.unique(x[id_col].to_numpy(), return_inverse=True) for x in (left, right))
                there = _known_cells(packs, l_ids, r_ids)
                if same:
                    there |= there.T

                def unknown(part: slice) -> np.ndarray:
                    return ~there[a[part][:, None], b[None, :]]

            for part in kernel(left, right, same, unknown):
                if len(part):
                    is_sent = True
                    yield part
        if not is_sent:
            yield pd.DataFrame(columns=names)

    names = [field.strip().split(" ")[0] for field in schema.split(",")]
    return _dealt_out(copies.unionByName(sent), n).groupBy("__lo", "__hi").applyInPandas(run, schema)


def stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; pairs too close for the product form are taken again from differences."""
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    square = a @ b.T
    square *= -2.0
    square += aa[:, None]
    square += bb[None, :]
    # Most strips hold no such pair, which the smallest value tells at once.
    if square.size and not square.min() >= 1e-5 * (aa.max() + bb.max()):
        near = np.flatnonzero((square < 1e-5 * (aa[:, None] + bb[None, :])).ravel())
        for start in range(0, len(near), 65536):
            r, c = np.divmod(near[start : start + 65536], square.shape[1])
            delta = a[r] - b[c]
            square[r, c] = np.einsum("ij,ij->i", delta, delta)
    np.maximum(square, 0.0, out=square)
    return np.sqrt(square, out=square)


def unit_rows(a: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(length > 0, length, 1.0)


def moments_by_flag(values: np.ndarray, flag: np.ndarray, keep: np.ndarray | None) -> Iterator[tuple[bool, int, float, float]]:
    """Count, sum and sum of squares of the kept values where the flag is set and where it is not."""
    for state in (True, False):
        chosen = flag == state if keep is None else (flag == state) & keep
        part = values[chosen]
        if part.size:
            yield state, int(part.size), float(part.sum()), float((part * part).sum())


#: Bytes of a table that may travel with a task.
TABLE_BYTES = 32 << 20


def small_table(df: DataFrame, bound: int) -> pd.DataFrame | None:
    """The rows of ``df`` if there are at most ``bound`` and ``TABLE_BYTES`` of arrays, else None. Never brings more than that to the driver."""
    wide = [F.coalesce(F.size(c), F.lit(0)) for c, kind in df.dtypes if kind.startswith(("array", "map"))]
    if wide:
        width = only_row(df.agg(F.max(sum(wide[1:], wide[0])).alias("w")))["w"] or 1
        bound = min(bound, TABLE_BYTES // (8 * max(width, 1)))
    rows = df.limit(bound + 1).toPandas()
    return rows if len(rows) <= bound else None


def _meet(a: DataFrame, b: DataFrame, cells: Sequence[str], kernel: Callable, schema: str) -> DataFrame:
    """Cogroup by the cells; the right side gets new column names, because both sides may be the same table."""
    renamed = b.select(*[F.col(c).alias(f"__x_{c}") for c in b.columns])
    names = [field.strip().split(" ")[0] for field in schema.split(",")]

    def run(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(block):
            return pd.DataFrame(columns=names)
        block.columns = [c.removeprefix("__x_") for c in block.columns]
        return kernel(rows.reset_index(drop=True), block.reset_index(drop=True))

    return a.groupBy(*cells).cogroup(renamed.groupBy(*[f"__x_{c}" for c in cells])).applyInPandas(run, schema)


def map_with_table(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    bound: int = 4096,
    block_rows: int = 4096,
    id_col: str = "id",
    right_id: str = "cls",
) -> DataFrame:
    """Apply ``kernel(rows, table)`` to all rows against all rows of a table.

    A table of at most ``bound`` rows (class prototypes) travels with the task
    and nothing is shuffled. A larger one is cut into blocks, and the kernel
    sees each block of rows with each block of the table.
    """
    table = small_table(right, bound)
    if table is not None:
        step = max(1, min(block_rows, STRIP_PAIRS // max(len(table), 1)))

        def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), step):
                    yield kernel(batch.iloc[start : start + step].reset_index(drop=True), table)

        return left.mapInPandas(narrow, schema)
    n_left, n_right = (max(1, math.ceil(df.count() / block_rows)) for df in (left, right))
    a = left.withColumn("__l", F.pmod(F.xxhash64(id_col), F.lit(n_left))).withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    b = right.withColumn("__r", F.pmod(F.xxhash64(right_id), F.lit(n_right))).withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    a, b = (df.withColumn("__l", F.col("__l").cast("long")).withColumn("__r", F.col("__r").cast("long")) for df in (a, b))

    return _meet(a, b, ["__l", "__r"], kernel, schema)



def cogroup_blocks(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: str,
    right_id: str,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int = 4096,
) -> DataFrame:
    """Apply ``kernel(left block, right block)`` to the rows that share the keys.

    Both sides of a key are cut into blocks by id hash, as many as their own
    size asks for, and every block meets every block of the other side. A key
    that holds a third of all rows becomes many tasks; a small key stays one.
    """
    keys = list(keys)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias(name))

    sizes = blocks(left, "__nl").join(blocks(right, "__nr"), keys)

    def placed(df: DataFrame, ident: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(ident), F.col(f"__n{own}")).cast("int").alias(f"__{own}")
        theirs = F.explode(F.sequence(F.lit(0), F.col(f"__n{other}") - 1)).alias(f"__{other}")
        return df.join(sizes, keys).select(*df.columns, mine, theirs)

    a, b = placed(left, left_id, "l", "r"), placed(right, right_id, "r", "l")
    return _meet(a, b, [*keys, "__l", "__r"], kernel, schema)
