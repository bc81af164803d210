"""Affinity tables: all pairs, normalised views, rankings, nearest neighbours, agreement scores.

An affinity table holds ``(id1, id2, affinity)`` with ``id1 < id2``; the full
symmetric matrix exists only as a view.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.labels import BACKGROUND
from motefield.operators.pairs import CELLS, PAIR_ROWS, STRIP, STRIP_PAIRS, class_runs, class_sorted, cogroup_blocks, distances, map_blocks, map_unknown_pairs, small_table, stack, strips, unit_rows, unknown_strips
from motefield.operators.ranking import first_per_group
from motefield.session import only_row, written

# Target similarity of two background rows and of background with anything else.
BACKGROUND_SIM = 0.2
BACKGROUND_OTHER_SIM = 0.01
TARGET_BOUND = 200_000  # class pairs that may travel with a task


def _scaled_blocks(left: pd.DataFrame, right: pd.DataFrame, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    a = unit_rows(stack(left[vec_col]))
    return a, a if right is left else unit_rows(stack(right[vec_col]))


def _as_pairs(left: np.ndarray, right: np.ndarray, rows: np.ndarray, cols: np.ndarray, **values: np.ndarray) -> pd.DataFrame:
    a, b = left[rows], right[cols]
    swap = a > b
    return pd.DataFrame({"id1": np.where(swap, b, a), "id2": np.where(swap, a, b), **values})


#: Pairs that a task puts in the order of their affinity at once, and those it sends on at once.
TILE_PAIRS, FRAME_PAIRS = 1 << 23, 1 << 18

#: Rows of a strip of other pairs: each row of the other block comes with the same few ids, which take little when written.
REPEATED = 64


def _affinities(
    left: pd.DataFrame, right: pd.DataFrame, same: bool, id_col: str, vec_col: str, by_value: bool, unknown: Callable[[slice], np.ndarray] | None = None
) -> Iterator[pd.DataFrame]:
    """Pairs of two blocks, tile by tile and at most ``FRAME_PAIRS`` at once; all of them, or those ``unknown`` tells."""
    a, b = _scaled_blocks(left, right, vec_col)
    l_ids, r_ids = left[id_col].to_numpy(), right[id_col].to_numpy()
    for part, keep in unknown_strips(len(a), len(b), same, unknown, *((len(a), TILE_PAIRS) if by_value else (REPEATED, STRIP_PAIRS))):
        cos, at = (b @ a[part].T).ravel(), None
        if keep is not None:
            at = np.flatnonzero(keep.T).astype(np.int32)
            cos = cos[at]
        order = np.argsort(cos) if by_value else np.arange(len(cos))
        for start in range(0, len(cos), FRAME_PAIRS):
            some = order[start : start + FRAME_PAIRS]
            cols, rows = np.divmod(some if at is None else at[some], part.stop - part.start)
            yield _as_pairs(l_ids[part], r_ids, rows, cols, affinity=cos[some])


def pairwise_affinity(
    features: DataFrame, id_col: str = "id", vec_col: str = "feature", existing: DataFrame | None = None, block_rows: int | None = None, by_value: bool = False
) -> DataFrame:
    """Cosine of every unordered pair; pairs already present in ``existing`` keep their value.

    Only the pairs of ``existing`` are shuffled, to the blocks they belong to.
    With ``by_value`` a task gives its pairs in the order of their affinity, ``TILE_PAIRS`` at a time: where affinities
    are rounded, equal ones then lie together, and written columns take about half.
    """
    spark_type = dict(features.dtypes)[id_col]
    schema = f"id1 {spark_type}, id2 {spark_type}, affinity double"

    def fresh(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        return _affinities(left, right, same, id_col, vec_col, by_value)

    def missing(left: pd.DataFrame, right: pd.DataFrame, same: bool, unknown: Callable[[slice], np.ndarray] | None) -> Iterator[pd.DataFrame]:
        return _affinities(left, right, same, id_col, vec_col, by_value, unknown)

    if existing is None:
        return map_blocks(features, id_col, [vec_col], fresh, schema, block_rows, most=PAIR_ROWS)
    return map_unknown_pairs(features, id_col, [vec_col], existing, missing, schema, block_rows).unionByName(existing.select("id1", "id2", "affinity"))


def missing_pairs(rows: DataFrame, aff: DataFrame, id_col: str = "id") -> DataFrame:
    """Unordered pairs of ids that have no affinity yet, without any arithmetic on their vectors; only the pairs of ``aff`` are shuffled."""
    spark_type = dict(rows.dtypes)[id_col]

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool, unknown: Callable[[slice], np.ndarray] | None) -> Iterator[pd.DataFrame]:
        l_ids, r_ids = left[id_col].to_numpy(), right[id_col].to_numpy()
        for part, keep in unknown_strips(len(left), len(right), same, unknown, REPEATED):
            cols, rows = np.nonzero(np.ones((len(right), part.stop - part.start), bool) if keep is None else keep.T)
            yield _as_pairs(l_ids[part], r_ids, rows, cols)

    return map_unknown_pairs(rows.select(id_col), id_col, [], aff, kernel, f"id1 {spark_type}, id2 {spark_type}")


def directed(aff: DataFrame) -> DataFrame:
    """Both directions of every pair; the diagonal is 1 by definition and is not stored."""
    return aff.select(F.explode(F.array(
        F.struct(F.col("id1").alias("i"), F.col("id2").alias("j"), "affinity"),
        F.struct(F.col("id2").alias("i"), F.col("id1").alias("j"), "affinity"),
    )).alias("e")).select("e.*")


def background_rows(matrix: DataFrame) -> DataFrame:
    """Rows of background ids become -|affinity|; columns stay, so the view is asymmetric."""
    named = F.lower(F.col("i").cast("string")).contains(BACKGROUND)
    return matrix.withColumn("affinity", F.when(named, -F.abs("affinity")).otherwise(F.col("affinity")))


def _minmax(matrix: DataFrame, signed: bool) -> DataFrame:
    matrix = written(matrix, "affinities")  # all pairs are computed once, for the range and for the result
    row = only_row(matrix.agg(F.min("affinity").alias("lo"), F.max("affinity").alias("hi")))
    if row["lo"] is None or abs(row["hi"] - row["lo"]) <= 1e-6:
        return matrix
    scaled = (F.col("affinity") - F.lit(row["lo"])) / F.lit(row["hi"] - row["lo"])
    if signed and row["lo"] < 0:
        scaled = 2.0 * scaled - 1.0
    return matrix.withColumn("affinity", scaled)


def normalize_affinity(matrix: DataFrame) -> DataFrame:
    """Off-diagonal values to [0, 1], or to [-1, 1] when any of them is negative."""
    return _minmax(matrix, signed=True)


def affinity_view(aff: DataFrame, ids: DataFrame, background: bool = True) -> DataFrame:
    """Matrix of the wanted ids (case ignored), always scaled to [0, 1], with the diagonal."""
    wanted = ids.select(F.lower(F.col("id").cast("string")).alias("__w")).distinct()
    left = F.lower(F.col("id1").cast("string"))
    right = F.lower(F.col("id2").cast("string"))
    kept = aff.join(wanted, left == F.col("__w"), "left_semi").join(wanted, right == F.col("__w"), "left_semi")
    matrix = directed(kept)
    scaled = _minmax(background_rows(matrix) if background else matrix, signed=False)
    known = scaled.select("i").distinct()
    return scaled.unionByName(known.select("i", F.col("i").alias("j"), F.lit(1.0).alias("affinity")))


def completeness(features: DataFrame, aff: DataFrame, expected: int | None = None) -> DataFrame:
    """Counts of features and pairs, and whether both are complete for ``expected`` ids; ``aff`` is an affinity table or its ``pair_counts``."""
    n = F.col("n_features") if expected is None else F.lit(expected)
    size = F.col("n_pairs") if "n_pairs" in aff.columns else F.lit(1).cast("long")
    counts = features.select(F.lit(1).cast("long").alias("f"), F.lit(0).cast("long").alias("p")).unionAll(aff.select(F.lit(0).cast("long"), size))
    return counts.agg(F.sum("f").alias("n_features"), F.sum("p").alias("n_pairs")).withColumn(
        "complete", (F.col("n_features") >= n) & (F.col("n_pairs") >= n * (n - 1) / 2)
    )


def ranked_pairs(aff: DataFrame, k: int | None = None) -> DataFrame:
    """Pairs by falling affinity; with ``k`` a top-k that never sorts the whole table."""
    ordered = aff.orderBy(F.col("affinity").desc(), "id1", "id2")
    return ordered if k is None else ordered.limit(k)


def pair_ids(aff: DataFrame) -> DataFrame:
    return aff.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()


def extreme_pairs(aff: DataFrame, k: int) -> DataFrame:
    """The k most and k least similar pairs."""
    top = aff.orderBy(F.col("affinity").desc(), "id1", "id2").limit(k).withColumn("side", F.lit("most"))
    low = aff.orderBy(F.col("affinity").asc(), "id1", "id2").limit(k).withColumn("side", F.lit("least"))
    return top.unionByName(low)


def affinity_histogram(aff: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and the largest affinity; the last bin is closed."""
    aff = written(aff.select("affinity"), "affinities")
    row = only_row(aff.agg(F.min("affinity").alias("lo"), F.max("affinity").alias("hi")))
    lo, hi = row["lo"], row["hi"]
    width = (hi - lo) / bins if hi > lo else 1.0
    slot = F.least(F.floor((F.col("affinity") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return aff.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n_pairs"))


def affinity_summary(aff: DataFrame) -> DataFrame:
    return aff.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.min("affinity").alias("min_affinity"),
        F.max("affinity").alias("max_affinity"),
        F.avg("affinity").alias("mean_affinity"),
        F.stddev_pop("affinity").alias("std_affinity"),
    )


# The same of all pairs of a feature table. Every pair is computed, but only sums or the best k of a block pair leave its
# task, so what is sent and kept does not grow with the pairs.


def _cosines(left: pd.DataFrame, right: pd.DataFrame, same: bool, vec_col: str) -> Iterator[np.ndarray]:
    """Affinities of two blocks, strip by strip."""
    a, b = _scaled_blocks(left, right, vec_col)
    for part, keep in strips(len(a), len(b), same):
        cos = a[part] @ b.T
        np.clip(cos, -1.0, 1.0, out=cos)
        cos = cos.ravel() if keep is None else cos[keep]
        if cos.size:
            yield cos


def pair_counts(features: DataFrame, id_col: str = "id", vec_col: str = "feature") -> DataFrame:
    """``(n_pairs)``: pairs with an affinity in each pair of blocks, for ``completeness``."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n_pairs": [sum(cos.size for cos in _cosines(left, right, same, vec_col))]})

    return map_blocks(features, id_col, [vec_col], kernel, "n_pairs long")


def paired_ids(features: DataFrame, id_col: str = "id", vec_col: str = "feature") -> DataFrame:
    """Ids that take part in any pair."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        if not same or len(left) > 1:
            yield pd.DataFrame({"id": np.unique(np.concatenate([left[id_col].to_numpy(), right[id_col].to_numpy()]))})

    return map_blocks(features.select(id_col), id_col, [], kernel, f"id {dict(features.dtypes)[id_col]}").distinct()


def all_pairs_summary(features: DataFrame, id_col: str = "id", vec_col: str = "feature") -> DataFrame:
    """``affinity_summary`` of all pairs."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        parts = [(cos.size, cos.sum(), cos @ cos, cos.min(), cos.max()) for cos in _cosines(left, right, same, vec_col)]
        if parts:
            n, s, q, lo, hi = (np.array(c) for c in zip(*parts))
            yield pd.DataFrame({"n": [n.sum()], "s": [s.sum()], "q": [q.sum()], "lo": [lo.min()], "hi": [hi.max()]})

    sums = map_blocks(features, id_col, [vec_col], kernel, "n long, s double, q double, lo double, hi double")
    mean = F.sum("s") / F.sum("n")
    spread = F.when(F.sum("n") > 0, F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))))
    return sums.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_pairs"), F.min("lo").alias("min_affinity"), F.max("hi").alias("max_affinity"),
        mean.alias("mean_affinity"), spread.alias("std_affinity"),
    )


def all_pairs_histogram(features: DataFrame, bins: int = 20, id_col: str = "id", vec_col: str = "feature") -> DataFrame:
    """``affinity_histogram`` of all pairs: one pass for the range, one for the counts; no affinity is stored."""
    row = only_row(all_pairs_summary(features, id_col, vec_col))
    lo, hi = row["min_affinity"], row["max_affinity"]
    width = (hi - lo) / bins if lo is not None and hi > lo else 1.0

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        count = np.zeros(bins, dtype="int64")
        for cos in _cosines(left, right, same, vec_col):
            count += np.bincount(np.clip((cos - lo) / width, 0, bins - 1).astype("int64"), minlength=bins)
        hit = np.flatnonzero(count)
        yield pd.DataFrame({"bin": hit.astype("int32"), "n": count[hit]})

    return map_blocks(features, id_col, [vec_col], kernel, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n_pairs"))


#: A product of matrices may differ by so much from the affinity that ranks a pair.
SLACK = 1e-12


def _plain_cosines(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, summed in the order of the dimensions: the same wherever a row lies, and 1 for equal rows."""
    out = np.zeros(len(rows))
    for start in range(0, len(rows), 16384):
        a, b = x[rows[start : start + 16384]], y[cols[start : start + 16384]]
        dot, aa, bb = (np.cumsum(p, axis=1)[:, -1] for p in (a * b, a * a, b * b))
        size = np.sqrt(aa * bb)
        out[start : start + 16384] = np.clip(dot / np.where(size > 0, size, 1.0), -1.0, 1.0)
    return out


def extremes_kernel(k: int, sides: tuple[str, ...], id_col: str, vec_col: str) -> Callable[[pd.DataFrame, pd.DataFrame, bool], Iterator[pd.DataFrame]]:
    """The best k of two blocks for ``all_pairs_extremes``."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        x, y = stack(left[vec_col]), stack(right[vec_col])
        l_ids, r_ids = left[id_col].to_numpy(), right[id_col].to_numpy()
        a, b = unit_rows(x), unit_rows(y)
        found, least = {}, dict.fromkeys(sides, -np.inf)
        for part, keep in strips(len(a), len(b), same):
            cos = a[part] @ b.T
            for side in sides:
                score = cos if side == "most" else -cos
                near = score >= least[side] - SLACK
                near = np.flatnonzero((near if keep is None else near & keep).ravel())
                if len(near) > k:
                    values = score.ravel()[near]
                    near = near[values >= np.partition(values, -k)[-k] - SLACK]
                if not len(near):
                    continue
                rows, cols = np.divmod(near, len(b))
                fresh = _as_pairs(l_ids[part], r_ids, rows, cols, affinity=_plain_cosines(x[part], y, rows, cols))
                both = pd.concat([found[side], fresh], ignore_index=True) if side in found else fresh
                found[side] = both.sort_values(["affinity", "id1", "id2"], ascending=[side == "least", True, True]).head(k)
                if len(found[side]) == k:
                    least[side] = float(found[side]["affinity"].iloc[-1]) * (1.0 if side == "most" else -1.0)
        for side, pairs in found.items():
            yield pairs.assign(side=side)

    return kernel


def all_pairs_extremes(features: DataFrame, k: int, sides: tuple[str, ...] = ("most", "least"), id_col: str = "id", vec_col: str = "feature") -> DataFrame:
    """The k most and k least similar of all pairs, ties to the smaller ids.

    A task keeps the best k of its block pair. What a matrix product puts near the k-th is taken again row by row, so
    that ties do not hang on where a row lies in its block.
    """
    kind = dict(features.dtypes)[id_col]
    found = map_blocks(features, id_col, [vec_col], extremes_kernel(k, sides, id_col, vec_col), f"id1 {kind}, id2 {kind}, affinity double, side string")
    order = F.when(F.col("side") == "most", -F.col("affinity")).otherwise(F.col("affinity"))
    return first_per_group(found, ["side"], [order, F.col("id1"), F.col("id2")], k)


def all_pairs_ranked(features: DataFrame, k: int, id_col: str = "id", vec_col: str = "feature") -> DataFrame:
    """``ranked_pairs`` of all pairs."""
    return ranked_pairs(all_pairs_extremes(features, k, ("most",), id_col, vec_col).drop("side"), k)


def top_k_similar(
    queries: DataFrame, corpus: DataFrame, k: int = 10, group: str = "run", id_col: str = "id", vec_col: str = "feature", block_rows: int = 4096
) -> DataFrame:
    """The k rows of the same group most similar to each query, without the query itself.

    Queries and corpus are cut into blocks per group, so a large group becomes
    many tasks. A task returns only its best k per query; the final ranking
    sees k rows per query and block. Exact for any block size.
    """
    types = dict(corpus.dtypes)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(id_col, kind="stable")
        vectors, r_ids = unit_rows(stack(right[vec_col])), right[id_col].to_numpy()
        parts = []
        for start in range(0, len(left), STRIP):
            part = left.iloc[start : start + STRIP]
            q_ids = part[id_col].to_numpy()
            sim = unit_rows(stack(part[vec_col])) @ vectors.T
            sim[q_ids[:, None] == r_ids[None, :]] = -np.inf
            order = np.argsort(-np.round(sim, 9), axis=1, kind="stable")[:, :k]
            rows, cols = np.repeat(np.arange(len(part)), order.shape[1]), order.ravel()
            found = sim[rows, cols] > -np.inf
            rows, cols = rows[found], cols[found]
            parts.append(pd.DataFrame({group: part[group].to_numpy()[rows], "query_id": q_ids[rows], "id": r_ids[cols], "similarity": sim[rows, cols]}))
        return pd.concat(parts, ignore_index=True)

    schema = f"{group} {types[group]}, query_id {types[id_col]}, id {types[id_col]}, similarity double"
    sides = [df.select(group, id_col, vec_col) for df in (queries, corpus)]
    found = cogroup_blocks(*sides, [group], id_col, id_col, best, schema, block_rows)
    order = [F.round("similarity", 9).desc(), F.col("id")]
    return first_per_group(found, [group, "query_id"], order, k)


def target_similarity(c1: Column, c2: Column, looked_up: Column) -> Column:
    """Target of a pair of classes: fixed values when background (-1) takes part, else the table value."""
    both, one = (c1 == -1) & (c2 == -1), (c1 == -1) | (c2 == -1)
    return (
        F.when(both, F.lit(BACKGROUND_SIM)).when(one, F.lit(BACKGROUND_OTHER_SIM)).when(c1 == c2, F.lit(1.0)).otherwise(F.coalesce(looked_up, F.lit(0.0)))
    )


def with_targets(pairs: DataFrame, class_aff: DataFrame, c1: str = "c1", c2: str = "c2") -> DataFrame:
    """Add ``target`` to rows of class pairs by an equi join on the ordered pair of classes."""
    table = class_aff.select(F.col("id1").alias("__a"), F.col("id2").alias("__b"), F.col("affinity").alias("__t"))
    joined = pairs.join(table, (F.least(c1, c2) == F.col("__a")) & (F.greatest(c1, c2) == F.col("__b")), "left")
    return joined.withColumn("target", target_similarity(F.col(c1), F.col(c2), F.col("__t"))).drop("__a", "__b", "__t")


def _class_pair_sums(
    left: pd.DataFrame, right: pd.DataFrame, same: bool, class_col: str, values: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], Callable]
) -> Iterator[pd.DataFrame]:
    """Sums of pair values by unordered pair of classes, for two blocks whose rows are sorted by class.

    ``values(left, right, left classes, right classes)`` is called for each run of left classes and returns a function
    of a strip of its rows and their class numbers, which gives named matrices.
    """
    left, l_names, l_first = class_sorted(left, class_col)
    right, r_names, r_first = (left, l_names, l_first) if same else class_sorted(right, class_col)
    r_sizes = np.diff(np.append(r_first, len(right)))
    for run, rows in class_runs(l_first, len(left), max(1, CELLS // len(r_names))):
        names, sizes = l_names[run], np.diff(np.append(l_first[run], rows.stop))
        code = np.repeat(np.arange(len(names)), sizes)
        block, cells = left.iloc[rows], {}
        strip_values = values(block, right, names, r_names)
        for part, _ in strips(len(block), len(right), False):
            own = code[part]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for name, value in strip_values(part, own).items():
                if same:
                    at = np.arange(rows.start + part.start, rows.start + part.stop)
                    value = value * (at[:, None] < np.arange(len(right))[None, :])
                cell = cells.setdefault(name, np.zeros((len(names), len(r_names))))
                cell[own[cuts]] += np.add.reduceat(np.add.reduceat(value, r_first, axis=1), cuts, axis=0)
        n = sizes[:, None] * r_sizes[None, :]
        if same:
            number = np.arange(run.start, run.stop)[:, None]
            n = np.where(number < np.arange(len(r_names))[None, :], n, np.where(number == np.arange(len(r_names))[None, :], sizes[:, None] * (sizes[:, None] - 1) // 2, 0))
        i, j = np.nonzero(n)
        c1, c2 = names[i], r_names[j]
        yield pd.DataFrame({"c1": np.minimum(c1, c2), "c2": np.maximum(c1, c2), "n": n[i, j], **{name: cell[i, j] for name, cell in cells.items()}})


def _lookup_by_class(table: pd.DataFrame) -> dict:
    """Affinities of a small class table as ``{class: {other class: affinity}}``."""
    known: dict = {}
    for a, b, value in zip(table["id1"], table["id2"], table["affinity"]):
        known.setdefault(a, {})[b] = value
        known.setdefault(b, {})[a] = value
    return known


def contrastive_score(
    df: DataFrame, class_aff: DataFrame, margin: float = 4.0, ratio_dims: int | None = None, id_col: str = "id", vec_col: str = "feature", class_col: str = "cls"
) -> DataFrame:
    """t*d^2 + (1-t)*max(margin-d, 0)^2 over all pairs, d = distance / sqrt(dims).

    The score is linear in the target t, and t depends on the classes only, so
    tasks return two sums per class pair and the table is joined afterwards.
    """
    kind = dict(df.dtypes)[class_col]

    def values(left: pd.DataFrame, right: pd.DataFrame, l_names: np.ndarray, r_names: np.ndarray) -> Callable:
        a, b = stack(left[vec_col])[:, :ratio_dims], stack(right[vec_col])[:, :ratio_dims]

        def strip(part: slice, own: np.ndarray) -> dict[str, np.ndarray]:
            d = distances(a[part], b) / np.sqrt(a.shape[1])
            short = np.maximum(margin - d, 0.0)
            return {"near": np.square(d, out=d), "far": np.square(short, out=short)}

        return strip

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        return _class_pair_sums(left, right, same, class_col, values)

    sums = map_blocks(df, id_col, [vec_col, class_col], kernel, f"c1 {kind}, c2 {kind}, n long, near double, far double")
    cells = sums.groupBy("c1", "c2").agg(F.sum("n").alias("n_pairs"), F.sum("near").alias("near"), F.sum("far").alias("far"))
    score = F.col("target") * F.col("near") + (1.0 - F.col("target")) * F.col("far")
    return with_targets(cells, class_aff).select("c1", "c2", "n_pairs", "target", score.alias("score_sum"))


def affinity_agreement(
    df: DataFrame, class_aff: DataFrame, ratio_dims: int | None = None, rescale: bool = True, id_col: str = "id", vec_col: str = "feature", class_col: str = "cls"
) -> DataFrame:
    """L1 distance of pair similarity and target, by unordered pair of classes.

    The absolute value ties each pair to its target. A class table of at most
    ``TARGET_BOUND`` pairs travels with the tasks; beyond it every row carries
    the targets of its own class as a map.
    """
    kind = dict(df.dtypes)[class_col]
    table = small_table(class_aff.select("id1", "id2", "affinity"), TARGET_BOUND)
    if table is not None:
        known = _lookup_by_class(table)
        carried, columns = df, [vec_col, class_col]
    else:
        known = None
        maps = directed(class_aff).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "affinity"))).alias("__known"))
        carried = df.join(maps, F.col(class_col) == F.col("i"), "left").drop("i")
        columns = [vec_col, class_col, "__known"]

    def values(left: pd.DataFrame, right: pd.DataFrame, l_names: np.ndarray, r_names: np.ndarray) -> Callable:
        a, b = unit_rows(stack(left[vec_col])[:, :ratio_dims]), unit_rows(stack(right[vec_col])[:, :ratio_dims])
        l_first = np.unique(left[class_col].to_numpy(), return_index=True)[1]
        r_codes = np.unique(right[class_col].to_numpy(), return_inverse=True)[1]
        target = np.zeros((len(l_names), len(r_names)))
        for i, cls in enumerate(l_names):
            own = known.get(cls, {}) if known is not None else dict(left["__known"].iloc[l_first[i]] or {})
            target[i] = [own.get(other, 0.0) for other in r_names]
        l_back, r_back = l_names[:, None] == -1, r_names[None, :] == -1
        target = np.where(l_names[:, None] == r_names[None, :], 1.0, target)
        target = np.where(l_back & r_back, BACKGROUND_SIM, np.where(l_back | r_back, BACKGROUND_OTHER_SIM, target))

        def strip(part: slice, own: np.ndarray) -> dict[str, np.ndarray]:
            sim = a[part] @ b.T
            sim = (sim + 1.0) / 2.0 if rescale else sim
            return {"l1": np.abs(sim - target[own][:, r_codes])}

        return strip

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        return _class_pair_sums(left, right, same, class_col, values)

    sums = map_blocks(carried, id_col, columns, kernel, f"c1 {kind}, c2 {kind}, n long, l1 double")
    return sums.groupBy("c1", "c2").agg(F.sum("n").alias("n_pairs"), (F.sum("l1") / F.sum("n")).alias("mean_l1"))
