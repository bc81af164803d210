"""Quality of an embedding space: separation, silhouette, overlap, diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.functions.tails import chi2_upper
from motefield.functions.vectors import euclidean, let
from motefield.operators.pairs import CELLS, class_runs, class_sorted, distances, map_block_pairs, map_blocks, map_with_table, stack, strips
from motefield.session import only_row, written


def centroids(df: DataFrame, vec_col: str = "feature", class_col: str = "cls") -> DataFrame:
    """Mean vector and row count per class, combined on the map side."""
    summary = Summarizer.metrics("mean", "count").summary(array_to_vector(F.col(vec_col).cast("array<double>"))).alias("s")
    return df.groupBy(class_col).agg(summary).select(
        class_col, vector_to_array("s.mean").alias("centroid"), F.col("s.count").cast("long").alias("n")
    )


def class_spread(df: DataFrame, vec_col: str = "feature", class_col: str = "cls") -> DataFrame:
    """Centroid and mean distance to it, per class."""
    centers = centroids(df, vec_col, class_col)
    near = df.join(centers, class_col).groupBy(class_col).agg(F.avg(euclidean(F.col(vec_col), F.col("centroid"))).alias("spread"))
    return centers.join(near, class_col)


def davies_bouldin(df: DataFrame, vec_col: str = "feature", class_col: str = "cls") -> DataFrame:
    """Mean over classes of the worst (spread_i + spread_j) / distance_ij; 0 with fewer than two classes."""
    kind = dict(df.dtypes)[class_col]

    def kernel(left: pd.DataFrame, right: pd.DataFrame, keep: np.ndarray | None) -> pd.DataFrame:
        d = distances(stack(left["centroid"]), stack(right["centroid"]))
        spread = left["spread"].to_numpy()[:, None] + right["spread"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 0, spread / d, 0.0)
        rows, cols = np.nonzero(np.ones(d.shape, bool) if keep is None else keep)
        worst = pd.DataFrame({
            "cls": np.concatenate([left[class_col].to_numpy()[rows], right[class_col].to_numpy()[cols]]),
            "ratio": np.concatenate([ratio[rows, cols]] * 2),
        })
        return worst.groupby("cls", as_index=False).max()

    found = map_block_pairs(class_spread(df, vec_col, class_col), class_col, ["centroid", "spread"], kernel, f"cls {kind}, ratio double")
    worst = found.groupBy("cls").agg(F.max("ratio").alias("ratio"))
    return worst.agg(F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("davies_bouldin"))


def distance_kernel(id_col: str, vec_col: str, class_col: str) -> Callable[[pd.DataFrame, pd.DataFrame, bool], Iterator[pd.DataFrame]]:
    """Sums of two blocks for ``distance_sums``."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        left, l_names, l_first = class_sorted(left, class_col)
        right, r_names, r_first = (left, l_names, l_first) if same else class_sorted(right, class_col)
        x = stack(left[vec_col])
        y = x if same else stack(right[vec_col])
        width = max(1, CELLS // max(len(left), len(right)))
        for l_run, l_rows in class_runs(l_first, len(left), width):
            for r_run, r_rows in class_runs(r_first, len(right), width):
                l_starts, r_starts = l_first[l_run] - l_rows.start, r_first[r_run] - r_rows.start
                there, back = _tile_sums(x[l_rows], l_starts, y[r_rows], r_starts, both=not same)
                sides = [(left, l_rows, r_names[r_run], np.diff(np.append(r_starts, r_rows.stop - r_rows.start)), there)]
                if back is not None:
                    sides.append((right, r_rows, l_names[l_run], np.diff(np.append(l_starts, l_rows.stop - l_rows.start)), back))
                for rows, chosen, others, sizes, (s, q) in sides:
                    ids, own = rows[id_col].to_numpy()[chosen], rows[class_col].to_numpy()[chosen]
                    # A block that meets itself has every pair both ways, and every row with itself, at distance 0.
                    n = sizes[None, :] - ((own[:, None] == others[None, :]) & same)
                    r, c = np.nonzero(n)
                    yield pd.DataFrame({"id": ids[r], "own": own[r], "other": others[c], "n": n[r, c].astype("int64"), "s": s[r, c], "q": q[r, c]})

    return kernel


def distance_sums(df: DataFrame, id_col: str = "id", vec_col: str = "feature", class_col: str = "cls") -> DataFrame:
    """``(id, own, other, n, s, q)``: count, sum and sum of squares of the distances of each row to each class.

    The one all-pairs pass behind separation, silhouette and pairwise
    diversity. The rows of a block are sorted by class, and a task adds up its
    strips in one array of rows and classes for each side, so a row leaves a
    block pair once for each class and memory is that of two blocks, whatever their pairs.
    """
    id_type, kind = dict(df.dtypes)[id_col], dict(df.dtypes)[class_col]

    schema = f"id {id_type}, own {kind}, other {kind}, n long, s double, q double"
    sums = map_blocks(df, id_col, [vec_col, class_col], distance_kernel(id_col, vec_col, class_col), schema)
    return sums.groupBy("id", "own", "other").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])


def _tile_sums(x: np.ndarray, x_starts: np.ndarray, y: np.ndarray, y_starts: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums of distances and of their squares of each row of ``x`` by class of ``y``, and of ``y`` by class of ``x`` if ``both``."""
    there, back = np.zeros((2, len(x), len(y_starts))), np.zeros((2, len(x_starts), len(y))) if both else None
    code = np.repeat(np.arange(len(x_starts)), np.diff(np.append(x_starts, len(x))))
    for part, _ in strips(len(x), len(y), False):
        d = distances(x[part], y)
        own = code[part]
        for i, value in enumerate((d, d * d)):
            there[i, part] = np.add.reduceat(value, y_starts, axis=1)
            if both:
                cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    back[i, own[lo]] += value[lo:hi].sum(axis=0)
    return there, None if back is None else back.transpose(0, 2, 1)


def cosine_sums(df: DataFrame, id_col: str = "id", vec_col: str = "feature", class_col: str = "cls") -> DataFrame:
    """``(id, own, other, n, s)`` of cosine distances without any pair: a row against the sum of the unit rows of each class."""
    kind = dict(df.dtypes)
    unit = df.select(id_col, class_col, F.col(vec_col).cast("array<double>").alias("__u"))
    length = F.sqrt(F.aggregate("__u", F.lit(0.0), lambda a, x: a + x * x))
    unit = unit.withColumn("__u", let(length, lambda n: F.transform("__u", lambda x: F.when(n > 0, x / n).otherwise(x))))
    classes = centroids(unit, "__u", class_col)

    def against(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        x, total = stack(rows["__u"]), stack(table["centroid"]) * table["n"].to_numpy()[:, None]
        n = np.broadcast_to(table["n"].to_numpy(), (len(x), len(total))).copy()
        own = rows[class_col].to_numpy()[:, None] == table[class_col].to_numpy()[None, :]
        n[own] -= 1
        near = x @ total.T - own * np.einsum("ij,ij->i", x, x)[:, None]
        r, c = np.nonzero(n)
        return pd.DataFrame({"id": rows[id_col].to_numpy()[r], "own": rows[class_col].to_numpy()[r], "other": table[class_col].to_numpy()[c], "n": n[r, c], "s": n[r, c] - near[r, c]})

    schema = f"id {kind[id_col]}, own {kind[class_col]}, other {kind[class_col]}, n long, s double"
    return map_with_table(unit, classes, against, schema, id_col=id_col, right_id=class_col)


def silhouettes_of(sums: DataFrame) -> DataFrame:
    """Silhouette of every row from its sums of distances; a row alone in its class scores 0."""
    means = sums.withColumn("d", F.col("s") / F.col("n"))
    inner = F.max(F.when(F.col("own") == F.col("other"), F.col("d")))
    outer = F.min(F.when(F.col("own") != F.col("other"), F.col("d")))
    both = means.groupBy("id", "own").agg(inner.alias("a"), outer.alias("b"))
    scale = F.greatest("a", "b")
    score = F.when(F.col("a").isNull() | F.col("b").isNull() | (scale == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / scale)
    return both.select("id", F.col("own").alias("cls"), "a", "b", score.alias("silhouette"))


def silhouette_samples(df: DataFrame, metric: str = "euclidean", id_col: str = "id", vec_col: str = "feature", class_col: str = "cls") -> DataFrame:
    """Silhouette of every row; cosine distances need no pairs."""
    passes = {"euclidean": distance_sums, "cosine": cosine_sums}
    if metric not in passes:
        raise ValueError(f"unknown metric {metric}")
    return silhouettes_of(passes[metric](df, id_col, vec_col, class_col))


def _mean_silhouette(samples: DataFrame) -> DataFrame:
    return samples.agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette"))


def silhouette(df: DataFrame, metric: str = "euclidean", **columns) -> DataFrame:
    """Mean silhouette; 0 with fewer than two classes."""
    return _mean_silhouette(silhouette_samples(df, metric, **columns))


def pair_sums(df: DataFrame, id_col: str = "id", vec_col: str = "feature", class_col: str = "cls") -> DataFrame:
    """``(same, n, s, q)``: ``distance_sums`` added up within and between classes inside the tasks.

    A task sends a row or two for each tile of classes, so what is shuffled after the blocks does not grow with the rows.
    """
    by_row = distance_kernel(id_col, vec_col, class_col)

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        for part in by_row(left, right, same):
            within = (part["own"] == part["other"]).astype("boolean").mask(part[["own", "other"]].isna().any(axis=1))
            yield part[["n", "s", "q"]].groupby(within.rename("same"), dropna=False).sum().reset_index()

    return map_blocks(df, id_col, [vec_col, class_col], kernel, "same boolean, n long, s double, q double")


def moments_of(sums: DataFrame) -> DataFrame:
    """Count, mean and population deviation of pair distances within and between classes, from ``distance_sums`` or ``pair_sums``.

    Every pair is in the sums twice.
    """
    same = F.col("same") if "same" in sums.columns else F.col("own") == F.col("other")
    mean = F.sum("s") / F.sum("n")
    spread = F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0)))
    return sums.groupBy(same.alias("same")).agg(
        (F.sum("n") / 2).cast("long").alias("n_pairs"), mean.alias("mean_distance"), spread.alias("std_distance")
    )


def pair_moments(df: DataFrame, id_col: str = "id", vec_col: str = "feature", class_col: str = "cls") -> DataFrame:
    return moments_of(pair_sums(df, id_col, vec_col, class_col))


def separation_of(moments: DataFrame) -> DataFrame:
    """Within and between distances and their ratio, as one row, from ``pair_moments``."""
    picked = {}
    for name, flag in (("within", F.col("same")), ("between", ~F.col("same"))):
        for stat, source in (("mean", "mean_distance"), ("std", "std_distance"), ("n", "n_pairs")):
            zero = F.lit(0) if stat == "n" else F.lit(0.0)
            picked[f"{stat}_{name}"] = F.coalesce(F.max(F.when(flag, F.col(source))), zero)
    row = moments.agg(*[value.alias(name) for name, value in picked.items()])
    ratio = (
        F.when(F.col("n_between") == 0, F.lit(1.0))
        .when(F.col("mean_within") > 0, F.col("mean_between") / F.col("mean_within"))
        .when(F.col("mean_between") > 0, F.lit(float("inf")))
        .otherwise(F.lit(1.0))
    )
    return row.withColumn("separation_ratio", ratio)


def separation(df: DataFrame, id_col: str = "id", vec_col: str = "feature", class_col: str = "cls") -> DataFrame:
    return separation_of(pair_moments(df, id_col, vec_col, class_col))


def class_separation(df: DataFrame, id_col: str = "id", vec_col: str = "feature", class_col: str = "cls", sums: DataFrame | None = None) -> DataFrame:
    """Long report ``(metric, value)``: separation, Davies-Bouldin index and mean silhouette, from one all-pairs pass.

    ``sums`` are ``distance_sums`` of the same rows if the caller has them.
    """
    sums = written(distance_sums(df, id_col, vec_col, class_col), "distances") if sums is None else sums
    wide = separation_of(moments_of(sums))
    metrics = ["mean_within", "std_within", "mean_between", "std_between", "separation_ratio"]
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")).select("m.*")
    index = davies_bouldin(df, vec_col, class_col).select(F.lit("davies_bouldin").alias("metric"), F.col("davies_bouldin").alias("value"))
    score = _mean_silhouette(silhouettes_of(sums)).select(F.lit("silhouette").alias("metric"), F.col("silhouette").alias("value"))
    return long.unionByName(index).unionByName(score)


def class_covariance(df: DataFrame, vec_col: str = "feature", class_col: str = "cls") -> DataFrame:
    """Sample covariance per class (row-major), from centred products summed per task and then per element."""
    kind = dict(df.dtypes)[class_col]
    centers = centroids(df, vec_col, class_col)
    centred = df.join(centers, class_col).select(class_col, F.zip_with(vec_col, "centroid", lambda v, c: v - c).alias("x"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for batch in batches:
            for cls, rows in batch.groupby(class_col):
                x = stack(rows["x"])
                totals[cls] = totals.get(cls, 0.0) + x.T @ x
        if totals:
            yield pd.DataFrame({class_col: list(totals), "gram": [g.ravel() for g in totals.values()]})

    grams = centred.mapInPandas(products, f"{class_col} {kind}, gram array<double>")
    cells = grams.select(class_col, F.posexplode("gram").alias("pos", "g")).groupBy(class_col, "pos").agg(F.sum("g").alias("g"))
    packed = cells.groupBy(class_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "g"))), lambda c: c["g"]).alias("gram"))
    return centers.join(packed, class_col).select(
        class_col, "n", "centroid", F.transform("gram", lambda g: g / F.greatest(F.col("n") - 1, F.lit(1))).alias("cov")
    )


def mahalanobis_overlap(df: DataFrame, vec_col: str = "feature", class_col: str = "cls", eps: float = 1e-6) -> DataFrame:
    """Chi-square tail of the distance from class i (its covariance) to the mean of class j, for all i, j.

    The diagonal is 1; classes with fewer than two rows have overlap 0 with every class.
    """
    kind = dict(df.dtypes)[class_col]
    stats = class_covariance(df, vec_col, class_col)

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inv = []
            for n, mean, cov in zip(batch["n"], batch["centroid"], batch["cov"]):
                d = len(mean)
                inv.append(np.linalg.inv(np.asarray(cov).reshape(d, d) + eps * np.eye(d)).ravel() if n > 1 else np.zeros(d * d))
            yield pd.DataFrame({class_col: batch[class_col], "n": batch["n"], "centroid": batch["centroid"], "inv": inv})

    ready = stats.mapInPandas(invert, f"{class_col} {kind}, n long, centroid array<double>, inv array<double>")

    def one_way(left: pd.DataFrame, right: pd.DataFrame, used: np.ndarray) -> pd.DataFrame:
        mu_i, mu_j = stack(left["centroid"]), stack(right["centroid"])
        d = mu_i.shape[1]
        out = []
        for r in range(len(left)):
            delta = mu_j - mu_i[r]
            square = np.einsum("jd,de,je->j", delta, np.asarray(left["inv"].iloc[r]).reshape(d, d), delta)
            for c in np.nonzero(used[r])[0]:
                alone = left["n"].iloc[r] < 2 or right["n"].iloc[c] < 2
                out.append((left[class_col].iloc[r], right[class_col].iloc[c], 0.0 if alone else chi2_upper(float(square[c]), d)))
        return pd.DataFrame(out, columns=["i", "j", "overlap"])

    def kernel(left: pd.DataFrame, right: pd.DataFrame, keep: np.ndarray | None) -> pd.DataFrame:
        used = np.ones((len(left), len(right)), bool) if keep is None else keep
        parts = [p for p in (one_way(left, right, used), one_way(right, left, used.T)) if len(p)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["i", "j", "overlap"])

    off = map_block_pairs(ready, class_col, ["n", "centroid", "inv"], kernel, f"i {kind}, j {kind}, overlap double")
    same = stats.select(F.col(class_col).alias("i"), F.col(class_col).alias("j"), F.when(F.col("n") > 1, 1.0).otherwise(0.0).alias("overlap"))
    return off.unionByName(same)


def mean_distance_of(sums: DataFrame) -> DataFrame:
    """Mean distance of all pairs from ``distance_sums`` or ``pair_sums``."""
    return sums.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)).alias("diversity"))


def diversity(df: DataFrame, method: str = "variance", id_col: str = "id", vec_col: str = "feature") -> DataFrame:
    """Mean variance per dimension, mean pair distance, or log-determinant of the covariance; 0 below two rows."""
    if method == "variance":
        summary = Summarizer.metrics("variance", "count").summary(array_to_vector(F.col(vec_col).cast("array<double>")))
        row = df.agg(summary.alias("s")).select(vector_to_array("s.variance").alias("v"), F.col("s.count").alias("n"))
        mean = F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / F.size("v") * (F.col("n") - 1) / F.col("n")
        return row.select(F.when(F.col("n") < 2, F.lit(0.0)).otherwise(mean).alias("diversity"))
    everyone = df.withColumn("__all", F.lit(0))
    if method == "pairwise":
        return mean_distance_of(pair_sums(everyone, id_col, vec_col, "__all"))
    if method == "determinant":
        row = only_row(class_covariance(everyone, vec_col, "__all"))
        if row is None or row["n"] < 2:
            value = 0.0
        else:
            d = len(row["centroid"])
            sign, logdet = np.linalg.slogdet(np.asarray(row["cov"]).reshape(d, d) + 1e-10 * np.eye(d))
            value = float(logdet) if sign > 0 else float("-inf")
        return df.sparkSession.range(1).select(F.lit(value).alias("diversity"))
    raise ValueError(f"unknown method {method}")
