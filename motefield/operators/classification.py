"""Fusion of embedding sources and cross-validated classification reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.tails import t_quantile, t_two_sided
from motefield.operators.logistic import fit_all_folds
from motefield.operators.pairs import map_with_table, stack, unit_rows
from motefield.operators.ranking import rank_by_hash, rank_by_value
from motefield.session import written

# Number of folds, seed, weights of the two sources.
N_FOLDS = 10
SEED = 171717
FUSION_WEIGHTS = (0.7, 0.3)


def fuse(a: Column, b: Column, method: str = "average") -> Column:
    """One vector from two: average, concatenation or fixed weighting."""
    if method == "concat":
        return F.concat(a, b)
    wa, wb = {"average": (0.5, 0.5), "weighted": FUSION_WEIGHTS}[method]
    return F.zip_with(a, b, lambda x, y: x * wa + y * wb)


def stratified_folds(df: DataFrame, key: str, id_col: str, k: int = N_FOLDS, seed=SEED) -> DataFrame:
    """Fold of each row: rows of a class are dealt out in seeded hash order."""
    ranked = rank_by_hash(df, [key], [id_col], seed)
    return ranked.withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k)).cast("int")).drop("rn")


def fold_scalers(df: DataFrame, vec_col: str = "feature") -> DataFrame:
    """Mean and population deviation per dimension over the training rows of each fold (all other folds).

    One pass takes centred moments of each fold. They are one row for each
    fold, and a training set is put together from those of the other folds.
    """
    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.col(vec_col).cast("array<double>"))).alias("s")
    rows = df.groupBy("fold").agg(summary).select("fold", F.col("s.count").alias("n"), vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v")).collect()
    out = []
    for fold in (r["fold"] for r in rows):
        rest = [(r["n"], np.array(r["m"]), np.array(r["v"])) for r in rows if r["fold"] != fold]
        if rest:
            total = sum(n for n, _, _ in rest)
            mean = sum(n * m for n, m, _ in rest) / total
            spread = np.sqrt(sum((n - 1) * v + n * (m - mean) ** 2 for n, m, v in rest) / total)
            out.append((fold, mean.tolist(), np.where(spread > 1e-12, spread, 1.0).tolist()))
    return df.sparkSession.createDataFrame(out, f"fold {dict(df.dtypes)['fold']}, mean array<double>, std array<double>")


def scaled(vec: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(vec, mean, lambda v, m: v - m), std, lambda v, s: v / s)


def scale_test_rows(df: DataFrame, vec_col: str = "feature") -> DataFrame:
    """Test rows of each fold scaled by the training rows of that fold."""
    return df.join(fold_scalers(df, vec_col), "fold").withColumn(vec_col, scaled(F.col(vec_col), F.col("mean"), F.col("std"))).drop("mean", "std")


def fold_coefficients(df: DataFrame, vec_col: str = "feature", class_col: str = "cls", max_iter: int = 1000, c: float = 1.0) -> DataFrame:
    """``(fold, class, coefficients, intercept)`` of a multinomial logistic regression for each fold, on the rows of all others.

    Coefficients are for rows scaled by ``fold_scalers``. All folds are fitted
    together: a pass over the rows serves every fold (``logistic.fit_all_folds``).
    One row per fold and class comes to the driver.
    """
    base = written(df.select("fold", class_col, vec_col), "folds")
    labels = sorted(r[0] for r in base.select(class_col).distinct().collect())
    scalers = {r["fold"]: (np.array(r["mean"]), np.array(r["std"])) for r in fold_scalers(base, vec_col).collect()}
    folds = sorted(scalers)

    def number(names: list, col: str) -> Column:
        return (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(col)) - 1).cast("int")

    # Rows of a fold that has no other rows to learn from have no fit.
    rows = base.select(F.coalesce(number(folds, "fold"), F.lit(-1)).alias("f"), number(labels, class_col).alias("y"), F.col(vec_col).cast("array<double>").alias("x")) if folds else None
    fitted = fit_all_folds(rows, [scalers[f] for f in folds], len(labels), c, max_iter)[0] if folds else []
    out = [(f, k, w[:-1].tolist(), float(w[-1])) for f, fit in zip(folds, fitted) for k, w in zip(labels, fit)]
    types = dict(base.dtypes)
    return df.sparkSession.createDataFrame(out, f"fold {types['fold']}, class {types[class_col]}, coefficients array<double>, intercept double")


def fold_probabilities(df: DataFrame, coefficients: DataFrame, id_col: str = "id", vec_col: str = "feature", class_col: str = "cls", on: str = "test") -> DataFrame:
    """Class probabilities of the test rows (or training rows) of each fold as ``(fold, id, label, class, score, y)``.

    One row per fold and class travels to the rows as a table of weights.
    """
    weights = coefficients.join(fold_scalers(df, vec_col), "fold").groupBy("fold").agg(
        F.array_sort(F.collect_list(F.struct("class", "coefficients", "intercept"))).alias("__w"), F.first("mean").alias("__m"), F.first("std").alias("__s")
    )
    renamed = weights.withColumnRenamed("fold", "__f")
    folds = F.array(*[F.lit(r[0]) for r in coefficients.select("fold").distinct().collect()])
    fits = F.array("fold") if on == "test" else F.filter(folds, lambda f: f != F.col("fold"))
    vector = scaled(F.col(vec_col), F.col("__m"), F.col("__s"))
    rows = df.select(F.explode(fits).alias("__f"), F.col(id_col).alias("id"), F.col(class_col).alias("label"), F.col(vec_col)).join(F.broadcast(renamed), "__f").withColumn("__x", vector)
    logits = F.transform("__w", lambda w: w["intercept"] + F.aggregate(F.zip_with(w["coefficients"], F.col("__x"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    rows = rows.select(F.col("__f").alias("fold"), "id", "label", "__w", logits.alias("__z")).withColumn("__e", F.transform("__z", lambda z: F.exp(z - F.array_max("__z"))))
    total = F.aggregate("__e", F.lit(0.0), lambda a, b: a + b)
    each = F.explode(F.zip_with("__w", "__e", lambda w, e: F.struct(w["class"].alias("class"), (e / F.col("__t")).alias("score")))).alias("p")
    out = rows.withColumn("__t", total).select("fold", "id", "label", each)
    return out.select("fold", "id", "label", "p.class", "p.score", (F.col("label") == F.col("p.class")).cast("int").alias("y"))


def fit_predict_folds(df: DataFrame, id_col: str = "id", vec_col: str = "feature", class_col: str = "cls", max_iter: int = 1000, c: float = 1.0, on: str = "test") -> DataFrame:
    """Multinomial logistic regression per fold; class probabilities of the test rows (or training rows) as ``(fold, id, label, class, score, y)``."""
    base = written(df.select("fold", id_col, class_col, vec_col), "folds")
    return fold_probabilities(base, fold_coefficients(base, vec_col, class_col, max_iter, c), id_col, vec_col, class_col, on)


def stationarity(df: DataFrame, id_col: str = "id", vec_col: str = "feature", class_col: str = "cls", max_iter: int = 1000, c: float = 1.0) -> DataFrame:
    """``(fold, class, pos, residual)``: gradient of each fold's objective at its fit, summed over its training rows, by class and dimension.

    Taken from the probabilities of the training rows, not by the solver; zero at the optimum.
    """
    base = written(df.select("fold", id_col, class_col, vec_col), "folds")
    fitted = fold_coefficients(base, vec_col, class_col, max_iter, c)
    chances = fold_probabilities(base, fitted, id_col, vec_col, class_col, "train").select("fold", "id", "class", (F.col("score") - F.col("y")).alias("__r"))
    train = chances.join(base.select(F.col(id_col).alias("id"), F.col(vec_col).alias("__x")), "id").join(fold_scalers(base, vec_col), "fold")
    vectors = train.select("fold", "class", array_to_vector(F.transform(scaled(F.col("__x"), F.col("mean"), F.col("std")), lambda v: v * F.col("__r"))).alias("v"))
    sums = vectors.groupBy("fold", "class").agg(Summarizer.metrics("sum").summary(F.col("v")).alias("s")).select("fold", "class", vector_to_array("s.sum").alias("g"))
    both = sums.join(fitted, ["fold", "class"]).select("fold", "class", F.zip_with("g", "coefficients", lambda g, w: g + w / c).alias("g"))
    return both.select("fold", "class", F.posexplode("g").alias("pos", "residual"))


def centroid_scores(rows: DataFrame, centers: DataFrame, id_col: str, vec_col: str, class_col: str, dims: int | None = None) -> DataFrame:
    """Cosine of every row to every class centroid, as ``(fold, id, label, class, score, y)``."""
    types = dict(rows.dtypes)

    def kernel(left: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        cos = unit_rows(stack(left[vec_col])[:, :dims]) @ unit_rows(stack(table["centroid"])[:, :dims]).T
        n, k = cos.shape
        label, cls = np.repeat(left[class_col].to_numpy(), k), np.tile(table[class_col].to_numpy(), n)
        return pd.DataFrame({
            "fold": np.repeat(left["fold"].to_numpy(), k), "id": np.repeat(left[id_col].to_numpy(), k), "label": label, "class": cls,
            "score": np.round(cos.ravel(), 9), "y": (label == cls).astype("int32"),
        })

    schema = f"fold int, id {types[id_col]}, label {types[class_col]}, class {types[class_col]}, score double, y int"
    return map_with_table(rows.select("fold", id_col, class_col, vec_col), centers.select(class_col, "centroid"), kernel, schema, id_col=id_col, right_id=class_col)


def predictions(scores: DataFrame) -> DataFrame:
    """Best class per row; the lowest class wins a tie."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "class"))
    return scores.groupBy("fold", "id", "label").agg(best.alias("b")).select("fold", "id", "label", F.col("b.class").alias("pred"))


def fold_accuracy(preds: DataFrame) -> DataFrame:
    return preds.groupBy("fold").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def spread_over_folds(per_fold: DataFrame, col: str) -> DataFrame:
    return per_fold.agg(F.avg(col).alias(f"mean_{col}"), F.stddev_pop(col).alias(f"std_{col}"))


def average_precision(scores: DataFrame) -> DataFrame:
    """One-vs-rest average precision per (fold, class), rows with equal scores sharing a threshold.

    Rows are first merged per distinct score; the running counts then go
    through ordered buckets, so one class of one fold may be arbitrarily large.
    Classes without positives in a fold are left out.
    """
    steps = scores.groupBy("fold", "class", "score").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    run = rank_by_value(steps, ["fold", "class"], "score", descending=True, running={"tp": "pos", "seen": "n"})
    parts = run.groupBy("fold", "class").agg(F.sum("pos").alias("positives"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("area"))
    return parts.filter("positives > 0").select("fold", "class", (F.col("area") / F.col("positives")).alias("average_precision"))


def mean_average_precision(scores: DataFrame) -> DataFrame:
    return average_precision(scores).groupBy("fold").agg(F.avg("average_precision").alias("map"))


def confusion_counts(preds: DataFrame) -> DataFrame:
    """True and false positives and false negatives per (fold, class); a row counts for its own and its predicted class."""
    own = F.struct(
        F.col("label").alias("class"), (F.col("pred") == F.col("label")).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"),
        (F.col("pred") != F.col("label")).cast("long").alias("fn"),
    )
    other = F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(1).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    marks = F.when(F.col("pred") == F.col("label"), F.array(own)).otherwise(F.array(own, other))
    return preds.select("fold", F.inline(marks)).groupBy("fold", "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def per_class_metrics(scores: DataFrame) -> DataFrame:
    """Precision, recall and average precision per class, mean and deviation over the folds."""
    grid = scores.select("fold", "class").distinct()
    counts = confusion_counts(predictions(scores))

    def share(a: Column, b: Column) -> Column:
        return F.when(a + b > 0, a / (a + b)).otherwise(F.lit(0.0))

    rates = grid.join(counts, ["fold", "class"], "left").na.fill(0, ["tp", "fp", "fn"]).select(
        "fold", "class", share(F.col("tp"), F.col("fp")).alias("precision"), share(F.col("tp"), F.col("fn")).alias("recall")
    )
    joined = rates.join(average_precision(scores), ["fold", "class"], "left")
    sources = {"map": "average_precision", "precision": "precision", "recall": "recall"}
    return joined.groupBy("class").agg(*[
        F.coalesce(fn(source), F.lit(0.0)).alias(f"{stat}_{name}") for name, source in sources.items() for stat, fn in (("mean", F.avg), ("std", F.stddev_pop))
    ])


def paired_ttest(baseline: DataFrame, method: DataFrame, col: str, alpha: float = 0.05) -> DataFrame:
    """Paired t-test of two per-fold series, as one row; the closing step runs on that row."""
    pairs = baseline.select("fold", F.col(col).alias("a")).join(method.select("fold", F.col(col).alias("b")), "fold")
    diff = F.col("b") - F.col("a")
    row = pairs.agg(F.avg(diff).alias("mean_improvement"), F.stddev_samp(diff).alias("sd"), F.count(F.lit(1)).alias("n"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for mean, sd, n in zip(batch["mean_improvement"], batch["sd"], batch["n"]):
                error = sd / np.sqrt(n) if n > 1 else np.nan
                if not error > 0:
                    t = 0.0 if mean == 0 else float(np.copysign(np.inf, mean))
                    p, half = (1.0 if mean == 0 else 0.0), 0.0
                else:
                    t = mean / error
                    p, half = t_two_sided(t, n - 1), t_quantile(1 - alpha / 2, n - 1) * error
                out.append((p, t, mean, mean - half, mean + half, bool(p < alpha)))
            yield pd.DataFrame(out, columns=["p_value", "t_statistic", "mean_improvement", "ci_lower", "ci_upper", "is_significant"])

    return row.mapInPandas(close, "p_value double, t_statistic double, mean_improvement double, ci_lower double, ci_upper double, is_significant boolean")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def improvement_report(baseline: DataFrame, method: DataFrame, col: str = "map") -> DataFrame:
    """Relative improvement in percent of the baseline mean, with the significance of the paired test."""
    test = paired_ttest(baseline, method, col)
    base = baseline.agg(F.avg(col).alias("baseline_mean")).withColumn("__k", F.lit(0))
    return test.withColumn("__k", F.lit(0)).join(base, "__k").select(
        "baseline_mean", "mean_improvement", (F.col("mean_improvement") / F.col("baseline_mean") * 100).alias("improvement_pct"), "p_value", stars(F.col("p_value")).alias("stars")
    )


def class_improvement(baseline: DataFrame, method: DataFrame, col: str = "mean_map") -> DataFrame:
    """Change of a per-class metric."""
    a, b = baseline.select("class", F.col(col).alias("baseline")), method.select("class", F.col(col).alias("method"))
    return a.join(b, "class").withColumn("improvement", F.col("method") - F.col("baseline"))


def cross_validate(df: DataFrame, methods: dict[str, Column], key: str, id_col: str, k: int = N_FOLDS, seed=SEED, max_iter: int = 100) -> DataFrame:
    """Test scores of several feature columns over the same folds, as ``(method, fold, id, label, class, score, y)``."""
    folds = stratified_folds(df, key, id_col, k, seed)
    out = None
    for name, column in methods.items():
        rows = folds.select("fold", F.col(id_col).alias("id"), F.col(key).alias("cls"), column.alias("feature"))
        part = fit_predict_folds(rows, max_iter=max_iter).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out

