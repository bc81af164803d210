"""Queries on fused embeddings and classification reports (H1-H9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.catalog import tables as t
from motefield.catalog.joins import ALIGN_SQL, aligned
from motefield.catalog.registry import query, rounded
from motefield.operators import classification as ops


def _fused(spark, sf, method):
    df = aligned(spark, sf)
    return rounded(df.select("label", "pair_rank", F.posexplode(ops.fuse(F.col("a"), F.col("b"), method)).alias("pos", "v")))


_ALIGNED = f"WITH {ALIGN_SQL}, p AS (SELECT label, pair_rank, a, b FROM a JOIN b USING (label, pair_rank))"


@query("h1_fuse_average", f"{_ALIGNED} SELECT label, pair_rank, (i - 1)::INT AS pos, round((a[i] + b[i]) / 2, 6) AS v FROM p, UNNEST(range(1, 33)) AS u(i)", ("emb",))
def h1_fuse_average(spark, sf):
    return _fused(spark, sf, "average")


@query("h1_fuse_concat", f"{_ALIGNED} SELECT label, pair_rank, (i - 1)::INT AS pos, round(list_concat(a, b)[i], 6) AS v FROM p, UNNEST(range(1, 65)) AS u(i)", ("emb",))
def h1_fuse_concat(spark, sf):
    return _fused(spark, sf, "concat")


@query("h1_fuse_weighted", f"{_ALIGNED} SELECT label, pair_rank, (i - 1)::INT AS pos, round(0.7 * a[i] + 0.3 * b[i], 6) AS v FROM p, UNNEST(range(1, 33)) AS u(i)", ("emb",))
def h1_fuse_weighted(spark, sf):
    return _fused(spark, sf, "weighted")


@query("h2_stratified_folds", "SELECT vec_id, label, fold FROM folds", ("folds",))
def h2_stratified_folds(spark, sf):
    return ops.stratified_folds(t.emb(spark, sf), "label", "vec_id", t.FOLDS, t.SEED).select("vec_id", "label", "fold")


@query(
    "h3_scale_by_fold",
    """WITH x AS MATERIALIZED (SELECT fold, vec_id, i, e[i] AS v FROM folds, UNNEST(range(1, 65)) AS u(i)),
       own AS MATERIALIZED (SELECT fold, i, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY fold, i),
       rest AS (SELECT fold, i, sum(n) OVER w - n AS n, sum(s) OVER w - s AS s, sum(q) OVER w - q AS q FROM own WINDOW w AS (PARTITION BY i)),
       scale AS MATERIALIZED (SELECT fold, i, s / n AS m, sqrt(q / n - (s / n) ** 2) AS sd FROM rest)
       SELECT x.fold, vec_id, (x.i - 1)::INT AS pos, round((v - m) / sd, 6) AS v FROM x JOIN scale ON x.fold = scale.fold AND x.i = scale.i""",
    ("folds",),
)
def h3_scale_by_fold(spark, sf):
    scaled = ops.scale_test_rows(t.folds(spark, sf), "e")
    return rounded(scaled.select("fold", "vec_id", F.posexplode("e").alias("pos", "v")))


@query("h4_fit_predict_folds")
def h4_fit_predict_folds(spark, sf):
    rows = t.folds(spark, sf).select("fold", F.col("vec_id").alias("id"), F.col("label").alias("cls"), F.col("e").alias("feature"))
    return rounded(ops.fit_predict_folds(rows), 4)


@query("h4_calibration", "SELECT f.fold, label AS class, count(*)::DOUBLE AS expected FROM folds x, (SELECT DISTINCT fold FROM folds) f WHERE x.fold <> f.fold GROUP BY ALL", ("folds",))
def h4_calibration(spark, sf):
    """At the optimum the probabilities of a class over the training rows add up to its rows, as the intercept is free."""
    rows = t.folds(spark, sf).select("fold", F.col("vec_id").alias("id"), F.col("label").alias("cls"), F.col("e").alias("feature"))
    fitted = ops.fit_predict_folds(rows, on="train")
    return fitted.groupBy("fold", "class").agg(F.round(F.sum("score"), 1).alias("expected"))


@query(
    "h4_stationarity",
    """SELECT f.fold, c.label AS class, (i - 1)::INT AS pos, 0.0::DOUBLE AS residual FROM (SELECT DISTINCT fold FROM folds) f, (SELECT DISTINCT label FROM folds) c, UNNEST(range(1, 65)) AS u(i)""",
    ("folds",),
)
def h4_stationarity(spark, sf):
    """At the optimum of every fold the gradient of its objective is zero for each class and dimension."""
    rows = t.folds(spark, sf).select("fold", F.col("vec_id").alias("id"), F.col("label").alias("cls"), F.col("e").alias("feature"))
    return ops.stationarity(rows).withColumn("residual", F.round("residual", 2) + 0.0)


_PRED = "pred AS (SELECT fold, id, label, class AS pred FROM scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, class) = 1)"
_ACC = f"{_PRED}, acc AS (SELECT fold, avg((pred = label)::INT) AS accuracy FROM pred GROUP BY fold)"


@query("h5_fold_accuracy", f"WITH {_ACC} SELECT fold, round(accuracy, 6) AS accuracy FROM acc", ("scores",))
def h5_fold_accuracy(spark, sf):
    return rounded(ops.fold_accuracy(ops.predictions(t.scores(spark, sf))))


@query("h5_accuracy_summary", f"WITH {_ACC} SELECT round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy FROM acc", ("scores",))
def h5_accuracy_summary(spark, sf):
    return rounded(ops.spread_over_folds(ops.fold_accuracy(ops.predictions(t.scores(spark, sf))), "accuracy"))


def _ap(source, name="ap"):
    return f"""{name}_steps AS (SELECT fold, class, score, sum(y) AS pos, count(*) AS n FROM {source} GROUP BY ALL),
     {name}_run AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM {name}_steps WINDOW w AS (PARTITION BY fold, class ORDER BY score DESC)),
     {name} AS (SELECT fold, class, sum(pos * tp / seen) / sum(pos) AS ap FROM {name}_run GROUP BY ALL HAVING sum(pos) > 0)"""


def _map(source, name):
    return f"{_ap(source, name)}, {name}_map AS (SELECT fold, avg(ap) AS map FROM {name} GROUP BY fold)"


@query("h6_average_precision", f"WITH {_ap('scores')} SELECT fold, class, round(ap, 6) AS average_precision FROM ap", ("scores",))
def h6_average_precision(spark, sf):
    return rounded(ops.average_precision(t.scores(spark, sf)))


@query("h6_mean_average_precision", f"WITH {_map('scores', 'ap')} SELECT fold, round(map, 6) AS map FROM ap_map", ("scores",))
def h6_mean_average_precision(spark, sf):
    return rounded(ops.mean_average_precision(t.scores(spark, sf)))


def _classes(source, name):
    return f"""{name}_pred AS (SELECT fold, id, label, class AS pred FROM {source} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, class) = 1),
     {name}_c AS (SELECT g.fold, g.class, count(*) FILTER (pred = class AND label = class) AS tp, count(*) FILTER (pred = class AND label <> class) AS fp, count(*) FILTER (pred <> class AND label = class) AS fn
           FROM (SELECT DISTINCT fold, class FROM {source}) g JOIN {name}_pred USING (fold) GROUP BY ALL),
     {_ap(source, name)},
     {name}_r AS (SELECT class, coalesce(avg(ap), 0) AS mean_map, coalesce(stddev_pop(ap), 0) AS std_map, avg(p) AS mean_precision, stddev_pop(p) AS std_precision, avg(r) AS mean_recall, stddev_pop(r) AS std_recall
           FROM (SELECT fold, class, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM {name}_c) LEFT JOIN {name} USING (fold, class) GROUP BY class)"""


@query(
    "h7_per_class_metrics",
    f"""WITH {_classes('scores', 'k')} SELECT class, round(mean_map, 6) AS mean_map, round(std_map, 6) AS std_map, round(mean_precision, 6) AS mean_precision, round(std_precision, 6) AS std_precision,
        round(mean_recall, 6) AS mean_recall, round(std_recall, 6) AS std_recall FROM k_r""",
    ("scores",),
)
def h7_per_class_metrics(spark, sf):
    return rounded(ops.per_class_metrics(t.scores(spark, sf)))


# Closed form of the t distribution with four degrees of freedom (five folds) and its 97.5 % quantile.
_TTEST = f"""{_map('scores_half', 'h')}, {_map('scores', 'f')},
     d AS (SELECT avg(f.map - h.map) AS m, stddev_samp(f.map - h.map) / sqrt(count(*)) AS se, avg(h.map) AS base FROM f_map f JOIN h_map h USING (fold)),
     tt AS (SELECT m, se, base, m / se AS t, 1 - 2 * (3.0 / 8 * abs(m / se) / sqrt(1 + (m / se) ** 2 / 4) * (1 - (m / se) ** 2 / (1 + (m / se) ** 2 / 4) / 12)) AS p FROM d)"""


def _two_maps(spark, sf):
    return ops.mean_average_precision(t.scores(spark, sf, 32)), ops.mean_average_precision(t.scores(spark, sf))


@query(
    "h8_paired_ttest",
    f"""WITH {_TTEST} SELECT round(p, 6) AS p_value, round(t, 6) AS t_statistic, round(m, 6) AS mean_improvement, round(m - 2.7764451051977987 * se, 6) AS ci_lower,
        round(m + 2.7764451051977987 * se, 6) AS ci_upper, p < 0.05 AS is_significant FROM tt""",
    ("scores", "scores_half"),
)
def h8_paired_ttest(spark, sf):
    return rounded(ops.paired_ttest(*_two_maps(spark, sf), "map"))


@query(
    "h9_improvement_report",
    f"""WITH {_TTEST} SELECT round(base, 6) AS baseline_mean, round(m, 6) AS mean_improvement, round(m / base * 100, 6) AS improvement_pct, round(p, 6) AS p_value,
        CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM tt""",
    ("scores", "scores_half"),
)
def h9_improvement_report(spark, sf):
    return rounded(ops.improvement_report(*_two_maps(spark, sf)))


@query(
    "h9_class_improvement",
    f"""WITH {_classes('scores_half', 'a')}, {_classes('scores', 'b')} SELECT class, round(a_r.mean_map, 6) AS baseline, round(b_r.mean_map, 6) AS method, round(b_r.mean_map - a_r.mean_map, 6) AS improvement
        FROM a_r JOIN b_r USING (class)""",
    ("scores", "scores_half"),
)
def h9_class_improvement(spark, sf):
    return rounded(ops.class_improvement(ops.per_class_metrics(t.scores(spark, sf, 32)), ops.per_class_metrics(t.scores(spark, sf))))
