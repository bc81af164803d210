"""Queries on embedding spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.catalog import tables as t
from motefield.catalog.registry import query, rounded
from motefield.functions.vectors import latent_kl
from motefield.operators import embeddings as ops

_DBI = """spread AS (SELECT emb.label, avg(list_distance(e, c)) AS s FROM emb JOIN centers USING (label) GROUP BY emb.label),
     worst AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS r FROM centers a JOIN centers b ON a.label <> b.label
               JOIN spread sa ON sa.label = a.label JOIN spread sb ON sb.label = b.label GROUP BY a.label)"""
_PAIRS = "d AS (SELECT a.label = b.label AS same, list_distance(a.e, b.e) AS d FROM emb a JOIN emb b ON a.vec_id < b.vec_id)"
_SILHOUETTE = """m AS (SELECT a.vec_id AS id, a.label AS own, b.label AS other, avg(list_distance(a.e, b.e)) AS d FROM emb a JOIN emb b ON a.vec_id <> b.vec_id GROUP BY ALL),
     ab AS (SELECT id, own, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM m GROUP BY id, own),
     sil AS (SELECT id, own - 1 AS cls, a, b, coalesce((b - a) / greatest(a, b), 0) AS silhouette FROM ab)"""
_SEPARATION = """w AS (SELECT avg(d) FILTER (same) AS mean_within, stddev_pop(d) FILTER (same) AS std_within, count(*) FILTER (same) AS n_within,
            avg(d) FILTER (NOT same) AS mean_between, stddev_pop(d) FILTER (NOT same) AS std_between, count(*) FILTER (NOT same) AS n_between FROM d)"""


@query("g1_davies_bouldin", f"WITH {_DBI} SELECT round(avg(r), 6) AS davies_bouldin FROM worst", ("centers",))
def g1_davies_bouldin(spark, sf):
    return rounded(ops.davies_bouldin(t.features(spark, sf)))


@query("g1_class_centroids", "SELECT label - 1 AS cls, (i - 1)::INT AS dim, round(c[i], 6) AS value FROM centers, UNNEST(range(1, 65)) AS r(i)", ("centers",))
def g1_class_centroids(spark, sf):
    return rounded(ops.centroids(t.features(spark, sf)).select("cls", F.posexplode("centroid").alias("dim", "value")))


@query(
    "g2_silhouette_samples",
    f"WITH {_SILHOUETTE} SELECT id, cls, round(a, 6) AS a, round(b, 6) AS b, round(silhouette, 6) AS silhouette FROM sil",
    ("emb",),
)
def g2_silhouette_samples(spark, sf):
    return rounded(ops.silhouette_samples(t.features(spark, sf)))


@query("g2_silhouette", f"WITH {_SILHOUETTE} SELECT round(avg(silhouette), 6) AS silhouette FROM sil", ("emb",))
def g2_silhouette(spark, sf):
    return rounded(ops.silhouette(t.features(spark, sf)))


@query(
    "g2_silhouette_cosine",
    f"WITH {_SILHOUETTE.replace('list_distance', 'list_cosine_distance')} SELECT round(avg(silhouette), 6) AS silhouette FROM sil",
    ("emb",),
)
def g2_silhouette_cosine(spark, sf):
    return rounded(ops.silhouette(t.features(spark, sf), "cosine"))


@query(
    "g3_separation",
    f"""WITH {_PAIRS}, {_SEPARATION} SELECT round(mean_within, 6) AS mean_within, round(std_within, 6) AS std_within, n_within,
        round(mean_between, 6) AS mean_between, round(std_between, 6) AS std_between, n_between, round(mean_between / mean_within, 6) AS separation_ratio FROM w""",
    ("emb",),
)
def g3_separation(spark, sf):
    return rounded(ops.separation(t.features(spark, sf)))


CLASS_SEPARATION_SQL = f"""WITH {_PAIRS}, {_SEPARATION}, {_DBI}, {_SILHOUETTE}
    SELECT 'mean_within' AS metric, round(mean_within, 6) AS value FROM w UNION ALL SELECT 'std_within', round(std_within, 6) FROM w
    UNION ALL SELECT 'mean_between', round(mean_between, 6) FROM w UNION ALL SELECT 'std_between', round(std_between, 6) FROM w
    UNION ALL SELECT 'separation_ratio', round(mean_between / mean_within, 6) FROM w
    UNION ALL SELECT 'davies_bouldin', round(avg(r), 6) FROM worst UNION ALL SELECT 'silhouette', round(avg(silhouette), 6) FROM sil"""


@query("g3_class_separation", CLASS_SEPARATION_SQL, ("centers",))
def g3_class_separation(spark, sf):
    return rounded(ops.class_separation(t.features(spark, sf)))


# d' A^-1 d by elimination, all classes j at once: of [[A, D], [D', 0]] the negative of D' A^-1 D is left after removing all
# rows of A. The chi-square tail of 64 dimensions is a finite sum.
_OVERLAP = """cov AS MATERIALIZED (SELECT label, i, j, covar_samp(e[i], e[j]) + CASE WHEN i = j THEN 1e-6 ELSE 0 END AS c FROM emb, UNNEST(range(1, 65)) AS r(i), UNNEST(range(1, 65)) AS s(j) GROUP BY label, i, j),
     cov_rows AS (SELECT label, i, list(c ORDER BY j) AS r FROM cov GROUP BY label, i),
     delta AS (SELECT a.label AS i, b.label AS j, list_transform(list_zip(a.c, b.c), lambda t: t[2] - t[1]) AS d FROM centers a JOIN centers b ON a.label <> b.label),
     deltas AS MATERIALIZED (SELECT i, list(j ORDER BY j) AS js, list(d ORDER BY j) AS ds FROM delta GROUP BY i),
     upper_rows AS (SELECT label AS cls, cov_rows.i AS k, list_concat(r, list_transform(ds, lambda d: d[cov_rows.i])) AS r FROM cov_rows JOIN deltas ON deltas.i = label),
     start AS (SELECT cls AS i, any_value(js) AS js, list_concat(list(r ORDER BY k), any_value(list_transform(ds, lambda d: list_concat(d, list_transform(ds, lambda x: 0.0::DOUBLE))))) AS m
               FROM upper_rows JOIN deltas ON deltas.i = cls GROUP BY cls),
     steps AS (SELECT i, js, m, 0 AS n FROM start UNION ALL
       SELECT i, js, list_transform(rest, lambda r: list_transform(list_zip(r[2:], first_row), lambda t: t[1] - r[1] * t[2] / first_cell)), n + 1
       FROM (SELECT i, js, m[2:] AS rest, m[1][2:] AS first_row, m[1][1] AS first_cell, n FROM steps WHERE n < 64)),
     half AS (SELECT i, js[k] AS j, -m[k][k] / 2 AS h FROM steps, UNNEST(range(1, len(js) + 1)) AS u(k) WHERE n = 64),
     tail AS (SELECT i, j, CASE WHEN h > 700 THEN 0 ELSE least(exp(-h) * list_sum(list_transform(range(0, 32), lambda k: h ** k / factorial(k::INT))), 1) END AS overlap FROM half)"""


@query(
    "g4_mahalanobis_overlap",
    f"WITH {_OVERLAP} SELECT i - 1 AS i, j - 1 AS j, round(overlap, 6) AS overlap FROM tail UNION ALL SELECT label - 1, label - 1, 1.0 FROM centers",
    ("centers",),
)
def g4_mahalanobis_overlap(spark, sf):
    return rounded(ops.mahalanobis_overlap(t.features(spark, sf)))


@query(
    "g4_class_covariance",
    """SELECT a.label - 1 AS cls, ((i - 1) * 64 + j - 1)::INT AS pos, round(covar_samp(a.e[i], a.e[j]), 6) AS cov
       FROM emb a, UNNEST(range(1, 65)) AS r(i), UNNEST(range(1, 65)) AS s(j) GROUP BY 1, 2""",
    ("emb",),
)
def g4_class_covariance(spark, sf):
    return rounded(ops.class_covariance(t.features(spark, sf)).select("cls", F.posexplode("cov").alias("pos", "cov")))


@query(
    "g5_diversity_variance",
    "SELECT round(avg(v), 6) AS diversity FROM (SELECT i, var_pop(e[i]) AS v FROM emb, UNNEST(range(1, 65)) AS r(i) GROUP BY i)",
    ("emb",),
)
def g5_diversity_variance(spark, sf):
    return rounded(ops.diversity(t.features(spark, sf), "variance"))


@query("g5_diversity_pairwise", f"WITH {_PAIRS} SELECT round(avg(d), 6) AS diversity FROM d", ("emb",))
def g5_diversity_pairwise(spark, sf):
    return rounded(ops.diversity(t.features(spark, sf), "pairwise"))


@query(
    "g5_diversity_determinant",
    """WITH cov AS (SELECT i, j, covar_samp(e[i], e[j]) + CASE WHEN i = j THEN 1e-10 ELSE 0 END AS c FROM emb, UNNEST(range(1, 65)) AS r(i), UNNEST(range(1, 65)) AS s(j) GROUP BY i, j),
       rows_ AS (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i),
       steps AS (SELECT list(r ORDER BY i) AS m, 0.0::DOUBLE AS logdet, 0 AS n FROM rows_ UNION ALL
         SELECT list_transform(m[2:], lambda r: list_transform(range(2, len(r) + 1), lambda k: r[k] - r[1] * m[1][k] / m[1][1])), logdet + ln(m[1][1]), n + 1 FROM steps WHERE n < 64)
       SELECT round(logdet, 6) AS diversity FROM steps WHERE n = 64""",
    ("emb",),
)
def g5_diversity_determinant(spark, sf):
    return rounded(ops.diversity(t.features(spark, sf), "determinant"))


@query(
    "g7_latent_kl",
    """SELECT vec_id, round(-0.5 * list_sum(list_transform(range(1, 33), lambda i: 1 + e[i + 32] - e[i] * e[i] - exp(e[i + 32]))), 6) AS kl FROM emb""",
    ("emb",),
)
def g7_latent_kl(spark, sf):
    return rounded(t.emb(spark, sf).select("vec_id", latent_kl(F.slice("e", 1, 32), F.slice("e", 33, 32)).alias("kl")))


@query(
    "g7_mean_latent_kl",
    """SELECT round(avg(-0.5 * list_sum(list_transform(range(1, 33), lambda i: 1 + e[i + 32] - e[i] * e[i] - exp(e[i + 32])))), 6) AS mean_kl FROM emb""",
    ("emb",),
)
def g7_mean_latent_kl(spark, sf):
    return rounded(t.emb(spark, sf).agg(F.avg(latent_kl(F.slice("e", 1, 32), F.slice("e", 33, 32))).alias("mean_kl")))
