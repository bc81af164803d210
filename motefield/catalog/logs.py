"""Queries on metric logs and class prototypes, batch and stream (K1-K8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.catalog import tables as t
from motefield.catalog.registry import query, rounded
from motefield.catalog.similarity import class_affinity
from motefield.operators import metric_log as ml
from motefield.operators import prototypes as pr
from motefield.session import only_row, scratch_path
from motefield.streaming.metric_stream import epoch_metric_stream
from motefield.streaming.prototype_stream import prototype_stream, step_prototype_stream

S = t.SEED
KEYS = ("click", "error", "purchase", "signup", "view")


def _stream(spark, sf, table, schema):
    """Rows of a table as a stream. A pattern, as a stream takes no single file by its plain name; it matches a file and a folder of files alike."""
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


@query(
    "k1_epoch_metrics",
    "SELECT epoch, " + ", ".join(f"arg_max(value, step) FILTER (key = '{k}') AS {k}" for k in KEYS) + " FROM metric_log GROUP BY epoch",
    ("metric_log",),
)
def k1_epoch_metrics(spark, sf):
    return ml.epoch_metrics(t.metric_log(spark, sf))


@query(
    "k1_last_per_epoch_without_duplicates",
    """WITH l AS (SELECT epoch, step, value, CASE step % 3 WHEN 0 THEN key || '_step' WHEN 1 THEN key || '_epoch' ELSE key END AS key FROM metric_log)
       SELECT epoch, key, max(step) AS step, arg_max(value, step) AS value FROM l WHERE NOT suffix(key, '_step') AND NOT suffix(key, '_epoch') GROUP BY epoch, key""",
    ("metric_log",),
)
def k1_last_per_epoch(spark, sf):
    log = t.metric_log(spark, sf)
    named = F.when(F.col("step") % 3 == 0, F.concat("key", F.lit("_step"))).when(F.col("step") % 3 == 1, F.concat("key", F.lit("_epoch"))).otherwise(F.col("key"))
    return ml.last_per_epoch(log.withColumn("key", named))


@query(
    "k1_epoch_metrics_stream",
    "SELECT epoch, key, max(step) AS step, arg_max(value, step) AS value FROM metric_log GROUP BY epoch, key",
    ("metric_log",),
)
def k1_epoch_metrics_stream(spark, sf):
    schema = t.read(spark, sf, "events").schema
    events = _stream(spark, sf, "events", schema)
    log = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("step"), F.col("event_type").alias("key"), "value")
    return epoch_metric_stream(spark, log, scratch_path(spark, "epoch-metrics"), scratch_path(spark, "epoch-metrics-checkpoint"))


_AT = ", ".join(f"max(step) FILTER (key = '{k}') OVER w AS s_{k}" for k in KEYS)


@query(
    "k2_metric_snapshots",
    f"""WITH e AS (SELECT max(step) AS step FROM metric_log GROUP BY epoch), a AS (SELECT step, {_AT} FROM metric_log WINDOW w AS (ORDER BY step)),
        s AS (SELECT * FROM a WHERE step % 25 = 0 OR step IN (SELECT step FROM e))
        SELECT s.step, {', '.join(f'{k}.value AS {k}' for k in KEYS)} FROM s {' '.join(f'LEFT JOIN metric_log {k} ON {k}.step = s_{k}' for k in KEYS)}""",
    ("metric_log",),
)
def k2_metric_snapshots(spark, sf):
    return ml.metric_snapshots(t.metric_log(spark, sf), KEYS)


@query(
    "k3_curriculum_timeline",
    """WITH e AS (SELECT DISTINCT epoch - 19723 AS epoch FROM metric_log)
       SELECT epoch, CASE WHEN epoch < 5 THEN 0 WHEN epoch < 15 THEN 1 ELSE 2 END AS stage, CASE WHEN epoch < 5 THEN 5 - epoch WHEN epoch < 15 THEN 15 - epoch ELSE -1 END AS remaining_epochs FROM e""",
    ("metric_log",),
)
def k3_curriculum_timeline(spark, sf):
    epochs = t.metric_log(spark, sf).select((F.col("epoch") - 19723).alias("epoch")).distinct()
    return ml.curriculum_timeline(epochs, [5, 10, None]).na.fill(-1, ["remaining_epochs"])


_EMA = """r AS (SELECT label - 1 AS cls, vec_id, e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM emb WHERE label > 0),
     ema AS (SELECT cls, any_value(n) AS n, max(vec_id) AS last_order, i, sum(CASE k WHEN 1 THEN 0.3::DOUBLE ** (n - 1) ELSE 0.7 * 0.3::DOUBLE ** (n - k) END * e[i]) AS v FROM r, UNNEST(range(1, 65)) AS u(i) GROUP BY cls, i)"""


def _proto_rows(df):
    return rounded(df.select("cls", "n", "last_order", F.posexplode("prototype").alias("pos", "v")))


@query("k4_prototypes", f"WITH {_EMA} SELECT cls, n, last_order, (i - 1)::INT AS pos, round(v, 6) AS v FROM ema", ("emb",))
def k4_prototypes(spark, sf):
    return _proto_rows(pr.prototypes(t.features(spark, sf), "id"))


def _feature_stream(spark, sf):
    schema = t.read(spark, sf, "embeddings").schema
    rows = _stream(spark, sf, "embeddings", schema)
    return rows.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("step"), (F.col("label") - 1).cast("int").alias("cls"), F.col("embedding").cast("array<double>").alias("feature"))


@query("k4_prototypes_stream", f"WITH {_EMA} SELECT cls, n, last_order, (i - 1)::INT AS pos, round(v, 6) AS v FROM ema", ("emb",))
def k4_prototypes_stream(spark, sf):
    return _proto_rows(prototype_stream(spark, _feature_stream(spark, sf), "id"))


# The ordered fold as a recursive query: one row per class and rank.
_FOLD = """u AS (SELECT label - 1 AS cls, vec_id AS step, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM emb WHERE label > 0 AND vec_id >= 20),
     fold AS (SELECT cls, step, k, v AS p FROM u WHERE k = 1 UNION ALL
       SELECT cls, step, k, list_transform(q, lambda v: v / sqrt(list_dot_product(q, q))) AS p FROM (
         SELECT u.cls, u.step, u.k, list_transform(range(1, 65), lambda i: m * fold.p[i] + (1 - m) * u.v[i]) AS q
         FROM (SELECT *, CASE WHEN step < 5000 THEN 0.5 + 0.4 * step / 5000 ELSE 0.9 END::DOUBLE AS m FROM u) u JOIN fold ON u.cls = fold.cls AND u.k = fold.k + 1)),
     last AS (SELECT cls, step AS last_step, p FROM fold QUALIFY row_number() OVER (PARTITION BY cls ORDER BY k DESC) = 1)"""


def _step_rows(df):
    return rounded(df.select("cls", "last_step", F.posexplode("prototype").alias("pos", "v")))


_STEP_SQL = f"WITH {_FOLD} SELECT cls, last_step, (i - 1)::INT AS pos, round(p[i], 6) AS v FROM last, UNNEST(range(1, 65)) AS t(i)"


@query("k5_prototypes_v2", _STEP_SQL, ("emb",))
def k5_prototypes_v2(spark, sf):
    return _step_rows(pr.prototypes_v2(t.features(spark, sf), "id", "id", warmup=20))


@query("k5_prototypes_v2_stream", _STEP_SQL, ("emb",))
def k5_prototypes_v2_stream(spark, sf):
    return _step_rows(step_prototype_stream(spark, _feature_stream(spark, sf), 20))


def _weights(spark, sf, protos, by="step"):
    classes = t.features(spark, sf).select("cls").distinct()
    now = only_row(t.read(spark, sf, "embeddings").agg(F.max("vec_id").alias("m")))["m"] + 100.0
    return pr.prototype_weights(classes, protos, now, by=by)


@query("k6_prototype_weights_by_step", f"WITH {_EMA}, l AS (SELECT DISTINCT cls, last_order FROM ema) SELECT DISTINCT label - 1 AS cls, round(coalesce(exp(-0.0001 * ((SELECT max(vec_id) + 100 FROM emb) - last_order)), 0), 6) AS weight FROM emb LEFT JOIN l ON cls = label - 1", ("emb",))
def k6_prototype_weights_by_step(spark, sf):
    return rounded(_weights(spark, sf, pr.prototypes(t.features(spark, sf), "id")))


@query("k6_prototype_weights_by_time", f"WITH {_EMA}, l AS (SELECT DISTINCT cls, last_order FROM ema) SELECT DISTINCT label - 1 AS cls, round(coalesce(exp(-0.01 * ((SELECT max(vec_id) + 100 FROM emb) - last_order)), 0), 6) AS weight FROM emb LEFT JOIN l ON cls = label - 1", ("emb",))
def k6_prototype_weights_by_time(spark, sf):
    return rounded(_weights(spark, sf, pr.prototypes(t.features(spark, sf), "id"), "time"))


_SCORED = f"""{_EMA}, p AS (SELECT cls, list(v ORDER BY i) AS p, exp(-0.01 * ((SELECT max(vec_id) + 100 FROM emb) - any_value(last_order))) AS w FROM ema GROUP BY cls),
     x AS (SELECT label - 1 AS cls, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS e FROM emb WHERE label > 0),
     j AS (SELECT x.cls, list_distance(x.e, p.p) AS d, list_dot_product(x.e, p.p) AS s, w, CASE WHEN x.cls = p.cls THEN 1.0 ELSE affinity END::DOUBLE AS t
           FROM x CROSS JOIN p LEFT JOIN class_aff ON id1 = least(x.cls, p.cls) AND id2 = greatest(x.cls, p.cls))"""


def _scores(spark, sf, form):
    rows = t.features(spark, sf)
    protos = pr.prototypes(rows, "id")
    weighted = protos.join(_weights(spark, sf, protos, "time"), "cls")
    return pr.prototype_score(rows, weighted, class_affinity(spark, sf), form)


@query(
    "k7_prototype_score",
    f"WITH {_SCORED} SELECT cls, round(sum((t * d * d + (1 - t) * greatest(4 - d, 0) ** 2) * w), 6) AS loss, count(*) FILTER (w > 0.1) AS n_fresh FROM j GROUP BY cls",
    ("class_aff",),
)
def k7_prototype_score(spark, sf):
    return rounded(_scores(spark, sf, "contrastive"))


@query(
    "k7_prototype_score_cosine",
    f"WITH {_SCORED} SELECT round(coalesce(sum(abs(s - t) * w) / nullif(count(*) FILTER (w > 0.1), 0), 0), 6) AS score FROM j",
    ("class_aff",),
)
def k7_prototype_score_cosine(spark, sf):
    return rounded(pr.total_score(_scores(spark, sf, "cosine")))


def _u(parts, start=1):
    return f"('0x' || substr(md5(concat_ws('|', {parts})), {start}, 8))::UBIGINT / 4294967296.0"


@query(
    "k8_crossover",
    f"""WITH {_EMA}, p AS (SELECT cls, list(v ORDER BY i) AS p FROM ema GROUP BY cls),
        x AS (SELECT vec_id, label - 1 AS cls, e, {_u(f"vec_id, '{S}p'")} < 0.3 AND label > 0 AS crossed FROM emb),
        m AS (SELECT vec_id, i, CASE WHEN {_u(f"vec_id, i - 1, '{S}m'")} < 0.5 THEN e[i] ELSE p[i] END
              + 0.01 * sqrt(-2 * ln(1 - {_u(f"vec_id, i - 1, '{S}n'")})) * cos(2 * pi() * {_u(f"vec_id, i - 1, '{S}n'", 9)}) AS v FROM x JOIN p USING (cls), UNNEST(range(1, 65)) AS u(i) WHERE crossed),
        n AS (SELECT vec_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM m)
        SELECT vec_id AS id, cls, crossed, (u.i - 1)::INT AS pos, round(coalesce(n.v, e[u.i]), 6) AS v FROM x CROSS JOIN UNNEST(range(1, 65)) AS u(i) LEFT JOIN n USING (vec_id, i)""",
    ("emb",),
)
def k8_crossover(spark, sf):
    rows = t.features(spark, sf)
    mixed = pr.crossover(rows, pr.prototypes(rows, "id"), S)
    return rounded(mixed.select("id", "cls", "crossed", F.posexplode("feature").alias("pos", "v")))
