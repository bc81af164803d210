"""Queries on samples and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.catalog import tables as t
from motefield.catalog.registry import query, rounded
from motefield.operators import sampling as ops

S = t.SEED


@query("d1_cap_per_group", "SELECT structure, run, pick_id FROM picks QUALIFY row_number() OVER (PARTITION BY run, structure ORDER BY pick_id) <= 15", ("picks",))
def d1_cap_per_group(spark, sf):
    return ops.cap_per_group(t.picks(spark, sf), ["run", "structure"], [F.col("pick_id")], 15).select("structure", "run", "pick_id")


@query(
    "d2_even_sample",
    """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
            w AS (SELECT DISTINCT event_type, k * (n - 1) // 36 AS i FROM r, UNNEST(range(37)) AS u(k))
       SELECT event_type, event_id FROM r SEMI JOIN w USING (event_type, i)""",
)
def d2_even_sample(spark, sf):
    return ops.even_sample(t.read(spark, sf, "events").select("event_type", "event_id"), ["event_type"], "event_id", 37)


@query(
    "d2_even_sample_string_ids",
    """WITH e AS (SELECT event_type, 'p' || event_id AS id FROM events),
            r AS (SELECT event_type, id, row_number() OVER (PARTITION BY event_type ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e),
            w AS (SELECT DISTINCT event_type, k * (n - 1) // 36 AS i FROM r, UNNEST(range(37)) AS u(k))
       SELECT event_type, id FROM r SEMI JOIN w USING (event_type, i)""",
)
def d2_even_sample_string_ids(spark, sf):
    rows = t.read(spark, sf, "events").select("event_type", F.concat(F.lit("p"), "event_id").alias("id"))
    return ops.even_sample(rows, ["event_type"], "id", 37)


@query(
    "d3_balance",
    f"""WITH n AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM documents GROUP BY lang))
        SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', doc_id, {S})), doc_id) <= (SELECT c FROM n)""",
)
def d3_balance(spark, sf):
    return ops.balance(t.read(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", S)


STAGE_SPANS = """spans AS (SELECT stage, any_value(duration) AS duration FROM stages GROUP BY stage),
     ranges AS (SELECT stage, coalesce(sum(duration) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_epoch, duration FROM spans)"""


@query(
    "d4_stage_table",
    """WITH spans AS (SELECT snr::INT AS stage, count(*) % 7 + 1 AS duration FROM particles GROUP BY 1)
       SELECT stage, coalesce(sum(duration) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_epoch,
              sum(duration) OVER (ORDER BY stage)::BIGINT AS end_epoch FROM spans""",
    ("particles",),
)
def d4_stage_table(spark, sf):
    sources = t.particles(spark, sf).groupBy(F.col("snr").cast("int").alias("stage"))
    return ops.stage_table(sources.agg((F.count(F.lit(1)) % 7 + 1).alias("duration")))


@query(
    "d4_stage_at_epoch",
    f"""WITH {STAGE_SPANS}, e AS (SELECT event_id, (epoch - 19723) AS epoch FROM (SELECT step AS event_id, epoch FROM metric_log))
        SELECT event_id, epoch, stage FROM e JOIN ranges ON epoch >= start_epoch AND (duration IS NULL OR epoch < start_epoch + duration)""",
    ("stages", "metric_log"),
)
def d4_stage_at_epoch(spark, sf):
    log = t.metric_log(spark, sf).select(F.col("step").alias("event_id"), (F.col("epoch") - 19723).alias("epoch"))
    return log.withColumn("stage", ops.stage_of(F.col("epoch"), [5, 10, None]))


def _samples(spark, sf):
    return t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(":", "source", "lang").alias("sample_id"))


def _weights(spark, stage=1):
    return t.stages(spark).filter(F.col("stage") == stage).select("sample_id", "weight")


_QUOTA = """s AS (SELECT doc_id AS id, source || ':' || lang AS sample_id FROM documents),
     w AS (SELECT sample_id, weight FROM stages WHERE stage = 1),
     q AS (SELECT sample_id, count(*) AS class_size, any_value(weight) AS weight FROM s JOIN w USING (sample_id) GROUP BY sample_id)"""


@query(
    "d5_sample_weights",
    f"WITH {_QUOTA} SELECT id, sample_id, round(coalesce(weight / class_size / (SELECT sum(weight) FROM q), 0), 9) AS sample_weight FROM s LEFT JOIN q USING (sample_id)",
    ("stages",),
)
def d5_sample_weights(spark, sf):
    return rounded(ops.sample_weights(_samples(spark, sf), _weights(spark)), 9)


_EPOCH = f"""{_QUOTA}, b AS (SELECT *, floor(weight / (SELECT sum(weight) FROM w) * 997)::BIGINT AS base FROM q),
     c AS (SELECT *, (997 - (SELECT sum(base) FROM b)) * weight / (SELECT sum(weight) FROM b) AS share FROM b),
     f AS (SELECT sample_id, class_size, base + floor(share)::BIGINT AS base, round(share - floor(share), 9) AS fraction FROM c),
     quota AS (SELECT sample_id, class_size, (base + CASE WHEN row_number() OVER (ORDER BY fraction DESC, sample_id) <= 997 - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END)::BIGINT AS quota FROM f)"""


@query("d6_epoch_quota", f"WITH {_EPOCH} SELECT * FROM quota", ("stages",))
def d6_epoch_quota(spark, sf):
    return ops.epoch_quota(_samples(spark, sf), _weights(spark), 997)


@query(
    "d6_epoch_sample",
    f"""WITH {_EPOCH}, r AS (SELECT id, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY id) AS rn FROM s),
        d AS (SELECT sample_id, class_size, UNNEST(range(1, quota + 1)) AS draw FROM quota),
        p AS (SELECT sample_id, draw, floor(('0x' || substr(md5(concat_ws('|', sample_id, draw, {S})), 1, 8))::UBIGINT / 4294967296.0 * class_size)::BIGINT + 1 AS rn FROM d)
        SELECT sample_id, draw, id, md5(concat_ws('|', sample_id, draw, '{S}s')) AS shuffle_key FROM p JOIN r USING (sample_id, rn)""",
    ("stages",),
)
def d6_epoch_sample(spark, sf):
    return ops.epoch_sample(_samples(spark, sf), _weights(spark), 997, S)


@query(
    "d6_epoch_sample_string_ids",
    f"""WITH {_EPOCH}, r AS (SELECT 'p' || id AS id, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY 'p' || id) AS rn FROM s),
        d AS (SELECT sample_id, class_size, UNNEST(range(1, quota + 1)) AS draw FROM quota),
        p AS (SELECT sample_id, draw, floor(('0x' || substr(md5(concat_ws('|', sample_id, draw, {S})), 1, 8))::UBIGINT / 4294967296.0 * class_size)::BIGINT + 1 AS rn FROM d)
        SELECT sample_id, draw, id, md5(concat_ws('|', sample_id, draw, '{S}s')) AS shuffle_key FROM p JOIN r USING (sample_id, rn)""",
    ("stages",),
)
def d6_epoch_sample_string_ids(spark, sf):
    return ops.epoch_sample(_samples(spark, sf).withColumn("id", F.concat(F.lit("p"), "id")), _weights(spark), 997, S)


@query(
    "d7_panel_sample",
    f"""WITH g AS (SELECT doc_id AS id, source, lang, count(*) OVER (PARTITION BY source, lang) AS n FROM documents),
        big AS (SELECT source, lang, id FROM g WHERE n >= 6 QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY md5(concat_ws('|', id, {S})), id) <= 6),
        small AS (SELECT source, lang, id, n, row_number() OVER (PARTITION BY source, lang ORDER BY id) AS rn FROM g WHERE n < 6),
        d AS (SELECT source, lang, draw, floor(('0x' || substr(md5(concat_ws('|', source, lang, draw, {S})), 1, 8))::UBIGINT / 4294967296.0 * n)::BIGINT + 1 AS rn
              FROM (SELECT DISTINCT source, lang, n FROM small), UNNEST(range(1, 7)) AS u(draw))
        SELECT source, lang, id FROM big UNION ALL SELECT source, lang, id FROM d JOIN small USING (source, lang, rn)""",
)
def d7_panel_sample(spark, sf):
    docs = t.read(spark, sf, "documents").select("source", "lang", F.col("doc_id").alias("id"))
    return ops.panel_sample(docs, ["source", "lang"], "id", 6, S)


@query(
    "d8_sample_groups",
    f"""WITH c AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5(concat_ws('|', source, {S})), source LIMIT 6)
        SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM c)""",
)
def d8_sample_groups(spark, sf):
    return ops.sample_groups(t.read(spark, sf, "documents").select("doc_id", "source"), "source", 6, S)


@query(
    "d8_first_and_random_groups",
    f"""WITH n AS (SELECT DISTINCT source FROM documents), h AS (SELECT source FROM n ORDER BY source LIMIT 4),
        r AS (SELECT source FROM n WHERE source NOT IN (SELECT source FROM h) ORDER BY md5(concat_ws('|', source, {S})), source LIMIT 6)
        SELECT source, 'first' AS part FROM h UNION ALL SELECT source, 'random' FROM r""",
)
def d8_first_and_random_groups(spark, sf):
    return ops.first_and_random_groups(t.read(spark, sf, "documents"), "source", 4, 6, S)


@query(
    "d9_sample_files",
    f"SELECT molecule_id, source_type FROM (SELECT DISTINCT molecule_id, source_type FROM particles) QUALIFY row_number() OVER (PARTITION BY molecule_id ORDER BY md5(concat_ws('|', source_type, {S})), source_type) = 1",
    ("particles",),
)
def d9_sample_files(spark, sf):
    return ops.sample_files(t.particles(spark, sf), "molecule_id", "source_type", S)


@query(
    "d10_mix_background",
    f"""WITH pool AS (SELECT doc_id AS source_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE lang = 'de'),
        u AS (SELECT doc_id AS id, n_chars % 5 AS cls, ('0x' || substr(md5(concat_ws('|', doc_id, {S})), 1, 8))::UBIGINT / 4294967296.0 AS u,
              floor(('0x' || substr(md5(concat_ws('|', doc_id, '{S}b')), 1, 8))::UBIGINT / 4294967296.0 * (SELECT count(*) FROM pool))::BIGINT + 1 AS rn FROM documents WHERE lang <> 'de')
        SELECT id, cls, id AS source_id FROM u WHERE u >= 0.2 UNION ALL SELECT id, -1, source_id FROM u JOIN pool USING (rn) WHERE u < 0.2""",
)
def d10_mix_background(spark, sf):
    docs = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 5).alias("cls"), "lang")
    return ops.mix_background(docs.filter("lang <> 'de'"), docs.filter("lang = 'de'"), 0.2, S)


@query(
    "d10_mix_background_string_ids",
    f"""WITH docs AS (SELECT 'p' || doc_id AS doc_id, n_chars, lang FROM documents),
        pool AS (SELECT doc_id AS source_id, row_number() OVER (ORDER BY doc_id) AS rn FROM docs WHERE lang = 'de'),
        u AS (SELECT doc_id AS id, n_chars % 5 AS cls, ('0x' || substr(md5(concat_ws('|', doc_id, {S})), 1, 8))::UBIGINT / 4294967296.0 AS u,
              floor(('0x' || substr(md5(concat_ws('|', doc_id, '{S}b')), 1, 8))::UBIGINT / 4294967296.0 * (SELECT count(*) FROM pool))::BIGINT + 1 AS rn FROM docs WHERE lang <> 'de')
        SELECT id, cls, id AS source_id FROM u WHERE u >= 0.2 UNION ALL SELECT id, -1, source_id FROM u JOIN pool USING (rn) WHERE u < 0.2""",
)
def d10_mix_background_string_ids(spark, sf):
    docs = t.read(spark, sf, "documents").select(F.concat(F.lit("p"), "doc_id").alias("id"), (F.col("n_chars") % 5).alias("cls"), "lang")
    return ops.mix_background(docs.filter("lang <> 'de'"), docs.filter("lang = 'de'"), 0.2, S)


@query("d11_sample_n", f"SELECT event_id, event_type FROM events ORDER BY md5(concat_ws('|', event_id, {S})), event_id LIMIT 500")
def d11_sample_n(spark, sf):
    return ops.sample_n(t.read(spark, sf, "events").select("event_id", "event_type"), "event_id", 500, S).orderBy("event_id")
