"""Queries on particle tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.catalog import tables as t
from motefield.catalog.registry import query, rounded
from motefield.functions import labels
from motefield.functions import vectors as v
from motefield.operators import clean as ops


def _with_edges(spark, sf):
    """Volumes in which some labels carry broken rows."""
    return t.volumes4(spark, sf).select(
        "vol", "label", F.when(F.col("label") != 8, F.col("data")).alias("data"),
        F.when(F.col("label") == 9, F.array(F.lit(4), F.lit(4), F.lit(5))).when(F.col("label") != 7, F.col("shape")).alias("shape"),
    )


@query(
    "b1_reject_counts",
    """SELECT CASE label WHEN 7 THEN 'bad_shape' WHEN 8 THEN 'missing_data' ELSE 'length_mismatch' END AS reason, count(*) AS n
       FROM embeddings WHERE label IN (7, 8, 9) GROUP BY 1""",
)
def b1_reject_counts(spark, sf):
    return ops.validate(_with_edges(spark, sf))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("b1_valid_volumes", "SELECT vec_id AS vol, round(list_sum(e), 6) AS total FROM emb WHERE label < 7", ("emb",))
def b1_valid_volumes(spark, sf):
    good = ops.validate(_with_edges(spark, sf))[0]
    return rounded(good.select("vol", v.total(F.col("data")).alias("total")))


@query("b2_decode_volumes", "SELECT vec_id AS vol, (i - 1)::INT AS pos, round(e[i], 6) AS value FROM emb, UNNEST(range(1, 65)) AS r(i)", ("emb",))
def b2_decode_volumes(spark, sf):
    packed = ops.encode_volumes(t.volumes4(spark, sf).select("vol", "data"))
    return rounded(ops.decode_volumes(packed, "data").select("vol", F.posexplode("data").alias("pos", "value")))


@query(
    "b3_canonical_labels",
    """WITH p AS (SELECT p_partkey, replace(replace(lower(p_name), ' ', '_'), '-', '_') AS l FROM part)
       SELECT p_partkey, CASE l WHEN 'small_ring' THEN 'ring' WHEN 'red_widget' THEN 'widget' ELSE coalesce(l, 'unknown') END AS label FROM p""",
)
def b3_canonical_labels(spark, sf):
    named = t.read(spark, sf, "part").select("p_partkey", labels.canonical_label(F.col("p_name"), {"small_ring": "ring", "red_widget": "widget"}).alias("label"))
    return named


@query(
    "b3_canonicalize_by_table",
    """WITH p AS (SELECT c_custkey, lower(c_mktsegment) AS l FROM customer), al AS (SELECT lower(n_name) AS variant, 'region_' || n_regionkey AS name FROM nation
                  UNION ALL SELECT 'household', 'home')
       SELECT c_custkey, coalesce(name, l) AS label FROM p LEFT JOIN al ON l = variant""",
)
def b3_canonicalize_by_table(spark, sf):
    nations = t.read(spark, sf, "nation").select(F.lower("n_name").alias("variant"), F.concat(F.lit("region_"), "n_regionkey").alias("name"))
    aliases = nations.unionByName(spark.sql("SELECT 'household' AS variant, 'home' AS name"))
    return ops.canonicalize(t.read(spark, sf, "customer"), "c_mktsegment", aliases).select("c_custkey", "label")


def _mapping(spark, sf):
    nation = t.read(spark, sf, "nation").filter("n_regionkey <> 2")
    return nation.select(F.concat(F.lit("src"), "n_nationkey").alias("name"), F.lower("n_name").alias("pdb_id"))


_CLASSES = """map AS (SELECT 'src' || n_nationkey AS name, lower(n_name) AS pdb_id FROM nation WHERE n_regionkey <> 2),
     names AS (SELECT DISTINCT source AS name, pdb_id FROM documents LEFT JOIN map ON source = name WHERE source <> 'src3'),
     ranks AS (SELECT name, pdb_id, CASE WHEN pdb_id IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY pdb_id NULLS LAST) - 1 END::INT AS cls FROM names)"""


def _sources(spark, sf):
    molecule = F.when(F.col("source") == "src3", labels.BACKGROUND).otherwise(F.col("source")).alias("molecule_id")
    return t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), molecule)


@query(
    "b4_class_index",
    f"WITH {_CLASSES} SELECT doc_id AS id, CASE source WHEN 'src3' THEN 'background' ELSE source END AS molecule_id, coalesce(cls, -1) AS cls FROM documents LEFT JOIN ranks ON source = name",
)
def b4_class_index(spark, sf):
    return ops.class_index(_sources(spark, sf), _mapping(spark, sf))


@query("b4_unmapped_labels", f"WITH {_CLASSES} SELECT name FROM ranks WHERE pdb_id IS NULL")
def b4_unmapped_labels(spark, sf):
    return ops.unmapped_labels(_sources(spark, sf), _mapping(spark, sf))


@query(
    "b5_ordered_class",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE -1 END::INT AS cls FROM events",
)
def b5_ordered_class(spark, sf):
    return t.read(spark, sf, "events").select("event_id", ops.ordered_class(F.col("event_type"), ["view", "click", "signup"]).alias("cls"))


def _keys(spark, sf):
    key = F.when(F.col("p_size") == 7, F.lit(labels.BACKGROUND)).otherwise(F.col("p_partkey").cast("string"))
    return t.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), key.alias("molecule_id"))


@query(
    "b6_pdb_like_structures",
    "SELECT p_partkey AS id, CASE p_size WHEN 7 THEN 'background' ELSE p_partkey::VARCHAR END AS molecule_id FROM part WHERE p_size = 7 OR length(p_partkey::VARCHAR) = 4",
)
def b6_pdb_like_structures(spark, sf):
    return ops.filter_structures(_keys(spark, sf), background=True)


def _wanted(spark, sf):
    return t.read(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").cast("string").alias("id"))


@query(
    "b6_requested_structures",
    "SELECT p_partkey AS id, p_partkey::VARCHAR AS molecule_id FROM part WHERE p_size <> 7 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
)
def b6_requested_structures(spark, sf):
    return ops.filter_structures(_keys(spark, sf), _wanted(spark, sf))


@query(
    "b6_missing_structures",
    "SELECT DISTINCT l_partkey::VARCHAR AS id FROM lineitem WHERE l_quantity > 49 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)",
)
def b6_missing_structures(spark, sf):
    return ops.missing_structures(_keys(spark, sf), _wanted(spark, sf))


@query("b7_structure_counts", "SELECT coalesce(molecule_id, 'background') AS structure, count(*) AS n FROM particles GROUP BY 1", ("particles",))
def b7_structure_counts(spark, sf):
    return ops.structure_counts(t.particles(spark, sf))


@query("b8_source_counts", "SELECT source_type, count(*) AS n FROM particles GROUP BY 1", ("particles",))
def b8_source_counts(spark, sf):
    return ops.source_counts(t.particles(spark, sf))


@query(
    "b9_class_balance",
    """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
       SELECT lang, n, round(n / (SELECT sum(n) FROM c), 6) AS share, round((SELECT max(n) / min(n) FROM c), 6) AS ratio,
              (SELECT max(n) / min(n) > 3 FROM c) AS imbalanced FROM c""",
)
def b9_class_balance(spark, sf):
    return rounded(ops.class_balance(t.read(spark, sf, "documents"), "lang"))


_LEVELS = "levels AS (SELECT molecule_id, snr, min(id) AS first_id FROM particles WHERE snr IS NOT NULL AND molecule_id <> 'background' GROUP BY ALL)"


@query("b10_snr_levels", f"WITH {_LEVELS} SELECT * FROM levels", ("particles",))
def b10_snr_levels(spark, sf):
    return ops.snr_levels(t.particles(spark, sf))


@query(
    "b10_most_levels",
    f"WITH {_LEVELS} SELECT molecule_id, count(*) AS n_levels FROM levels GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    ("particles",),
)
def b10_most_levels(spark, sf):
    return ops.most_levels(ops.snr_levels(t.particles(spark, sf)))


@query(
    "b10_level_range",
    f"""WITH {_LEVELS} SELECT molecule_id, min(snr) AS low_snr, max(snr) AS high_snr, arg_min(first_id, snr) AS low_id, arg_max(first_id, snr) AS high_id
        FROM levels GROUP BY 1 HAVING max(snr) - min(snr) >= 2""",
    ("particles",),
)
def b10_level_range(spark, sf):
    return ops.level_range(ops.snr_levels(t.particles(spark, sf)))


@query(
    "b11_spread_levels",
    f"""WITH {_LEVELS}, r AS (SELECT molecule_id, snr, row_number() OVER (PARTITION BY molecule_id ORDER BY snr) - 1 AS i, count(*) OVER (PARTITION BY molecule_id) AS l FROM levels)
        SELECT molecule_id, snr FROM r WHERE l <= 6 OR i = l - 1 OR i IN (0, l // 5, 2 * l // 5, 3 * l // 5, 4 * l // 5)""",
    ("particles",),
)
def b11_spread_levels(spark, sf):
    return ops.spread_levels(ops.snr_levels(t.particles(spark, sf)))


@query(
    "b12_density_summary",
    """WITH d AS (SELECT label, list_avg(e) AS density FROM emb)
       SELECT label, round(min(density), 6) AS low, round(quantile_cont(density, 0.25), 6) AS q1, round(quantile_cont(density, 0.5), 6) AS median,
              round(quantile_cont(density, 0.75), 6) AS q3, round(max(density), 6) AS high FROM d GROUP BY 1""",
    ("emb",),
)
def b12_density_summary(spark, sf):
    means = t.volumes4(spark, sf).select("vol", "label", v.mean(F.col("data")).alias("density"))
    return rounded(ops.density_summary(means, ["label"], ties=["vol"]))


@query(
    "b13_sanitize_metrics",
    """SELECT event_id, event_type || '_rate' AS name, value::VARCHAR AS value FROM events UNION ALL
       SELECT event_id, 'm_' || (event_id % 3) || '_loss', (event_id * 2)::VARCHAR FROM events""",
)
def b13_sanitize_metrics(spark, sf):
    raw = F.create_map(
        F.concat("event_type", F.lit("/rate")), F.col("value").cast("string"),
        F.concat((F.col("event_id") % 3).cast("string"), F.lit(".loss")), (F.col("event_id") * 2).cast("string"),
        F.lit(""), F.lit("1"), F.lit("bad"), F.col("props"),
    )
    return t.read(spark, sf, "events").select("event_id", F.explode(ops.sanitize_metrics(raw)).alias("name", "value"))


@query(
    "b14_derive_ids",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS structure, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE lang END AS run, source AS head FROM documents""",
)
def b14_derive_ids(spark, sf):
    sample = F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.concat_ws("_", "source", "lang"))
    meta = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    path = F.concat_ws("/", "source", "lang", "doc_id")
    return t.read(spark, sf, "documents").select(
        "doc_id", ops.derive_structure(meta, sample).alias("structure"), ops.derive_run(F.lit(None).cast("string"), sample).alias("run"), ops.path_head(path).alias("head")
    )


@query("b15_near_snr", "SELECT id, snr FROM particles WHERE abs(snr - 5) <= 1.5", ("particles",))
def b15_near_snr(spark, sf):
    return ops.near_snr(t.particles(spark, sf), 5.0, 1.5).select("id", "snr")


@query("b16_stem_id", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '_' || lang ELSE source || '-' || doc_id END AS id FROM documents")
def b16_stem_id(spark, sf):
    stem = F.concat_ws("_", "source", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("doc_id").cast("string")))
    return t.read(spark, sf, "documents").select("doc_id", labels.stem_id(stem).alias("id"))
