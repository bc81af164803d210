"""Queries that join runs, tomograms, picks and embedding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.catalog import tables as t
from motefield.catalog.registry import query, rounded
from motefield.catalog.similarity import class_affinity
from motefield.functions import vectors as v
from motefield.operators import joins as ops
from motefield.operators import similarity as sim


@query(
    "c1_join_coordinates",
    "SELECT event_id AS pick_id, vec_id, label, value AS x FROM events JOIN embeddings ON event_id = vec_id",
)
def c1_join_coordinates(spark, sf):
    coords = t.read(spark, sf, "events").select(F.concat(F.lit("emb/"), "event_id").alias("filepath"), F.col("event_id").alias("pick_id"), F.col("value").alias("x"))
    rows = t.read(spark, sf, "embeddings").select(F.concat(F.lit("output/emb/"), "vec_id").alias("filepath"), "vec_id", "label")
    return ops.join_coordinates(coords, rows, required=True).drop("filepath")


def _two_sources(spark, sf):
    """All rows twice: in the second source the labels from 5 on are one higher, so that each source has a label the other one lacks."""
    base = t.emb(spark, sf)
    a = base.select(F.col("vec_id").alias("id_a"), "label", F.slice("e", 1, 32).alias("a"))
    b = base.select(F.col("vec_id").alias("id_b"), F.when(F.col("label") >= 5, F.col("label") + 1).otherwise(F.col("label")).alias("label"), F.slice("e", 33, 32).alias("b"))
    return a, b


_SHIFTED = "CASE WHEN label >= 5 THEN label + 1 ELSE label END"
ALIGN_SQL = f"""a AS (SELECT vec_id AS id_a, label, e[1:32] AS a, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', vec_id, 171717)), vec_id) AS pair_rank FROM emb),
     shifted AS (SELECT vec_id, {_SHIFTED} AS label, e FROM emb),
     b AS (SELECT vec_id AS id_b, label, e[33:64] AS b, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', vec_id, '171717b')), vec_id) AS pair_rank FROM shifted)"""


def aligned(spark, sf):
    a, b = _two_sources(spark, sf)
    return ops.align_tables(a, b, "label", "id_a", "id_b")


@query("c2_align_tables", f"WITH {ALIGN_SQL} SELECT label, pair_rank, id_a, id_b FROM a JOIN b USING (label, pair_rank)", ("emb",))
def c2_align_tables(spark, sf):
    return aligned(spark, sf).select("label", "pair_rank", "id_a", "id_b")


@query("c2_align_by_id", f"WITH {ALIGN_SQL} SELECT a.label, id_a, id_b FROM a JOIN b ON a.label = b.label AND id_a = id_b", ("emb",))
def c2_align_by_id(spark, sf):
    return ops.align_by_id(*_two_sources(spark, sf), "label", "id_a", "id_b").select("label", "id_a", "id_b")


@query("c3_common_structures", f"SELECT label FROM emb INTERSECT SELECT {_SHIFTED} FROM emb", ("emb",))
def c3_common_structures(spark, sf):
    return ops.common_values(*_two_sources(spark, sf), "label")


def _requested(spark, sf):
    """Ids asked for: supplier names in the wrong case, and customer names the table does not have."""
    known = t.read(spark, sf, "supplier").filter("s_acctbal > 0").select(F.upper("s_name").alias("id"))
    return known.unionByName(t.read(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_name").alias("id")))


@query("c4_lookup_ids", "SELECT s_name AS id, s_nationkey FROM supplier WHERE s_acctbal > 0")
def c4_lookup_ids(spark, sf):
    table = t.read(spark, sf, "supplier").select(F.col("s_name").alias("id"), "s_nationkey")
    return ops.lookup_ids(_requested(spark, sf), table)


@query("c4_missing_ids", "SELECT DISTINCT c_name AS id FROM customer WHERE c_acctbal > 9000 AND lower(c_name) NOT IN (SELECT lower(s_name) FROM supplier)")
def c4_missing_ids(spark, sf):
    return ops.missing_ids(_requested(spark, sf), t.read(spark, sf, "supplier").select(F.col("s_name").alias("id")))


@query(
    "c5_missing_pairs",
    "SELECT a.vec_id AS id1, b.vec_id AS id2 FROM emb a JOIN emb b ON a.vec_id < b.vec_id WHERE (a.vec_id + b.vec_id) % 4 <> 0",
    ("emb",),
)
def c5_missing_pairs(spark, sf):
    features = t.features(spark, sf)
    stored = sim.pairwise_affinity(features).filter("(id1 + id2) % 4 = 0")
    return ops.missing_pairs(features, stored)


@query("c6_unfinished_runs", "SELECT DISTINCT p_brand AS run FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)")
def c6_unfinished_runs(spark, sf):
    runs = t.spacings(spark, sf)
    return ops.unfinished(runs.select("run").distinct(), runs.filter("size > 49"))


@query(
    "c7_best_spacing",
    "SELECT run, ord, size FROM spacings WHERE abs(size - 10) <= 1 QUALIFY row_number() OVER (PARTITION BY run ORDER BY abs(size - 10), ord) = 1",
    ("spacings",),
)
def c7_best_spacing(spark, sf):
    return ops.best_spacing(t.spacings(spark, sf), 10.0, 1.0)


@query(
    "c7_runs_without_spacing",
    "SELECT DISTINCT p_brand || '/' || p_name || '/' || (p_partkey % 7) AS run FROM part EXCEPT SELECT p_brand || '/' || p_name || '/' || (p_partkey % 7) FROM part WHERE abs(p_size - 10) <= 1",
)
def c7_runs_without_spacing(spark, sf):
    part = t.read(spark, sf, "part")
    finer = part.select(F.concat_ws("/", "p_brand", "p_name", F.col("p_partkey") % 7).alias("run"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("double").alias("size"))
    return ops.runs_without_spacing(finer, 10.0, 1.0)


@query(
    "c8_preferred_tomogram",
    "SELECT run, ord, tomo_type FROM spacings QUALIFY row_number() OVER (PARTITION BY run ORDER BY tomo_type <> 'SMALL', ord) = 1",
    ("spacings",),
)
def c8_preferred_tomogram(spark, sf):
    return ops.preferred_tomogram(t.spacings(spark, sf), F.col("tomo_type") == "SMALL")


@query(
    "c8_preferred_tomogram_by_name",
    "SELECT run, ord, tomo_type FROM spacings QUALIFY row_number() OVER (PARTITION BY run ORDER BY NOT (tomo_type LIKE '%PRO%' OR tomo_type LIKE '%LARGE%'), ord) = 1",
    ("spacings",),
)
def c8_preferred_tomogram_by_name(spark, sf):
    return ops.preferred_tomogram(t.spacings(spark, sf), F.col("tomo_type").contains("PRO") | F.col("tomo_type").contains("LARGE"))


_INSIDE = """inside AS (SELECT p.*, z::INT - 2 AS z0, y::INT - 2 AS y0, x::INT - 2 AS x0 FROM picks p JOIN tomograms t USING (run)
          WHERE z >= 2 AND z + 2 <= nz AND y >= 2 AND y + 2 <= ny AND x >= 2 AND x + 2 <= nx)"""
BOXES_SQL = f"""{_INSIDE}, boxes AS (SELECT i.run, i.pick_id, ((v.z - z0) * 16 + (v.y - y0) * 4 + v.x - x0)::INT AS pos, v.v FROM inside i JOIN tomo_voxels v
          ON v.run = i.run AND v.z >= z0 AND v.z < z0 + 4 AND v.y >= y0 AND v.y < y0 + 4 AND v.x >= x0 AND v.x < x0 + 4)"""


def placed_picks(spark, sf):
    return ops.pick_voxels(t.picks(spark, sf), F.lit(1.0))


def boxes(spark, sf, normalize=False):
    return ops.extract_boxes(placed_picks(spark, sf), t.tomograms(spark, sf), t.tomo_chunks(spark, sf), 4, 4, normalize)


@query("c9_boxes_inside", f"WITH {_INSIDE} SELECT run, pick_id, z0, y0, x0 FROM inside", ("picks", "tomograms"))
def c9_boxes_inside(spark, sf):
    return ops.boxes_inside(placed_picks(spark, sf), t.tomograms(spark, sf), 4).select("run", "pick_id", "z0", "y0", "x0")


@query("c9_extract_boxes", f"WITH {BOXES_SQL} SELECT run, pick_id, pos, round(v, 6) AS v FROM boxes", ("picks", "tomograms", "tomo_voxels"))
def c9_extract_boxes(spark, sf):
    return rounded(boxes(spark, sf).select("run", "pick_id", F.posexplode("data").alias("pos", "v")))


@query(
    "c9_extract_boxes_zscore",
    f"""WITH {BOXES_SQL} SELECT run, pick_id, pos, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS v FROM boxes WINDOW w AS (PARTITION BY pick_id)""",
    ("picks", "tomograms", "tomo_voxels"),
)
def c9_extract_boxes_zscore(spark, sf):
    return rounded(boxes(spark, sf, True).select("run", "pick_id", F.posexplode("data").alias("pos", "v")))


@query("c10_filter_picks", "SELECT run, pick_id, structure FROM picks WHERE structure IN ('click', 'view') AND user_id = 7", ("picks",))
def c10_filter_picks(spark, sf):
    return ops.filter_picks(t.picks(spark, sf), structure=["click", "view"], user_id=7).select("run", "pick_id", "structure")


@query(
    "c11_nearest_pick",
    """WITH pts AS (SELECT (o_custkey % 10)::INT AS run, o_orderkey AS point_id, o_orderkey % 10 + 0.25 AS x, o_custkey % 12 + 0.5 AS y, floor(o_totalprice) % 60 AS z FROM orders),
            p AS (SELECT run, x, y, z, min(pick_id) AS pick_id FROM picks GROUP BY ALL),
            d AS (SELECT run, point_id, pick_id, (pts.x - p.x) ** 2 + (pts.y - p.y) ** 2 + (pts.z - p.z) ** 2 AS d2 FROM pts JOIN p USING (run))
       SELECT run, point_id, arg_min(pick_id, (d2, pick_id)) AS pick_id, round(sqrt(min(d2)), 6) AS distance FROM d GROUP BY run, point_id""",
    ("picks",),
)
def c11_nearest_pick(spark, sf):
    points = t.read(spark, sf, "orders").select(
        F.pmod("o_custkey", F.lit(10)).cast("int").alias("run"), F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % 10 + 0.25).cast("double").alias("x"),
        (F.col("o_custkey") % 12 + 0.5).cast("double").alias("y"), (F.floor("o_totalprice") % 60).cast("double").alias("z"),
    )
    return rounded(ops.nearest_pick(points, t.picks(spark, sf)))


@query(
    "c12_target_lookup",
    """WITH o AS (SELECT o_orderkey, (o_orderkey % 10 - 1)::INT AS c1, (o_custkey % 10 - 1)::INT AS c2 FROM orders)
       SELECT o_orderkey, c1, c2, round(CASE WHEN c1 = -1 AND c2 = -1 THEN 0.2 WHEN c1 = -1 OR c2 = -1 THEN 0.01 WHEN c1 = c2 THEN 1.0 ELSE affinity END, 6) AS target
       FROM o LEFT JOIN class_aff ON id1 = least(c1, c2) AND id2 = greatest(c1, c2)""",
    ("class_aff",),
)
def c12_target_lookup(spark, sf):
    pairs = t.read(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 10 - 1).cast("int").alias("c1"), (F.col("o_custkey") % 10 - 1).cast("int").alias("c2")
    )
    return rounded(sim.with_targets(pairs, class_affinity(spark, sf)))


@query(
    "l3_leading_dims",
    "SELECT vec_id, round(list_sum(e[1:48]), 6) AS total, 48 AS dims FROM emb",
    ("emb",),
)
def l3_leading_dims(spark, sf):
    part = t.emb(spark, sf).select("vec_id", v.leading_dims(F.col("e"), 0.75).alias("p"))
    return rounded(part.select("vec_id", v.total(F.col("p")).alias("total"), F.size("p").alias("dims")))
