"""Queries on readers, sinks, scoring and whole jobs.

The driver's tables carry no particle files, so each query first writes the
rows of a whole table in the layout in question to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from motefield.catalog import tables as t
from motefield.catalog.embeddings import CLASS_SEPARATION_SQL
from motefield.catalog.joins import _INSIDE, BOXES_SQL
from motefield.catalog.poses import ROTATION_METRICS_SQL, rotations
from motefield.catalog.registry import query, rounded
from motefield.catalog.volumes import _EDGE8, _MOMENTS, _SMOOTH
from motefield.functions.vectors import total
from motefield.operators.scoring import score
from motefield.plans.evaluation import evaluate
from motefield.plans.extraction import extract_embeddings
from motefield.plans.similarity_matrix import similarity_matrix
from motefield.session import scratch_path
from motefield.sources import particles as src
from motefield.sources import sinks


def _particle_rows(spark, sf):
    """Embedding rows as particle rows: structure by label, signal-to-noise level by id."""
    base = t.emb(spark, sf)
    return base.select(
        "vec_id", F.concat(F.lit("s"), "label").alias("structure"), (F.col("vec_id") % 3).cast("double").alias("snr"), F.col("e").alias("volume"), F.array(*[F.lit(4)] * 3).alias("shape"),
        F.when(F.col("vec_id") % 2 == 0, F.slice("e", 1, 4)).alias("orientation_axis_angle"),
    )


def _tree(spark, sf, layout):
    """Write the rows as ``<structure>/snr_<x>`` or ``<structure>_snr_<x>`` folders, in the order of their ids.

    A scan deals out its files by size, so the rows of a table of several files come in no order of their own.
    """
    root = scratch_path(spark, "tree")
    rows = _particle_rows(spark, sf)
    for s, level in sorted(tuple(r) for r in rows.select("structure", "snr").distinct().collect()):
        part = rows.filter((F.col("structure") == s) & (F.col("snr") == level)).drop("structure", "snr")
        part.coalesce(1).sortWithinPartitions("vec_id").write.parquet(f"{root}/{s}/snr_{level}" if layout == "nested" else f"{root}/{s}_snr_{level}")
    return root


@query(
    "a1_read_particles",
    "SELECT vec_id, 's4' AS structure, 1.0::DOUBLE AS snr, vec_id % 2 = 0 AS has_pose, round(list_sum(e), 6) AS total FROM emb WHERE label = 4 AND vec_id % 3 = 1",
    ("emb",),
)
def a1_read_particles(spark, sf):
    df = src.read_particles(spark, _tree(spark, sf, "nested"), "s4", "1.0")
    return rounded(df.select("vec_id", "structure", "snr", "has_pose", total(F.col("volume")).alias("total")))


@query("a1_rejected_files", "SELECT DISTINCT 's' || label AS structure, 'no readable rows' AS reason, 1::BIGINT AS n FROM embeddings WHERE label = 4")
def a1_rejected_files(spark, sf):
    root = _tree(spark, sf, "nested")
    t.read(spark, sf, "embeddings").select(F.col("label").cast("string")).coalesce(1).write.text(f"{root}/s4/snr_1.0/broken.parquet")
    found = src.rejected_files(spark, f"{root}/*/snr_*/*.parquet")
    return found.groupBy(F.regexp_extract("path", "/([^/]+)/snr_", 1).alias("structure"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a1_read_particles_flat",
    "SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS row_index FROM emb WHERE label = 7 AND vec_id % 3 = 2 ORDER BY vec_id LIMIT 5",
    ("emb",),
)
def a1_read_particles_flat(spark, sf):
    return src.read_particles(spark, _tree(spark, sf, "flat"), "s7", "2.0", 5).select("vec_id", "row_index")


@query("a2_catalog", "SELECT 's' || label AS structure, (vec_id % 3)::DOUBLE AS snr, count(*) AS n_rows, 1::BIGINT AS n_files FROM embeddings GROUP BY ALL")
def a2_catalog(spark, sf):
    return src.particle_catalog(spark, _tree(spark, sf, "nested"))


@query("a3_latest_version", "SELECT max('v_' || lang) AS version, (SELECT count(*) FROM documents WHERE lang = (SELECT max(lang) FROM documents)) AS n_rows FROM documents")
def a3_latest_version(spark, sf):
    root = scratch_path(spark, "versions")
    docs = t.read(spark, sf, "documents").select("doc_id", "lang")
    for lang in sorted(r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"] is not None):
        docs.filter(F.col("lang") == lang).write.parquet(f"{root}/v_{lang}")
    found = src.latest_version(spark, f"{root}/v")
    return spark.read.parquet(found).agg(F.lit(found.split("/")[-1]).alias("version"), F.count(F.lit(1)).alias("n_rows"))


def _training_files(spark, sf):
    """Three sources: with source types, without them, and one that lacks a required column."""
    root = scratch_path(spark, "sources")
    rows = t.emb(spark, sf).select(
        "vec_id", F.col("e").alias("subvolume"), F.array(*[F.lit(4)] * 3).alias("shape"), F.when(F.col("label") > 0, F.concat(F.lit("m"), "label")).alias("molecule_id"),
        F.when(F.col("vec_id") % 4 > 0, F.concat(F.lit("lab"), F.col("vec_id") % 4)).alias("source_type"),
    )
    rows.filter("vec_id % 2 = 0").write.parquet(f"{root}/a.parquet")
    rows.filter("vec_id % 2 = 1").drop("source_type").write.parquet(f"{root}/b.parquet")
    rows.drop("shape").write.parquet(f"{root}/c.parquet")
    return [f"{root}/{n}.parquet" for n in "abc"]


_SOURCES = """s AS (SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN 'source_1' WHEN vec_id % 4 = 0 THEN 'source_0' ELSE 'lab2' END AS source_type,
     CASE WHEN label > 0 THEN 'm' || label ELSE 'background' END AS molecule FROM embeddings)"""


@query("a4_load_sources", f"WITH {_SOURCES} SELECT vec_id, source_type, source_type || ':' || molecule AS sample_id, CASE vec_id % 2 WHEN 0 THEN 'a.parquet' ELSE 'b.parquet' END AS dataset_source FROM s")
def a4_load_sources(spark, sf):
    return src.load_sources(spark, _training_files(spark, sf))[0].select("vec_id", "source_type", "sample_id", "dataset_source")


@query("a4_skipped_sources", "SELECT DISTINCT 2::INT AS position, 'c.parquet' AS dataset_source, 'missing columns: shape' AS reason FROM embeddings")
def a4_skipped_sources(spark, sf):
    return src.load_sources(spark, _training_files(spark, sf))[2]


@query("a4_source_counts", f"WITH {_SOURCES} SELECT source_type, molecule AS molecule_id, count(*) AS n FROM s GROUP BY ALL")
def a4_source_counts(spark, sf):
    return src.load_sources(spark, _training_files(spark, sf))[1]


@query(
    "a5_read_validation",
    "SELECT vec_id, 's' || label AS structure_id FROM embeddings WHERE vec_id % 3 = 1 AND label IN (2, 5) QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 7",
)
def a5_read_validation(spark, sf):
    root = scratch_path(spark, "validation")
    rows = _particle_rows(spark, sf).withColumn("pdb_code", F.upper("structure")).drop("structure")
    for level in range(3):
        rows.filter(F.col("snr") == level).drop("snr").coalesce(1).sortWithinPartitions("vec_id").write.parquet(f"{root}/validation_set_snr{level}.parquet")
    return src.read_validation(spark, root, "1", ["S2", "s5"], 7).select("vec_id", "structure_id")


@query(
    "a6_snr_extremes",
    """WITH s AS (SELECT lang AS structure, 'set_snr_' || regexp_extract(source, '([0-9]+)', 1) || '.5' AS source_type, regexp_extract(source, '([0-9]+)', 1)::DOUBLE + 0.5 AS snr FROM documents)
       SELECT structure, min(snr) AS low_snr, arg_min(source_type, snr) AS low_set, max(snr) AS high_snr, arg_max(source_type, snr) AS high_set FROM s GROUP BY structure""",
)
def a6_snr_extremes(spark, sf):
    named = F.concat(F.lit("set_snr_"), F.regexp_extract("source", "([0-9]+)", 1), F.lit(".5"))
    return src.snr_extremes(t.read(spark, sf, "documents").select(F.col("lang").alias("structure"), named.alias("source_type")))


@query("a7_read_coords_csv", "SELECT event_type AS protein, 'run' || user_id || '/' || event_id AS filepath, value AS x, (event_id % 9)::DOUBLE AS y, 0.5::DOUBLE AS z FROM events")
def a7_read_coords_csv(spark, sf):
    path = scratch_path(spark, "coords")
    rows = t.read(spark, sf, "events").select(
        F.col("event_type").alias("protein"), F.concat(F.lit("run"), "user_id", F.lit("/"), "event_id").alias("filepath"), F.col("value").alias("x"), (F.col("event_id") % 9).cast("double").alias("y"), F.lit(0.5).alias("z")
    )
    rows.write.csv(path, header=True)
    return src.read_coords_csv(spark, path)


@query("a8_read_objects", "SELECT n_name AS name, lower(n_name) AS pdb_id, n_nationkey AS label FROM nation WHERE n_regionkey <> 3")
def a8_read_objects(spark, sf):
    path = scratch_path(spark, "project")
    item = F.struct(F.col("n_name").alias("name"), F.lower("n_name").alias("pdb_id"), F.col("n_nationkey").alias("label"), (F.col("n_regionkey") != 3).alias("is_particle"))
    t.read(spark, sf, "nation").agg(F.collect_list(item).alias("pickable_objects")).coalesce(1).write.json(path)
    return src.read_objects(spark, path).select("name", "pdb_id", "label")


@query("a9_write_embeddings", "SELECT label AS run, vec_id, CASE WHEN label = 3 THEN 2 ELSE 1 END AS version FROM embeddings")
def a9_write_embeddings(spark, sf):
    path = scratch_path(spark, "embeddings")
    rows = t.read(spark, sf, "embeddings").select(F.col("label").alias("run"), "vec_id", "embedding")
    sinks.write_embeddings(rows.withColumn("version", F.lit(1)), path)
    sinks.write_embeddings(rows.filter("run = 3").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path).select("run", "vec_id", "version")


@query("a9_embedding_summary", "SELECT event_type AS structure, count(*) AS n FROM events GROUP BY 1")
def a9_embedding_summary(spark, sf):
    return sinks.embedding_summary(t.picks(spark, sf))


@query("a10_write_json_lines", "SELECT event_id AS step, event_type AS key, value FROM events")
def a10_write_json_lines(spark, sf):
    path = scratch_path(spark, "metrics")
    sinks.write_json_lines(sinks.metric_lines(t.metric_log(spark, sf)), path)
    lines = spark.read.schema("step long, metrics map<string, double>").json(path)
    return lines.select("step", F.explode("metrics").alias("key", "value"))


@query(
    "a11_write_report",
    """SELECT coalesce(o.run, e.run) AS structure, n, total, coalesce(errors, '') AS errors, '4' AS box FROM (SELECT p_brand AS run, count(*) AS n, sum(p_size) AS total FROM part WHERE p_size < 40 GROUP BY 1) o
       FULL JOIN (SELECT p_brand AS run, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS errors FROM part WHERE p_size >= 49 GROUP BY 1) e USING (run)""".replace("USING (run)", "ON o.run = e.run").replace("sum(p_size)", "sum(p_size)::BIGINT"),
)
def a11_write_report(spark, sf):
    path = scratch_path(spark, "report")
    part = t.spacings(spark, sf)
    results = part.filter("size < 40").groupBy(F.col("run").alias("structure")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("total"))
    errors = part.filter("size >= 49").select(F.col("run").alias("structure"), F.col("tomo_type").alias("error"))
    sinks.write_report(results, path, {"box": "4", "seed": "42"}, errors=errors)
    schema = "structure string, results struct<n: long, total: long>, errors array<string>, config map<string, string>"
    back = spark.read.schema(schema).json(path)
    return back.select("structure", "results.n", "results.total", F.coalesce(F.concat_ws(",", "errors"), F.lit("")).alias("errors"), F.col("config")["box"].alias("box"))


def pooling_encoder():
    """A stand-in for a trained network: pooled means, their log size, the first voxels as pose, the range as weight."""

    def encode(volumes: np.ndarray):
        n = len(volumes)
        pooled = volumes.reshape(n, 2, 2, 2, 2, 2, 2).mean(axis=(2, 4, 6)).reshape(n, 8)
        return pooled, np.log(np.abs(pooled) + 1.0), volumes.reshape(n, -1)[:, :4], volumes.max(axis=(1, 2, 3)) - volumes.min(axis=(1, 2, 3))

    return encode


@query(
    "l1_score",
    """WITH p AS (SELECT vec_id, ((z // 2) * 4 + (y // 2) * 2 + x // 2)::INT AS pos, avg(v) AS mu FROM vox4 GROUP BY ALL), w AS (SELECT vec_id, max(v) - min(v) AS w, sum(v) FILTER (z = 0 AND y = 0) AS ps FROM vox4 GROUP BY vec_id)
       SELECT vec_id AS vol, pos, round(mu, 6) AS mu, round(ln(abs(mu) + 1), 6) AS log_var, round(w, 6) AS weight, round(ps, 6) AS pose_sum FROM p JOIN w USING (vec_id)""",
    ("vox4",),
)
def l1_score(spark, sf):
    scored = score(t.volumes4(spark, sf), pooling_encoder, 32)
    cells = scored.select("vol", F.round("global_weight", 6).alias("weight"), F.round(total(F.col("pose")), 6).alias("pose_sum"), F.posexplode(F.arrays_zip("embedding", "log_var")).alias("pos", "c"))
    return cells.select("vol", "pos", F.round("c.embedding", 6).alias("mu"), F.round("c.log_var", 6).alias("log_var"), "weight", "pose_sum")


def _extraction_inputs(spark, sf):
    """Ten runs with two spacings of two tomograms each; only the finer ``SMALL`` one holds the values of the label's vectors.

    Run 6 has no spacing near the target, run 2 lacks a chunk, and run 1 has a voxel that is not a number.
    """
    runs = t.read(spark, sf, "part").select(F.pmod("p_partkey", F.lit(10)).cast("int").alias("run")).distinct()
    kinds = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(s).alias("add"), F.lit(k).alias("tomo_type"), F.lit(w).alias("off")) for o, s, k, w in
                      ((0, 5.0, "RAW", 100.0), (1, 5.0, "SMALL", 200.0), (2, 0.0, "RAW", 300.0), (3, 0.0, "SMALL", 0.0))])
    base = F.when(F.col("run") == 6, F.lit(60.0)).otherwise(F.lit(9.0))
    listed = runs.select("run", F.explode(kinds).alias("k")).select("run", "k.ord", (base + F.col("k.add")).alias("size"), "k.tomo_type", "k.off")
    values = F.transform("data", lambda v, i: F.when((F.col("off") == 0) & (F.col("run") == 1) & (F.col("cz") + F.col("cy") + F.col("cx") + i == 0), F.lit(float("nan"))).otherwise(v + F.col("off")))
    chunks = t.tomo_chunks(spark, sf).filter(~((F.col("run") == 2) & (F.col("cz") == 1) & (F.col("cy") == 1) & (F.col("cx") == 1)))
    keyed = chunks.join(listed, "run").select("run", "size", "tomo_type", "cz", "cy", "cx", values.alias("data"))
    sizes = t.tomograms(spark, sf).join(listed, "run").select("run", "size", "tomo_type", "nz", "ny", "nx")
    turn = F.array(*[F.when(F.lit(i % 5 == 0), F.lit(1.0)).when(F.lit(i == 3), F.col("x")).otherwise(F.lit(0.0)) for i in range(16)])
    picks = t.picks(spark, sf).withColumns({a: F.col(a) * 9.0 for a in "xyz"}).withColumn("transform", turn)
    return picks, dict(
        spacings=listed.drop("off"), tomograms=sizes, chunks=keyed, encoder=pooling_encoder, box=4, edge=4, target=10.0, tolerance=1.0, wanted=F.col("tomo_type") == "SMALL"
    )


_HOLED = """hole AS (SELECT run, pick_id FROM inside WHERE run = 2 AND z0 + 4 > 4 AND z0 < 8 AND y0 + 4 > 4 AND x0 + 4 > 4)"""
_EXTRACTED = f"""{BOXES_SQL}, {_HOLED},
     nb AS (SELECT b.run, b.pick_id, pos, CASE WHEN b.run = 1 AND i.z0 = 0 AND i.y0 = 0 AND i.x0 = 0 AND pos = 0 THEN 'NaN'::DOUBLE ELSE v END AS v FROM boxes b JOIN inside i ON b.run = i.run AND b.pick_id = i.pick_id
            WHERE (b.run, b.pick_id) NOT IN (SELECT (run, pick_id) FROM hole)),
     s AS (SELECT run, pick_id, avg(v) AS m, CASE WHEN isnan(max(v)) THEN 'NaN'::DOUBLE ELSE stddev_pop(CASE WHEN isnan(v) THEN NULL ELSE v END) END AS sd FROM nb GROUP BY ALL),
     z AS (SELECT run, pick_id, pos, (v - m) / sd AS v FROM nb JOIN s USING (run, pick_id)),
     emb8 AS (SELECT run, pick_id, ((pos // 32) * 4 + ((pos // 8) % 2) * 2 + (pos // 2) % 2)::INT AS k, avg(v) AS mu FROM z GROUP BY ALL)"""


@query(
    "l2_extract_embeddings",
    f"WITH {_EXTRACTED} SELECT run, pick_id, structure, user_id, k AS pos, round(mu, 6) AS mu, 3.0::DOUBLE AS trace FROM emb8 JOIN picks USING (run, pick_id) WHERE run <> 6",
    ("picks", "tomograms", "tomo_voxels"),
)
def l2_extract_embeddings(spark, sf):
    path = scratch_path(spark, "extracted")
    picks, inputs = _extraction_inputs(spark, sf)
    # The first call does some runs only; the second one finds them done and adds the rest.
    extract_embeddings(spark, path, picks.filter("run < 3"), **inputs)
    extract_embeddings(spark, path, picks, **inputs)
    out = spark.read.parquet(path)
    trace = sum(F.get("orientation", i) for i in (0, 4, 8)).alias("trace")
    return rounded(out.select("run", "pick_id", "structure", "user_id", trace, F.posexplode("embedding").alias("pos", "mu")))


@query(
    "l2_failed_runs",
    f"""WITH {_INSIDE}, {_HOLED} SELECT run, pick_id, 'incomplete box' AS error FROM hole
        UNION ALL SELECT DISTINCT (user_id % 10)::INT, NULL::BIGINT, 'no matching voxel spacing' FROM events WHERE user_id % 10 = 6""",
    ("picks", "tomograms"),
)
def l2_failed_runs(spark, sf):
    picks, inputs = _extraction_inputs(spark, sf)
    return extract_embeddings(spark, scratch_path(spark, "extracted"), picks, **inputs)


@query(
    "l2_metadata",
    f"""WITH {_INSIDE}, {_HOLED}, k AS (SELECT run, structure FROM inside WHERE run <> 6 AND structure IN ('click', 'view') AND (run, pick_id) NOT IN (SELECT (run, pick_id) FROM hole))
        SELECT structure, count(*) AS n, (SELECT count(*) FROM k) AS total, (SELECT count(DISTINCT run) FROM k) AS runs,
            '{{"box":"4","normalization":"z-score","target_spacing":"10.0","tolerance":"1.0"}}' AS config FROM k GROUP BY structure""",
    ("picks", "tomograms"),
)
def l2_metadata(spark, sf):
    path = scratch_path(spark, "extracted")
    picks, inputs = _extraction_inputs(spark, sf)
    extract_embeddings(spark, path, picks, only={"structure": ["click", "view"]}, **inputs)
    return spark.read.schema("structure string, n long, total long, runs long, config string").json(f"{path}/_summary")


_RECON_NAMES = {"mean_intensity": "m", "std_intensity": "sd", "dynamic_range": "hi - lo", "active_fraction": "act", "contrast": "CASE WHEN abs(m) > 1e-10 THEN sd / abs(m) ELSE 0 END", "edge_strength": "edge",
                "snr_db": "10 * log10(p / (sd * sd))", "mse": "mse", "psnr": "20 * log10(peak / sqrt(mse))", "correlation": "c",
                "ssim": "least(greatest((2 * ab + 1e-4) * (2 * sab + 9e-4) / ((aa + bb + 1e-4) * (sa + sb + 9e-4)), 0), 1)"}
_RECON = f"""{_EDGE8}, qa AS (SELECT vol, avg(v) AS m, stddev_pop(v) AS sd, max(v) AS hi, min(v) AS lo, avg(v * v) AS p, avg(sqrt(gz * gz + gy * gy + gx * gx)) AS edge FROM g GROUP BY vol),
     qk AS (SELECT vol, avg((abs(v) > 0.1 * sd)::INT) AS act FROM g JOIN qa USING (vol) GROUP BY vol), {_MOMENTS.replace('m AS (', 'pm AS (', 1)}, qall AS (SELECT * FROM qa JOIN qk USING (vol) JOIN pm USING (vol)),
     recon AS ({' UNION ALL '.join(f"SELECT '{s}_{n}' AS metric, {f}({e}) AS value FROM qall" for n, e in _RECON_NAMES.items() for s, f in (('mean', 'avg'), ('std', 'stddev_pop')))})"""


@query(
    "g6_evaluate",
    f"""WITH emb_report AS ({CLASS_SEPARATION_SQL}), {_RECON}, {ROTATION_METRICS_SQL},
        dv AS (SELECT avg(v) AS v FROM (SELECT i, var_pop(e[i]) AS v FROM emb, UNNEST(range(1, 65)) AS r(i) GROUP BY i)), dp AS (SELECT avg(list_distance(a.e, b.e)) AS v FROM emb a JOIN emb b ON a.vec_id < b.vec_id)
        SELECT 'embedding' AS part, metric, round(value, 4) AS value FROM emb_report UNION ALL SELECT 'diversity', 'variance', round(v, 4) FROM dv UNION ALL SELECT 'diversity', 'pairwise', round(v, 4) FROM dp
        UNION ALL SELECT 'reconstruction', metric, round(value, 4) FROM recon UNION ALL SELECT 'pose', metric, round(value, 4) FROM rm""",
    ("centers", "pair8", "rotations"),
)
def g6_evaluate(spark, sf):
    return rounded(evaluate(t.features(spark, sf), t.volume_pairs8(spark, sf), rotations(spark, sf)), 4)


@query(
    "f4_similarity_matrix_of_structures",
    f"""WITH {_SMOOTH}, unit AS (SELECT structure, pos, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM dense WINDOW w AS (PARTITION BY structure)),
        pool AS (SELECT structure, (pos // 1024) * 16 + ((pos // 64) % 4) * 4 + (pos // 4) % 4 AS cell, avg(v) / 40 AS v FROM unit GROUP BY ALL), feat AS (SELECT structure, list(v ORDER BY cell) AS f FROM pool GROUP BY structure),
        pr AS (SELECT a.structure AS i, b.structure AS j, list_cosine_similarity(a.f, b.f) AS affinity FROM feat a JOIN feat b ON a.structure <> b.structure)
        SELECT i, j, round((affinity - (SELECT min(affinity) FROM pr)) / (SELECT max(affinity) - min(affinity) FROM pr), 6) AS affinity FROM pr""",
    ("atoms",),
)
def f4_similarity_matrix_of_structures(spark, sf):
    return rounded(similarity_matrix(t.atoms(spark, sf), 16, 40.0, 100.0, 4)[1])
