"""Queries on volumes and structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.catalog import tables as t
from motefield.catalog.registry import query, rounded
from motefield.operators import structures as st
from motefield.operators import volume_metrics as vm
from motefield.operators import volumes as ops

S = t.SEED


def voxels(df, *keys):
    """Packed volumes as rounded (keys, pos, v) rows."""
    return rounded(df.select(*keys, F.posexplode("data").alias("pos", "v")))


_POS4 = "(z * 16 + y * 4 + x)::INT AS pos"
_POS8 = "(z * 64 + y * 8 + x)::INT AS pos"
_U = "('0x' || substr(md5(concat_ws('|', {})), {}, 8))::UBIGINT / 4294967296.0"


@query(
    "e1_volume_stats",
    """SELECT vec_id AS vol, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.5), 6) AS median,
              round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99,
              count(*)::INT AS n_voxels FROM vox4 GROUP BY vec_id""",
    ("vox4",),
)
def e1_volume_stats(spark, sf):
    return rounded(ops.volume_stats(t.volumes4(spark, sf)).drop("label", "shape"))


_STATS = "s AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99, quantile_cont(v, 0.02) AS p2, quantile_cont(v, 0.98) AS p98 FROM vox4 GROUP BY vec_id)"


@query("e2_normalize_zscore", f"WITH {_STATS} SELECT vec_id AS vol, {_POS4}, round((v - m) / (sd + 1e-6), 6) AS v FROM vox4 JOIN s USING (vec_id)", ("vox4",))
def e2_normalize_zscore(spark, sf):
    return voxels(ops.normalize(t.volumes4(spark, sf)), "vol")


@query("e2_normalize_minmax", f"WITH {_STATS} SELECT vec_id AS vol, {_POS4}, round((v - lo) / (hi - lo + 1e-6), 6) AS v FROM vox4 JOIN s USING (vec_id)", ("vox4",))
def e2_normalize_minmax(spark, sf):
    return voxels(ops.normalize(t.volumes4(spark, sf), "min-max"), "vol")


@query(
    "e2_normalize_percentile",
    f"WITH {_STATS} SELECT vec_id AS vol, {_POS4}, round(least(greatest((v - p1) / (p99 - p1 + 1e-6), 0), 1), 6) AS v FROM vox4 JOIN s USING (vec_id)",
    ("vox4",),
)
def e2_normalize_percentile(spark, sf):
    return voxels(ops.normalize(t.volumes4(spark, sf), "percentile"), "vol")


@query("e3_normalize_dataset_zscore", f"WITH {_STATS} SELECT vec_id AS vol, {_POS4}, round((v - m) / sd, 6) AS v FROM vox4 JOIN s USING (vec_id)", ("vox4",))
def e3_normalize_dataset_zscore(spark, sf):
    return voxels(ops.normalize(t.volumes4(spark, sf), rule="dataset"), "vol")


@query(
    "e3_normalize_dataset_percentile",
    f"WITH {_STATS} SELECT vec_id AS vol, {_POS4}, round(least(greatest((v - p2) / (p98 - p2), 0), 1), 6) AS v FROM vox4 JOIN s USING (vec_id)",
    ("vox4",),
)
def e3_normalize_dataset_percentile(spark, sf):
    return voxels(ops.normalize(t.volumes4(spark, sf), "percentile", "dataset"), "vol")


@query("e4_denormalize", f"WITH {_STATS} SELECT vec_id AS vol, {_POS4}, round((v - m) / (sd + 1e-6) * sd + m, 6) AS v FROM vox4 JOIN s USING (vec_id)", ("vox4",))
def e4_denormalize(spark, sf):
    return voxels(ops.denormalize(ops.normalize(t.volumes4(spark, sf))), "vol")


@query(
    "e5_center_crop",
    "SELECT vol, ((z - 2) * 24 + (y - 2) * 8 + x)::INT AS pos, round(v, 6) AS v FROM vox8 WHERE z BETWEEN 2 AND 5 AND y BETWEEN 2 AND 4",
    ("vox8",),
)
def e5_center_crop(spark, sf):
    return voxels(ops.center_crop(t.volumes8(spark, sf), (4, 3, 16)), "vol")


def _projection_sql(agg):
    return f"""WITH p AS (SELECT vec_id, 0 AS axis, y * 4 + x AS pos, {agg}(v) AS v FROM vox4 GROUP BY ALL UNION ALL SELECT vec_id, 1, z * 4 + x, {agg}(v) FROM vox4 GROUP BY ALL
        UNION ALL SELECT vec_id, 2, z * 4 + y, {agg}(v) FROM vox4 GROUP BY ALL)
        SELECT vec_id AS vol, axis, pos::INT AS pos, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS v FROM p WINDOW w AS (PARTITION BY vec_id, axis)"""


def _projected(spark, sf, agg):
    return rounded(ops.projections(t.volumes4(spark, sf), agg).select("vol", "axis", F.posexplode("image").alias("pos", "v")))


@query("e6_projections_sum", _projection_sql("sum"), ("vox4",))
def e6_projections_sum(spark, sf):
    return _projected(spark, sf, "sum")


@query("e6_projections_mean", _projection_sql("avg"), ("vox4",))
def e6_projections_mean(spark, sf):
    return _projected(spark, sf, "mean")


@query("e6_projections_max", _projection_sql("max"), ("vox4",))
def e6_projections_max(spark, sf):
    return _projected(spark, sf, "max")


@query(
    "e7_pool_features",
    "SELECT vol, ((z // 4) * 4 + (y // 4) * 2 + x // 4)::INT AS pos, round(avg(v) / 10, 6) AS v FROM vox8 GROUP BY ALL",
    ("vox8",),
)
def e7_pool_features(spark, sf):
    return voxels(ops.pool_features(t.volumes8(spark, sf), 4, 10.0).withColumnRenamed("feature", "data"), "vol")


@query(
    "e8_soft_mask",
    f"""WITH r AS (SELECT vol, {_POS8}, v, sqrt((z - 4) ** 2 + (y - 4) ** 2 + (x - 4) ** 2) AS r FROM vox8)
        SELECT vol, pos, round(CASE WHEN r <= 2 THEN v WHEN r < 3.5 THEN v * exp(-((r - 2) ** 2) / (2 * 0.25)) ELSE 0 END, 6) AS v FROM r""",
    ("vox8",),
)
def e8_soft_mask(spark, sf):
    return voxels(ops.soft_mask(t.volumes8(spark, sf), 2.0, 1.5), "vol")


def _slope(axis, others, table, key, n):
    w = f"(PARTITION BY {key}, {others} ORDER BY {axis})"
    return f"CASE {axis} WHEN 0 THEN lead(v) OVER {w} - v WHEN {n - 1} THEN v - lag(v) OVER {w} ELSE (lead(v) OVER {w} - lag(v) OVER {w}) / 2 END"


_EDGE8 = f"""g AS (SELECT vol, z, y, x, v, {_slope('z', 'y, x', 'vox8', 'vol', 8)} AS gz, {_slope('y', 'z, x', 'vox8', 'vol', 8)} AS gy, {_slope('x', 'z, y', 'vox8', 'vol', 8)} AS gx FROM vox8)"""


@query("e9_edge_strength", f"WITH {_EDGE8} SELECT vol, round(avg(sqrt(gz * gz + gy * gy + gx * gx)), 6) AS edge_strength FROM g GROUP BY vol", ("vox8",))
def e9_edge_strength(spark, sf):
    return rounded(ops.edge_strength(t.volumes8(spark, sf)).select("vol", "edge_strength"))


@query(
    "e10_local_histogram",
    f"""WITH o AS (SELECT a.d AS dz, b.d AS dy, c.d AS dx FROM UNNEST([-1, 0, 1]) AS a(d), UNNEST([-1, 0, 1]) AS b(d), UNNEST([-1, 0, 1]) AS c(d)),
        n AS (SELECT p.vec_id, p.z, p.y, p.x, coalesce(q.v, 0) AS v FROM vox4 p CROSS JOIN o LEFT JOIN vox4 q ON q.vec_id = p.vec_id AND q.z = p.z + dz AND q.y = p.y + dy AND q.x = p.x + dx)
        SELECT vec_id AS vol, {_POS4}, least(floor((v + 1) * 16), 31)::INT AS bin, round(count(*) / 27, 6) AS share FROM n WHERE v BETWEEN -1 AND 1 GROUP BY ALL""",
    ("vox4",),
)
def e10_local_histogram(spark, sf):
    return rounded(ops.local_histogram(t.volumes4(spark, sf)).drop("label"))


def _draw(name):
    return _U.format(f"vec_id, '{S}{name}'", 1)


_PLAN = f"""plan AS (SELECT vec_id, CASE WHEN {_draw('r')} < 0.5 THEN floor({_draw('k')} * 3)::INT + 1 ELSE 0 END AS turns,
          CASE WHEN {_draw('n')} < 0.7 THEN 0.05 + {_draw('s')} * 0.15 ELSE 0 END::DOUBLE AS noise,
          CASE WHEN {_draw('c')} < 0.7 THEN 0.7 + {_draw('f')} * 0.6 ELSE 1 END::DOUBLE AS contrast,
          CASE WHEN {_draw('c')} < 0.7 THEN -0.1 + {_draw('b')} * 0.2 ELSE 0 END::DOUBLE AS brightness FROM emb)"""


@query(
    "e11_augment_plan",
    f"WITH {_PLAN} SELECT vec_id AS vol, turns, round(noise, 6) AS noise, round(contrast, 6) AS contrast, round(brightness, 6) AS brightness FROM plan",
    ("emb",),
)
def e11_augment_plan(spark, sf):
    return rounded(ops.augment_plan(t.volumes4(spark, sf).select("vol"), S))


@query(
    "e11_augment_without_noise",
    f"""WITH {_PLAN}, m AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd FROM vox4 GROUP BY vec_id),
        r AS (SELECT vec_id, x, v, contrast, brightness, CASE turns WHEN 1 THEN 3 - y WHEN 2 THEN 3 - z WHEN 3 THEN y ELSE z END AS z,
              CASE turns WHEN 1 THEN z WHEN 2 THEN 3 - y WHEN 3 THEN 3 - z ELSE y END AS y FROM vox4 JOIN plan USING (vec_id))
        SELECT vec_id AS vol, {_POS4}, round(contrast * (v - m) + m + brightness * sd, 6) AS v FROM r JOIN m USING (vec_id)""",
    ("vox4",),
)
def e11_augment_without_noise(spark, sf):
    return voxels(ops.augment(t.volumes4(spark, sf), S, noise_prob=0.0), "vol")


@query("e11_augment")
def e11_augment(spark, sf):
    return voxels(ops.augment(t.volumes4(spark, sf), S), "vol")


@query(
    "e12_match_stats",
    f"""WITH m AS (SELECT vec_id, label, avg(v) AS m, stddev_pop(v) AS sd FROM vox4 GROUP BY ALL), s AS (SELECT m.label, m.m AS sm, m.sd AS ssd FROM m JOIN template_of t ON m.vec_id = t.template_id)
        SELECT vec_id AS vol, {_POS4}, round((v - m) / sd * ssd + sm, 6) AS v FROM vox4 JOIN m USING (vec_id) JOIN s ON s.label = vox4.label""",
    ("vox4", "template_of"),
)
def e12_match_stats(spark, sf):
    base = t.volumes4(spark, sf)
    source = base.join(t.templates(spark, sf).select(F.col("template_id").alias("vol")), "vol", "left_semi").select("label", F.col("data").alias("source"))
    return voxels(ops.match_stats(base.join(source, "label")), "vol")


@query("e13_mean_volume", f"SELECT label, {_POS8}, round(avg(v), 6) AS v FROM vox8 GROUP BY ALL", ("vox8",))
def e13_mean_volume(spark, sf):
    return voxels(ops.mean_volume(t.volumes8(spark, sf), ["label"]), "label")


_CENTERS = "c AS (SELECT structure, sum(mass) AS m, sum(mass * x) / sum(mass) AS cx, sum(mass * y) / sum(mass) AS cy, sum(mass * z) / sum(mass) AS cz FROM atoms GROUP BY structure)"


@query(
    "e14_structure_info",
    f"""WITH {_CENTERS}, e AS (SELECT structure, count(*) AS n_atoms, count(DISTINCT chain)::INT AS n_chains, sum(mass) AS mass, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM atoms GROUP BY structure),
        g AS (SELECT structure, sqrt(sum(mass * ((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) / sum(mass)) AS rg FROM atoms JOIN c USING (structure) GROUP BY structure)
        SELECT structure, n_atoms, n_chains, round(mass, 6) AS mass, round(cx, 6) AS center_x, round(cy, 6) AS center_y, round(cz, 6) AS center_z, round(ex, 6) AS extent_x, round(ey, 6) AS extent_y,
               round(ez, 6) AS extent_z, round(rg, 6) AS radius_of_gyration, round(greatest(ex, ey, ez), 6) AS max_extent, round(greatest(ex, ey, ez) / 10, 6) AS diameter_nm, round(mass / 1000, 6) AS mass_kda
        FROM e JOIN c USING (structure) JOIN g USING (structure)""",
    ("atoms",),
)
def e14_structure_info(spark, sf):
    return rounded(st.structure_info(t.atoms(spark, sf)))


_RASTER = f"""{_CENTERS}, p AS (SELECT structure, mass, (x - cx) / 40 + 8 AS x, (y - cy) / 40 + 8 AS y, (z - cz) / 40 + 8 AS z FROM atoms JOIN c USING (structure)),
     b AS (SELECT structure, mass, floor(x)::INT AS i, floor(y)::INT AS j, floor(z)::INT AS k, x - floor(x) AS fx, y - floor(y) AS fy, z - floor(z) AS fz FROM p
           WHERE x >= 0 AND x < 15 AND y >= 0 AND y < 15 AND z >= 0 AND z < 15),
     raster AS (SELECT structure, i + d // 4 AS i, j + (d // 2) % 2 AS j, k + d % 2 AS k,
           sum(mass * (CASE d // 4 WHEN 0 THEN 1 - fx ELSE fx END) * (CASE (d // 2) % 2 WHEN 0 THEN 1 - fy ELSE fy END) * (CASE d % 2 WHEN 0 THEN 1 - fz ELSE fz END)) AS density
           FROM b, UNNEST(range(8)) AS u(d) GROUP BY ALL)"""


@query("e15_rasterize", f"WITH {_RASTER} SELECT structure, i::INT AS i, j::INT AS j, k::INT AS k, round(density, 6) AS density FROM raster", ("atoms",))
def e15_rasterize(spark, sf):
    return rounded(st.rasterize(t.atoms(spark, sf), 16, 40.0))


def _smooth_pass(src, dst, axis):
    others = [a for a in "ijk" if a != axis]
    place = f"((g.{axis} + o + 32) % 32)"
    return f"""{dst} AS MATERIALIZED (SELECT g.structure, g.i, g.j, g.k, sum(w * s.density) AS density FROM grid g CROSS JOIN kernel
        JOIN {src} s ON s.structure = g.structure AND s.{others[0]} = g.{others[0]} AND s.{others[1]} = g.{others[1]} AND s.{axis} = CASE WHEN {place} < 16 THEN {place} ELSE 31 - {place} END GROUP BY ALL)"""


_SMOOTH = f"""{_RASTER.replace("raster AS (", "raster AS MATERIALIZED (")}, kernel AS (SELECT o, exp(-0.5 * (o / (100 / 94.2)) ** 2) / sum(exp(-0.5 * (o / (100 / 94.2)) ** 2)) OVER () AS w FROM UNNEST(range(-4, 5)) AS u(o)),
     grid AS MATERIALIZED (SELECT structure, a.i, b.i AS j, d.i AS k FROM c, UNNEST(range(16)) AS a(i), UNNEST(range(16)) AS b(i), UNNEST(range(16)) AS d(i)),
     {_smooth_pass('raster', 's1', 'i')}, {_smooth_pass('s1', 's2', 'j')}, {_smooth_pass('s2', 's3', 'k')},
     dense AS (SELECT g.structure, ((g.i * 16 + g.j) * 16 + g.k)::INT AS pos, coalesce(s3.density, 0) AS v FROM grid g LEFT JOIN s3 ON s3.structure = g.structure AND s3.i = g.i AND s3.j = g.j AND s3.k = g.k)"""


@query("e16_smooth", f"WITH {_SMOOTH} SELECT structure, pos, round(v, 6) AS v FROM dense", ("atoms",))
def e16_smooth(spark, sf):
    packed = st.pack_density(st.rasterize(t.atoms(spark, sf), 16, 40.0), 16)
    return voxels(st.smooth(packed, st.resolution_sigma(100.0, 40.0)), "structure")


@query(
    "e16_atom_density",
    f"WITH {_SMOOTH} SELECT structure, pos, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS v FROM dense WINDOW w AS (PARTITION BY structure)",
    ("atoms",),
)
def e16_atom_density(spark, sf):
    return voxels(st.atom_density(t.atoms(spark, sf), 16, 40.0, 100.0), "structure")


@query(
    "e17_render_splats",
    """SELECT set_id, (a.i * 36 + b.i * 6 + c.i)::INT AS pos, round(sum(w * exp(-0.5 * ((a.i - 3 * (x + 1)) ** 2 + (b.i - 3 * (y + 1)) ** 2 + (c.i - 3 * (z + 1)) ** 2) / (4 * sigma * sigma))), 6) AS v
       FROM splats, UNNEST(range(6)) AS a(i), UNNEST(range(6)) AS b(i), UNNEST(range(6)) AS c(i) GROUP BY ALL""",
    ("splats",),
)
def e17_render_splats(spark, sf):
    placed = t.splats(spark, sf).select("set_id", "splat_id", *[(3 * (F.col(a) + 1)).alias(a) for a in "xyz"], (2 * F.col("sigma")).alias("sigma"), "w")
    return voxels(st.render_splats(placed, (6, 6, 6)), "set_id")


@query(
    "e17_render_splats_rotated",
    """SELECT set_id, (a.i * 36 + b.i * 6 + c.i)::INT AS pos, round(sum(w * exp(-0.5 * ((a.i + 3 * (y + 1) - 4) ** 2 + (b.i - 3 * (x + 1)) ** 2 + (c.i - 3 * (z + 1)) ** 2) / (4 * sigma * sigma))), 6) AS v
       FROM (SELECT set_id, w, sigma, x, y - 4.0 / 3 AS y, z FROM splats), UNNEST(range(6)) AS a(i), UNNEST(range(6)) AS b(i), UNNEST(range(6)) AS c(i) GROUP BY ALL""",
    ("splats",),
)
def e17_render_splats_rotated(spark, sf):
    placed = t.splats(spark, sf).select(
        "set_id", "splat_id", (3 * (F.col("x") + 1)).alias("x"), (3 * (F.col("y") + 1) - 8).alias("y"), (3 * (F.col("z") + 1)).alias("z"), (2 * F.col("sigma")).alias("sigma"), "w"
    )
    return voxels(st.render_splats(placed, (6, 6, 6), rotation=[[0, -1, 0], [1, 0, 0], [0, 0, 1]]), "set_id")


@query(
    "e18_render_splats_clamped",
    """WITH s AS (SELECT set_id, x, y, z, least(greatest(3 * w - 0.1, 0), 1) AS w, least(greatest(sigma * 0.45 + 0.05, 1e-6), 1) AS sd FROM splats)
       SELECT set_id, (a.i * 25 + b.i * 5 + c.i)::INT AS pos,
              round(least(greatest(sum(w * exp(-0.5 * ((a.i / 2 - 1 - x) ** 2 + (b.i / 2 - 1 - y) ** 2 + (c.i / 2 - 1 - z) ** 2) / (sd * sd))), 0), 1), 6) AS v
       FROM s, UNNEST(range(5)) AS a(i), UNNEST(range(5)) AS b(i), UNNEST(range(5)) AS c(i) GROUP BY ALL""",
    ("splats",),
)
def e18_render_splats_clamped(spark, sf):
    weighted = t.splats(spark, sf).withColumn("w", 3 * F.col("w") - 0.1)
    return voxels(st.render_splats_clamped(weighted, (5, 5, 5), (0.05, 0.5)), "set_id")


_QUALITY = """SELECT vol, round(m, 6) AS mean_intensity, round(sd, 6) AS std_intensity, round(hi - lo, 6) AS dynamic_range, round(act, 6) AS active_fraction,
     round(CASE WHEN abs(m) > 1e-10 THEN sd / abs(m) ELSE 0 END, 4) AS contrast, round(edge, 6) AS edge_strength, round(10 * log10(p / (sd * sd)), 6) AS snr_db FROM q"""


def _quality_sql(mask):
    return f"""WITH {_EDGE8}, i AS (SELECT * FROM g WHERE {mask}), a AS (SELECT vol, avg(v) AS m, stddev_pop(v) AS sd, max(v) AS hi, min(v) AS lo, avg(v * v) AS p,
        avg(sqrt(gz * gz + gy * gy + gx * gx)) AS edge FROM i GROUP BY vol), k AS (SELECT vol, avg((abs(v) > 0.1 * sd)::INT) AS act FROM i JOIN a USING (vol) GROUP BY vol),
        q AS (SELECT * FROM a JOIN k USING (vol)) {_QUALITY}"""


def _quality(df):
    return rounded(df.select("vol", *vm.QUALITY).withColumn("contrast", F.round("contrast", 4)))


@query("i1_volume_quality", _quality_sql("true"), ("vox8",))
def i1_volume_quality(spark, sf):
    return _quality(vm.volume_quality(t.volumes8(spark, sf)))


@query("i1_volume_quality_masked", _quality_sql("(z - 4) ** 2 + (y - 4) ** 2 + (x - 4) ** 2 <= 9"), ("vox8",))
def i1_volume_quality_masked(spark, sf):
    def inside(p):
        z, y, x = F.shiftright(p, 6) - 4, F.pmod(F.shiftright(p, 3), F.lit(8)) - 4, F.pmod(p, F.lit(8)) - 4
        return (z * z + y * y + x * x <= 9).cast("double")

    masked = t.volumes8(spark, sf).withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(511)), inside))
    return _quality(vm.volume_quality(masked, "mask"))


_MOMENTS = """m AS (SELECT vol, avg((va - vb) ** 2) AS mse, greatest(max(abs(va)), max(abs(vb))) AS peak, corr(va, vb) AS c, avg(va * vb) AS ab, avg(va * va) AS aa, avg(vb * vb) AS bb,
      var_pop(va) AS sa, var_pop(vb) AS sb, covar_pop(va, vb) AS sab FROM pair8 GROUP BY vol)"""


@query(
    "i2_pair_metrics",
    f"WITH {_MOMENTS} SELECT vol, round(mse, 6) AS mse, round(20 * log10(peak / sqrt(mse)), 6) AS psnr, round(coalesce(c, 0), 6) AS correlation FROM m",
    ("pair8",),
)
def i2_pair_metrics(spark, sf):
    return rounded(vm.pair_metrics(t.volume_pairs8(spark, sf)).select("vol", "mse", "psnr", "correlation"))


@query(
    "i3_ssim",
    f"""WITH {_MOMENTS} SELECT vol, round(least(greatest((2 * ab + 1e-4) * (2 * sab + 9e-4) / ((aa + bb + 1e-4) * (sa + sb + 9e-4)), 0), 1), 6) AS ssim FROM m""",
    ("pair8",),
)
def i3_ssim(spark, sf):
    return rounded(vm.pair_metrics(t.volume_pairs8(spark, sf)).select("vol", "ssim"))


# Discrete Fourier transform of 8x8x8 volumes, one axis after the other; frequencies from -4 to 3.
_SPECTRUM = """f AS (SELECT UNNEST(range(-4, 4)) AS k),
     d1 AS (SELECT vol, label, z, y, k AS fx, sum(v * cos(2 * pi() * k * x / 8)) AS re, sum(-v * sin(2 * pi() * k * x / 8)) AS im FROM vox8, f GROUP BY ALL),
     d2 AS (SELECT vol, label, z, k AS fy, fx, sum(re * cos(2 * pi() * k * y / 8) + im * sin(2 * pi() * k * y / 8)) AS re,
            sum(im * cos(2 * pi() * k * y / 8) - re * sin(2 * pi() * k * y / 8)) AS im FROM d1, f GROUP BY ALL),
     spec AS (SELECT vol, label, k AS fz, fy, fx, sum(re * cos(2 * pi() * k * z / 8) + im * sin(2 * pi() * k * z / 8)) AS re,
            sum(im * cos(2 * pi() * k * z / 8) - re * sin(2 * pi() * k * z / 8)) AS im FROM d2, f GROUP BY ALL)"""
_SPECTRUM_PAIR = f"""{_SPECTRUM}, sp AS (SELECT a.vol, a.fz, a.fy, a.fx, sqrt(a.fz ** 2 + a.fy ** 2 + a.fx ** 2) AS r, a.re * b.re + a.im * b.im AS cross_power,
     a.re ** 2 + a.im ** 2 AS pa, b.re ** 2 + b.im ** 2 AS pb, (a.re - b.re) ** 2 + (a.im - b.im) ** 2 AS d2
     FROM spec a JOIN spec b ON b.vol = a.vol + 1 AND a.fz = b.fz AND a.fy = b.fy AND a.fx = b.fx)"""
_CURVE = "curve AS (SELECT vol, floor(r + 0.5)::INT AS shell, sum(cross_power) / sqrt(sum(pa) * sum(pb)) AS fsc, 80.0 / (2 * floor(r + 0.5)) AS resolution FROM sp WHERE r >= 0.5 AND r < 3.5 GROUP BY ALL HAVING count(*) >= 10)"


def _resolution_sql(keys, threshold=0.5):
    return f"""places AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY shell) AS i FROM curve),
     marks AS (SELECT {keys}, max(i) FILTER (fsc >= {threshold}) AS above, min(i) FILTER (fsc < {threshold}) AS below, count(*) AS n, list(fsc ORDER BY i) AS f, list(resolution ORDER BY i) AS res FROM places GROUP BY ALL),
     resolved AS (SELECT {keys}, CASE WHEN n = 1 OR above IS NULL THEN res[1] WHEN below IS NULL THEN res[n] WHEN below = above + 1
       THEN res[above] + ({threshold} - f[above]) / (f[below] - f[above]) * (res[below] - res[above]) ELSE res[below] END AS resolution FROM marks)"""


@query("i4_fsc_curve", f"WITH {_SPECTRUM_PAIR}, {_CURVE} SELECT vol, shell, round(fsc, 6) AS fsc, round(resolution, 6) AS resolution FROM curve", ("vox8",))
def i4_fsc_curve(spark, sf):
    return rounded(vm.fsc_curve(t.volume_pairs8(spark, sf), 10.0).select("vol", "shell", "fsc", "resolution"))


@query("i4_fsc_resolution", f"WITH {_SPECTRUM_PAIR}, {_CURVE}, {_resolution_sql('vol', 0.02)} SELECT vol, round(resolution, 6) AS resolution FROM resolved", ("vox8",))
def i4_fsc_resolution(spark, sf):
    curve = vm.fsc_curve(t.volume_pairs8(spark, sf), 10.0)
    return rounded(vm.fsc_resolution(curve, ["vol"], 0.02))


_SIMPLE = "curve AS (SELECT vol, floor(r)::INT AS shell, coalesce(sum(cross_power) / nullif(sqrt(sum(pa) * sum(pb)), 0), 0) AS fsc, floor(r) + 0.5 AS frequency FROM sp WHERE r < 4 GROUP BY ALL)"


@query("i5_fsc_simple_curve", f"WITH {_SPECTRUM_PAIR}, {_SIMPLE} SELECT vol, shell, round(fsc, 6) AS fsc, frequency FROM curve", ("vox8",))
def i5_fsc_simple_curve(spark, sf):
    return rounded(vm.fsc_simple(t.volume_pairs8(spark, sf), ["vol"])[0])


@query(
    "i5_fsc_simple_resolution",
    f"WITH {_SPECTRUM_PAIR}, {_SIMPLE} SELECT vol, coalesce(min(frequency) FILTER (fsc < 0.5), max(frequency)) AS resolution FROM curve GROUP BY vol",
    ("vox8",),
)
def i5_fsc_simple_resolution(spark, sf):
    return vm.fsc_simple(t.volume_pairs8(spark, sf), ["vol"])[1]


@query(
    "i6_wedge_error",
    f"""WITH {_SPECTRUM_PAIR}, h AS (SELECT *, CASE WHEN fz = 0 THEN pi() / 2 ELSE atan2(abs(fx) / 8, abs(fz) / 8) END AS tilt FROM sp WHERE fx IN (0, 1, 2, 3, -4)),
        w AS (SELECT vol, d2, (0.3 + 0.7 * (1 - 1 / (1 + exp(-100 * (pi() / 4 - tilt))))) * exp(-r / 8) AS w FROM h)
        SELECT vol, round(sum(d2 * w * w) / (sum(w) * 512), 6) AS wedge_error FROM w GROUP BY vol""",
    ("vox8",),
)
def i6_wedge_error(spark, sf):
    return rounded(vm.wedge_error(t.volume_pairs8(spark, sf)).select("vol", "wedge_error"))


COUNTS = (2, 3, 5)
_CONVERGENCE = f"""{_SPECTRUM}, ranked AS (SELECT DISTINCT label, vol, dense_rank() OVER (PARTITION BY label ORDER BY vol) AS rn FROM vox8),
     counts AS (SELECT label, n FROM (SELECT label, max(rn) AS total FROM ranked GROUP BY label), UNNEST([2, 3, 5]) AS u(n) WHERE n <= total),
     part AS (SELECT c.label, c.n, r.vol FROM counts c JOIN ranked r ON r.label = c.label AND r.rn <= c.n),
     av AS (SELECT p.label, p.n, z, y, x, avg(v) AS va FROM part p JOIN vox8 v ON v.vol = p.vol GROUP BY ALL), bv AS (SELECT label, z, y, x, avg(v) AS vb FROM vox8 GROUP BY ALL),
     pm AS (SELECT label, n, avg((va - vb) ** 2) AS mse, greatest(max(abs(va)), max(abs(vb))) AS peak, corr(va, vb) AS c, avg(va * vb) AS ab, avg(va * va) AS aa, avg(vb * vb) AS bb,
            var_pop(va) AS sa, var_pop(vb) AS sb, covar_pop(va, vb) AS sab FROM av JOIN bv USING (label, z, y, x) GROUP BY ALL),
     sa AS (SELECT p.label, p.n, fz, fy, fx, avg(re) AS re, avg(im) AS im FROM part p JOIN spec s ON s.vol = p.vol GROUP BY ALL), sb AS (SELECT label, fz, fy, fx, avg(re) AS re, avg(im) AS im FROM spec GROUP BY ALL),
     sp AS (SELECT a.label, a.n, sqrt(a.fz ** 2 + a.fy ** 2 + a.fx ** 2) AS r, a.re * b.re + a.im * b.im AS cross_power, a.re ** 2 + a.im ** 2 AS pa, b.re ** 2 + b.im ** 2 AS pb
            FROM sa a JOIN sb b ON a.label = b.label AND a.fz = b.fz AND a.fy = b.fy AND a.fx = b.fx),
     {_CURVE.replace('SELECT vol,', 'SELECT label, n,')}, {_resolution_sql('label, n').replace('count(*) AS n,', 'count(*) AS size,').replace('n = 1', 'size = 1').replace('res[n]', 'res[size]')},
     report AS (SELECT label, n, round(mse, 6) AS mse, round(20 * log10(peak / sqrt(mse)), 6) AS psnr, round(c, 6) AS correlation,
            round(least(greatest((2 * ab + 1e-4) * (2 * sab + 9e-4) / ((aa + bb + 1e-4) * (sa + sb + 9e-4)), 0), 1), 6) AS ssim, round(resolution, 6) AS resolution FROM pm JOIN resolved USING (label, n))"""


def _convergence(spark, sf):
    vols = t.volumes8(spark, sf)
    reference = ops.mean_volume(vols, ["label"]).withColumn("shape", F.array(*[F.lit(8)] * 3))
    return rounded(vm.convergence(vols, reference, COUNTS, "label", "vol", 10.0))


@query("i7_convergence", f"WITH {_CONVERGENCE} SELECT * FROM report", ("vox8",))
def i7_convergence(spark, sf):
    return _convergence(spark, sf)


@query("i8_summary_at_max", f"WITH {_CONVERGENCE} SELECT * FROM report QUALIFY n = max(n) OVER (PARTITION BY label)", ("vox8",))
def i8_summary_at_max(spark, sf):
    return vm.summary_at_max(_convergence(spark, sf), "label")


_NORMAL = f"""sqrt(-2 * ln(1 - {_U.format(f"vec_id, z * 16 + y * 4 + x, c, {S}", 1)})) * cos(2 * pi() * {_U.format(f"vec_id, z * 16 + y * 4 + x, c, {S}", 9)})"""


@query(
    "i9_resample_spread",
    f"""WITH sd AS (SELECT vec_id, stddev_pop(v) AS sd FROM vox4 GROUP BY vec_id),
        c AS (SELECT vec_id, z, y, x, v, CASE c WHEN 0 THEN v ELSE v + 0.1 * sd * {_NORMAL} END AS nv FROM vox4 JOIN sd USING (vec_id), UNNEST(range(4)) AS u(c))
        SELECT vec_id AS vol, {_POS4}, round(avg(nv), 6) AS mean, round(var_pop(nv) * 1000, 6) AS variance_e3 FROM c GROUP BY ALL""",
    ("vox4",),
)
def i9_resample_spread(spark, sf):
    vols = t.volumes4(spark, sf)
    std = ops.volume_stats(vols).select("vol", "std")
    spread = vm.resample_spread(vols.join(std, "vol"), 4, 0.1, S)
    return rounded(spread.select("vol", "pos", "mean", (F.col("variance") * 1000).alias("variance_e3")))


@query("i10_normalized_mse", "SELECT round(sum((va - vb) ** 2) / (count(DISTINCT vol) * 512), 6) AS normalized_mse FROM pair8", ("pair8",))
def i10_normalized_mse(spark, sf):
    return rounded(vm.normalized_mse(t.volume_pairs8(spark, sf), 512))
