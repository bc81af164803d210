"""Queries on poses and splat sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.catalog import tables as t
from motefield.catalog.registry import query, rounded
from motefield.functions import rotations as rot
from motefield.operators import poses as ops
from motefield.operators import splats as sp


def rotations(spark, sf):
    return t.poses(spark, sf).select(
        "vec_id", "label", rot.quaternion_to_matrix(F.col("q_true")).alias("r_true"), rot.quaternion_to_matrix(F.col("q_pred")).alias("r_pred")
    )


def cells(df, col, *keys):
    return rounded(df.select(*keys, F.posexplode(col).alias("pos", "v")))


_UNROLL9 = "UNNEST(range(1, 10)) AS u(i)"


@query("j1_quaternion_to_matrix", f"SELECT vec_id, (i - 1)::INT AS pos, round(rt[i], 6) AS v FROM rotations, {_UNROLL9}", ("rotations",))
def j1_quaternion_to_matrix(spark, sf):
    return cells(rotations(spark, sf), "r_true", "vec_id")


@query(
    "j1_axis_angle_to_matrix",
    f"""WITH a AS (SELECT vec_id, CASE WHEN label = 9 THEN 0 ELSE 3 * e[1] END AS t, CASE WHEN label = 9 THEN [1.0, 0, 0] ELSE list_transform(e[2:4], lambda v: v / sqrt(list_dot_product(e[2:4], e[2:4]))) END AS n FROM emb),
        m AS (SELECT vec_id, [cos(t) + n[1]*n[1]*(1-cos(t)), n[1]*n[2]*(1-cos(t)) - n[3]*sin(t), n[1]*n[3]*(1-cos(t)) + n[2]*sin(t),
              n[2]*n[1]*(1-cos(t)) + n[3]*sin(t), cos(t) + n[2]*n[2]*(1-cos(t)), n[2]*n[3]*(1-cos(t)) - n[1]*sin(t),
              n[3]*n[1]*(1-cos(t)) - n[2]*sin(t), n[3]*n[2]*(1-cos(t)) + n[1]*sin(t), cos(t) + n[3]*n[3]*(1-cos(t))] AS m FROM a)
        SELECT vec_id, (i - 1)::INT AS pos, round(m[i], 6) AS v FROM m, {_UNROLL9}""",
    ("emb",),
)
def j1_axis_angle_to_matrix(spark, sf):
    axis = F.when(F.col("label") == 9, F.array(*[F.lit(0.0)] * 3)).otherwise(F.slice("e", 2, 3))
    df = t.emb(spark, sf).select("vec_id", rot.axis_angle_to_matrix(F.concat(F.array(3.0 * F.get("e", 0)), axis)).alias("m"))
    return cells(df, "m", "vec_id")


@query("j1_matrix_to_quaternion", "SELECT vec_id, (i - 1)::INT AS pos, round(qt[i] * CASE WHEN qt[1] < 0 THEN -1 ELSE 1 END, 6) AS v FROM poses, UNNEST(range(1, 5)) AS u(i)", ("poses",))
def j1_matrix_to_quaternion(spark, sf):
    df = rotations(spark, sf).select("vec_id", rot.matrix_to_quaternion(F.col("r_true")).alias("q"))
    return cells(df, "q", "vec_id")


@query(
    "j1_matrix_to_axis_angle",
    """WITH p AS (SELECT vec_id, list_transform(qt, lambda v: v * CASE WHEN qt[1] < 0 THEN -1 ELSE 1 END) AS q FROM poses),
       a AS (SELECT vec_id, [2 * acos(q[1]), q[2] / sqrt(1 - q[1] * q[1]), q[3] / sqrt(1 - q[1] * q[1]), q[4] / sqrt(1 - q[1] * q[1])] AS a FROM p)
       SELECT vec_id, (i - 1)::INT AS pos, round(a[i], 6) AS v FROM a, UNNEST(range(1, 5)) AS u(i)""",
    ("poses",),
)
def j1_matrix_to_axis_angle(spark, sf):
    df = rotations(spark, sf).select("vec_id", rot.matrix_to_axis_angle(F.col("r_true")).alias("a"))
    return cells(df, "a", "vec_id")


@query(
    "j1_matrix_to_euler",
    """WITH p AS (SELECT vec_id, [degrees(atan2(rt[8], rt[9])), degrees(asin(-rt[7])), degrees(atan2(rt[4], rt[1]))] AS a FROM rotations)
       SELECT vec_id, (i - 1)::INT AS pos, round(a[i], 6) AS v FROM p, UNNEST(range(1, 4)) AS u(i)""",
    ("rotations",),
)
def j1_matrix_to_euler(spark, sf):
    df = rotations(spark, sf).select("vec_id", rot.matrix_to_euler(F.col("r_true")).alias("a"))
    return cells(df, "a", "vec_id")


@query("j1_euler_round_trip", f"SELECT vec_id, (i - 1)::INT AS pos, round(rt[i], 6) AS v FROM rotations, {_UNROLL9}", ("rotations",))
def j1_euler_round_trip(spark, sf):
    df = rotations(spark, sf).select("vec_id", rot.matrix_to_euler(F.col("r_true")).alias("a"))
    return cells(df.select("vec_id", rot.euler_to_matrix(F.col("a")).alias("m")), "m", "vec_id")


@query(
    "j1_quaternion_order",
    "SELECT vec_id, (i - 1)::INT AS pos, round([qt[2], qt[3], qt[4], qt[1]][i], 6) AS v FROM poses, UNNEST(range(1, 5)) AS u(i)",
    ("poses",),
)
def j1_quaternion_order(spark, sf):
    last = t.poses(spark, sf).select("vec_id", rot.scalar_last(F.col("q_true")).alias("q"))
    both = last.select("vec_id", rot.scalar_last(rot.scalar_first(F.col("q"))).alias("q"))
    return cells(both, "q", "vec_id")


@query(
    "j2_orientation",
    f"""SELECT vec_id, (i - 1)::INT AS pos, round(CASE vec_id % 3 WHEN 0 THEN [e[1], e[2], e[3], e[5], e[6], e[7], e[9], e[10], e[11]][i] WHEN 1 THEN e[i]
        ELSE [1, 0, 0, 0, 1, 0, 0, 0, 1][i] END, 6) AS v FROM emb, {_UNROLL9}""",
    ("emb",),
)
def j2_orientation(spark, sf):
    length = F.when(F.col("vec_id") % 3 == 0, 16).when(F.col("vec_id") % 3 == 1, 9).otherwise(7)
    df = t.emb(spark, sf).select("vec_id", rot.transform_to_rotation(F.slice("e", F.lit(1), length)).alias("m"))
    return cells(df, "m", "vec_id")


_ERROR = "degrees(acos((least(greatest(list_dot_product(rt, rp), -1), 3) - 1) / 2))"


@query("j3_geodesic", f"SELECT vec_id, round({_ERROR}, 6) AS error FROM rotations", ("rotations",))
def j3_geodesic(spark, sf):
    return rounded(ops.rotation_errors(rotations(spark, sf)).select("vec_id", "error"))


@query("j4_quaternion_distance", "SELECT vec_id, round(1 - abs(list_dot_product(qt, qp)), 6) AS distance FROM poses", ("poses",))
def j4_quaternion_distance(spark, sf):
    return rounded(t.poses(spark, sf).select("vec_id", rot.quaternion_distance(F.col("q_true"), F.col("q_pred")).alias("distance")))


ROTATION_METRICS_SQL = f"""err AS (SELECT {_ERROR} AS e FROM rotations),
     d AS (SELECT vec_id, [rp[1]*rt[1]+rp[2]*rt[2]+rp[3]*rt[3], rp[1]*rt[4]+rp[2]*rt[5]+rp[3]*rt[6], rp[1]*rt[7]+rp[2]*rt[8]+rp[3]*rt[9],
           rp[4]*rt[1]+rp[5]*rt[2]+rp[6]*rt[3], rp[4]*rt[4]+rp[5]*rt[5]+rp[6]*rt[6], rp[4]*rt[7]+rp[5]*rt[8]+rp[6]*rt[9],
           rp[7]*rt[1]+rp[8]*rt[2]+rp[9]*rt[3], rp[7]*rt[4]+rp[8]*rt[5]+rp[9]*rt[6], rp[7]*rt[7]+rp[8]*rt[8]+rp[9]*rt[9]] AS m FROM rotations),
     rel AS (SELECT degrees(acos((least(greatest(list_dot_product(a.m, b.m), -1), 3) - 1) / 2)) AS e FROM d a JOIN d b ON a.vec_id < b.vec_id),
     rm AS (SELECT 'mean_geodesic_error' AS metric, avg(e) AS value FROM err UNION ALL SELECT 'std_geodesic_error', stddev_pop(e) FROM err UNION ALL SELECT 'max_geodesic_error', max(e) FROM err
       UNION ALL SELECT 'min_geodesic_error', min(e) FROM err UNION ALL SELECT 'median_geodesic_error', quantile_cont(e, 0.5) FROM err
       UNION ALL SELECT 'mean_relative_error', avg(e) FROM rel UNION ALL SELECT 'std_relative_error', stddev_pop(e) FROM rel)"""


@query("j5_rotation_metrics", f"WITH {ROTATION_METRICS_SQL} SELECT metric, round(value, 6) AS value FROM rm", ("rotations",))
def j5_rotation_metrics(spark, sf):
    return rounded(ops.rotation_metrics(rotations(spark, sf), "vec_id"))


@query("j5_rotation_metrics_radians", f"WITH {ROTATION_METRICS_SQL} SELECT metric, round(radians(value), 6) AS value FROM rm", ("rotations",))
def j5_rotation_metrics_radians(spark, sf):
    return rounded(ops.rotation_metrics(rotations(spark, sf), "vec_id", degrees=False))


@query(
    "j6_align_points",
    """SELECT label AS set_id, count(*) AS n, pos, CASE pos WHEN 1 THEN -1.0 WHEN 3 THEN 1.0 WHEN 8 THEN 1.0 ELSE 0.0 END::DOUBLE AS r, 1.0::DOUBLE AS tx, (2.0 + label)::DOUBLE AS ty, 3.0::DOUBLE AS tz, 0.0::DOUBLE AS rmsd
       FROM embeddings, (SELECT UNNEST(range(9))::INT AS pos) GROUP BY label, pos""",
)
def j6_align_points(spark, sf):
    """Points turned by a quarter about z and moved; the motion is found again for each label."""
    e = [F.get("e", i) for i in range(3)]
    points = t.emb(spark, sf).select(
        F.col("label").alias("set_id"), *[c.alias(n) for c, n in zip(e, ("px", "py", "pz"), strict=True)],
        (1.0 - e[1]).alias("qx"), (e[0] + 2.0 + F.col("label")).alias("qy"), (e[2] + 3.0).alias("qz"),
    )
    found = ops.align_points(points)
    moved = [F.round(F.get("translation", i), 6).alias(n) for i, n in enumerate(("tx", "ty", "tz"))]
    cells = found.select("set_id", "n", *moved, F.round("rmsd", 4).alias("rmsd"), F.posexplode("rotation").alias("pos", "r"))
    return cells.withColumn("r", F.round("r", 6) + 0.0)


# The best global rotation as a quaternion: the leading eigenvector of a 4x4 matrix, by repeated squaring of the shifted matrix.
_S = {f"s{a}{b}": " + ".join(f"rp[{3 * a + c + 1}] * rt[{3 * b + c + 1}]" for c in range(3)) for a in range(3) for b in range(3)}
_GLOBAL = f"""hs AS (SELECT count(*) AS n, {', '.join(f"sum({v}) / count(*) AS {k}" for k, v in _S.items())} FROM rotations),
     nm AS (SELECT 0 AS step, [s00 + s11 + s22 + 9, s12 - s21, s20 - s02, s01 - s10, s12 - s21, s00 - s11 - s22 + 9, s01 + s10, s20 + s02,
            s20 - s02, s01 + s10, s11 - s00 - s22 + 9, s12 + s21, s01 - s10, s20 + s02, s12 + s21, s22 - s00 - s11 + 9]::DOUBLE[] AS m FROM hs
       UNION ALL SELECT step + 1, list_transform(range(0, 16), lambda p: list_sum(list_transform(range(0, 4), lambda k: m[(p // 4) * 4 + k + 1] * m[k * 4 + p % 4 + 1])) / list_dot_product(m, m)) FROM nm WHERE step < 25),
     qv AS (SELECT list_transform(range(0, 4), lambda k: m[k * 4 + 1] + 0.3 * m[k * 4 + 2] + 0.2 * m[k * 4 + 3] + 0.1 * m[k * 4 + 4]) AS v FROM nm WHERE step = 25),
     qn AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS q FROM qv),
     gr AS (SELECT [1 - 2*(q[3]*q[3] + q[4]*q[4]), 2*(q[2]*q[3] - q[1]*q[4]), 2*(q[2]*q[4] + q[1]*q[3]), 2*(q[2]*q[3] + q[1]*q[4]), 1 - 2*(q[2]*q[2] + q[4]*q[4]), 2*(q[3]*q[4] - q[1]*q[2]),
            2*(q[2]*q[4] - q[1]*q[3]), 2*(q[3]*q[4] + q[1]*q[2]), 1 - 2*(q[2]*q[2] + q[3]*q[3])] AS g FROM qn),
     al AS (SELECT vec_id, rt, list_transform(range(0, 9), lambda p: g[(p // 3) * 3 + 1] * rp[p % 3 + 1] + g[(p // 3) * 3 + 2] * rp[p % 3 + 4] + g[(p // 3) * 3 + 3] * rp[p % 3 + 7]) AS ra FROM rotations, gr),
     ae AS (SELECT vec_id, list_distance(ra, rt) ** 2 / 3 AS d2, degrees(acos((least(greatest(list_dot_product(ra, rt), -1), 3) - 1) / 2)) AS error FROM al)"""


@query("j6_align_rotations", f"WITH {_GLOBAL} SELECT vec_id, round(error, 6) AS error FROM ae", ("rotations",))
def j6_align_rotations(spark, sf):
    return rounded(ops.align_rotations(rotations(spark, sf))[0].select("vec_id", "error"))


@query(
    "j6_alignment_summary",
    f"""WITH {_GLOBAL} SELECT round(sqrt(avg(d2)), 6) AS rmsd, round(avg(error), 6) AS mean_angular_error, round(stddev_pop(error), 6) AS std_angular_error,
        round(max(error), 6) AS max_angular_error, round(min(error), 6) AS min_angular_error FROM ae""",
    ("rotations",),
)
def j6_alignment_summary(spark, sf):
    return rounded(ops.alignment_summary(rotations(spark, sf)))


@query(
    "j7_alignment_stats",
    f"""WITH q AS (SELECT 'euler_x' AS quantity, degrees(atan2(rp[8], rp[9])) AS v FROM rotations UNION ALL SELECT 'euler_y', degrees(asin(-rp[7])) FROM rotations
          UNION ALL SELECT 'euler_z', degrees(atan2(rp[4], rp[1])) FROM rotations UNION ALL SELECT 'angular_diff', {_ERROR} FROM rotations)
        SELECT quantity, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM q GROUP BY quantity""",
    ("rotations",),
)
def j7_alignment_stats(spark, sf):
    return rounded(ops.alignment_stats(rotations(spark, sf)))


_SELECTED = """sel0 AS (SELECT s.*, sqrt(x * x + y * y + z * z) < 0.22 AS inside, w > quantile_cont(w, 0.1) OVER (PARTITION BY set_id) AS heavy FROM splats s),
     sel AS (SELECT * FROM sel0 QUALIFY CASE WHEN count(*) FILTER (inside AND heavy) OVER (PARTITION BY set_id) < 10 THEN inside ELSE inside AND heavy END)"""


@query("j8_select_splats", f"WITH {_SELECTED} SELECT set_id, splat_id, round(w, 6) AS w FROM sel", ("splats",))
def j8_select_splats(spark, sf):
    return rounded(sp.select_splats(t.splats(spark, sf), 0.22, (0.0, 0.0, 0.0), 10.0).select("set_id", "splat_id", "w"))


_MOMENTS = """c AS (SELECT set_id, count(*) AS n, sum(w) AS v1, sum(w * w) AS v2, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * z) / sum(w) AS cz FROM splats GROUP BY set_id),
     m AS (SELECT set_id, sum(w * (x - cx) ** 2) / sum(w) AS xx, sum(w * (x - cx) * (y - cy)) / sum(w) AS xy, sum(w * (x - cx) * (z - cz)) / sum(w) AS xz,
           sum(w * (y - cy) ** 2) / sum(w) AS yy, sum(w * (y - cy) * (z - cz)) / sum(w) AS yz, sum(w * (z - cz) ** 2) / sum(w) AS zz FROM splats JOIN c USING (set_id) GROUP BY set_id)"""
# Eigenvalues of a symmetric 3x3 matrix in closed form (trigonometric solution of the cubic).
_EIGEN = """q AS (SELECT *, (xx + yy + zz) / 3 AS q, (xy * xy + xz * xz + yz * yz) AS p1 FROM m), p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * p1) / 6) AS p FROM q),
     r AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3) AS r FROM p),
     ph AS (SELECT *, acos(least(greatest(r, -1), 1)) / 3 AS phi FROM r),
     eig AS (SELECT set_id, q + 2 * p * cos(phi) AS m1, 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)) AS m2, q + 2 * p * cos(phi + 2 * pi() / 3) AS m3 FROM ph)"""


@query(
    "j9_weighted_covariance",
    f"""WITH {_MOMENTS}, {_EIGEN} SELECT set_id, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(f * xx, 6) AS xx, round(f * xy, 6) AS xy, round(f * xz, 6) AS xz,
        round(f * yy, 6) AS yy, round(f * yz, 6) AS yz, round(f * zz, 6) AS zz, round(f * m1, 6) AS e1, round(f * m2, 6) AS e2, round(f * m3, 6) AS e3
        FROM (SELECT *, v1 / (v1 - v2 / v1) AS f FROM c) JOIN m USING (set_id) JOIN eig USING (set_id)""",
    ("splats",),
)
def j9_weighted_covariance(spark, sf):
    pca = sp.weighted_pca(t.splats(spark, sf))
    return rounded(pca.drop("axes").select("*", *[F.get("eigenvalues", i).alias(f"e{i + 1}") for i in range(3)]).drop("eigenvalues"))


def _with_template(spark, sf):
    sets = t.splats(spark, sf)
    chosen = t.templates(spark, sf).select("label", F.col("template_id").alias("set_id"))
    template = sets.join(chosen, ["label", "set_id"], "left_semi").drop("set_id")
    return sets, template


_CELLS = [("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz")]
_OTHERS = {1: (2, 3), 2: (1, 3), 3: (1, 2)}


def _projector(axis, a, b):
    """Entry (a, b) of the projector on one eigenvector: the product of (A - m) over the other two eigenvalues, scaled."""
    p, q = _OTHERS[axis]
    product = " + ".join(f"({_CELLS[a][k]} - {f'm{p}' if a == k else '0'}) * ({_CELLS[k][b]} - {f'm{q}' if k == b else '0'})" for k in range(3))
    return f"({product}) / ((m{axis} - m{p}) * (m{axis} - m{q}))"


_PROJECTED = " UNION ALL ".join(f"SELECT set_id, {i - 1} AS axis, {a * 3 + b} AS pos, round({_projector(i, a, b)}, 4) AS v FROM eig JOIN m USING (set_id)" for i in (1, 2, 3) for a in range(3) for b in range(3))


@query("j9_axis_projectors", f"WITH {_MOMENTS}, {_EIGEN} {_PROJECTED}", ("splats",))
def j9_axis_projectors(spark, sf):
    """Outer product of each principal axis with itself: free of the sign an eigenvector leaves open."""
    pca = sp.weighted_pca(t.splats(spark, sf)).select("set_id", "axes", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("axis"))
    cell = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda p: F.get("axes", F.floor(p / 3).cast("int") * 3 + F.col("axis")) * F.get("axes", F.pmod(p, F.lit(3)) * 3 + F.col("axis")))
    return rounded(pca.select("set_id", "axis", F.posexplode(cell).alias("pos", "v")), 4)


_AXES = f"""proj AS ({_PROJECTED.replace("round(", "(").replace(", 4) AS v", ") AS v")}),
     pl AS (SELECT set_id, axis, list(v ORDER BY pos) AS p FROM proj GROUP BY set_id, axis),
     pm AS (SELECT *, CASE WHEN p[1] >= p[5] AND p[1] >= p[9] THEN 0 WHEN p[5] >= p[9] THEN 1 ELSE 2 END AS k FROM pl),
     ax AS (SELECT set_id, axis, list_transform(range(0, 3), lambda j: p[j * 3 + k + 1] / sqrt(p[k * 3 + k + 1])) AS v FROM pm),
     two AS (SELECT a.set_id, a.v AS a, b.v AS b FROM ax a JOIN ax b ON a.set_id = b.set_id AND a.axis = 0 AND b.axis = 1)"""


@query(
    "j9_weighted_axes",
    f"""WITH {_MOMENTS}, {_EIGEN}, {_AXES} SELECT set_id, pos, round(CASE pos % 3 WHEN 0 THEN a[pos // 3 + 1] WHEN 1 THEN b[pos // 3 + 1]
            ELSE a[(pos // 3 + 1) % 3 + 1] * b[(pos // 3 + 2) % 3 + 1] - a[(pos // 3 + 2) % 3 + 1] * b[(pos // 3 + 1) % 3 + 1] END, 4) AS v
        FROM two, (SELECT UNNEST(range(9))::INT AS pos)""",
    ("splats",),
)
def j9_weighted_axes(spark, sf):
    """The largest component of the first two axes is positive; the third makes the set right-handed."""
    return rounded(sp.weighted_pca(t.splats(spark, sf)).select("set_id", F.posexplode("axes").alias("pos", "v")), 4)


# Sets and template as selected at each radius, under one number for (set, radius, side), so that the moments and axes above apply.
_SIDES = """rad AS (SELECT * FROM (VALUES (0, 0.2::DOUBLE), (1, 0.25::DOUBLE), (2, 0.4::DOUBLE)) AS v(ri, radius)),
     cut AS MATERIALIZED (SELECT set_id, quantile_cont(w, 0.2) AS cut FROM splats GROUP BY set_id),
     mk AS MATERIALIZED (SELECT s.label, s.set_id, ri, s.x, s.y, s.z, s.w, sqrt(x * x + y * y + z * z) < radius AS inside, sqrt(x * x + y * y + z * z) < radius AND w > cut AS heavy
           FROM splats s JOIN cut ON s.set_id = cut.set_id, rad),
     nb AS (SELECT label, set_id, ri, count(*) FILTER (heavy) AS n FROM mk GROUP BY ALL),
     tpl AS (SELECT DISTINCT s.label, template_id FROM splats s JOIN template_of ON s.set_id = template_id),
     lo AS MATERIALIZED (SELECT a.label, a.set_id, a.ri, template_id, a.n < 10 OR b.n < 10 AS loose FROM nb a JOIN tpl ON a.label = tpl.label JOIN nb b ON b.set_id = template_id AND b.ri = a.ri),
     side AS MATERIALIZED (SELECT lo.set_id * 6 + lo.ri * 2 AS set_id, x, y, z, w FROM lo JOIN mk ON mk.set_id = lo.set_id AND mk.ri = lo.ri WHERE CASE WHEN loose THEN inside ELSE heavy END
           UNION ALL SELECT lo.set_id * 6 + lo.ri * 2 + 1, x, y, z, w FROM lo JOIN mk ON mk.set_id = template_id AND mk.ri = lo.ri WHERE CASE WHEN loose THEN inside ELSE heavy END)"""
_TURNED = """th AS (SELECT two.set_id AS id, a AS u, b AS v, [a[2] * b[3] - a[3] * b[2], a[3] * b[1] - a[1] * b[3], a[1] * b[2] - a[2] * b[1]] AS t, [cx, cy, cz] AS c FROM two JOIN c ON c.set_id = two.set_id WHERE n >= 3),
     rot AS MATERIALIZED (SELECT a.id // 6 AS set_id, (a.id % 6) // 2 AS ri, a.c AS ca, b.c AS cb,
           list_transform(range(0, 9), lambda k: b.u[k // 3 + 1] * a.u[k % 3 + 1] + b.v[k // 3 + 1] * a.v[k % 3 + 1] + b.t[k // 3 + 1] * a.t[k % 3 + 1]) AS r
           FROM th a JOIN th b ON b.id = a.id + 1 AND a.id % 2 = 0),
     mv AS (SELECT rot.set_id, rot.ri, s.splat_id AS i, s.w, r[1] * (x - ca[1]) + r[2] * (y - ca[2]) + r[3] * (z - ca[3]) + cb[1] AS x, r[4] * (x - ca[1]) + r[5] * (y - ca[2]) + r[6] * (z - ca[3]) + cb[2] AS y,
           r[7] * (x - ca[1]) + r[8] * (y - ca[2]) + r[9] * (z - ca[3]) + cb[3] AS z FROM rot JOIN splats s ON s.set_id = rot.set_id),
     fa AS MATERIALIZED (SELECT mv.*, sqrt(x * x + y * y + z * z) < radius AS inside, sqrt(x * x + y * y + z * z) < radius AND w > cut AS heavy FROM mv JOIN cut ON cut.set_id = mv.set_id JOIN rad ON rad.ri = mv.ri),
     fb AS MATERIALIZED (SELECT rot.set_id, rot.ri, s.splat_id AS i, s.w, s.x, s.y, s.z, sqrt(x * x + y * y + z * z) < radius AS inside, sqrt(x * x + y * y + z * z) < radius AND w > cut AS heavy
           FROM rot JOIN lo ON lo.set_id = rot.set_id AND lo.ri = rot.ri JOIN splats s ON s.set_id = template_id JOIN cut ON cut.set_id = template_id JOIN rad ON rad.ri = rot.ri),
     few AS (SELECT rot.set_id, rot.ri, coalesce(a.n, 0) < 10 OR coalesce(b.n, 0) < 10 AS loose FROM rot
           LEFT JOIN (SELECT set_id, ri, count(*) FILTER (heavy) AS n FROM fa GROUP BY ALL) a ON a.set_id = rot.set_id AND a.ri = rot.ri
           LEFT JOIN (SELECT set_id, ri, count(*) FILTER (heavy) AS n FROM fb GROUP BY ALL) b ON b.set_id = rot.set_id AND b.ri = rot.ri),
     da AS (SELECT fa.* FROM fa JOIN few ON few.set_id = fa.set_id AND few.ri = fa.ri WHERE CASE WHEN loose THEN inside ELSE heavy END),
     db AS (SELECT fb.* FROM fb JOIN few ON few.set_id = fb.set_id AND few.ri = fb.ri WHERE CASE WHEN loose THEN inside ELSE heavy END),
     dist AS MATERIALIZED (SELECT da.set_id, da.ri, da.i, db.i AS j, da.w AS wa, db.w AS wb, sqrt((da.x - db.x) ** 2 + (da.y - db.y) ** 2 + (da.z - db.z) ** 2) AS d FROM da JOIN db ON da.set_id = db.set_id AND da.ri = db.ri),
     there AS (SELECT set_id, ri, sum(d * w) / sum(w) AS m FROM (SELECT set_id, ri, i, min(d) AS d, any_value(wa) AS w FROM dist GROUP BY ALL) GROUP BY ALL),
     back AS (SELECT set_id, ri, sum(d * w) / sum(w) AS m FROM (SELECT set_id, ri, j, min(d) AS d, any_value(wb) AS w FROM dist GROUP BY ALL) GROUP BY ALL),
     scored AS (SELECT rot.set_id, radius, coalesce((there.m + back.m) / 2, 'inf'::DOUBLE) AS score FROM rot JOIN rad ON rad.ri = rot.ri
           LEFT JOIN there ON there.set_id = rot.set_id AND there.ri = rot.ri LEFT JOIN back ON back.set_id = rot.set_id AND back.ri = rot.ri)"""


@query(
    "j10_align_sets_pca",
    f"""WITH {_SIDES}, {_MOMENTS.replace("splats", "side")}, {_EIGEN}, {_AXES}, {_TURNED}
        SELECT label, scored.set_id, round(radius, 6) AS radius, round(score, 6) AS score FROM scored JOIN (SELECT DISTINCT label, set_id FROM lo) l ON l.set_id = scored.set_id
        QUALIFY row_number() OVER (PARTITION BY scored.set_id ORDER BY round(score, 9), radius) = 1""",
    ("splats", "template_of"),
)
def j10_align_sets_pca(spark, sf):
    sets, template = _with_template(spark, sf)
    best = sp.align_sets_pca(sets, template, "label", radii=(0.2, 0.25, 0.4), center=(0.0, 0.0, 0.0), percentile=20.0)
    return rounded(best.drop("rotation"))


def _against_template(spark, sf):
    """Each set and a copy of its template under the same set id."""
    sets, template = _with_template(spark, sf)
    members = sets.select("label", "set_id").distinct()
    return sets, template.join(members, "label")


@query(
    "j11_chamfer",
    """WITH tp AS (SELECT splats.* FROM splats JOIN template_of ON set_id = template_id),
       d AS (SELECT a.set_id, a.splat_id AS i, b.splat_id AS j, a.w AS wa, b.w AS wb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM splats a JOIN tp b ON a.label = b.label),
       f AS (SELECT set_id, i, min(d) AS d, any_value(wa) AS w FROM d GROUP BY set_id, i), g AS (SELECT set_id, j, min(d) AS d, any_value(wb) AS w FROM d GROUP BY set_id, j)
       SELECT set_id, round((fa + ga) / 2, 6) AS chamfer FROM (SELECT set_id, sum(d * w) / sum(w) AS fa FROM f GROUP BY set_id) JOIN (SELECT set_id, sum(d * w) / sum(w) AS ga FROM g GROUP BY set_id) USING (set_id)""",
    ("splats", "template_of"),
)
def j11_chamfer(spark, sf):
    return rounded(sp.chamfer(*_against_template(spark, sf)))


@query(
    "j12_structural_metrics",
    f"""WITH {_MOMENTS}, {_EIGEN} SELECT set_id, n, round(v1, 6) AS w_sum, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(sqrt(xx + yy + zz), 6) AS radius_of_gyration,
        round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3, round(m3 - (m1 + m2) / 2, 6) AS asphericity, round(m2 - m1, 6) AS acylindricity FROM c JOIN m USING (set_id) JOIN eig USING (set_id)""",
    ("splats",),
)
def j12_structural_metrics(spark, sf):
    return rounded(sp.structural_metrics(t.splats(spark, sf)))


@query(
    "j13_compare_sets",
    """WITH tp AS (SELECT splats.* FROM splats JOIN template_of ON set_id = template_id),
       d AS (SELECT a.set_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS lo, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS mean
             FROM splats a JOIN tp b ON a.label = b.label WHERE a.w > 0.01 AND b.w > 0.01 GROUP BY a.set_id),
       p AS (SELECT a.set_id, avg(abs(a.w - b.w)) AS wm, max(abs(a.w - b.w)) AS wx, avg(abs(a.sigma - b.sigma)) AS sm, max(abs(a.sigma - b.sigma)) AS sx FROM splats a JOIN tp b ON a.label = b.label AND a.splat_id = b.splat_id GROUP BY a.set_id)
       SELECT set_id, round(lo, 6) AS min_centroid_distance, round(mean, 6) AS mean_centroid_distance, round(wm, 6) AS weight_diff_mean, round(wx, 6) AS weight_diff_max,
              round(sm, 6) AS sigma_diff_mean, round(sx, 6) AS sigma_diff_max FROM p LEFT JOIN d USING (set_id)""",
    ("splats", "template_of"),
)
def j13_compare_sets(spark, sf):
    return rounded(sp.compare_sets(*_against_template(spark, sf)))


@query("j14_voxel_coords", "SELECT set_id, splat_id, round((y + 1) * 33 - 9, 6) AS x, round((x + 1) * 33 - 9, 6) AS y, round((z + 1) * 33 - 9, 6) AS z FROM splats", ("splats",))
def j14_voxel_coords(spark, sf):
    return rounded(sp.to_voxel_coords(t.splats(spark, sf), 48.0).select("set_id", "splat_id", "x", "y", "z"))


@query("j14_voxel_coords_reversed", "SELECT set_id, splat_id, round((z + 1) * 33 - 9, 6) AS x, round((y + 1) * 33 - 9, 6) AS y, round((x + 1) * 33 - 9, 6) AS z FROM splats", ("splats",))
def j14_voxel_coords_reversed(spark, sf):
    return rounded(sp.to_voxel_coords(t.splats(spark, sf), 48.0, order=(2, 1, 0)).select("set_id", "splat_id", "x", "y", "z"))


@query("j14_box_coords", "SELECT set_id, splat_id, round((z + 1) * 24, 6) AS x, round((x + 1) * 24, 6) AS y, round((y + 1) * 24, 6) AS z FROM splats", ("splats",))
def j14_box_coords(spark, sf):
    return rounded(sp.to_voxel_coords(t.splats(spark, sf), 48.0, 0.0, (2, 0, 1)).select("set_id", "splat_id", "x", "y", "z"))


@query("j15_significant_splats", "SELECT set_id, count(*) FILTER (w > 0.01) AS n_significant FROM splats GROUP BY set_id", ("splats",))
def j15_significant_splats(spark, sf):
    return sp.significant_splats(t.splats(spark, sf))
