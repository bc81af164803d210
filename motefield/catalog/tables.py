"""Domain tables derived from the driver's tables, once in Spark and once in SQL.

``SQL_TABLES[name] = (tables it uses, select statement)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.functions.labels import snr_of
from motefield.functions.vectors import let, norm
from motefield.operators.classification import centroid_scores
from motefield.operators.embeddings import centroids
from motefield.operators.ranking import rank_by_hash, rank_by_value

SEED = 42
FOLDS = 5
_GAP = 1_000_000  # room for volume numbers inside one label

SQL_TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "emb": ((), "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"),
    "vox4": (
        ("emb",),
        "SELECT vec_id, label, (i // 16)::INT AS z, ((i // 4) % 4)::INT AS y, (i % 4)::INT AS x, e[i + 1] AS v FROM emb, UNNEST(range(64)) AS t(i)",
    ),
    "chunk8": (
        ("emb",),
        f"""SELECT label, label::BIGINT * {_GAP} + rn // 8 AS vol, (rn % 8)::INT AS k, e FROM (
              SELECT label, e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM emb)
            UNION ALL SELECT label, label::BIGINT * {_GAP} + rn // 8, (rn % 8)::INT, list_transform(range(64), lambda i: 0.0::DOUBLE)
              FROM (SELECT label, UNNEST(range(n, 8 * ((n + 7) // 8))) AS rn FROM (SELECT label, count(*) AS n FROM emb GROUP BY label))""",
    ),
    "vox8": (
        ("chunk8",),
        """SELECT label, vol, ((k // 4) * 4 + i // 16)::INT AS z, (((k // 2) % 2) * 4 + (i // 4) % 4)::INT AS y,
                  ((k % 2) * 4 + i % 4)::INT AS x, e[i + 1] AS v FROM chunk8, UNNEST(range(64)) AS t(i)""",
    ),
    "pair8": (
        ("vox8",),
        """SELECT a.vol, a.label, a.z, a.y, a.x, a.v AS va, b.v AS vb FROM vox8 a
           JOIN vox8 b ON b.vol = a.vol + 1 AND a.z = b.z AND a.y = b.y AND a.x = b.x""",
    ),
    "centers": (
        ("emb",),
        """SELECT label, list(m ORDER BY i) AS c FROM (
             SELECT label, i, avg(e[i]) AS m FROM emb, UNNEST(range(1, 65)) AS t(i) GROUP BY label, i) GROUP BY label""",
    ),
    "class_aff": (
        ("centers",),
        """SELECT a.label - 1 AS id1, b.label - 1 AS id2, (list_cosine_similarity(a.c, b.c) + 1) / 2 AS affinity
           FROM centers a JOIN centers b ON a.label < b.label""",
    ),
    "aff": (
        ("emb",),
        """SELECT a.vec_id AS id1, b.vec_id AS id2, list_cosine_similarity(a.e, b.e) AS affinity
           FROM emb a JOIN emb b ON a.vec_id < b.vec_id""",
    ),
    "brand_aff": (
        (),
        """SELECT id1, id2, list_cosine_similarity(f1, f2) AS affinity FROM (
             SELECT a.id AS id1, b.id AS id2, a.f AS f1, b.f AS f2 FROM brand_features a JOIN brand_features b ON a.id < b.id)""",
    ),
    "brand_features": (
        (),
        """SELECT CASE WHEN p_brand = 'Brand#3' THEN 'Background#3' ELSE p_brand END AS id,
                  [avg(p_size) / 50 - 0.5, avg(p_retailprice) / 1000 - 1, avg(p_partkey % 7) - 3, avg(p_partkey % 11) - 5]::DOUBLE[] AS f
           FROM part GROUP BY 1""",
    ),
    "picks": (
        (),
        """SELECT (user_id % 10)::INT AS run, event_id AS pick_id, event_type AS structure, (event_id % 9)::DOUBLE AS x,
                  ((event_id // 9) % 9)::DOUBLE AS y, (floor(value)::BIGINT % 48)::DOUBLE AS z, user_id FROM events""",
    ),
    "tomo_voxels": (
        ("emb",),
        """SELECT label AS run, ((rn // 4) * 4 + i // 16)::INT AS z, (((rn // 2) % 2) * 4 + (i // 4) % 4)::INT AS y,
                  ((rn % 2) * 4 + i % 4)::INT AS x, e[i + 1] AS v
           FROM (SELECT label, e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM emb
                 UNION ALL SELECT label, list_transform(range(64), lambda i: 0.0::DOUBLE), UNNEST(range(n, 4 * ((n + 3) // 4)))
                   FROM (SELECT label, count(*) AS n FROM emb GROUP BY label)), UNNEST(range(64)) AS t(i)""",
    ),
    "tomograms": (("emb",), "SELECT label AS run, (4 * ((count(*) + 3) // 4))::INT AS nz, 8 AS ny, 8 AS nx FROM emb GROUP BY label"),
    "spacings": ((), "SELECT p_brand AS run, p_partkey AS ord, p_size::DOUBLE AS size, p_type AS tomo_type FROM part"),
    "particles": (
        (),
        """SELECT doc_id AS id, source AS source_type, CASE WHEN lang = 'de' THEN 'background' WHEN lang = 'es' THEN NULL ELSE lang END AS molecule_id,
                  regexp_extract(source, '([0-9]+)', 1)::DOUBLE AS snr, n_chars FROM documents""",
    ),
    "atoms": (
        (),
        """SELECT l_partkey % 50 AS structure, l_returnflag AS chain, l_extendedprice % 400 AS x, l_quantity * 8 AS y,
                  l_discount * 4000 AS z, l_quantity AS mass FROM lineitem""",
    ),
    "splats": (
        ("emb",),
        """SELECT vec_id AS set_id, label, s::INT AS splat_id, e[4 * s + 1] AS x, e[4 * s + 2] AS y, e[4 * s + 3] AS z,
                  abs(e[4 * s + 4]) AS w, 0.1 + abs(e[4 * s + 1]) AS sigma FROM emb, UNNEST(range(16)) AS t(s)""",
    ),
    "template_of": (("emb",), "SELECT label, min(vec_id) AS template_id FROM emb GROUP BY label"),
    "poses": (
        ("emb",),
        """SELECT vec_id, label, list_transform(e[1:4], lambda v: v / sqrt(list_dot_product(e[1:4], e[1:4]))) AS qt,
                  list_transform(e[5:8], lambda v: v / sqrt(list_dot_product(e[5:8], e[5:8]))) AS qp FROM emb""",
    ),
    "rotations": (
        ("poses",),
        """SELECT vec_id, label, [1 - 2*(qt[3]*qt[3] + qt[4]*qt[4]), 2*(qt[2]*qt[3] - qt[1]*qt[4]), 2*(qt[2]*qt[4] + qt[1]*qt[3]),
                  2*(qt[2]*qt[3] + qt[1]*qt[4]), 1 - 2*(qt[2]*qt[2] + qt[4]*qt[4]), 2*(qt[3]*qt[4] - qt[1]*qt[2]),
                  2*(qt[2]*qt[4] - qt[1]*qt[3]), 2*(qt[3]*qt[4] + qt[1]*qt[2]), 1 - 2*(qt[2]*qt[2] + qt[3]*qt[3])] AS rt,
                  [1 - 2*(qp[3]*qp[3] + qp[4]*qp[4]), 2*(qp[2]*qp[3] - qp[1]*qp[4]), 2*(qp[2]*qp[4] + qp[1]*qp[3]),
                  2*(qp[2]*qp[3] + qp[1]*qp[4]), 1 - 2*(qp[2]*qp[2] + qp[4]*qp[4]), 2*(qp[3]*qp[4] - qp[1]*qp[2]),
                  2*(qp[2]*qp[4] - qp[1]*qp[3]), 2*(qp[3]*qp[4] + qp[1]*qp[2]), 1 - 2*(qp[2]*qp[2] + qp[3]*qp[3])] AS rp FROM poses""",
    ),
    "folds": (
        ("emb",),
        f"""SELECT vec_id, label, e, ((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', vec_id, {SEED})), vec_id) - 1) % {FOLDS})::INT AS fold
            FROM emb""",
    ),
    "scores": (
        ("folds", "centers"),
        """SELECT f.fold, f.vec_id AS id, c.label AS class, round(list_cosine_similarity(f.e, c.c), 9) AS score, (f.label = c.label)::INT AS y, f.label
           FROM folds f CROSS JOIN centers c""",
    ),
    "scores_half": (
        ("folds", "centers"),
        """SELECT f.fold, f.vec_id AS id, c.label AS class, round(list_cosine_similarity(f.e[1:32], c.c[1:32]), 9) AS score, (f.label = c.label)::INT AS y, f.label
           FROM folds f CROSS JOIN centers c""",
    ),
    "metric_log": (
        (),
        """SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS epoch, event_id AS step, event_type AS key, value FROM events""",
    ),
    "stages": (
        (),
        """SELECT * FROM (VALUES (0, 5, 'src0:en', 1.0::DOUBLE), (0, 5, 'src1:en', 1.0), (1, 10, 'src0:en', 0.5), (1, 10, 'src1:en', 1.5),
             (1, 10, 'src2:fr', 1.0), (2, NULL, 'src2:fr', 2.0), (2, NULL, 'src0:en', 0.25)) AS s(stage, duration, sample_id, weight)""",
    ),
}
SQL_TABLES["brand_aff"] = (("brand_features",), SQL_TABLES["brand_aff"][1])

STAGES = [
    (0, 5, "src0:en", 1.0), (0, 5, "src1:en", 1.0), (1, 10, "src0:en", 0.5), (1, 10, "src1:en", 1.5),
    (1, 10, "src2:fr", 1.0), (2, None, "src2:fr", 2.0), (2, None, "src0:en", 0.25),
]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding rows under the names the operators use; label 0 is the background class -1."""
    return emb(spark, sf).select(F.col("vec_id").alias("id"), (F.col("label") - 1).cast("int").alias("cls"), F.col("e").alias("feature"))


def volumes4(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select(
        F.col("vec_id").alias("vol"), "label", F.array(*[F.lit(4)] * 3).alias("shape"), F.col("e").alias("data")
    )


def volumes8(spark: SparkSession, sf: str) -> DataFrame:
    """Eight vectors of one label as the corners of an 8x8x8 volume; the last volume of a label is filled up with zeros."""
    ranked = rank_by_value(emb(spark, sf), ["label"], "vec_id")
    chunks = ranked.select(
        "label",
        (F.col("label").cast("long") * _GAP + F.floor((F.col("rn") - 1) / 8)).alias("vol"),
        F.pmod(F.col("rn") - 1, F.lit(8)).cast("int").alias("k"),
        "e",
    )
    whole = chunks.groupBy("label", "vol").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("c"))

    def element(p):
        z, y, x = F.shiftright(p, 6), F.pmod(F.shiftright(p, 3), F.lit(8)), F.pmod(p, F.lit(8))
        chunk = F.shiftright(z, 2) * 4 + F.shiftright(y, 2) * 2 + F.shiftright(x, 2)
        inner = F.pmod(z, F.lit(4)) * 16 + F.pmod(y, F.lit(4)) * 4 + F.pmod(x, F.lit(4))
        return F.coalesce(F.get(F.get(F.col("c"), chunk)["e"], inner), F.lit(0.0))

    return whole.select(
        "vol", "label", F.array(*[F.lit(8)] * 3).alias("shape"), F.transform(F.sequence(F.lit(0), F.lit(511)), element).alias("data")
    )


def volume_pairs8(spark: SparkSession, sf: str) -> DataFrame:
    """Each 8x8x8 volume with the next one of its label."""
    a = volumes8(spark, sf)
    b = a.select((F.col("vol") - 1).alias("vol"), F.col("data").alias("data_b"))
    return a.withColumnRenamed("data", "data_a").join(b, "vol")


def brand_features(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.when(F.col("p_brand") == "Brand#3", F.lit("Background#3")).otherwise(F.col("p_brand"))
    return read(spark, sf, "part").groupBy(brand.alias("id")).agg(
        F.array(
            F.avg("p_size") / 50 - 0.5, F.avg("p_retailprice") / 1000 - 1, F.avg(F.col("p_partkey") % 7) - 3, F.avg(F.col("p_partkey") % 11) - 5
        ).alias("feature")
    )


def picks(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        F.pmod("user_id", F.lit(10)).cast("int").alias("run"),
        F.col("event_id").alias("pick_id"),
        F.col("event_type").alias("structure"),
        F.pmod("event_id", F.lit(9)).cast("double").alias("x"),
        F.pmod(F.floor(F.col("event_id") / 9), F.lit(9)).cast("double").alias("y"),
        F.pmod(F.floor("value"), F.lit(48)).cast("double").alias("z"),
        "user_id",
    )


def tomo_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """4x4x4 chunks of one tomogram per label on a 2x2 grid of columns; the last layer is filled up with zeros."""
    rows = rank_by_value(emb(spark, sf), ["label"], "vec_id").select("label", (F.col("rn") - 1).cast("long").alias("rn"), "e")
    n = F.count(F.lit(1))
    ends = read(spark, sf, "embeddings").groupBy("label").agg(n.alias("n")).filter(F.col("n") % 4 != 0)
    zeros = ends.select("label", F.explode(F.sequence(F.col("n"), 4 * F.ceil(F.col("n") / 4) - 1)).alias("rn"), F.array_repeat(F.lit(0.0), 64).alias("e"))
    return rows.unionByName(zeros).select(
        F.col("label").alias("run"),
        F.floor(F.col("rn") / 4).cast("int").alias("cz"),
        F.pmod(F.floor(F.col("rn") / 2), F.lit(2)).cast("int").alias("cy"),
        F.pmod(F.col("rn"), F.lit(2)).cast("int").alias("cx"),
        F.col("e").alias("data"),
    )


def tomograms(spark: SparkSession, sf: str) -> DataFrame:
    layers = (4 * F.ceil(F.count(F.lit(1)) / 4)).cast("int").alias("nz")
    return read(spark, sf, "embeddings").groupBy(F.col("label").alias("run")).agg(layers).select("run", "nz", F.lit(8).alias("ny"), F.lit(8).alias("nx"))


def spacings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(
        F.col("p_brand").alias("run"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("double").alias("size"), F.col("p_type").alias("tomo_type")
    )


def particles(spark: SparkSession, sf: str) -> DataFrame:
    molecule = F.when(F.col("lang") == "de", "background").when(F.col("lang") == "es", F.lit(None)).otherwise(F.col("lang"))
    return read(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_type"), molecule.alias("molecule_id"),
        snr_of(F.regexp_replace("source", "src", "snr_")).alias("snr"), "n_chars",
    )


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        F.pmod("l_partkey", F.lit(50)).alias("structure"), F.col("l_returnflag").alias("chain"), F.pmod("l_extendedprice", F.lit(400.0)).alias("x"),
        (F.col("l_quantity") * 8).alias("y"), (F.col("l_discount") * 4000).alias("z"), F.col("l_quantity").alias("mass"),
    )


def splats(spark: SparkSession, sf: str) -> DataFrame:
    one = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda s: F.struct(
            s.alias("splat_id"), F.get("e", 4 * s).alias("x"), F.get("e", 4 * s + 1).alias("y"), F.get("e", 4 * s + 2).alias("z"),
            F.abs(F.get("e", 4 * s + 3)).alias("w"), (F.lit(0.1) + F.abs(F.get("e", 4 * s))).alias("sigma"),
        ),
    )
    return emb(spark, sf).select(F.col("vec_id").alias("set_id"), "label", F.explode(one).alias("s")).select("set_id", "label", "s.*")


def templates(spark: SparkSession, sf: str) -> DataFrame:
    """The set with the lowest id of each label."""
    return read(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("template_id"))


def poses(spark: SparkSession, sf: str) -> DataFrame:
    def scaled(start: int):
        part = F.slice("e", start, 4)
        return let(norm(part), lambda n: F.transform(part, lambda v: v / n))

    return emb(spark, sf).select("vec_id", "label", scaled(1).alias("q_true"), scaled(5).alias("q_pred"))


def folds(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rank_by_hash(emb(spark, sf), ["label"], ["vec_id"], SEED)
    return ranked.withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(FOLDS)).cast("int")).drop("rn")


def scores(spark: SparkSession, sf: str, dims: int = 64) -> DataFrame:
    """Cosine of every row to every class centroid."""
    rows = folds(spark, sf)
    return centroid_scores(rows, centroids(rows, "e", "label"), "vec_id", "e", "label", dims)


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        F.unix_date(F.to_date("ts")).alias("epoch"), F.col("event_id").alias("step"), F.col("event_type").alias("key"), "value"
    )


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, "stage int, duration int, sample_id string, weight double")
