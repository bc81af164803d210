"""From raw documents to packed training rows: quality, line dedup, near-dedup, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``. A row is named by a hash of its id, text
and language, so stages also work on null and repeated ids and on ids of any
type: rows that agree in all of them are judged alike. Whole texts are read,
however long, and an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.llm.linededup import drop_recurring_lines, is_long
from motefield.llm.neardup import near_duplicates
from motefield.llm.packing import pack, token_count
from motefield.llm.quality import quality
from motefield.llm.secrets import redacted, scan
from motefield.session import ship_package, written

_KEY, _LENGTH = "__row", "__length"


def _keyed(docs: DataFrame) -> DataFrame:
    parts = [F.to_json(F.struct("doc_id", *([F.col("lang")] if "lang" in docs.columns else []))), F.coalesce("text", F.lit("\x00"))]
    return docs.withColumn(_KEY, F.xxhash64(*parts))


def _sized(docs: DataFrame) -> DataFrame:
    """Keep the column of text lengths true where there is one."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the perplexity band of their language; null and empty texts have too few words and go."""
    ship_package(spark)
    keyed = _keyed(docs)
    verdict = quality(keyed, id_col=_KEY)
    return keyed.join(verdict.filter("kept").select(F.col("doc_id").alias(_KEY)).distinct(), _KEY, "left_semi").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; one of which no line is left goes, its lines stand elsewhere.

    So does one that has lost all its long lines and over nine tenths of its length: what is left are the headings of a copy.
    A null or empty text has nothing to lose and stays; of rows without an id each text is a document.
    """
    ship_package(spark)
    left = drop_recurring_lines(docs.withColumn(_LENGTH, F.length("text")), min_docs=3, long_docs=2)
    lost = F.size("dropped_lines") > 0
    rest = (10 * F.length("text") < F.col(_LENGTH)) & ~F.exists(F.split("text", "\n"), is_long)
    gone = F.coalesce(lost & ((F.size("dropped_lines") == F.col("n_lines")) | rest), F.lit(False))
    return _sized(left.filter(~gone)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the row of least id, a null id last; of repeated rows one. Null and empty texts are classes of their own."""
    ship_package(spark)
    keyed = _keyed(docs)
    classes = near_duplicates(keyed, id_col=_KEY).distinct()
    named = keyed.select("doc_id", _KEY).join(classes.select(F.col("doc_id").alias(_KEY), "class_id"), _KEY)
    kept = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", _KEY)).alias("least")).select(F.col(f"least.{_KEY}").alias(_KEY))
    return keyed.join(kept, _KEY, "left_semi").dropDuplicates([_KEY]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; null and empty texts stay as they are."""
    ship_package(spark)
    return _sized(redacted(docs, scan(docs))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document in the batches of its length bucket; null and empty texts have length 0, longer ones than a bucket are cut into segments."""
    ship_package(spark)
    return pack(docs, token_count(F.col("text")))


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secrets", secret_scan), ("packing", packing)]

#: The language model and the near-duplicate classes have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one keeps is written to the shared folder and is the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
