"""Writers of embeddings, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_embeddings(df: DataFrame, path: str, run: str = "run", per_file: int = 1_000_000) -> None:
    """Write embeddings by run; runs present in ``df`` replace their older rows, other runs stay.

    Every task writes the runs it holds, without a shuffle by run, so a run with
    a third of all rows is written by all tasks; long files are cut.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", per_file)
        .partitionBy(run)
        .parquet(path)
    )


def embedding_summary(df: DataFrame, key: str = "structure") -> DataFrame:
    """Rows per structure, kept beside the embeddings."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def write_embedding_metadata(spark: SparkSession, path: str, config: dict, key: str = "structure", run: str = "run") -> DataFrame:
    """Counts per structure, totals and settings of an embedding output, as JSON lines in its ``_summary`` folder.

    The leading underscore keeps the folder out of reads of the embeddings.
    """
    rows = spark.read.parquet(path).select(run, *([key] if key else []))
    totals = rows.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(run).alias("runs"))
    settings = F.to_json(F.create_map(*[F.lit(str(x)) for pair in sorted(config.items()) for x in pair]))
    out = embedding_summary(rows, key).join(totals).withColumn("config", settings)
    out.write.mode("overwrite").json(f"{path}/_summary")
    return out


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def metric_lines(log: DataFrame) -> DataFrame:
    """One JSON object ``{step, metrics{}}`` per step."""
    return log.groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metrics"))


def write_report(results: DataFrame, path: str, config: dict[str, str], key: str = "structure", errors: DataFrame | None = None) -> DataFrame:
    """One JSON object per structure with configuration, results and errors; returns what was written."""
    measures = [c for c in results.columns if c != key]
    settings = F.create_map(*[F.lit(str(x)) for pair in sorted(config.items()) for x in pair]) if config else F.create_map()
    report = results.select(key, F.struct(*measures).alias("results"))
    if errors is not None:
        grouped = errors.groupBy(key).agg(F.sort_array(F.collect_set("error")).alias("errors"))
        report = report.join(grouped, key, "full")
    out = report.withColumn("config", settings)
    out.write.mode("overwrite").json(path)
    return out

