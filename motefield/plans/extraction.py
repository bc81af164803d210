"""From picks and chunked tomograms to embeddings, as one lazy plan over all runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.functions.rotations import transform_to_rotation
from motefield.operators.joins import best_spacing, extract_boxes, filter_picks, incomplete_picks, pick_voxels, preferred_tomogram, unfinished
from motefield.operators.scoring import normalize_for_scoring, score
from motefield.sources.sinks import write_embedding_metadata, write_embeddings


def finished_runs(spark: SparkSession, path: str, run_type: str) -> DataFrame:
    """Runs already in the output; none if there is no output yet. Reads the partition column only."""
    try:
        return spark.read.parquet(path).select(F.col("run").cast(run_type).alias("run")).distinct()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], f"run {run_type}")


#: What names a tomogram, and what is kept of a pick beside its box.
TOMOGRAM = ["run", "size", "tomo_type"]
PICK_COLUMNS = ("structure", "x", "y", "z", "session_id", "user_id")


def chosen_tomograms(spacings: DataFrame, target: float, tolerance: float, wanted: Column) -> DataFrame:
    """``(run, size, tomo_type)``: of the best spacing of each run the preferred tomogram."""
    spacing = best_spacing(spacings, target, tolerance).select("run", "size")
    chosen = preferred_tomogram(spacings.join(spacing, ["run", "size"]), wanted)
    return spacing.join(chosen.select("run", "tomo_type"), "run")


def plan_extraction(
    picks: DataFrame,
    spacings: DataFrame,
    tomograms: DataFrame,
    chunks: DataFrame,
    done: DataFrame,
    encoder: Callable,
    box: int,
    edge: int,
    target: float,
    tolerance: float,
    wanted: Column,
    batch_size: int = 64,
    only: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Embeddings of all runs still to do, and ``(run, pick_id, error)`` of runs and picks that cannot be done.

    Tomograms and chunks are keyed by run, spacing and tomogram type, so other
    tomograms of a run never mix in. ``only`` filters picks by metadata columns
    (structures, ground truth status). Position, session, user and the
    orientation of the pick's ``transform`` stay with the embedding. The loop
    over runs of a one-machine job is a join here; a tomogram is never held as
    a whole.
    """
    picks = filter_picks(picks, **(only or {}))
    todo = unfinished(picks.select("run").distinct(), done)
    chosen = chosen_tomograms(spacings, target, tolerance, wanted)
    ready = todo.join(chosen, "run").join(tomograms, TOMOGRAM)
    no_pick = F.lit(None).cast(dict(picks.dtypes)["pick_id"]).alias("pick_id")
    no_spacing = todo.join(chosen, "run", "left_anti").select("run", no_pick, F.lit("no matching voxel spacing").alias("error"))
    no_tomogram = todo.join(chosen, "run").join(tomograms, TOMOGRAM, "left_anti").select("run", no_pick, F.lit("no tomogram").alias("error"))
    placed = pick_voxels(picks.join(ready.select(*TOMOGRAM), "run"), F.col("size"))
    sizes = ready.select(*TOMOGRAM, "nz", "ny", "nx")
    holes = incomplete_picks(placed, sizes, chunks, box, edge, TOMOGRAM).select("run", "pick_id", F.lit("incomplete box").alias("error"))
    boxes = extract_boxes(placed, sizes, chunks, box, edge, keys=TOMOGRAM)
    scored = score(normalize_for_scoring(boxes), encoder, batch_size)
    pose = [transform_to_rotation(F.col("transform")).alias("orientation")] if "transform" in picks.columns else []
    out = scored.join(picks.select("run", "pick_id", *[c for c in PICK_COLUMNS if c in picks.columns], *pose), ["run", "pick_id"])
    return out, no_spacing.unionByName(no_tomogram).unionByName(holes)


def extract_embeddings(spark: SparkSession, path: str, picks: DataFrame, **inputs) -> DataFrame:
    """Run the plan for unfinished runs, add them to the output and describe it; returns what failed and why."""
    done = finished_runs(spark, path, dict(picks.dtypes)["run"])
    embeddings, errors = plan_extraction(picks, done=done, **inputs)
    write_embeddings(embeddings, path)
    config = {"box": inputs["box"], "target_spacing": inputs["target"], "tolerance": inputs["tolerance"], "normalization": "z-score"}
    write_embedding_metadata(spark, path, config)
    return errors
