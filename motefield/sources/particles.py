"""Readers of particle files: training tables, structure/SNR trees, validation trees, project files.

Readers select columns and push filters to the scan; file names come from the
``_metadata`` column, so no path is opened twice and nothing is listed on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.functions.labels import snr_of
from motefield.operators.clean import has_columns
from motefield.operators.ranking import first_per_group
from motefield.session import only_row

# Names of the volume and id columns in the order they are looked for, pose of a particle without one.
VOLUME_COLUMNS = ("subvolume", "volume", "data")
ID_COLUMNS = ("pdb_code", "structure", "pdb_id")
TRAINING_COLUMNS = ("subvolume", "shape", "molecule_id")
NO_POSE = (0.0, 0.0, 0.0, 1.0)


def _first_present(df: DataFrame, names: Sequence[str]) -> Column | None:
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else None


def _located(reader, paths: list[str]) -> DataFrame:
    df = reader.parquet(*paths)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("batch_file"), F.col("_metadata.row_index").alias("row_index"))


def _reader(spark: SparkSession, skip_corrupt: bool = False):
    """A file that can't be read is an error, unless the caller asks to skip it and looks at ``rejected_files``."""
    return spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", str(skip_corrupt).lower())


def rejected_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, reason)`` of files below a path pattern that give no rows: broken or empty ones."""

    def same(path: Column) -> Column:
        return F.regexp_replace(path, "^file:/+", "file:/")

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select(same(F.col("path")).alias("path"))
    try:
        read = _reader(spark, True).parquet(pattern).select(same(F.col("_metadata.file_path")).alias("path")).distinct()
        missing = listed.join(read, "path", "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        missing = listed
    return missing.withColumn("reason", F.lit("no readable rows"))


def read_particles(spark: SparkSession, root: str, structure: str, snr: float | str, n: int | None = None, skip_corrupt: bool = False) -> DataFrame:
    """Particles of one structure and SNR from ``<root>/<structure>/snr_<x>/`` or ``<root>/<structure>_snr_<x>/``.

    A broken file is an error; with ``skip_corrupt`` it is left out, and
    ``rejected_files`` names it.

    Files with 'metadata' in their name are skipped. With ``n`` the first n
    rows in file-name and row order are taken, as a top-n and not a sort.
    """
    df = None
    for path in (f"{root}/{structure}/snr_{snr}/*.parquet", f"{root}/{structure}_snr_{snr}/*.parquet"):
        try:
            df = _located(_reader(spark, skip_corrupt), [path])
            break
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if df is None:
        raise FileNotFoundError(f"no files of {structure} at snr {snr} below {root}")
    df = df.filter(~F.col("batch_file").contains("metadata"))
    volume = _first_present(df, VOLUME_COLUMNS)
    if volume is None:
        raise ValueError(f"no volume column among {df.columns}")
    pose = F.col("orientation_axis_angle") if "orientation_axis_angle" in df.columns else F.lit(None)
    kept = [c for c in df.columns if c not in (*VOLUME_COLUMNS, "file_path")]
    out = df.select(*kept, volume.alias("volume"), pose.isNotNull().alias("has_pose"), F.lit(structure).alias("structure"), F.lit(float(snr)).alias("snr"))
    return out if n is None else out.orderBy("batch_file", "row_index").limit(n)


def particle_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Structures and SNR levels below a root with their rows and files; folders without a numeric SNR are skipped."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    path = F.col("_metadata.file_path")
    named = files.select(path.alias("path")).filter(~F.element_at(F.split("path", "/"), -1).contains("metadata"))
    snr = F.expr("try_cast(regexp_extract(path, r'/[^/]*?snr_([^/]+)/[^/]+$', 1) AS double)")
    nested, flat = F.regexp_extract("path", r"/([^/]+)/snr_[^/]+/[^/]+$", 1), F.regexp_extract("path", r"/([^/]+)_snr_[^/]+/[^/]+$", 1)
    found = named.select("path", F.when(nested != "", nested).otherwise(flat).alias("structure"), snr.alias("snr"))
    counts = found.groupBy("structure", "snr", "path").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("snr IS NOT NULL AND structure <> ''").groupBy("structure", "snr").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"))


def latest_version(spark: SparkSession, folder: str) -> str:
    """The folder itself if it holds files, else the last of the sorted ``<folder>_*`` versions.

    Only paths are listed; the content column of the listing is never read.
    """
    name = folder.rstrip("/").split("/")[-1]
    for pattern in (folder, f"{folder}_*"):
        try:
            listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path")
            suffix = F.regexp_extract("path", rf"/\Q{name}\E(_[^/]*)?/", 1)
            row = only_row(listing.agg(F.max(suffix).alias("suffix")))
            if row["suffix"] is not None:
                return folder.rstrip("/") + row["suffix"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(folder)


def load_sources(spark: SparkSession, paths: Sequence[str], skip_corrupt: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Union of several training files, row counts per (source, molecule), and the sources that were left out with the reason.

    A source without the required columns is left out as a whole. Rows keep
    their own ``source_type``; where there is none it is ``source_<i>``.
    """
    parts, skipped = [], []
    for i, path in enumerate(paths):
        df = _reader(spark, skip_corrupt).parquet(path)
        if not has_columns(df, TRAINING_COLUMNS):
            missing = sorted(set(TRAINING_COLUMNS) - set(df.columns))
            skipped.append((i, path.rstrip("/").split("/")[-1], "missing columns: " + ", ".join(missing)))
            continue
        own = F.col("source_type") if "source_type" in df.columns else F.lit(None).cast("string")
        parts.append(df.withColumn("source_type", F.coalesce(own, F.lit(f"source_{i}"))).withColumn("dataset_source", F.lit(path.rstrip("/").split("/")[-1])))
    if not parts:
        raise ValueError("no source has the required columns")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    molecule = F.coalesce(F.col("molecule_id"), F.lit("background"))
    out = out.withColumn("sample_id", F.concat_ws(":", "source_type", molecule))
    left_out = spark.createDataFrame(skipped, "position int, dataset_source string, reason string")
    return out, out.groupBy("source_type", molecule.alias("molecule_id")).agg(F.count(F.lit(1)).alias("n")), left_out


def _existing(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """The path patterns that match at least one file or folder."""
    found = []
    for pattern in patterns:
        try:
            _reader(spark).parquet(pattern)
            found.append(pattern)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def read_validation(spark: SparkSession, root: str, snr: str, structures: Sequence[str] | None = None, n: int | None = None, skip_corrupt: bool = False) -> DataFrame:
    """Rows of ``validation_*_snr<x>.parquet`` (files or folders) with a lower-case id.

    On request some structures only, and their first n rows.
    """
    paths = _existing(spark, [f"{root}{level}/validation_*_snr{snr}.parquet" for level in ("", "/*")])
    if not paths:
        raise FileNotFoundError(f"no validation files of snr {snr} below {root}")
    df = _located(_reader(spark, skip_corrupt), paths)
    ident = _first_present(df, ID_COLUMNS)
    if ident is None:
        raise ValueError("no id column")
    out = df.withColumn("structure_id", F.lower(ident))
    if structures is not None:
        out = out.filter(F.col("structure_id").isin([s.lower() for s in structures]))
    return out if n is None else first_per_group(out, ["structure_id"], [F.col("batch_file"), F.col("row_index")], n)


def snr_extremes(df: DataFrame, structure: str = "structure", text: str = "source_type") -> DataFrame:
    """Data sets with the lowest and the highest SNR per structure, the SNR read from their name."""
    named = df.select(structure, text, snr_of(F.col(text)).alias("snr")).filter("snr IS NOT NULL")
    return named.groupBy(structure).agg(
        F.min("snr").alias("low_snr"), F.min_by(text, F.struct("snr", text)).alias("low_set"), F.max("snr").alias("high_snr"), F.max_by(text, F.struct("snr", text)).alias("high_set")
    )


def read_coords_csv(spark: SparkSession, path: str, schema: str = "protein string, filepath string, x double, y double, z double") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Pickable objects of a project file that are particles, with name and pdb id."""
    item = "name:string,pdb_id:string,label:int,radius:double,is_particle:boolean,map_threshold:double"
    project = spark.read.schema(f"pickable_objects array<struct<{item}>>").json(path, multiLine=True)
    return project.select(F.inline("pickable_objects")).filter(F.coalesce("is_particle", F.lit(False)))
