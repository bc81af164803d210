"""Named queries against their SQL on the smallest tables.

By default one query per area is run; MOTEFIELD_ALL=1 runs all of them.
"""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry_point  # noqa: E402
from tools.check_queries import TABLES, canonical  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "f2_pairwise_affinity", "f10_top_k_similar", "f11_affinity_agreement", "g3_class_separation", "b4_class_index", "b12_density_summary", "c2_align_tables",
    "c9_extract_boxes", "c11_nearest_pick", "d2_even_sample", "d6_epoch_sample", "e1_volume_stats", "e16_smooth", "i4_fsc_resolution", "j5_rotation_metrics",
    "j9_weighted_covariance", "h6_average_precision", "h8_paired_ttest", "k2_metric_snapshots", "k4_prototypes_stream", "k5_prototypes_v2", "a2_catalog", "l1_score",
]
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("MOTEFIELD_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 7


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder whose embeddings are a folder of files of unequal sizes, the largest with the last ids."""
    path = tmp_path_factory.mktemp("tables")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas().sort_values("vec_id")
    (path / "embeddings.parquet").mkdir()
    cuts = [0, 60, 180, len(rows)]
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        rows.iloc[lo:hi].to_parquet(path / "embeddings.parquet" / f"part-{i}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["a1_read_particles_flat", "a5_read_validation", "k4_prototypes_stream", "k5_prototypes_v2_stream"])
def test_tables_in_folders_of_files(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    want = con.execute(ORACLES[name]).df()
    assert len(want) and canonical(QUERIES[name](spark, folder).toPandas()) == canonical(want)
