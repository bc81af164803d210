"""Registered queries against SQL, and the stages of the pipeline against their rules."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from motefield.llm.queries import ORACLES, QUERIES  # noqa: E402
from motefield.session import written  # noqa: E402
from tools.check_queries import TABLES, canonical  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        con = duckdb.connect()
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = con.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        left = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert left and set(left) <= set(seen) and docs.count() == len(left)
        if name in ("quality", "near_dedup"):
            assert all(left[i] == seen[i] for i in left)
        if name == "line_dedup":
            assert all(set(left[i].split("\n")) <= set(seen[i].split("\n")) for i in left)
        if name == "secrets":
            assert set(left) == set(seen) and not any("AKIA" in t for t in left.values())
        seen = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(seen)


def test_pipeline_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), name)
        assert docs.count() >= 0
    repeated = corpus_pipeline.near_dedup(spark, odd, SF).collect()
    assert sum(r["doc_id"] in (1, 2) for r in repeated) == 1 and len(repeated) == odd.count() - 2
