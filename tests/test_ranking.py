"""Ranks, running sums and percentiles on groups of very different size."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motefield.functions.hashing import normal, uniform
from motefield.operators.clean import exact_percentiles
from motefield.operators.metric_log import fill_forward
from motefield.operators.ranking import first_per_group, rank_by_hash, rank_by_value


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most of the rows, some small ones and one with a single row."""
    rng = np.random.default_rng(5)
    keys = ["hot"] * 700 + ["a"] * 40 + ["b"] * 9 + ["one"]
    frame = pd.DataFrame({"k": keys, "id": rng.permutation(len(keys)), "v": np.round(rng.normal(size=len(keys)), 1), "w": rng.integers(0, 9, len(keys))})
    return frame, spark.createDataFrame(frame).repartition(5).cache()


def test_rank_by_value(skewed):
    frame, df = skewed
    got = rank_by_value(df, ["k"], "v", ["id"], running={"run": "w"}, buckets=16, group_size="n").toPandas().sort_values("id")
    want = frame.sort_values(["k", "v", "id"])
    want["rn"] = want.groupby("k").cumcount() + 1
    want["run"] = want.groupby("k")["w"].cumsum()
    want["n"] = want.groupby("k")["w"].transform("size")
    want = want.sort_values("id")
    for col in ("rn", "run", "n"):
        assert got[col].tolist() == want[col].tolist()


def test_rank_by_value_descending_without_keys(skewed):
    frame, df = skewed
    got = rank_by_value(df, [], "id", descending=True).toPandas()
    assert (got["rn"] + got["id"]).nunique() == 1


def test_rank_by_hash_does_not_depend_on_partitions(skewed):
    _, df = skewed
    a = rank_by_hash(df, ["k"], ["id"], 7).toPandas().set_index("id")["rn"].sort_index()
    b = rank_by_hash(df.repartition(11), ["k"], ["id"], 7, hex_digits=1).toPandas().set_index("id")["rn"].sort_index()
    assert a.equals(b)
    assert sorted(a) == sorted(np.concatenate([np.arange(1, n + 1) for n in (700, 40, 9, 1)]))


def test_first_per_group(skewed):
    _, df = skewed
    assert first_per_group(df, ["k"], [F.col("id")], 5).groupBy("k").count().toPandas()["count"].tolist().count(5) == 3


def test_exact_percentiles(skewed):
    frame, df = skewed
    got = exact_percentiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.99, 1.0], ["id"]).toPandas()
    for row in got.itertuples():
        want = np.percentile(frame[frame["k"] == row.k]["v"], row.share * 100)
        assert row.value == pytest.approx(want, abs=1e-12)
    assert len(got) == 20


@pytest.mark.parametrize("few", [0, 40, 10_000])
def test_percentiles_by_leading_bits(spark, few):
    """Ties, nulls, both zeros, infinities, close values, negative ones, and one value alone; no bucket is finished early with few=0."""
    rng = np.random.default_rng(4)
    groups = {
        "ties": [1.5] * 70 + [2.5] * 30, "zeros": [-0.0, 0.0, -0.0, 0.0, -1.0], "close": (1.0 + np.arange(200) * 2.0**-52).tolist(), "mixed": (rng.normal(size=300) * 10.0 ** rng.integers(-200, 200, 300)).tolist(),
        "one": [-7.25], "ends": [float("-inf"), -1.0, 3.0, float("inf")], None: rng.normal(size=50).tolist(),
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("ties", None), ("none", None)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v", shares, few=few).collect()
    assert len(got) == len(groups) * len(shares)
    for r in got:
        ordered = sorted(groups[r["k"]])
        place = r["share"] * (len(ordered) - 1)
        low, part = ordered[int(place)], place - int(place)
        want = low + part * (ordered[int(place) + 1] - low) if part else low
        assert r["value"] == want or r["value"] == pytest.approx(want, rel=1e-12, nan_ok=True), r
    whole = exact_percentiles(spark.createDataFrame([(0, 3.0), (1, float("nan")), (2, 1.0)], "i int, v double"), [], "v", [0.5, 1.0], few=few).orderBy("share").collect()
    assert whole[0]["value"] == 3.0 and np.isnan(whole[1]["value"])


def test_fill_forward(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"t": np.arange(200, dtype="int64"), "a": np.where(rng.random(200) < 0.05, rng.random(200), np.nan)})
    df = spark.createDataFrame(frame).select("t", F.when(~F.isnan("a"), F.col("a")).alias("a"))
    got = fill_forward(df, "t", ["a"], block=16).toPandas().sort_values("t")["a"].to_numpy(dtype=float)
    np.testing.assert_array_equal(got, frame["a"].ffill().to_numpy())


def test_uniform_and_normal_have_the_right_moments(spark):
    row = spark.range(20000).select(uniform(1, F.col("id")).alias("u"), normal(2, F.col("id")).alias("n")).agg(
        F.avg("u").alias("u"), F.avg("n").alias("n"), F.stddev("n").alias("s"), F.min("u").alias("lo"), F.max("u").alias("hi")
    ).first()
    assert abs(row["u"] - 0.5) < 0.01 and abs(row["n"]) < 0.03 and abs(row["s"] - 1) < 0.03
    assert 0 <= row["lo"] and row["hi"] < 1


def test_null_keys_and_values_are_ranked_too(spark):
    rows = [("a", 1, 0.5), ("a", 2, None), ("a", 3, 0.1), (None, 4, 2.0), (None, 5, 1.0), (None, 6, None)]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    got = {r["id"]: (r["rn"], r["n"]) for r in rank_by_value(df, ["k"], "v", ["id"], group_size="n").collect()}
    assert got == {2: (1, 3), 3: (2, 3), 1: (3, 3), 6: (1, 3), 5: (2, 3), 4: (3, 3)}  # nulls first, as Spark sorts
    hashed = rank_by_hash(df, ["k"], ["id"], 1).collect()
    assert sorted(r["rn"] for r in hashed if r["k"] is None) == [1, 2, 3] and len(hashed) == 6


def test_one_value_of_half_of_the_rows_is_split(spark):
    rows = [("k", None if i % 7 == 0 else "same" if i % 2 else f"v{i:05d}", f"id{i:05d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v string, id string").repartition(6)
    got = rank_by_value(df, ["k"], "v", ["id"], buckets=16)
    want = {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2])))}
    assert {r["id"]: r["rn"] for r in got.select("id", "rn").collect()} == want
    # the ranges the rows were written by: the common value lies in several of them
    ranged = df.repartitionByRange(16, "k", "v", "id").filter("v = 'same'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert ranged >= 6
