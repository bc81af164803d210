"""Labels, sampling, classification reports, streams and sinks on small made cases."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motefield.functions.labels import canonical_label, snr_of, stem_id
from motefield.operators import classification as cl
from motefield.operators import clean
from motefield.operators import prototypes as pr
from motefield.operators import sampling as sa
from motefield.operators.metric_log import last_per_epoch
from motefield.session import scratch_path
from motefield.sources import particles as src
from motefield.sources import sinks
from motefield.streaming.metric_stream import epoch_metric_stream
from motefield.streaming.prototype_stream import prototype_stream, step_prototype_stream


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_labels(spark):
    assert column(spark, ["VLP", "Apo-Ferritin", "beta galactoside", None, "Ribosome"], canonical_label) == ["virus_like_particle", "apoferritin", "beta_galactosidase", "unknown", "ribosome"]
    assert column(spark, ["1abc_2", "x_y", "a_b_10"], stem_id) == ["1abc-2", "x_y", "a_b-10"]
    assert column(spark, ["snr_0.5", "set-SNR-3", "snr2.25/x", "none"], snr_of) == [0.5, 3.0, 2.25, None]


def test_background_and_empty_volumes(spark):
    df = spark.createDataFrame([(1, [1.0] * 8, [2, 2, 2]), (2, [], [2, 2, 2]), (3, None, [2, 2, 2]), (4, [1.0], None), (5, [1.0] * 8, [2, 4])], "i int, data array<double>, shape array<int>")
    good, bad = clean.validate(df)
    assert [r["i"] for r in good.collect()] == [1]
    assert {r["i"]: r["reason"] for r in bad.collect()} == {2: "length_mismatch", 3: "missing_data", 4: "bad_shape", 5: "bad_shape"}


def test_undecodable_buffers(spark):
    df = spark.createDataFrame([(1, bytearray(np.arange(3, dtype="float32").tobytes())), (2, bytearray(b"abc")), (3, None)], "i int, subvolume binary")
    got = {r["i"]: r["subvolume"] for r in clean.decode_volumes(df).collect()}
    assert got == {1: [0.0, 1.0, 2.0], 2: None, 3: None}


def test_samples_have_the_right_sizes(spark):
    frame = pd.DataFrame({"id": np.arange(1000), "sample_id": np.where(np.arange(1000) < 700, "hot", np.where(np.arange(1000) < 995, "b", "c"))})
    df = spark.createDataFrame(frame)
    even = sa.balance(df, "sample_id", "id", 1).groupBy("sample_id").count().collect()
    assert {r["count"] for r in even} == {5}
    weights = spark.createDataFrame([("hot", 1.0), ("c", 2.0), ("gone", 1.0)], "sample_id string, weight double")
    drawn = sa.epoch_sample(df, weights, 101, 3).toPandas()
    assert len(drawn) == 101 and set(drawn["sample_id"]) == {"hot", "c"}
    assert 60 <= (drawn["sample_id"] == "c").sum() <= 70
    total = sa.sample_weights(df, weights).agg(F.sum("sample_weight")).first()[0]
    assert total == pytest.approx(1.0)
    none = sa.sample_weights(df, weights.filter("sample_id = 'gone'")).select("sample_weight").distinct().collect()
    assert [r[0] for r in none] == [0.001]
    spaced = sorted(r["id"] for r in sa.even_sample(df, ["sample_id"], "id", 7).filter("sample_id = 'hot'").collect())
    assert spaced == np.linspace(0, 699, 7, dtype=int).tolist()
    panel = sa.panel_sample(df, ["sample_id"], "id", 8, 1).groupBy("sample_id").count().collect()
    assert {r["count"] for r in panel} == {8}
    assert sa.sample_n(df, "id", 33, 5).count() == 33


def test_large_quota_is_unrolled_in_chunks(spark):
    quota = spark.createDataFrame([("a", 10, 95), ("b", 3, 0)], "k string, class_size long, quota long")
    got = sorted(r["draw"] for r in sa.draw_numbers(quota, chunk=10).collect())
    assert got == list(range(1, 96))


def test_average_precision_with_ties(spark):
    rng = np.random.default_rng(0)
    score, y = np.round(rng.random(200), 1), (rng.random(200) < 0.3).astype(int)
    rows = [(0, i, 0, 1, float(s), int(v)) for i, (s, v) in enumerate(zip(score, y))]
    df = spark.createDataFrame(rows, "fold int, id int, label int, class int, score double, y int")
    got = cl.average_precision(df).first()["average_precision"]
    want, before = 0.0, 0
    for cut in sorted(set(score))[::-1]:
        taken = score >= cut
        hits = y[taken].sum()
        want += (hits - before) / y.sum() * hits / taken.sum()
        before = hits
    assert got == pytest.approx(want)


def test_regression_beats_the_share_of_the_largest_class(spark):
    rng = np.random.default_rng(1)
    y = np.repeat([0, 1, 2], 30)
    x = rng.normal(size=(90, 4)) + np.eye(4)[y] * 4
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "id int, cls int, feature array<double>")
    scores = cl.fit_predict_folds(cl.stratified_folds(df, "cls", "id", 3), max_iter=20)
    assert scores.groupBy("fold", "id").agg(F.sum("score").alias("s")).filter("abs(s - 1) > 1e-6").count() == 0
    assert cl.spread_over_folds(cl.fold_accuracy(cl.predictions(scores)), "accuracy").first()["mean_accuracy"] > 0.85


def _labelled(spark, n, folds, seed=6):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 4, n)
    x = rng.normal(size=(n, 5)) * [1, 10, 0.1, 1, 1] + np.eye(4, 5)[y] * 1.5 + [0, 100, 0, 0, 0]
    rows = [(i, int(i % folds), f"c{c}", [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, fold int, cls string, feature array<double>").repartition(4)


def test_common_solver_finds_each_folds_optimum(spark):
    """The probabilities of Spark's own classifier, fitted fold by fold, and a gradient of zero."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = _labelled(spark, 240, 3)
    got = {(r["fold"], r["id"], r["class"]): r["score"] for r in cl.fit_predict_folds(df).collect()}
    assert len(got) == 240 * 4
    for r in cl.fold_scalers(df).collect():
        scaled = cl.scaled(F.col("feature"), F.array(*map(F.lit, r["mean"])), F.array(*map(F.lit, r["std"])))
        rows = df.select("id", "fold", array_to_vector(scaled).alias("features"), F.substring("cls", 2, 1).cast("double").alias("label"))
        model = LogisticRegression(family="multinomial", regParam=1.0 / 160, standardization=False, maxIter=1000, tol=1e-12).fit(rows.filter(F.col("fold") != r["fold"]))
        for row in model.transform(rows.filter(F.col("fold") == r["fold"])).select("id", vector_to_array("probability").alias("p")).collect():
            assert [got[r["fold"], row["id"], f"c{k}"] for k in range(4)] == pytest.approx(row["p"], abs=1e-5)
    residual = cl.stationarity(df).agg(F.max(F.abs("residual")).alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert residual["m"] < 1e-3 and residual["n"] == 3 * 4 * 5


def test_passes_do_not_grow_with_the_folds(spark):
    from motefield.operators.logistic import fit_all_folds

    def passes(folds):
        df = _labelled(spark, 300, folds)
        scalers = {r["fold"]: (np.array(r["mean"]), np.array(r["std"])) for r in cl.fold_scalers(df).collect()}
        rows = df.select(F.col("fold").alias("f"), F.substring("cls", 2, 1).cast("int").alias("y"), F.col("feature").alias("x"))
        return fit_all_folds(rows, [scalers[f] for f in range(folds)], 4)[1]

    few, many = passes(2), passes(10)
    assert many <= 1.5 * few and many < 120


def test_ttest_of_equal_and_shifted_series(spark):
    def series(values):
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "fold int, map double")

    same = cl.paired_ttest(series([0.5, 0.6, 0.7]), series([0.5, 0.6, 0.7]), "map").first()
    assert same["p_value"] == 1.0 and not same["is_significant"]
    got = cl.paired_ttest(series([0.50, 0.52, 0.48, 0.51, 0.49]), series([0.55, 0.57, 0.52, 0.57, 0.54]), "map").first()
    diff = np.array([0.05, 0.05, 0.04, 0.06, 0.05])
    assert got["t_statistic"] == pytest.approx(diff.mean() / (diff.std(ddof=1) / np.sqrt(5)))
    assert got["is_significant"] and got["ci_lower"] < 0.05 < got["ci_upper"]


@pytest.fixture(scope="module")
def row_files(spark):
    """Embedding rows in several files, so that a stream takes several micro-batches."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 3)), np.where(rng.random(300) < 0.5, 0, rng.integers(-1, 4, 300))
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "step long, cls int, feature array<double>")
    path = scratch_path(spark, "rows")
    for part in range(4):
        time.sleep(1.1)  # a file stream takes files by modification time
        df.filter(f"step >= {part * 75} AND step < {part * 75 + 75}").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return df, stream


def test_prototype_stream_equals_batch(spark, row_files):
    df, stream = row_files
    got = {r["cls"]: r for r in prototype_stream(spark, stream, "step").collect()}
    want = {r["cls"]: r for r in pr.prototypes(df, "step").collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[c]["prototype"], want[c]["prototype"]) and got[c]["n"] == want[c]["n"] for c in want)


def test_step_prototype_stream_equals_batch(spark, row_files):
    df, stream = row_files
    got = {r["cls"]: r for r in step_prototype_stream(spark, stream, 10).collect()}
    want = {r["cls"]: r for r in pr.prototypes_v2(df, "step", "step", warmup=10).collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[c]["prototype"], want[c]["prototype"]) for c in want)


def test_readers_report_missing_data(spark):
    with pytest.raises(FileNotFoundError):
        src.read_particles(spark, scratch_path(spark, "empty"), "s", "1.0")
    path = scratch_path(spark, "bad")
    spark.range(3).write.parquet(f"{path}/s/snr_1.0")
    with pytest.raises(ValueError):
        src.read_particles(spark, path, "s", "1.0")
    with pytest.raises(ValueError):
        src.load_sources(spark, [f"{path}/s/snr_1.0"])


def test_rerun_replaces_only_its_runs(spark):
    path = scratch_path(spark, "sink")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "run string, v int")
    sinks.write_embeddings(df, path)
    sinks.write_embeddings(spark.createDataFrame([("b", 9)], "run string, v int"), path)
    assert sorted((r["run"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 9)]


def test_comparison_of_two_sources(spark):
    from motefield.plans.classification import compare_sources

    rng = np.random.default_rng(12)
    y = np.repeat([0, 1, 2], 24)

    def source(noise, shift):
        x = np.eye(3)[y] * 2 + rng.normal(size=(72, 3)) * noise
        return spark.createDataFrame([(i + shift, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "id int, cls int, feature array<double>")

    reports = compare_sources(source(0.3, 0), source(2.0, 500).filter("id <> 500"), k=3, max_iter=10, balanced=True)
    summary = {r["method"]: r for r in reports["summary"].collect()}
    assert summary["first"]["mean_accuracy"] > summary["second"]["mean_accuracy"]
    assert reports["scores"].count() == 3 * 69 * 3
    assert reports["per_class"].count() == 9 and reports["class_improvement"].count() == 3
    assert reports["improvement"].first()["mean_improvement"] > 0


def test_restarted_stream_goes_on(spark):
    from motefield.streaming.prototype_stream import STATE_SCHEMA, run_prototype_stream

    rng = np.random.default_rng(21)
    rows = [(i, int(i % 3) - 1, [float(v) for v in rng.normal(size=2)]) for i in range(12)]
    df = spark.createDataFrame(rows, "step long, cls int, feature array<double>")
    path, state, checkpoint = (scratch_path(spark, n) for n in ("restart", "restart-state", "restart-checkpoint"))
    for low, high in ((0, 6), (6, 12), (12, 12)):
        if high > low:
            df.filter(f"step >= {low} AND step < {high}").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).parquet(path)
        last = run_prototype_stream(stream, "step", state, checkpoint)
    got = {r["cls"]: r for r in spark.read.schema(STATE_SCHEMA).parquet(last).collect()}
    want = {r["cls"]: r for r in pr.prototypes(df, "step").collect()}
    assert set(got) == set(want) == {0, 1}
    assert all(np.allclose(got[c]["prototype"], want[c]["prototype"]) and got[c]["n"] == 4 for c in want)


def test_broken_files_are_errors_and_are_named(spark):
    path = scratch_path(spark, "broken")
    good = spark.createDataFrame([([1.0], [1, 1, 1], "m")], "subvolume array<double>, shape array<int>, molecule_id string")
    good.coalesce(1).write.parquet(f"{path}/s/snr_1.0/good.parquet")
    spark.createDataFrame([("no parquet",)], "t string").coalesce(1).write.text(f"{path}/s/snr_1.0/bad.parquet")
    with pytest.raises(Exception):  # noqa: B017  whichever reader error comes first
        src.read_particles(spark, path, "s", "1.0").collect()
    assert src.read_particles(spark, path, "s", "1.0", skip_corrupt=True).count() == 1
    rejected = src.rejected_files(spark, f"{path}/s/snr_1.0/*.parquet").collect()
    assert len(rejected) == 1 and "bad.parquet" in rejected[0]["path"]


def test_metric_stream_takes_late_rows_and_restarts(spark):
    folder, out, check = (scratch_path(spark, n) for n in ("log", "out", "check"))
    schema = "ts timestamp, step long, key string, value double"
    days = [5, 1, 9, 3, 1]

    def add(i):
        rows = [(f"2024-01-0{days[i]} 0{h}:00:00", 10 * i + h, "loss", float(100 * i + h)) for h in range(3)]
        spark.createDataFrame(rows, "ts string, step long, key string, value double").selectExpr("cast(ts as timestamp) ts", "step", "key", "value").coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return epoch_metric_stream(spark, stream, out, check)

    for i in range(3):
        add(i)
    run()
    add(3)
    add(4)
    got = {(r["epoch"], r["key"]): (r["step"], r["value"]) for r in run().collect()}
    batch = spark.read.parquet(folder).selectExpr("unix_date(to_date(ts)) epoch", "key", "step", "value")
    want = {(r["epoch"], r["key"]): (r["step"], r["value"]) for r in last_per_epoch(batch).collect()}
    assert got == want and len(want) == 4


def test_step_prototype_stream_counts_late_rows_and_restarts(spark):
    path, out, check = (scratch_path(spark, n) for n in ("late", "late-out", "late-check"))
    schema = "step long, cls int, feature array<double>"
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(v) for v in rng.normal(size=3)]) for i in range(60)]

    def add_and_run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        return {r["cls"]: r for r in step_prototype_stream(spark, stream, 5, out, check).collect()}

    first = add_and_run(rows[20:40])
    again = add_and_run(rows[:20])
    assert all(again[c]["late"] == sum(1 for r in rows[5:20] if r[1] == c) and again[c]["prototype"] == first[c]["prototype"] for c in (0, 1))
    last = add_and_run(rows[40:])
    want = {r["cls"]: r for r in pr.prototypes_v2(spark.createDataFrame(rows[20:], schema), "step", "step", warmup=5).collect()}
    assert all(np.allclose(last[c]["prototype"], want[c]["prototype"]) for c in want)


def test_versioned_state_reads_the_newest_rows_and_compacts(spark):
    from motefield.streaming.state import VersionedState

    rng = np.random.default_rng(2)
    path = scratch_path(spark, "versioned")
    state, want = VersionedState(spark, path, "k int, v double", ["k"], every=3), {}
    for batch in range(8):
        before = {r["k"]: r["v"] for r in state.before(batch).collect()}
        assert before == want
        changed = {int(k): float(rng.normal()) for k in rng.choice(20, 4, replace=False)}
        for _ in range(2 if batch in (2, 4) else 1):  # a batch that is repeated finds and writes the same
            assert {r["k"]: r["v"] for r in state.before(batch).collect()} == want
            state.write(spark.createDataFrame(list(changed.items()), "k int, v double"), batch)
        want |= changed
        assert spark.read.parquet(f"{path}/changes/batch={batch}").count() == 4  # what changed, not what there is
    assert {r["k"]: r["v"] for r in state.latest().collect()} == want and len(want) > 8
    assert state.next_batch() == 8 and VersionedState(spark, scratch_path(spark, "none"), "k int, v double", ["k"]).latest().count() == 0


def test_stream_killed_between_write_and_commit(spark, monkeypatch):
    from motefield.streaming.state import VersionedState

    rows = [("2024-01-01 00:00:00", 1, "loss", 1.0), ("2024-01-01 01:00:00", 2, "loss", 2.0), ("2024-01-02 00:00:00", 3, "loss", 3.0), ("2024-01-01 02:00:00", 0, "loss", 9.0)]
    schema = "ts timestamp, step long, key string, value double"
    path, out, check = (scratch_path(spark, n) for n in ("killed", "killed-out", "killed-check"))

    def add_and_run(part):
        if part:
            spark.createDataFrame(part, "ts string, step long, key string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
        return epoch_metric_stream(spark, spark.readStream.schema(schema).parquet(path), out, check)

    add_and_run(rows[:2])
    write = VersionedState.write

    def dying(self, changed, batch):
        write(self, changed, batch)
        raise RuntimeError("killed after the write")

    monkeypatch.setattr(VersionedState, "write", dying)
    with pytest.raises(Exception):  # noqa: B017  the stream's own error
        add_and_run(rows[2:])
    monkeypatch.setattr(VersionedState, "write", write)
    got = sorted((r["step"], r["value"]) for r in add_and_run([]).collect())
    want = sorted((r["step"], r["value"]) for r in last_per_epoch(spark.read.parquet(path).select(F.unix_date(F.to_date("ts")).alias("epoch"), "key", "step", "value")).collect())
    assert got == want and len(got) == 2
