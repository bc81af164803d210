"""Class prototypes kept by exponential moving averages, and scores of rows against them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.hashing import normal, uniform
from motefield.functions.vectors import let, unit
from motefield.operators.pairs import distances, map_with_table, stack, unit_rows
from motefield.operators.ranking import rank_by_value
from motefield.operators.similarity import directed
from motefield.session import written

# Weight of a new row, decay per second and per step, momentum range and its warm-up,
# weight above which a prototype counts as fresh, share and noise of the crossover.
ALPHA = 0.7
TIME_DECAY = 0.01
STEP_DECAY = 0.0001
MOMENTUM = (0.5, 0.9)
MOMENTUM_STEPS = 5000
FRESH = 0.1
MARGIN = 4.0
CROSSOVER_PROB = 0.3
CROSSOVER_NOISE = 0.01


def ema_segment(df: DataFrame, order_col: str, class_col: str = "cls", vec_col: str = "feature", alpha: float = ALPHA) -> DataFrame:
    """Fold the rows of each class into ``(n, tail, first, last_order)``.

    A run of n rows maps a prototype p to (1 - alpha)^n p + tail, so runs of a
    class can be folded apart and then combined; an unseen class starts from
    its first row. Background rows (-1) are left out.
    """
    rows = df.filter(F.col(class_col) >= 0)
    ranked = rank_by_value(rows, [class_col], order_col, [vec_col], group_size="__n")
    weight = F.lit(alpha) * F.pow(F.lit(1.0 - alpha), F.col("__n") - F.col("rn"))
    weighted = ranked.withColumn("__w", weight).withColumn("__v", array_to_vector(F.col(vec_col).cast("array<double>")))
    # The weighted mean times the weight sum is the weighted sum; tiny weights underflow to zero harmlessly.
    summary = Summarizer.metrics("mean").summary(F.col("__v"), F.col("__w")).alias("s")
    sums = weighted.groupBy(class_col).agg(
        summary, F.sum("__w").alias("__total"), F.count(F.lit(1)).alias("n"), F.max(order_col).alias("last_order"),
        F.max(F.when(F.col("rn") == 1, F.col(vec_col))).alias("first"),
    )
    return sums.select(class_col, "n", "last_order", "first", F.transform(vector_to_array("s.mean"), lambda m: m * F.col("__total")).alias("tail"))


def apply_segment(seen: Column, n: Column, tail: Column, first: Column, alpha: float = ALPHA) -> Column:
    """Prototype after a segment: from the previous one, or from the segment's own first row."""
    start = F.coalesce(seen, first)
    return F.zip_with(start, tail, lambda p, s: p * F.pow(F.lit(1.0 - alpha), n) + s)


def prototypes(df: DataFrame, order_col: str, class_col: str = "cls", vec_col: str = "feature", alpha: float = ALPHA) -> DataFrame:
    """Moving average per class over all rows in order: a closed form, no ordered fold in one task."""
    seg = ema_segment(df, order_col, class_col, vec_col, alpha)
    start = F.lit(None).cast("array<double>")
    return seg.select(class_col, "n", "last_order", apply_segment(start, F.col("n"), F.col("tail"), F.col("first"), alpha).alias("prototype"))


def momentum_at(step: float) -> float:
    low, high = MOMENTUM
    return low + (high - low) * step / MOMENTUM_STEPS if step < MOMENTUM_STEPS else high


def fold_rows(steps: np.ndarray, vectors: np.ndarray, state: np.ndarray | None) -> np.ndarray:
    """Unit-length moving average over ordered rows, starting from ``state``."""
    return fold_with_gain(steps, vectors, state)[0]


def fold_with_gain(steps: np.ndarray, vectors: np.ndarray, state: np.ndarray | None, gain: float = 0.0) -> tuple[np.ndarray, float]:
    """The fold, and the logarithm of what it makes of a small error of its start.

    A row multiplies an error by the momentum over the length before it is
    scaled to one; that length is small only where a row opposes the prototype.
    """
    for step, row in zip(steps, unit_rows(vectors)):
        if state is None:
            state = row
        else:
            m = momentum_at(float(step))
            state = m * state + (1.0 - m) * row
            size = np.linalg.norm(state)
            gain += math.log(m / size) if size > 0 else math.inf
            state = state / size if size > 0 else state
    return state, gain


#: Rows of a segment, and rows before it that its start is guessed from. With a momentum of 0.9 the warm-up forgets all but 1e-20.
SEGMENT_ROWS, WARM_ROWS = 4096, 448
#: A seam may differ by so much, and change the end of its segment by so much.
SEAM, SEAM_END = 1e-7, 1e-13
#: Times that segments with open seams are folded again side by side, before the rest of their class is folded as one.
REPEATS = 3


def _segment_ends(rows: DataFrame, kind: str) -> DataFrame:
    """``(cls, seg, start, end, gain, last_step)`` of rows ``(cls, seg, part, rn, step, v)``.

    ``part`` 0 is a given start, 1 the warm-up, 2 the segment's own rows. Rows are sorted on disk-backed partitions and
    streamed through; a task keeps one vector.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, vector, start, gain, last = None, None, None, 0.0, 0

        def result() -> tuple:
            return (*key, start, vector, gain, last)

        for batch in batches:
            done = []
            keys = batch[["cls", "seg", "part"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            steps = batch["step"].to_numpy()
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                cls, seg, part = batch["cls"].iloc[lo], int(batch["seg"].iloc[lo]), int(batch["part"].iloc[lo])
                if (cls, seg) != key:
                    if key is not None:
                        done.append(result())
                    key, vector, start, gain = (cls, seg), None, None, 0.0
                vectors = stack(batch["v"].iloc[lo:hi])
                if part == 0:
                    vector = start = vectors[0]
                elif part == 1:
                    vector = start = fold_rows(steps[lo:hi], vectors, vector)
                else:
                    vector, gain = fold_with_gain(steps[lo:hi], vectors, vector, gain)
                last = int(steps[hi - 1])
            if done:
                yield pd.DataFrame(done, columns=names)
        if key is not None:
            yield pd.DataFrame([result()], columns=names)

    names = ["cls", "seg", "start", "end", "gain", "last_step"]
    near = rows.repartition("cls", "seg").sortWithinPartitions("cls", "seg", "part", "rn")
    return near.select("cls", "seg", "part", "step", "v").mapInPandas(run, f"cls {kind}, seg long, start array<double>, end array<double>, gain double, last_step long")


def _open_seams(ends: DataFrame) -> DataFrame:
    """``(cls, seg, at)`` of segments whose start differs from the end before them by more than their own end forgives; ``at`` is that end."""
    before = ends.select("cls", (F.col("seg") + 1).alias("seg"), F.col("end").alias("at"))
    both = ends.join(before, ["cls", "seg"])
    off = F.sqrt(F.aggregate(F.zip_with("start", "at", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    closed = (off == 0) | ((off <= SEAM) & (F.log(off) + F.col("gain") <= math.log(SEAM_END)))
    return both.filter(~F.coalesce(closed, F.lit(False))).select("cls", "seg", "at")


def prototypes_v2(
    df: DataFrame, step_col: str, id_col: str, class_col: str = "cls", vec_col: str = "feature", warmup: int = 0, state: DataFrame | None = None,
    segment_rows: int = SEGMENT_ROWS, warm_rows: int = WARM_ROWS, repeats: int = REPEATS,
) -> DataFrame:
    """Unit-length prototypes with a momentum that grows with the step; rows before the warm-up are ignored.

    Every step divides by a length that depends on all rows before it, so a
    class is an ordered fold. It is folded in parallel: rows are ranked in
    their class and cut into segments, and each segment starts from a guess,
    the fold of ``warm_rows`` rows before it, which forgets where it began. A
    seam where the guess differs from the end of the segment before, by more
    than the segment itself forgets again, is open: its segment is folded again
    from that end, all of them side by side. Where seams are still open after
    ``repeats`` times, as rows that oppose their prototype can force, the rest of
    that class is folded as one. So the result is the ordered fold's. Earlier
    prototypes may be given as ``state``.
    """
    kind = dict(df.dtypes)[class_col]
    rows = df.filter((F.col(class_col) >= 0) & (F.col(step_col) >= warmup)).select(
        F.col(class_col).alias("cls"), F.col(step_col).cast("long").alias("step"), F.col(id_col).cast("string").alias("__id"), F.col(vec_col).alias("v")
    ).withColumn("__len", F.length("__id"))
    ranked = rank_by_value(rows, ["cls"], "step", ["__len", "__id"], group_size="__n").withColumn("rn", F.col("rn").cast("long"))
    seg = F.expr(f"(rn - 1) div {segment_rows}")
    # The last rows of a segment are the warm-up of the one after it, if there is one.
    warms = (F.col("rn") > (F.col("seg") + 1) * segment_rows - warm_rows) & (F.col("__n") > (F.col("seg") + 1) * segment_rows)
    own, warm = F.struct(F.col("seg"), F.lit(2).alias("part")), F.struct((F.col("seg") + 1).alias("seg"), F.lit(1).alias("part"))
    placed = ranked.withColumn("seg", seg).withColumn("__to", F.explode(F.when(warms, F.array(own, warm)).otherwise(F.array(own))))
    placed = placed.select("cls", "__to.seg", "__to.part", "rn", "step", "v")

    def begun(at: DataFrame) -> DataFrame:
        return at.select("cls", "seg", F.lit(0).alias("part"), F.lit(0).cast("long").alias("rn"), F.lit(0).cast("long").alias("step"), "v")

    first = placed
    if state is not None:
        old = state.select("cls", F.lit(0).cast("long").alias("seg"), F.col("prototype").alias("v"))
        first = placed.unionByName(begun(old.join(placed.select("cls").distinct(), "cls", "left_semi")))
    ends = written(_segment_ends(first, kind), "segments")
    for times in range(repeats + 1):
        seams = written(_open_seams(ends), "seams")
        if seams.isEmpty():
            break
        again = placed.filter(F.col("part") == 2)
        if times < repeats:
            again, at = again.join(seams.select("cls", "seg"), ["cls", "seg"], "left_semi"), seams.select("cls", "seg", F.col("at").alias("v"))
        else:
            # From the first open seam on a class becomes one segment; its end takes the place of the last one.
            opened = seams.groupBy("cls").agg(F.min(F.struct("seg", "at")).alias("s")).select("cls", F.col("s.seg").alias("from"), F.col("s.at").alias("v"))
            again, at = again.join(opened.select("cls", "from"), "cls").filter(F.col("seg") >= F.col("from")).withColumn("seg", F.col("from")).drop("from"), opened.select("cls", F.col("from").alias("seg"), "v")
        redone = _segment_ends(again.unionByName(begun(at)), kind)
        if times < repeats:
            ends = written(ends.join(seams.select("cls", "seg"), ["cls", "seg"], "left_anti").unionByName(redone), "segments")
        else:
            ends = written(ends.join(opened, (ends["cls"] == opened["cls"]) & (ends["seg"] >= opened["from"]), "left_anti").unionByName(redone), "segments")
    out = ends.groupBy("cls").agg(F.max_by(F.struct("last_step", "end"), "seg").alias("s")).select("cls", "s.last_step", F.col("s.end").alias("prototype"))
    if state is not None:
        out = out.unionByName(state.select("cls", F.col("last_step").cast("long").alias("last_step"), "prototype").join(out.select("cls"), "cls", "left_anti"))
    return out


def time_weight(now: Column, seen: Column) -> Column:
    """Staleness weight by seconds; 0 for a class never seen."""
    return F.coalesce(F.exp(F.lit(-TIME_DECAY) * (now - seen)), F.lit(0.0))


def step_weight(now: Column, seen: Column) -> Column:
    """Staleness weight by steps; 0 for a class never seen."""
    return F.coalesce(F.exp(F.lit(-STEP_DECAY) * (now - seen)), F.lit(0.0))


def prototype_weights(classes: DataFrame, protos: DataFrame, now, seen_col: str = "last_order", by: str = "step", class_col: str = "cls") -> DataFrame:
    """Weight of every class at ``now``; classes without a prototype get 0."""
    fn = step_weight if by == "step" else time_weight
    return classes.join(protos.select(class_col, seen_col), class_col, "left").select(class_col, fn(F.lit(now), F.col(seen_col)).alias("weight"))


def prototype_score(df: DataFrame, protos: DataFrame, class_aff: DataFrame, form: str = "contrastive", margin: float = MARGIN) -> DataFrame:
    """Score of rows against all prototypes, by class of the row: ``(cls, loss, n_fresh)``.

    ``protos`` has ``cls, prototype, weight``. The total score is the sum of
    ``loss`` over the sum of ``n_fresh``; see ``total_score``. Tasks return one
    row per class and batch.
    """
    known = directed(class_aff).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "affinity"))).alias("known"))
    table = protos.join(known, protos["cls"] == known["i"], "left").select("cls", "prototype", "weight", F.map_keys("known").alias("other"), F.map_values("known").alias("affinity"))
    rows = df.filter(F.col("cls") >= 0)
    kind = dict(df.dtypes)["cls"]

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["cls", "loss", "n_fresh"])
        x, p, w = unit_rows(stack(left["feature"])), stack(right["prototype"]), right["weight"].to_numpy(dtype=float)
        names, code = np.unique(left["cls"].to_numpy(), return_inverse=True)
        target = np.zeros((len(names), len(right)))
        for j, (cls, other, aff) in enumerate(zip(right["cls"], right["other"], right["affinity"])):
            lookup = dict(zip(other, aff)) if other is not None else {}
            target[:, j] = [1.0 if c == cls else lookup.get(c, 0.0) for c in names]
        t = target[code]
        if form == "contrastive":
            d = distances(x, p)
            loss = (t * d * d + (1.0 - t) * np.maximum(margin - d, 0.0) ** 2) * w
        else:
            loss = np.abs(x @ p.T - t) * w
        return pd.DataFrame({
            "cls": names, "loss": np.bincount(code, weights=loss.sum(axis=1)), "n_fresh": np.bincount(code) * int((w > FRESH).sum()),
        })

    sums = map_with_table(rows.select("id", "cls", "feature"), table, kernel, f"cls {kind}, loss double, n_fresh long")
    return sums.groupBy("cls").agg(F.sum("loss").alias("loss"), F.sum("n_fresh").alias("n_fresh"))


def total_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.when(F.sum("n_fresh") > 0, F.sum("loss") / F.sum("n_fresh")).otherwise(F.lit(0.0)).alias("score"))


def crossover(df: DataFrame, protos: DataFrame, seed, prob: float = CROSSOVER_PROB, noise: float = CROSSOVER_NOISE, id_col: str = "id") -> DataFrame:
    """Mix a share of the rows with the prototype of their class, dimension by dimension, add noise, renormalise.

    All choices come from hashes of (row, dimension); the prototypes are one
    row per class, joined by key.
    """
    joined = df.join(protos.select("cls", "prototype"), "cls", "left")
    chosen = F.col("prototype").isNotNull() & (uniform(f"{seed}p", F.col(id_col)) < prob)

    def mixed(i: Column) -> Column:
        own = F.when(uniform(f"{seed}m", F.col(id_col), i) < 0.5, F.get("feature", i)).otherwise(F.get("prototype", i))
        return own + F.lit(noise) * normal(f"{seed}n", F.col(id_col), i)

    made = let(F.transform(F.sequence(F.lit(0), F.size("feature") - 1), mixed), unit)
    out = F.when(chosen, made).otherwise(F.col("feature"))
    return joined.withColumn("crossed", chosen).withColumn("feature", out).drop("prototype")
