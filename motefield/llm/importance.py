"""Importance resampling towards a target distribution of hashed n-grams, counted by segments.

Features are words and pairs of neighbouring words, hashed into buckets.
Newlines separate words, so they cut a text into lines that can be counted on
their own: the features of a distinct line are hashed once, its counts are
multiplied by how often the line occurs, and only the pairs that reach from one
line into the next are counted for each text. The same goes for the weights: a
distinct line's sum of gains is worked out once and joined to its occurrences.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import looked_up, text_slices
from motefield.operators.ranking import rank_by_value
from motefield.session import only_row, written

BUCKETS = 10_000
SEED, MIN_WORDS, PERCENT = 7, 20, 25
#: Capitals A to Z become small letters; of other ASCII only digits and small letters belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(line: bytes) -> list[bytes]:
    return line.translate(_FOLD).split()


def _numbers(crcs: list[int], buckets: int) -> bytes:
    return (np.array(crcs, np.uint32) % np.uint32(buckets)).astype(np.uint32 if buckets > 1 << 16 else np.uint16).tobytes()


def line_buckets(words: list[bytes], buckets: int = BUCKETS) -> bytes:
    """Buckets of the words and of the pairs of neighbours of one line."""
    one = list(map(crc32, words))
    return _numbers(one + list(map(crc32, words[1:], map(crc32, repeat(b" "), one))), buckets)


def _read(raw: bytes, buckets: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if buckets > 1 << 16 else np.uint16)


def line_table(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(key, times, buckets)`` of every distinct line with a word: 128-bit name, occurrences, buckets of its features."""
    lines = df.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).filter(F.col("line") != "")
    distinct = lines.groupBy("line").agg(F.count(F.lit(1)).alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text=0):
            keys, times, found = [], [], []
            for line, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = line.encode("utf-8", "replace")
                words = words_of(raw)
                if words:
                    keys.append(hashlib.md5(raw, usedforsecurity=False).digest())
                    times.append(n)
                    found.append(line_buckets(words, buckets))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(times, pa.int64()), pa.array(found, pa.binary())], ["key", "times", "buckets"])

    return distinct.mapInArrow(run, "key binary, times long, buckets binary")


def text_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, lines, buckets)`` of every row: names of its lines with words, and buckets of the pairs across lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            # name, first word, and checksum of the last word and a space, once for each distinct line
            known: dict[bytes, tuple[bytes, bytes, int] | None] = {}
            lines, across = [], []
            for text in part.column(1).to_pylist():
                names, pairs, last = [], [], None
                for raw in (text or "").encode("utf-8", "replace").split(b"\n"):
                    if raw not in known:
                        words = words_of(raw)
                        known[raw] = (hashlib.md5(raw, usedforsecurity=False).digest(), words[0], crc32(b" ", crc32(words[-1]))) if words else None
                    line = known[raw]
                    if line is None:
                        continue
                    names.append(line[0])
                    if last is not None:
                        pairs.append(crc32(line[1], last))
                    last = line[2]
                lines.append(names)
                across.append(_numbers(pairs, buckets))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lines, pa.list_(pa.binary())), pa.array(across, pa.binary())], ["doc_id", "lines", "buckets"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, lines array<binary>, buckets binary")


def bucket_counts(lines: DataFrame, texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: lines times their occurrences, and the pairs across lines. One small array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            numbers = _read(b"".join(raw), buckets)
            sizes = np.array([len(x) for x in raw], np.int64) // numbers.itemsize
            # Whole numbers below 2**53 are exact in the sums of one batch.
            total += np.bincount(numbers, weights=np.repeat(batch.column(0).to_numpy().astype(np.float64), sizes), minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    every = lines.select("times", "buckets").unionAll(texts.select(F.lit(1).cast("long").alias("times"), "buckets"))
    table = every.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets))))`` of every bucket."""
    whole_s, whole_t = float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole_s / ((s + 1.0) * whole_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _summed(df: DataFrame, columns: list[str], gains, buckets: int) -> DataFrame:
    """The chosen columns, with number and sum of gains of the features in ``buckets``."""
    sent = df.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.num_columns - 1).to_pylist()
            numbers = _read(b"".join(raw), buckets)
            ends = np.cumsum(np.array([0, *[len(x) for x in raw]], np.int64)) // numbers.itemsize
            upto = np.r_[0, np.cumsum(sent.value[numbers])]
            own = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(ends)), pa.array(np.diff(upto[ends]))], [*columns, "n", "gain"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*columns, "buckets").mapInArrow(run, f"{kinds}, n long, gain long")


def importance_weights(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(row, doc_id, n_features, weight)`` of every row; ``weight`` is the floored mean of the gains of its features.

    Features are all words and pairs of neighbouring words of the whole text,
    counted as often as they occur. Words are runs of ASCII letters and digits
    and of characters beyond ASCII; capitals A to Z count as small letters. A
    null text or one without words has no features and weight 0. Repeated rows
    count and are returned as often as they occur; ``row`` tells them apart. An
    empty target gives every bucket a gain that depends on the source alone, an
    empty table gives no rows. Other columns are left out.
    """
    lines = written(line_table(df, text_col, buckets), "lines")
    texts = written(text_table(df, id_col, text_col, buckets).withColumn("row", F.monotonically_increasing_id()), "texts")
    aimed = [written(t, "target") for t in (line_table(target, target_col, buckets), text_table(target.select(target_col, F.lit(0).alias("__id")), "__id", target_col, buckets))]
    gains = bucket_gains(bucket_counts(lines, texts, buckets), bucket_counts(*aimed, buckets))
    judged = written(_summed(lines, ["key", "times"], gains, buckets), "gains")
    each = looked_up(texts.select("row", F.explode("lines").alias("key")), judged, "key", "times")
    inside = each.groupBy("row").agg(F.sum("n").alias("n_lines"), F.sum("gain").alias("line_gain"))
    both = _summed(texts, ["row", "doc_id"], gains, buckets).join(inside, "row", "left")
    sums = both.select("row", "doc_id", (F.col("n") + F.coalesce("n_lines", F.lit(0))).alias("n_features"), (F.col("gain") + F.coalesce("line_gain", F.lit(0))).alias("total"))
    mean = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) div n_features END")
    return sums.select("row", "doc_id", "n_features", mean.alias("weight"))


def draw(weights: DataFrame, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``: a weighted draw without replacement.

    ``score`` adds a Gumbel variable from the hash of seed and id to the weight
    (in thousandths), so the highest scores are a draw in proportion to the
    weights' exponentials. Of the N rows of at least ``min_words`` words the
    ``percent`` in a hundred of highest score, rounded down, have a rank from 1
    on; ties go to the smaller id, and rows equal in that too come in any fixed
    order. A null id is hashed as an empty one and is smaller than all others.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))).cast("long")
    scored = written(weights.withColumn("score", score), "scores")
    # w words make w features and w - 1 pairs
    long_enough = scored.filter(F.col("n_features") >= max(1, 2 * min_words - 1))
    taken = percent * only_row(long_enough.agg(F.count(F.lit(1)).alias("n")))["n"] // 100
    ranked = rank_by_value(long_enough.select("row", "doc_id", "score"), [], "score", ["doc_id", "row"], descending=True, out="rank")
    ranked = ranked.filter(F.col("rank") <= taken).select("row", F.col("rank").cast("long").alias("rank"))
    return scored.join(ranked, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def drawn_rows(df: DataFrame, draws: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id was drawn, with all their columns."""
    ids = draws.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("__drawn")).distinct()
    return df.join(ids, F.col(id_col).eqNullSafe(F.col("__drawn")), "left_semi")
