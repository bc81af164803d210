"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motefield.llm.common import map_texts
from motefield.session import written

#: Lengths that share a cell of the two-level running sum.
CELL = 256


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """Byte-level BPE from a file of ranks; special strings in a text are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of every whole text; a null or empty text has none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoding(ranks).encode_ordinary
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return map_texts(df, {"doc_id": id_col, "text": text_col}, run, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """``(n_tokens, n_docs)``: how many rows have each length. Rows without a length are left out."""
    return lengths.filter(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length: documents and tokens at or above it, and the total if texts were cut there.

    Columns: ``n_tokens, n_docs, docs_at_least, tokens_at_least, truncated_total,
    share_at_most``. ``truncated_total`` is the sum of ``min(length, n_tokens)``
    over all documents; ``share_at_most`` is the share of documents no longer
    than ``n_tokens``, so the q-quantile is the first length whose share reaches q.
    An empty histogram gives no rows.
    """
    # The histogram is read twice below, its texts are encoded once.
    histogram = written(histogram, "histogram")
    # Cells of neighbouring lengths are summed first; only their sums, one row a cell, meet in one place.
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("cell", F.expr(f"n_tokens div {CELL}"))
    cells = rows.groupBy("cell").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    whole = Window.partitionBy(F.lit(0))
    above = whole.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "cell", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"),
    )
    inside = Window.partitionBy("cell").orderBy(F.col("n_tokens").desc())
    summed = rows.join(cells, "cell").select(
        "n_tokens", "n_docs", "d_all", "t_all",
        (F.sum("n_docs").over(inside) + F.col("d_above")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("t_above")).alias("tokens_at_least"),
    )
    return summed.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("d_all")).alias("share_at_most"),
    )


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``(context, n_docs, n_over, truncated_total)`` for any context limits, from the suffix sums alone.

    A limit takes the row of the next length at or above it: everything longer
    counts ``limit`` tokens. Above the longest text the total is that of all tokens.
    """
    chosen = [F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("n_tokens") >= n, F.col("n_tokens"))).alias(f"l{i}") for i, n in enumerate(limits)]
    row = sums.agg(*chosen, F.max("docs_at_least").alias("docs"), F.max("tokens_at_least").alias("tokens"))
    each = [
        F.struct(
            F.lit(n).cast("long").alias("context"), F.col("docs").alias("n_docs"),
            F.coalesce(F.col(f"l{i}.docs_at_least"), F.lit(0)).alias("n_over"),
            (F.col("tokens") - F.coalesce(F.col(f"l{i}.tokens_at_least"), F.lit(0)) + n * F.coalesce(F.col(f"l{i}.docs_at_least"), F.lit(0))).alias("truncated_total"),
        )
        for i, n in enumerate(limits)
    ]
    return row.select(F.inline(F.array(*each))).filter(F.col("n_docs").isNotNull())


def quantile_lengths(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the first length whose share of documents reaches each given share."""
    row = sums.agg(*[F.min(F.when(F.col("share_at_most") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(q).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)]))).filter(F.col("n_tokens").isNotNull())
