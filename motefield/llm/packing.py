"""Packing into optimal length buckets.

The histogram of all lengths is small, because lengths end at ``max_len``. Over
it dynamic programming chooses the bucket boundaries that make the least
padding in total. Documents then get a place in a batch of their bucket; a
batch holds as many rows as the token budget allows at the bucket's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.operators.ranking import rank_by_hash
from motefield.session import written

#: A run of letters, digits and underscores, or any other visible character.
TOKEN = r"[\p{L}\p{N}_]++|[^\s\p{L}\p{N}_]"


def token_count(text: Column) -> Column:
    """Words and punctuation marks of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """At most ``buckets`` boundaries with the least padding over a histogram, and that padding.

    Exact: ``best[k][j]`` is the least padding of the lengths up to ``j`` in
    ``k`` buckets of which the last ends at ``j``.
    """
    order = np.argsort(lengths)
    v, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(v)
    if not n:
        return [], 0
    docs, tokens = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * v)]
    best = v * docs[1:] - tokens[1:]
    back = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        nxt, last = best.copy(), np.zeros(n, np.int64)
        for j in range(1, n):
            # the bucket that ends at j begins after i
            pad = best[:j] + v[j] * (docs[j + 1] - docs[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(np.argmin(pad))
            if pad[i] < nxt[j]:
                nxt[j], last[j] = pad[i], i + 1
        best = nxt
        back.append(last)
    ends, j, k = [], n - 1, len(back) - 1
    while True:
        ends.append(int(v[j]))
        begin = int(back[k][j])
        if not begin:
            # zero means the first bucket, or that this many buckets are no better than one fewer
            while k and not begin:
                k -= 1
                begin = int(back[k][j])
            if not begin:
                break
        j, k = begin - 1, k - 1
    return ends[::-1], int(best[-1])


def pack(
    df: DataFrame, length: Column, max_len: int = 8192, buckets: int = 16, token_budget: int = 65536, seed: int = 0, id_col: str = "doc_id"
) -> DataFrame:
    """``(doc_id, segment, start, n_tokens, bucket_len, batch, slot)``: where every document goes.

    ``length`` is a column of token counts; null counts as 0. A document longer
    than ``max_len`` is cut into segments of that length and a rest, nothing is
    dropped. Empty documents take a place in the smallest bucket. Batches of a
    bucket are numbered from 0 in seeded hash order of (id, segment), so equal
    ids, null ids and repeated rows each get a place of their own. An empty
    table gives no rows; other columns are left out.
    """
    sized = df.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("__n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("__n") / max_len)).cast("int")
    segments = written(
        sized.select("doc_id", "__n", F.explode(F.sequence(F.lit(0), parts - 1)).alias("segment")).select(
            "doc_id", "segment", (F.col("segment").cast("long") * max_len).alias("start"),
            F.least(F.col("__n") - F.col("segment").cast("long") * max_len, F.lit(max_len)).alias("n_tokens"),
        ),
        "segments",
    )
    # At most max_len + 1 rows.
    histogram = segments.groupBy("n_tokens").count().collect()
    ends, _ = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    bucket = F.lit(None).cast("long")
    for end in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(bucket)
    ranked = rank_by_hash(segments.withColumn("bucket_len", bucket), ["bucket_len"], ["doc_id", "segment"], seed, out="__rn")
    room = F.greatest(F.lit(1), F.expr(f"{token_budget} div greatest(bucket_len, 1)"))
    place = ranked.withColumn("__room", room).withColumn("__rn", F.col("__rn") - 1)
    return place.select(
        "doc_id", "segment", "start", "n_tokens", "bucket_len",
        F.expr("__rn div __room").cast("long").alias("batch"), F.expr("__rn % __room").cast("int").alias("slot"),
    )
