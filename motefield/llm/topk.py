"""Exact top-k by integer inner product: tiles of queries against shards of rows.

Queries are cut into tiles and rows into shards by id hash. A task multiplies
one tile by one shard and keeps the best ``k`` of every query (partial
selection); the short lists are merged level by level, ``FAN`` shards at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.session import only_row

TILE_ROWS = 1024
SHARD_ROWS = 4096
FAN = 32


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, dim, v)`` with ``v = floor(scale * x)``, one row per id, unusable vectors left out."""
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = df.filter(F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; beyond what a long holds they stop at its limits."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(max(abs(int(a.max())), abs(int(a.min())))) * int(max(abs(int(b.max())), abs(int(b.min())))) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best_of_tile(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per query the ``k`` rows of highest score, ties to the smaller id, the query's own id left out."""
    rows = rows.sort_values("vec_id", ignore_index=True)
    ids, asked = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    score = _products(np.array(queries["v"].tolist(), np.int64).reshape(len(queries), -1), np.array(rows["v"].tolist(), np.int64).reshape(len(rows), -1))
    out = []
    for i, q in enumerate(asked):
        s = score[i]
        at = np.flatnonzero(ids != q)
        if len(at) > k:
            least = np.partition(s[at], len(at) - k)[len(at) - k]
            above, level = at[s[at] > least], at[s[at] == least]
            at = np.concatenate([above, level[: k - len(above)]])  # ids rise, so the first of equals are the smaller
        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at], "score": s[at]}))
    return pd.concat(out, ignore_index=True)


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best rows (all, if fewer), exactly.

    ``is_query`` is a condition on ``vec_id``. Components are floored to
    integers after scaling. Ties go to the smaller id; a row is never its own
    candidate. Vectors that are null or hold a null or non-finite component,
    and rows without an id, take no part. Of rows that repeat an id the one of
    the greatest vector counts. Only vectors of the query's length are its
    candidates. A query without candidates has no rows. Other columns are ignored.
    """
    rows = quantized(df, id_col, vector_col, scale)
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.count_if(is_query) / TILE_ROWS)).cast("int").alias("tiles"),
    )
    most = only_row(sizes.agg(F.max("shards").alias("n")))["n"] or 1
    placed = rows.join(sizes, "dim")
    own = F.xxhash64("vec_id")

    def over(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    shards = placed.select("dim", F.pmod(own, F.col("shards")).cast("int").alias("shard"), over("tiles").alias("tile"), "vec_id", "v")
    tiles = placed.filter(is_query).select(
        F.col("dim").alias("q_dim"), over("shards").alias("q_shard"), F.pmod(own, F.col("tiles")).cast("int").alias("q_tile"), F.col("vec_id").alias("q_id"), F.col("v").alias("q_v")
    )

    def multiply(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "shard": []})
        queries = queries.rename(columns={"q_id": "vec_id", "q_v": "v"})
        return best_of_tile(queries, block, k).assign(shard=key[1])

    keys = ["dim", "shard", "tile"]
    lists = tiles.groupBy(*[f"q_{c}" for c in keys]).cogroup(shards.groupBy(*keys)).applyInPandas(multiply, "query_id long, vec_id long, score long, shard int")
    best = [F.col("score").desc(), F.col("vec_id")]
    while True:
        most = -(-most // FAN)
        lists = lists.withColumn("shard", F.expr(f"shard div {FAN}").cast("int"))
        window = Window.partitionBy("query_id", "shard").orderBy(*best)
        lists = lists.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
        if most <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
