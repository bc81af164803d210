"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.session import only_row

#: A key of more than one row in so many is hot; there are at most so many of them.
HOT = 1000
#: Characters of text handled at once inside a task.
SLICE_CHARS = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes of text, so that long documents don't add up."""
    for batch in batches:
        start = size = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(df: DataFrame, columns: dict[str, str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to slices of the chosen columns; the second one is the text, and a null text reads as empty."""
    names = list(columns)
    chosen = df.select(*[(F.coalesce(F.col(c), F.lit("")) if i == 1 else F.col(c)).alias(names[i]) for i, c in enumerate(columns.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield fn(part)

    return chosen.mapInArrow(run, schema)


def looked_up(rows: DataFrame, table: DataFrame, key: str, times: str) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has one row for each key and, in ``times``, how many rows carry it.

    The keys of more than one in ``HOT`` of all rows, ``HOT`` at most, travel to
    the tasks; all others are shuffled, so no key fills a task. Null keys find nothing.
    """
    total = only_row(table.agg(F.sum(times).alias("n")))["n"] or 0
    hot = F.col(times) * HOT > total
    others = [c for c in table.columns if c != key]
    few = table.filter(hot).select(key, F.struct(*others).alias("__hot"))
    tried = rows.join(F.broadcast(few), key, "left")
    here = tried.filter(F.col("__hot").isNotNull()).select(*rows.columns, *[F.col(f"__hot.{c}").alias(c) for c in others])
    none = tried.filter(F.col("__hot").isNull() & F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in others])
    rest = tried.filter(F.col("__hot").isNull() & F.col(key).isNotNull()).select(*rows.columns).join(table.filter(~hot), key, "left")
    return here.unionByName(none).unionByName(rest.select(*rows.columns, *others))
