"""Batch scoring of particle tables with an encoder supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.volumes import per_volume

OUTPUTS = "embedding array<double>, log_var array<double>, pose array<double>, global_weight double"

#: Bytes of outputs that are sent on together.
SENT_BYTES = 16 << 20


def score(df: DataFrame, encoder: Callable[[], Callable], batch_size: int = 64, data_col: str = "data") -> DataFrame:
    """Add ``embedding, log_var, pose, global_weight`` for every volume.

    ``encoder()`` is called once per task and returns a function from a batch
    of volumes (n, z, y, x) to the four arrays. Volumes are passed on in
    batches of one shape and at most ``batch_size``; the volume column is dropped.
    A null volume is an error.
    """
    kept = [c for c in df.columns if c not in (data_col, "shape")]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", " + OUTPUTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for batch in batches:
            if batch[data_col].isna().any() or batch["shape"].isna().any():
                raise ValueError("a volume or its shape is null; set such rows apart with validate() first")
            shapes = batch["shape"].map(lambda s: tuple(int(x) for x in s))
            done, held = [], 0
            for shape, rows in batch.groupby(shapes, sort=False):
                for start in range(0, len(rows), batch_size):
                    part = rows.iloc[start : start + batch_size]
                    volumes = np.stack([np.asarray(v, dtype=np.float64).reshape(shape) for v in part[data_col]])
                    outputs = [np.asarray(x, dtype=float) for x in model(volumes)]
                    done.append((part.index, *outputs))
                    held += sum(x.nbytes for x in outputs)
                    if held > SENT_BYTES:
                        yield together(batch, done)
                        done, held = [], 0
            if done:
                yield together(batch, done)

    def together(batch: pd.DataFrame, done: list) -> pd.DataFrame:
        """The outputs of many calls of the encoder as one frame; a frame for each call costs more than the call."""
        index, mu, log_var, pose, weight = zip(*done)
        arrays = {name: [row for x in parts for row in x] for name, parts in (("embedding", mu), ("log_var", log_var), ("pose", pose))}
        return batch.loc[np.concatenate(index), kept].assign(**arrays, global_weight=np.concatenate(weight))

    return df.mapInPandas(run, schema)


def normalize_for_scoring(df: DataFrame) -> DataFrame:
    """Z-score of each box; boxes that are almost constant are only centred."""

    def run(v: np.ndarray) -> tuple:
        std = v.std()
        return ((v - v.mean()) / (std if std > 1e-6 else 1.0),)

    return per_volume(df, run, {"data": "array<double>"})


def run_counts(df: DataFrame, key: str = "run") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
