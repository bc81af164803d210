"""Versioned state of a stream: the changed rows of each micro-batch, and now and then all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.session import only_row

#: Micro-batches between two folders that hold the whole state.
EVERY = 16


class VersionedState:
    """One row for each key, in a folder.

    A micro-batch appends a folder with the rows it changed; after every
    ``every`` of them another folder holds all rows (compaction). A read takes
    the last such folder and the changes since, and the newest version of each
    key. Names follow from the number of the batch, so nothing is listed to
    read or write, a batch never reads what it writes itself, and one that is
    repeated after a failure finds its input unchanged and writes the same
    folders again. What a batch writes is in proportion to the keys it changed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], every: int = EVERY):
        self.spark, self.path, self.schema, self.keys, self.every = spark, path, schema, list(keys), every

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={batch}"

    def _rows(self, kind: str, batches: Sequence[int]) -> DataFrame:
        reader = self.spark.read.schema(f"{self.schema}, batch long").option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*[self._folder(kind, b) for b in batches])

    def before(self, batch: int) -> DataFrame:
        """The state that micro-batch number ``batch`` starts from."""
        whole = batch // self.every * self.every - 1
        rows = self.spark.createDataFrame([], f"{self.schema}, batch long")
        if whole >= 0:
            rows = self._rows("whole", [whole])
        if batch > whole + 1:
            rows = rows.unionByName(self._rows("changes", range(whole + 1, batch)))
        others = [c for c in rows.columns if c not in (*self.keys, "batch")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "batch").alias("s"))
        return newest.select(*[F.col(c) if c in self.keys else F.col(f"s.{c}").alias(c) for c in rows.columns if c != "batch"])

    def write(self, changed: DataFrame, batch: int) -> None:
        """Record the rows that a micro-batch changed; a row stands for all of its key."""
        names = [c for c in self.spark.createDataFrame([], self.schema).columns]
        changed.select(*names).write.mode("overwrite").parquet(self._folder("changes", batch))
        if (batch + 1) % self.every == 0:
            whole = batch // self.every * self.every - 1
            rows = self._rows("changes", range(whole + 1, batch + 1))
            if whole >= 0:
                rows = rows.unionByName(self._rows("whole", [whole]))
            others = [c for c in names if c not in self.keys]
            newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "batch").alias("s"))
            newest.select(*self.keys, "s.*").select(*names).write.mode("overwrite").parquet(self._folder("whole", batch))

    def next_batch(self) -> int:
        """Number after the last micro-batch written; from a listing of paths alone."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        try:
            listing = files.load(f"{self.path}/changes")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        last = only_row(listing.agg(F.max(F.regexp_extract("path", "/batch=([0-9]+)/", 1).cast("long")).alias("b")))["b"]
        return 0 if last is None else last + 1

    def latest(self) -> DataFrame:
        return self.before(self.next_batch())
