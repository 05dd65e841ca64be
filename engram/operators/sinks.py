"""A keyed table that streams merge into, batch by batch, and that replays do not change.

A batch is merged within itself and written to a folder of its number, which a repeated write replaces. Readers merge the
folders by key. Now and then all are folded into a base that says through which batch it goes: later readers take the
newest whole base and the batches after it, and a batch that the base already holds is not written again. So a query keeps
no state of its own for what only grows, and a sum counts every batch once, however often it is delivered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Merge = Callable[[DataFrame], DataFrame]


@dataclass
class MergedTable:
    """`merge` brings rows of equal keys to one row of the same columns; merging merged rows again gives the same."""

    spark: SparkSession
    path: str
    merge: Merge
    fold_after: int = 50

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind whose write has been committed."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        found = (x.getPath() for x in files.listStatus(at))
        whole = (x for x in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))
        return sorted(int(x.getName()) for x in whole if x.getName().isdigit())

    def through(self) -> int:
        return max(self._numbers("base"), default=-1)

    def put(self, batch: DataFrame, number: int) -> None:
        """Writes a batch; for `foreachBatch`. A batch that was written before leaves the table as it is."""
        base = self.through()
        if number <= base:
            return
        self.merge(batch).write.mode("overwrite").parquet(f"{self.path}/batch/{number}")
        if len([n for n in self._numbers("batch") if n > base]) > self.fold_after:
            self.fold()

    def _parts(self) -> list[str]:
        base = self.through()
        return [f"{self.path}/base/{base}"] * (base >= 0) + [f"{self.path}/batch/{n}" for n in self._numbers("batch") if n > base]

    def read(self) -> DataFrame | None:
        """The merged table, or None before the first batch."""
        parts = self._parts()
        return self.merge(self.spark.read.parquet(*parts)) if parts else None

    def fold(self) -> None:
        """Folds all batches into a new base; the old folders stay for readers that have begun, until `clean`."""
        numbers = self._numbers("batch")
        if numbers and numbers[-1] > self.through():
            self.read().write.mode("overwrite").parquet(f"{self.path}/base/{numbers[-1]}")

    def clean(self) -> None:
        """Removes bases but the newest, and batches that it holds; for when no reader of theirs is left."""
        base = self.through()
        for kind, old in (("base", [n for n in self._numbers("base") if n < base]), ("batch", [n for n in self._numbers("batch") if n <= base])):
            for n in old:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
