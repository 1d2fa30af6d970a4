"""Ids that a load has seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgernet.operators.membership import BITS, marks, merged, suspects
from ledgernet.sources.workspace import delete_path

class History:
    """The ids of a table that grows by batches under ``out``.

    ``out/seen/batch=n`` has the bitmaps of all batches up to n, so that a batch reads and
    writes one of them however long the load runs. A batch that runs twice reads what
    earlier batches wrote and replaces its own.
    """

    def __init__(self, spark: SparkSession, out: str, bits: int = BITS):
        self.spark, self.folder, self.bits = spark, f"{out}/seen", bits

    def _batches(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = [f.getPath().getName() for f in system.listStatus(path)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def before(self, number: int) -> DataFrame | None:
        """The bitmaps of all batches before this one."""
        earlier = [b for b in self._batches() if b < number]
        return self.spark.read.parquet(f"{self.folder}/batch={earlier[-1]}") if earlier else None

    def seen_again(self, ids: DataFrame, key: str, number: int, known: DataFrame) -> DataFrame | None:
        """Ids of the batch that earlier batches hold; ``known`` has theirs in a column of that name.

        None if the bitmaps rule every id out: ``known`` is then not read.
        """
        seen = self.before(number)
        if seen is None:
            return None
        maybe = suspects(ids.select(key), key, seen, self.bits)
        return None if maybe.isEmpty() else maybe.join(known.select(key), key, "left_semi")

    def add(self, ids: DataFrame, key: str, number: int) -> None:
        """Write the bitmaps up to this batch and delete those that no retry can need."""
        own, seen = marks(ids, key, self.bits), self.before(number)
        total = own if seen is None else merged(own, seen)
        total.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        for old in [b for b in self._batches() if b < number][:-1]:
            delete_path(self.spark, f"{self.folder}/batch={old}")
