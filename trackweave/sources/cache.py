"""Tables kept in memory until they change or grow old."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from trackweave.sources.records import list_files
from trackweave.sources.tables import location

LIFETIME = 3600.0


@dataclass
class TableCache:
    """Frames by table name or path.

    A frame is kept while the table's files (paths, sizes, times) are those it was read from and it is younger than
    ``lifetime`` seconds; otherwise it is dropped and read anew. Listing the files costs a small job, no data is read.
    """

    spark: SparkSession
    lifetime: float = LIFETIME
    clock: Callable[[], float] = time.monotonic
    _kept: dict[str, tuple[tuple, float, DataFrame]] = field(default_factory=dict)

    def get(self, name: str, read: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
        """The table, kept in memory; ``read`` says how to read it, by default as Parquet or by its name."""
        state, now = self._state(name), self.clock()
        if name in self._kept:
            known, since, frame = self._kept[name]
            if known == state and now - since < self.lifetime:
                return frame
            self.drop(name)
        if read is not None:
            frame = read(self.spark, name)
        else:
            self.spark.catalog.refreshByPath(name) if "/" in name else self.spark.catalog.refreshTable(name)
            frame = self.spark.read.parquet(name) if "/" in name else self.spark.table(name)
        frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
        self._kept[name] = (state, now, frame)
        return frame

    def drop(self, name: str) -> None:
        if name in self._kept:
            self._kept.pop(name)[2].unpersist()

    def clear(self) -> None:
        for name in list(self._kept):
            self.drop(name)

    def _state(self, name: str) -> tuple:
        path = name if "/" in name else location(self.spark, name)
        return tuple(sorted(tuple(row) for row in list_files(self.spark, path, "*.parquet").collect()))
