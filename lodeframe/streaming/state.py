"""State by key over micro-batches: marks that never fall, and rings that keep the newest rows of an owner.

State lives in the stream's checkpoint (RocksDB), one value or a few rows a key, and is read and written
by key alone, so a batch costs what it holds, whatever was seen before.  A stream that was stopped
goes on where it ended.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import conveyor as V

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams that start here keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Marks(StatefulProcessor):
    """The farthest position of each scope; a row comes out when it moves ahead, none for older positions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "position long, n_rows long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.mark.get() if self.mark.exists() else (None, 0)
        best, n = stored[0], stored[1]
        for row in rows:
            n += 1
            if row.position is not None and (best is None or row.position > best):
                best = row.position
        self.mark.update((best, n))
        if best != stored[0]:
            yield Row(scope=key[0], position=best, n_rows=n)

    def close(self) -> None:
        pass


class Ring(StatefulProcessor):
    """The ``size`` newest rows of each owner; what is older leaves the state for good."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "stamp long, pk long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = [(r[0], r[1]) for r in self.ring.get()]
        heapq.heapify(kept)
        changed = False
        for row in rows:
            item = (row.stamp, row.pk)
            if len(kept) < self.size:
                heapq.heappush(kept, item)
                changed = True
            elif item > kept[0]:
                heapq.heapreplace(kept, item)
                changed = True
        if changed:
            self.ring.put(sorted(kept))
            yield Row(owner=key[0], pks=[pk for _, pk in sorted(kept, reverse=True)])

    def close(self) -> None:
        pass


def _ran(changes: DataFrame, key: str, processor: StatefulProcessor, schema: T.StructType, out: str, checkpoint: str) -> None:
    with rocks_state(changes.sparkSession):
        V.convey(changes.groupBy(key).transformWithState(processor, schema, "update", "none"), lambda rows: rows, out, checkpoint, mode="update")


def advance_marks(changes: DataFrame, scope: str, position: str, out: str, checkpoint: str) -> None:
    """Move the marks of all scopes by all that has arrived; ``marks`` reads them.  A null position moves nothing."""
    rows = changes.select(F.col(scope).alias("scope"), F.col(position).cast("long").alias("position"))
    schema = T.StructType([T.StructField("scope", rows.schema["scope"].dataType), T.StructField("position", T.LongType()), T.StructField("n_rows", T.LongType())])
    _ran(rows, "scope", Marks(), schema, out, checkpoint)


def marks(spark: SparkSession, out: str) -> DataFrame:
    """(scope, position): where each scope is now."""
    return V.results(spark, out).groupBy("scope").agg(F.max("position").alias("position"))


def fill_rings(changes: DataFrame, owner: str, stamp: str, key: str, out: str, checkpoint: str, size: int = 5) -> None:
    """Put all that has arrived into the rings of its owners; ``rings`` reads them.

    Newer is a greater stamp (a timestamp counts in microseconds), then a greater key.  Rows without
    stamp or key are left out.
    """
    kind = changes.schema[stamp].dataType
    at = F.unix_micros(F.col(stamp).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(stamp).cast("long")
    rows = changes.select(F.col(owner).alias("owner"), at.alias("stamp"), F.col(key).cast("long").alias("pk")).where("stamp is not null and pk is not null")
    schema = T.StructType([T.StructField("owner", rows.schema["owner"].dataType), T.StructField("pks", T.ArrayType(T.LongType()))])
    _ran(rows, "owner", Ring(size), schema, out, checkpoint)


def rings(spark: SparkSession, out: str) -> DataFrame:
    """(owner, place, pk): what each ring holds now, the newest first."""
    last = V.results(spark, out).groupBy("owner").agg(F.max_by("pks", "batch_id").alias("pks"))
    return last.select("owner", F.posexplode("pks").alias("place", "pk")).select("owner", (F.col("place") + 1).alias("place"), "pk")
