"""Micro-batches over append-only tables with Structured Streaming.

A stream's offsets live in its checkpoint, so a run resumes where the last one ended.  Each batch
writes its results and its ledger row under its own number and overwrites them when it is
replayed: delivery is exactly once without locks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "batch_id long, status string, rows_in long, rows_out long"


def change_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Rows of Parquet files as they are appended below a path."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def without_echoes(changes: DataFrame, writer: Column, own: list[str]) -> DataFrame:
    """Changes that this process wrote itself trigger nothing."""
    return changes.where(~F.coalesce(writer.isin(own), F.lit(False)))


def convey(changes: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, most_rows: int | None = None, mode: str = "append") -> None:
    """Process all available changes in micro-batches, then stop.

    Results go to ``out``/results and a ledger row to ``out``/ledger, both by batch_id.  A batch of more
    than most_rows rows is halted: it writes its ledger row alone.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        n = rows.count()
        status, n_out = "empty", 0
        if n and most_rows is not None and n > most_rows:
            status = "halted"
        elif n:
            status = "completed"
            folder = f"{out}/results/batch_id={batch_id}"
            process(rows).write.mode("overwrite").parquet(folder)
            n_out = rows.sparkSession.read.parquet(folder).count()
        ledger = rows.sparkSession.createDataFrame([(batch_id, status, n, n_out)], LEDGER)
        ledger.drop("batch_id").coalesce(1).write.mode("overwrite").parquet(f"{out}/ledger/batch_id={batch_id}")
        rows.unpersist()

    changes.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/results").parquet(f"{out}/results")


def ledger(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/ledger").parquet(f"{out}/ledger")


def windowed(changes: DataFrame, ts: str, keys: list[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window and keys; rows later than the watermark are dropped by the stream, not by a batch."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return changes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(changes: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    return changes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def cursor_walk(rows: DataFrame, key: str, cursor: int, n: int) -> DataFrame:
    """The next n rows behind a cursor in key order, wrapping to the start; ``wrapped`` tells which lap a row is of."""
    return rows.withColumn("wrapped", F.col(key) <= cursor).orderBy("wrapped", key).limit(n)


def claimed_walk(rows: DataFrame, key: str, claims: DataFrame, worker: str, n: int, cap: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(walked, claims): the next rows behind the shared cursor, and the claims with this worker's own row.

    claims: (version, worker, cursor, wrapped), append-only; the row of the greatest version is the cursor.
    A claim is a compare-and-set: it adds the version behind the one that was read, so of two workers
    that read the same version the one whose row is second (by name) has lost and walks nothing: see
    ``winners``.  At most ``cap`` rows are scanned.
    """
    at = claims.agg(F.max(F.struct("version", "cursor")).alias("c")).select(F.coalesce("c.version", F.lit(0)).alias("version"), F.coalesce("c.cursor", F.lit(-1)).alias("cursor")).first()  # one row
    walked = cursor_walk(rows, key, at["cursor"], min(n, cap))
    end = walked.agg(F.max(F.struct("wrapped", key)).alias("e")).select(F.lit(at["version"] + 1).alias("version"), F.lit(worker).alias("worker"), F.coalesce(F.col(f"e.{key}"), F.lit(at["cursor"])).alias("cursor"), F.coalesce("e.wrapped", F.lit(False)).alias("wrapped"))
    return walked, claims.unionByName(end.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in claims.schema]))


def winners(claims: DataFrame) -> DataFrame:
    """(version, worker, cursor, wrapped): of the claims on one version the first by name holds."""
    rest = F.struct("worker", "cursor", "wrapped")
    return claims.groupBy("version").agg(F.min(rest).alias("w")).select("version", "w.*")


def lap_complete(walked: DataFrame, found: str = "found") -> DataFrame:
    """(n, n_found, drained): a backlog is empty only after a whole lap without a find."""
    return walked.agg(F.count("*").alias("n"), F.count_if(F.col(found)).alias("n_found")).withColumn("drained", F.col("n_found") == 0)


def high_water(marks: DataFrame, scope: str, position: str) -> DataFrame:
    """The farthest position of every scope: marks never move back."""
    return marks.groupBy(scope).agg(F.max(position).alias(position))


def backlog(rows: DataFrame, done: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows that nothing has processed."""
    return rows.join(done.select(key), key, "left_anti").orderBy(key).limit(n)
