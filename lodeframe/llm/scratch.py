"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder of this machine only where all runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lodeframe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, parts: list[str] | None = None) -> DataFrame:
    """The rows of df, written once as Parquet and read again: lost executors cost no recomputation."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that a broadcast may hold: some tens of MB on every executor.
BROADCAST_ROWS = 1 << 19


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its rows, which are counted, are few; else joined by a shuffle."""
    return F.broadcast(table) if table.count() <= most else table


#: Every so many rows show which keys are very common; a table has fewer than so many of these.
SAMPLED, COMMON = 64, 4096


def common_keys(table: DataFrame, key: str, *told_by: str) -> DataFrame:
    """The keys that hold more than a 4,096th of a written table's rows, by a sample (of rows that ``told_by`` tells apart): fewer than ``COMMON``."""
    sample = table.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(*told_by), F.lit(SAMPLED)) == 0)).groupBy(key).agg(F.count("*").alias("rows_"))
    sample = written(sample.where("rows_ > 1"), "common")
    total = sample.agg(F.sum("rows_")).first()[0] or 0
    return sample.where(F.col("rows_") > max(32, total // COMMON)).select(key)


def joined_apart(left: DataFrame, right: DataFrame, key: str, *told_by: str) -> DataFrame:
    """left join of a written table with one that has a row a key; very common keys meet a broadcast of their rows, not one task."""
    common = F.broadcast(common_keys(left, key, *told_by))
    few = F.broadcast(written(right.join(common, key, "left_semi"), "few"))
    cold = left.join(common, key, "left_anti").join(right, key, "left")
    return left.join(common, key, "left_semi").join(few, key, "left").select(*cold.columns).unionByName(cold)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind as keep it apart from the columns (whatever their case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for frame in frames:
        for folder in {x.rsplit("/", 1)[0] for x in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
