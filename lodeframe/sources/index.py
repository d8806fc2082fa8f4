"""A sink of search documents: Parquet parts by shard, shown by a manifest.

``docs.write.format("search-index").option("path", folder).option("key", "identifier")`` writes parts under
``data/`` and then, when all tasks are done, one manifest that lists the parts that count.  Readers
take the newest manifest, so a failed task or a lost executor leaves nothing visible.  Manifests have
a number each and are made exclusively: of writers that append at once one is second and adds
its parts to the other's list.

The folder is shared by driver and executors, in any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import logging
import os
import threading
import uuid
import weakref
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LOG = logging.getLogger(__name__)
SHARDS = 5
SHARD, DELETED = "shard_", "deleted_"


@dataclass
class Parts(WriterCommitMessage):
    files: list[str]


class Folder:
    """The files of an index."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")

    def at(self, *names: str) -> str:
        return "/".join((self.root.rstrip("/"), *names))

    def versions(self) -> list[str]:
        found = self.fs.get_file_info(pa.fs.FileSelector(self.at("manifest"), allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name[0] != ".")

    def manifest(self) -> tuple[int, list[tuple[int, str]]]:
        """(number of the newest manifest, its parts with the number of the commit that added each)."""
        names = self.versions()
        if not names:
            return 0, []
        with self.fs.open_input_stream(self.at("manifest", names[-1])) as f:
            return int(names[-1]), [tuple(x) for x in json.loads(f.read())]

    def publish(self, version: int, parts: list[tuple[int, str]]) -> bool:
        """Show the manifest of a number, unless there is one."""
        self.fs.create_dir(self.at("manifest"))
        beside, name = self.at("manifest", f".{uuid.uuid4().hex}"), self.at("manifest", f"{version:020d}")
        with self.fs.open_output_stream(beside) as f:
            f.write(json.dumps(parts).encode())
        if isinstance(self.fs, pa.fs.LocalFileSystem):
            try:
                os.link(beside, name)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(beside)
        if self.fs.get_file_info(name).type != pa.fs.FileType.NotFound:
            self.fs.delete_file(beside)
            return False
        self.fs.move(beside, name)
        return True

    def remove(self, files: list[str]) -> None:
        for name in files:
            if self.fs.get_file_info(self.at("data", name)).type == pa.fs.FileType.File:
                self.fs.delete_file(self.at("data", name))


class IndexWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, overwrite: bool) -> None:
        self.path, self.key, self.overwrite = path, key, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        """A part for each shard that the task holds rows of; none stays if it fails."""
        folder, task, open_parts = Folder(self.path), uuid.uuid4().hex, {}
        folder.fs.create_dir(folder.at("data"))
        try:
            for batch in iterator:
                if batch.column(batch.schema.get_field_index(self.key)).null_count:
                    raise ValueError(f"a document has no {self.key}")
                shards = batch.column(batch.schema.get_field_index(SHARD))
                for shard in shards.unique().to_pylist():
                    if shard not in open_parts:
                        open_parts[shard] = pq.ParquetWriter(folder.at("data", f"{shard}-{task}.parquet"), batch.schema, filesystem=folder.fs)
                    open_parts[shard].write_batch(batch.filter(pc.equal(shards, shard)))
            for part in open_parts.values():
                part.close()
        except BaseException:
            for part in open_parts.values():
                part.close()
            folder.remove([f"{s}-{task}.parquet" for s in open_parts])
            raise
        return Parts([f"{s}-{task}.parquet" for s in open_parts])

    def commit(self, messages: list[Parts | None]) -> None:
        folder, files = Folder(self.path), [f for m in messages if m for f in m.files]
        while True:
            version, parts = folder.manifest()
            if folder.publish(version + 1, ([] if self.overwrite else parts) + [(version + 1, f) for f in files]):
                return

    def abort(self, messages: list[Parts | None]) -> None:
        Folder(self.path).remove([f for m in messages if m for f in m.files])


class SearchIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search-index"

    def writer(self, schema: T.StructType, overwrite: bool) -> IndexWriter:
        return IndexWriter(self.options["path"], self.options["key"], overwrite)


_LOCK, _KNOWING = threading.Lock(), weakref.WeakSet()


def register(spark: SparkSession) -> None:
    """Make the sink known to a session, once, and the session to this thread: threads may write at the same time."""
    with _LOCK:
        if spark not in _KNOWING:
            spark.dataSource.register(SearchIndex)
            _KNOWING.add(spark)
    spark.createDataFrame([], "x int")  # the thread's active session is where a sink's name is looked up


def _written(rows: DataFrame, path: str, key: str, mode: str, deleted: bool) -> None:
    register(rows.sparkSession)
    shard = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(SHARDS)).cast("int")
    rows.withColumn(SHARD, F.coalesce(shard, F.lit(-1))).withColumn(DELETED, F.lit(deleted)).write.format("search-index").option("path", path).option("key", key).mode(mode).save()


def index_documents(docs: DataFrame, path: str, key: str) -> None:
    """Build the index anew; readers see the old one until all is written.  Keys are unique and not null."""
    _written(docs, path, key, "overwrite", False)


def _tried(rows: DataFrame, path: str, key: str, deleted: bool, what: str) -> bool:
    try:
        _written(rows, path, key, "append", deleted)
        return True
    except Exception:
        LOG.exception("%s of documents in %s failed", what, path)
        return False


def reindexed(rows: DataFrame, path: str, key: str) -> bool:
    """Put a few documents in the place of those of their keys; a failure is logged, not raised, and changes nothing."""
    return _tried(rows, path, key, False, "the update")


def removed(keys: DataFrame, path: str, key: str) -> bool:
    """Take documents out by their keys; a failure is logged, not raised, and changes nothing."""
    return _tried(keys.select(key), path, key, True, "the removal")


def indexed(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The documents that the index shows now.

    Rows of later commits, which are few, hide those of their keys in the first; only they are grouped.
    """
    folder = Folder(path)
    _, parts = folder.manifest()
    if not parts:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField(DELETED, T.BooleanType())])
    prefix = path if "://" in path else f"file://{os.path.abspath(path)}"
    read = lambda names: spark.read.schema(whole).parquet(*[f"{prefix.rstrip('/')}/data/{n}" for n in names])
    first = min(v for v, _ in parts)
    base, later = [f for v, f in parts if v == first], [(v, f) for v, f in parts if v != first]
    shown = read(base).where(~F.col(DELETED)).drop(DELETED)
    if not later:
        return shown
    versions = spark.createDataFrame(later, "version_ long, file_ string")
    rows = read([f for _, f in later]).withColumn("file_", F.col("_metadata.file_name")).join(versions, "file_")
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*whole.fieldNames()), F.col("version_")).alias("d")).select("d.*")
    return shown.join(newest.select(key), key, "left_anti").unionByName(newest.where(~F.col(DELETED)).drop(DELETED))
