"""A Python data source that lists catalogues: ``spark.read.format("listing").option("path", folder)``.

It is the extension point for connectors: a subclass lists another store with the same columns.
Remote stores need a network client and credentials, which the library does not ship.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Part(InputPartition):
    def __init__(self, folder: str) -> None:
        self.folder = folder


class FolderReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self):
        """A partition for each folder, without those that start with ``!``."""
        parts = []
        for folder, below, _ in os.walk(self.root):
            below[:] = sorted(d for d in below if not d.startswith("!"))
            parts.append(Part(folder))
        return parts

    def read(self, partition):
        try:
            entries = sorted(os.scandir(partition.folder), key=lambda e: e.name)
        except OSError:
            return  # a folder that cannot be listed is empty
        for e in entries:
            if e.is_file():
                s = e.stat()
                yield (e.path, e.name, partition.folder, s.st_size, int(s.st_mtime), None, None)


class FolderListing(DataSource):
    """Files of a local folder tree; checksums are null, for nothing is read."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "identifier string, name string, folder string, size long, modified long, md5 string, sha256 string"

    def reader(self, schema):
        return FolderReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderListing)
