"""JSON lines, CSV, XML orders, decklists and folder trees as DataFrames.  Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

SOURCES = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "name", "identifier", "source_type", "external_link", "description")])
ORDER_IMAGE = T.StructType([T.StructField("id", T.StringType()), T.StructField("slots", T.StringType()), T.StructField("name", T.StringType())])


def json_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Rows of JSON lines: blank lines and ``[`` ``]`` lines are skipped, trailing commas dropped; a line that does not parse keeps its text in _corrupt_record."""
    text = F.rtrim(F.trim(column))
    bare = F.regexp_replace(text, ",$", "")
    with_bad = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.where(~text.isin("", "[", "]")).select(F.from_json(bare, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return parsed.select("r.*")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Plain or gzipped (by the name) JSON-lines files or JSON arrays with one element a line."""
    return json_lines(spark.read.text(path), schema)


def valid_rows(rows: DataFrame, required: list[str], defaults: dict) -> tuple[DataFrame, DataFrame]:
    """(rows with defaults filled in, bad rows): a row is bad if it did not parse or lacks a required field."""
    lacking = F.col(CORRUPT).isNotNull()
    for c in required:
        lacking = lacking | F.col(c).isNull()
    return rows.where(~lacking).drop(CORRUPT).fillna(defaults), rows.where(lacking)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SOURCES).csv(path, header=True)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def order_slots(orders: DataFrame, column: str = "xml") -> DataFrame:
    """(keys, id, slot) of XML orders: ``<order><card><id/><slots>1,2</slots></card>...</order>`` in a text column."""
    schema = T.StructType([T.StructField("card", T.ArrayType(ORDER_IMAGE))])
    rest = [c for c in orders.columns if c != column]
    cards = orders.select(*rest, F.explode(F.from_xml(column, schema)["card"]).alias("c"))
    return cards.select(*rest, F.col("c.id").alias("id"), F.explode(F.split("c.slots", r"\s*,\s*")).alias("slot")).withColumn("slot", F.col("slot").cast("int"))


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Order files, one whole file a row."""
    return order_slots(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("xml")))


def pruned_tree(rows: DataFrame, path: str, root: str = "") -> DataFrame:
    """Rows outside of folders below the root whose name starts with ``!``, at any depth; names of files and folders above do not count."""
    below = F.when(F.col(path).startswith(root), F.substring(F.col(path), len(root) + 1, 1 << 30)).otherwise(F.col(path)) if root else F.col(path)
    return rows.where(~below.rlike(r"(^|/)![^/]*/"))


def scan_folder(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, folder, name, modified, size) of all files below a folder that any Hadoop file system holds; contents are not read."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    listed = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return pruned_tree(listed, "path", root).withColumn("name", F.regexp_extract("path", "[^/]+$", 0)).withColumn("folder", F.regexp_replace("path", "/[^/]+$", ""))


def front_or_face(value: Column, faces: Column, name: str) -> Column:
    """A scalar or, without one, its value on the first face."""
    return F.coalesce(value, F.try_element_at(faces, F.lit(1))[name])


def faces_of(faces: Column, layout: Column, layouts: tuple[str, ...] = ("transform", "modal_dfc", "split")) -> Column:
    """All faces where the layout has more than one that count, else none."""
    return F.when(layout.isin(*layouts) & (F.size(faces) >= 2), faces)


def union_in_order(arrays: Column) -> Column:
    """One array of the distinct elements of several, in the order of their first appearance."""
    return F.array_distinct(F.flatten(arrays))


def fresh(stored: Column, remote: Column) -> Column:
    """Nothing to download: the stored stamp is not older than the remote one."""
    return F.coalesce(stored >= remote, F.lit(False))
