"""Queries of pictures, policies and extension points."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import imaging as M
from .registry import query


@query("str_15_collector_line", "select pk, cast(pk % 300 + 1 as string) as number, case when pk % 3 = 2 then null when pk % 3 = 0 then 'abc' else 'xy1' end as set_code from cards")
def _(i):
    n = (F.col("pk") % 300 + 1).cast("string")
    line = F.when(F.col("pk") % 3 == 0, F.concat(n, F.lit("/264 R ABC . EN Some Artist"))).when(F.col("pk") % 3 == 1, F.concat(F.lit("XY1 "), n, F.lit(" 2019"))).otherwise(F.concat(n, F.lit("/300R 2020 ab")))
    return i.cards.select("pk", T.collector_line(line).alias("l")).select("pk", "l.*")


@query("img_4_picture_quality")
def _(i):
    """Vectors stand for pictures of 8 by 8 grey levels."""
    return i.embeddings.select("vec_id", M.quality(F.col("embedding")).alias("q")).select("vec_id", F.round("q.sharpness", 6).alias("sharpness"), F.round("q.entropy", 6).alias("entropy"), "q.truncated")


@query("img_9_merged_evidence", "select pk, 2 as ocr, 1 as hash, case when pk % 2 = 0 then 5 end as frame from cards")
def _(i):
    versions = lambda *pairs: F.create_map(*[F.lit(x) for p in pairs for x in p])
    old = F.when(F.col("pk") % 2 == 0, versions(("ocr", 1), ("frame", 5)))
    merged = M.merged_versions(old, versions(("ocr", 2), ("hash", 1)))
    return i.cards.select("pk", *[F.try_element_at(merged, F.lit(k)).alias(k) for k in ("ocr", "hash", "frame")])


@query("img_10_sliding_window", "select pk, cast(least(bit_count(xor(pk, 21)), bit_count(xor(pk * 3, 21)), bit_count(xor(pk * 7, 21))) as int) as distance from cards")
def _(i):
    windows = F.array(F.col("pk"), F.col("pk") * 3, F.col("pk") * 7)
    return i.cards.select("pk", M.nearest_window(windows, F.lit(21).cast("long"))["distance"].alias("distance"))


@query("ver_11_engines_on_pictures")
def _(i):
    """A reading is used where the picture is sharp and whole; else the row abstains by name."""
    q = i.embeddings.select("vec_id", "label", M.quality(F.col("embedding")).alias("q"))
    skip = F.when(F.col("q.truncated"), "truncated").when(F.col("q.entropy") < 2.0, "flat").otherwise("")
    return q.select("vec_id", F.when(skip == "", F.col("label")).alias("outcome"), skip.alias("skip_reason"))


@query("stm_10_load_governor", "select user_id, list_reduce(list_prepend(cast(8 as double), list(value order by event_id)), lambda w, x: case when x > 60 then greatest(1, floor(w / 2)) else w + 1 end) as width from events group by 1")
def _(i):
    loads = i.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("loads"))
    return loads.select("user_id", M.governed(F.col("loads"), 8, 60.0).alias("width"))


@query("stm_11_batch_sizes", "select c_custkey, greatest(1, least(cast(floor(4000 / (c_custkey % 50 + 1.0)) as bigint), cast(floor(600 / (c_custkey % 7 + 0.5)) as bigint), 500)) as rows from customer")
def _(i):
    k = F.col("c_custkey")
    return i.customer.select("c_custkey", M.batch_size(F.lit(4000), k % 50 + 1.0, F.lit(600), k % 7 + 0.5, 500).alias("rows"))


@query("udf_2_listing_source")
def _(i):
    """Reads a folder tree through the Python data source (the library's own package)."""
    from ..sources import listing

    listing.register(i.spark)
    root = str(Path(listing.__file__).parent) if i.spark.sparkContext.master.startswith("local[") else tempfile.gettempdir()
    files = i.spark.read.format("listing").option("path", root).load()
    return files.where(F.col("name").endswith(".py")).select("name", "size")


@query("udf_5_query_roster", None)
def _(i):
    """The registry as a table: what is offered and whether SQL states it too."""
    from .registry import ORACLES, QUERIES

    return i.spark.createDataFrame([(n, n in ORACLES) for n in sorted(QUERIES)], "name string, has_sql boolean")
