"""Queries of sources, synchronisation and maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import sync as Y
from ..session import shared_folder
from ..sources import files as R
from .registry import Inputs, query

STORED = "select o_orderkey as k, o_orderstatus as s, o_totalprice as p, o_orderpriority as r from orders where o_orderdate < timestamp '2000-01-01 00:00:00'"
INCOMING = "select o_orderkey as k, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as s, o_totalprice as p, o_orderpriority as r from orders where o_orderdate >= timestamp '1996-01-01 00:00:00'"
DIFF = f"with a as ({STORED}), b as ({INCOMING}) select coalesce(a.k, b.k) as k, case when b.k is null then 'deleted' when a.k is null then 'created' when a.s <> b.s or a.p <> b.p or a.r <> b.r then 'updated' else 'unchanged' end as op from a full join b on a.k = b.k"


def snapshots(i: Inputs) -> tuple[DataFrame, DataFrame]:
    o = i.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"), F.col("o_orderpriority").alias("r"), "o_orderdate")
    changed = F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s"))
    return o.where("o_orderdate < '2000-01-01'").drop("o_orderdate"), o.where("o_orderdate >= '1996-01-01'").withColumn("s", changed).drop("o_orderdate")


@query("src_15_full_sync", DIFF)
def _(i):
    old, new = snapshots(i)
    return Y.diffed(old, new, "k", ["s", "p", "r"]).select("k", "op")


@query("src_16_sync_counts", f"select op, count(*) as n from ({DIFF}) group by 1")
def _(i):
    old, new = snapshots(i)
    return Y.counts_by_op(Y.diffed(old, new, "k", ["s", "p", "r"]))


@query("src_14_upserted_rows", f"with a as ({STORED}), b as ({INCOMING}) select k, s, 'new' as side from b where r = '1-URGENT' union all select k, s, 'old' from a where k not in (select k from b where r = '1-URGENT')")
def _(i):
    old, new = snapshots(i)
    mark = lambda df, side: df.select("k", "s").withColumn("side", F.lit(side))
    return Y.upserted(mark(old, "old"), mark(new.where("r = '1-URGENT'"), "new"), ["k"])


@query("src_1_pruned_folders", "select p_partkey, p_type as folder from part where p_size % 9 <> 0")
def _(i):
    """Some folders begin with a mark, as does a folder above the root, and some files."""
    path = F.concat(F.lit("/!top/root/"), F.when(F.col("p_size") % 9 == 0, "!").otherwise(""), "p_type", F.lit("/"), F.when(F.col("p_size") % 4 == 0, "!").otherwise(""), "p_name")
    return R.pruned_tree(i.part.select("p_partkey", "p_type", path.alias("path")), "path", "/!top/root").select("p_partkey", F.col("p_type").alias("folder"))


@query("src_3_listing_rows", "select page_id, regexp_extract(url, '[^/]+$', 0) as name, length(html) as size from pages")
def _(i):
    return i.pages.select("page_id", F.regexp_extract("url", "[^/]+$", 0).alias("name"), F.length("html").cast("long").alias("size"))


LISTED = "select pk, cast(10 * round_even(pk * 300.0 / 1110.0 / 10, 0) as bigint) as dpi, case when pk % 5 in (0, 1, 3) then 1 else 2 end + case when pk % 4 = 1 then 5 else 0 end + case when pk % 4 = 2 then 5 else 0 end as priority, case pk % 4 when 0 then 'TOKEN' when 1 then 'CARDBACK' else 'CARD' end as card_type, case when size > 30000000 then 'too-large' when pk % 17 = 0 then 'no-extension' end as refused from cards"


def listed(i: Inputs) -> DataFrame:
    pk = F.col("pk")
    folder = F.when(pk % 4 == 0, "My Tokens").when(pk % 4 == 1, "Cardbacks").when(pk % 4 == 2, "Basics").otherwise("Other")
    name = F.concat("name", F.when(pk % 17 == 0, "").otherwise(".png"))
    return i.cards.select("pk", *[c.alias(n) for n, c in Y.listed_row(F.col("size"), pk, name, folder).items()])


@query("src_5_listing_transform", f"select pk, dpi, priority, card_type from ({LISTED})")
def _(i):
    return listed(i).select("pk", "dpi", "priority", "card_type")


@query("src_6_quarantine", f"select coalesce(refused, 'good') as kind, count(*) as n from ({LISTED}) group by 1")
def _(i):
    good, bad = Y.quarantined(listed(i))
    return good.agg(F.count("*").alias("n")).select(F.lit("good").alias("kind"), "n").unionByName(bad.groupBy(F.col("refused").alias("kind")).agg(F.count("*").alias("n")))


@query("src_7_unpacked_names", "select pk, language, name, 'png' as ext, cast(pk % 90 as string) as number from cards")
def _(i):
    raw = F.concat(F.lit("{"), "language", F.lit("} "), "name", F.lit(" {"), (F.col("pk") % 90).cast("string"), F.lit("}.png"))
    bare = X.without_language(X.without_extension(raw))
    return i.cards.select("pk", X.language_prefix(raw).alias("language"), X.collapse_spaces(X.without_brace_number(bare)).alias("name"), X.extension(raw).alias("ext"), X.brace_number(bare).alias("number"))


LINE = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])


def json_text(i: Inputs) -> DataFrame:
    """Lines of a legacy array: commas at their ends, brackets, blank and broken lines between them."""
    line = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "kind": "'), "event_type", F.lit('"'), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit(', "n": '), F.col("user_id").cast("string"))), F.lit("},"))
    value = F.when(F.col("event_id") % 50 == 0, "[").when(F.col("event_id") % 50 == 1, "  ").when(F.col("event_id") % 50 == 2, '{"id": broken').otherwise(line)
    return i.events.select(value.alias("value"))


@query("src_9_json_lines", "select event_id as id, event_type as kind, case when user_id % 3 <> 0 then user_id end as n from events where event_id % 50 > 2")
def _(i):
    return R.json_lines(json_text(i), LINE).where(f"{R.CORRUPT} is null").drop(R.CORRUPT)


@query("src_10_validated_rows", "select 'bad' as kind, count(*) filter (where event_id % 50 = 2) as n, cast(0 as bigint) as total from events union all select 'good', count(*) filter (where event_id % 50 > 2), cast(coalesce(sum(case when event_id % 50 > 2 then case when user_id % 3 = 0 then 7 else user_id end end), 0) as bigint) from events")
def _(i):
    good, bad = R.valid_rows(R.json_lines(json_text(i), LINE), ["id", "kind"], {"n": 7})
    count = lambda df, name, total: df.agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(name).alias("kind"), "n", "total")
    return count(bad, "bad", F.lit(0).cast("long")).unionByName(count(good, "good", F.coalesce(F.sum("n"), F.lit(0))))


@query("src_11_merged_lists", "with m as (select n_nationkey as k, upper(n_name) as name, 1 as p from nation where n_nationkey % 3 = 0 union all select n_nationkey, n_name, 0 from nation where n_nationkey % 3 <> 0) select k, name, row_number() over (order by p, k) - 1 as ordinal from m")
def _(i):
    n = i.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return Y.merged_lists(n, n.where("k % 3 = 0").withColumn("name", F.upper("name")), X.searchable(F.concat("name", F.translate(F.col("k").cast("string"), "0123456789", "abcdefghij"))), "k")


@query("src_12_csv_rows", "select n_nationkey as k, concat(cast(n_nationkey as string), ',', n_name) as line from nation")
def _(i):
    return i.nation.select(F.col("n_nationkey").alias("k"), F.to_csv(F.struct("n_nationkey", "n_name")).alias("line"))


@query("src_12_csv_files", "select pk, name, card_type, tag_list, dpi from cards")
def _(i):
    """The catalogue as CSV files with a header, and back with a given schema."""
    rows, path = i.cards.select("pk", "name", "card_type", "tag_list", "dpi"), f"{shared_folder(i.spark)}/csv-{uuid.uuid4().hex}"
    R.write_csv(rows, path)
    return i.spark.read.schema(rows.schema).option("emptyValue", "").option("nullValue", None).csv(path, header=True)


def tree(i: Inputs) -> str:
    """A folder tree that the parts are written to: kinds of parts, some of them pruned, below a folder whose name looks pruned."""
    root = f"{shared_folder(i.spark)}/!tree-{uuid.uuid4().hex}"
    for size in range(5):  # folders of two levels
        folder = f"{root}/{'!' if size == 3 else ''}size{size}/{'!' if size == 1 else ''}parts"
        i.part.where(F.col("p_size") % 5 == size).select("p_partkey", "p_name").write.csv(folder)
    return root


TREE = "select concat('size', p_size % 5, '/parts') as folder, count(*) as n from part where p_size % 5 not in (1, 3) group by 1"


@query("src_1_scanned_tree", TREE)
def _(i):
    """The rows of all files of a tree that a scan finds, by folder."""
    root = tree(i)
    rows = i.spark.read.text(f"{root}/*/*").select(F.col("_metadata.file_name").alias("name"))
    files = R.scan_folder(i.spark, root, "*.csv").select("name", "folder")
    return rows.join(files, "name").groupBy(F.regexp_extract("folder", "([^/]+/[^/]+)$", 1).alias("folder")).agg(F.count("*").alias("n"))


@query("src_17_surrogate_keys", "with f as (select l_partkey, l_suppkey, count(*) over (partition by l_suppkey) as group_rows from lineitem join part on p_partkey = l_partkey where p_size < 40) select 'found' as kind, count(*) as n, cast(sum(group_rows) as bigint) as total from f union all select 'missed', count(*), cast(0 as bigint) from lineitem where l_partkey not in (select p_partkey from part where p_size < 40)")
def _(i):
    dim = i.part.where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("sk"))
    found, missed = Y.enriched(i.lineitem.select("l_partkey", "l_suppkey"), dim, "l_partkey", "sk", "l_suppkey")
    one = found.agg(F.count("*").alias("n"), F.sum("group_rows").alias("total")).select(F.lit("found").alias("kind"), "n", "total")
    return one.unionByName(missed.agg(F.count("*").alias("n")).select(F.lit("missed").alias("kind"), "n", F.lit(0).cast("long").alias("total")))


def faces() -> F.Column:
    return F.array(F.struct((F.col("pk") + 1000).alias("illustration"), F.concat(F.lit("front "), "name").alias("text")), F.struct((F.col("pk") + 2000).alias("illustration"), F.concat(F.lit("back "), "name").alias("text")))


@query("src_18_faces", "select pk, coalesce(case when pk % 2 = 0 then illustration end, pk + 1000) as illustration, case when layout in ('transform', 'split') then 2 else 0 end as n_faces from printings")
def _(i):
    p = i.printings.withColumn("faces", faces())
    scalar = F.when(F.col("pk") % 2 == 0, F.col("illustration"))
    return p.select("pk", R.front_or_face(scalar, F.col("faces"), "illustration").alias("illustration"), F.coalesce(F.size(R.faces_of(F.col("faces"), F.col("layout"))), F.lit(0)).alias("n_faces"))


@query("src_19_joined_faces", "select pk, concat('front ', name, chr(10), '//', chr(10), 'back ', name) as text, case when artist = border then artist else concat(artist, '|', border) end as parts from printings")
def _(i):
    p = i.printings.withColumn("faces", faces())
    parts = R.union_in_order(F.array(F.array("artist", "border"), F.array("border", "artist")))
    return p.select("pk", F.array_join(F.transform("faces", lambda f: f["text"]), "\n//\n").alias("text"), F.array_join(parts, "|").alias("parts"))


@query("src_20_fresh_sources", "select n_nationkey, n_nationkey % 5 >= n_regionkey as fresh from nation")
def _(i):
    return i.nation.select("n_nationkey", R.fresh(F.col("n_nationkey") % 5, F.col("n_regionkey")).alias("fresh"))


@query("src_21_json_records", "select event_id, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k from events")
def _(i):
    return i.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("src_22_nested_to_lines", "select o_orderkey, concat(cast(cast(l_quantity as bigint) as string), 'x ', cast(l_partkey as string), ' (', l_returnflag, ') ', cast(l_linenumber as string)) as line from orders join lineitem on l_orderkey = o_orderkey")
def _(i):
    nested = i.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_partkey", "l_returnflag", "l_linenumber")).alias("rows"))
    deck = i.orders.select("o_orderkey").join(nested, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.explode("rows").alias("r"))
    return deck.select("o_orderkey", F.format_string("%dx %d (%s) %d", F.col("r.l_quantity").cast("long"), "r.l_partkey", "r.l_returnflag", "r.l_linenumber").alias("line"))


@query("src_23_xml_slots", "select l_orderkey, concat('i', cast(l_partkey as string)) as id, unnest([l_linenumber, l_linenumber + 10]) as slot from lineitem")
def _(i):
    card = F.concat(F.lit("<card><id>i"), F.col("l_partkey").cast("string"), F.lit("</id><slots>"), F.col("l_linenumber").cast("string"), F.lit(","), (F.col("l_linenumber") + 10).cast("string"), F.lit("</slots><name>n</name></card>"))
    xml = i.lineitem.groupBy("l_orderkey").agg(F.concat(F.lit("<order>"), F.array_join(F.collect_list(card), ""), F.lit("</order>")).alias("xml"))
    return R.order_slots(xml)


@query("src_24_face_pairs", "select distinct concat('front ', name) as front, concat('back ', name) as back from printings where layout = 'transform'")
def _(i):
    p = i.printings.where("layout = 'transform'").withColumn("faces", faces())
    return p.select(F.element_at("faces", 1)["text"].alias("front"), F.element_at("faces", 2)["text"].alias("back")).distinct()


REJUDGED = "select entity + 0 as entity, min(pk) + 1000000000 as pk, outcome, 'engine3-v9' as agent, 'run-new' as run_id from votes where agent like 'engine3-v%' and run_id in ('run1', 'run2') group by entity, outcome"


def rejudged(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """(table, archive) after a calculator's new run over the entities that two of its runs judged."""
    v = i.votes.select("entity", "pk", "outcome", "agent", "run_id")
    old = v.where("agent like 'engine3-v%' and run_id in ('run1', 'run2')")
    new = old.groupBy("entity", "outcome").agg((F.min("pk") + 1000000000).alias("pk")).select("entity", "pk", "outcome", F.lit("engine3-v9").alias("agent"), F.lit("run-new").alias("run_id"))
    return Y.replaced(v, new, ["entity"], "engine3", "run-new")


@query("stm_8_idempotent_replace", f"with n as ({REJUDGED}), t as (select entity, pk, outcome, agent, run_id from votes where agent is null or not (agent like 'engine3-v%' and entity in (select entity from n)) union all select entity, pk, outcome, agent, run_id from n) select entity, pk, outcome, agent, run_id from t")
def _(i):
    """The same run twice leaves what it leaves once: the second replaces the first's rows."""
    table, _ = rejudged(i)
    again = table.where("run_id = 'run-new'")
    return Y.replaced(table, again, ["entity"], "engine3", "run-new")[0].select("entity", "pk", "outcome", "agent", "run_id")


@query("stm_13_archived_generations", f"with n as ({REJUDGED}) select entity, pk, run_id, 'run-new' as superseded_by_run_id from votes where agent like 'engine3-v%' and entity in (select entity from n)")
def _(i):
    return rejudged(i)[1].select("entity", "pk", "run_id", "superseded_by_run_id")


@query("stm_14_skip_if_done", "select pk from cards where not (priority % 3 = 1 and created_day % 2 = 0)")
def _(i):
    done = i.cards.where("priority % 3 = 1 and created_day % 2 = 0").select("pk")
    return i.cards.select("pk").join(done, "pk", "left_anti")


@query("stm_3_seed_and_backlog", "with s as (select pk, 0 as lane from cards where pk in (5, 6, 7, 8) union all select pk, 1 from cards where status = 'UNRESOLVED'), d as (select pk, min(lane) as lane from s group by 1) select pk, lane from d order by lane, pk limit 50")
def _(i):
    seeds = i.cards.where("pk in (5, 6, 7, 8)").select("pk", F.lit(0).alias("lane"))
    both = seeds.unionByName(i.cards.where("status = 'UNRESOLVED'").select("pk", F.lit(1).alias("lane")))
    return both.groupBy("pk").agg(F.min("lane").alias("lane")).orderBy("lane", "pk").limit(50)


@query("dml_1_insert_ignore", "select distinct entity, agent from votes where agent is not null and outcome = 'view' and (entity, agent) not in (select (entity, agent) from votes where agent is not null and outcome = 'click')")
def _(i):
    v = i.votes.where("agent is not null").select("outcome", "entity", "agent")
    return Y.inserted_only(v.where("outcome = 'click'").drop("outcome"), v.where("outcome = 'view'").drop("outcome"), ["entity", "agent"])


@query("dml_3_retracted", "select pk from votes where not (run_id = 'run4' and source = 'ocr')")
def _(i):
    return Y.retracted(i.votes, (F.col("run_id") == "run4") & (F.col("source") == "ocr")).select("pk")


@query("dml_4_reparsed", "select pk, set_code as before, case when length(number) > 1 then set_code else '' end as after from (select distinct pk, set_code, number from evidence) where set_code <> case when length(number) > 1 then set_code else '' end")
def _(i):
    e = i.evidence.select("pk", "set_code", "number").distinct()
    after = F.when(F.length("number") > 1, F.col("set_code")).otherwise("")
    return e.withColumn("after", after).where(~F.col("set_code").eqNullSafe(F.col("after"))).select("pk", F.col("set_code").alias("before"), "after")


@query("dml_5_backfilled", "select c.pk, coalesce(c.dpi, v.dpi) as dpi, coalesce(c.phash, v.phash) as phash from cards c left join (select pk, 777 as dpi, pk as phash from cards where card_type = 'CARD') v using (pk)")
def _(i):
    values = i.cards.where("card_type = 'CARD'").select("pk", F.lit(777).alias("dpi"), F.col("pk").alias("phash"))
    return Y.backfilled(i.cards.select("pk", "dpi", "phash"), values, "pk", ["dpi", "phash"])


@query(
    "dml_6_warmed_stats",
    """with now as (select max(ts) as t from events), live as (select source_pk as key, count(*) as n from cards group by 1),
    cached as (select source_pk as key, count(*) - 1 as n, t - to_hours(cast(source_pk as integer)) as generated_at from cards, now where source_pk % 5 <> 0 group by source_pk, t)
    select l.key, case when c.generated_at > t - interval '12 hours' and l.key <> 3 then c.n else l.n end as n, case when c.generated_at > t - interval '12 hours' and l.key <> 3 then c.generated_at else t end as generated_at from live l cross join now left join cached c on c.key = l.key""",
)
def _(i):
    """Counts of sources from a cache that keeps 12 hours; source 3 is refreshed by force, and a fifth was never cached."""
    now = i.events.agg(F.max("ts").alias("now"))
    live = i.cards.groupBy(F.col("source_pk").alias("key")).agg(F.count("*").alias("n"))
    age = F.make_dt_interval(hours=F.col("key").cast("int"))
    cached = live.where("key % 5 <> 0").crossJoin(F.broadcast(now)).select("key", (F.col("n") - 1).alias("n"), (F.col("now") - age).alias("generated_at"))
    return Y.warmed(cached, live, now, "key", "n", 12, F.col("key") == 3)


@query("dml_7_last_write_wins", "select entity, agent, pk, outcome from (select *, row_number() over (partition by entity, agent order by ts desc, pk desc) as rn from votes where source in ('user', 'admin') and agent is not null) where rn = 1")
def _(i):
    v = i.votes.where(F.col("source").isin("user", "admin") & F.col("agent").isNotNull()).select("entity", "agent", "pk", "outcome", "ts")
    return Y.last_vote(v, ["entity", "agent"], ["ts", "pk"]).select("entity", "agent", "pk", "outcome")


@query("udf_4_canonical_loader", "select pk, name, set_code, number from printings where layout = 'normal'")
def _(i):
    loaded = i.printings.select(F.to_json(F.struct("pk", "name", "set_code", "number", "layout")).alias("value"))
    schema = T.StructType([T.StructField("pk", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("name", "set_code", "number", "layout")]])
    return R.json_lines(loaded, schema).where("layout = 'normal'").select("pk", "name", "set_code", "number")
