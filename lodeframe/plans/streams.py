"""Queries that run streams to their end; window queries are an extension beside the micro-batches."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, shared_folder
from ..streaming import claims as C
from ..streaming import conveyor as V
from ..streaming import state as K
from .registry import Inputs, query


#: Claimed keys that a worker holds before it writes them.
KEYS_HELD = 1 << 17


def ran(i: Inputs, process, name: str, changes=None) -> str:
    """Run the events through a conveyor; gives the folder of its results."""
    out = f"{shared_folder(i.spark)}/{name}-{uuid.uuid4().hex}"
    stream = V.change_stream(i.spark, f"{i.sf_dir}/events.parquet*", i.events.schema)
    V.convey(changes(stream) if changes else stream, process, out, f"{out}/checkpoint")
    return out


@query("stm_1_change_dispatch", "select event_id, event_type from events where user_id % 5 <> 0")
def _(i):
    own = lambda s: V.without_echoes(s, F.when(F.col("user_id") % 5 == 0, "self").otherwise("other"), ["self"])
    return V.results(i.spark, ran(i, lambda b: b.select("event_id", "event_type"), "dispatch", own)).select("event_id", "event_type")


@query("stm_2_conveyor_ledger", "select 'completed' as status, count(*) as rows_in, count(distinct user_id) as rows_out from events")
def _(i):
    out = ran(i, lambda b: b.groupBy("user_id").agg(F.count("*").alias("n")), "conveyor")
    total = V.results(i.spark, out).agg(F.countDistinct("user_id").alias("rows_out"))
    return V.ledger(i.spark, out).groupBy("status").agg(F.sum("rows_in").alias("rows_in")).crossJoin(total)


@query("stm_4_cursor_walk", "with n as (select count(*) as n, min(pk) as least from cards), w as (select pk, row_number() over (order by pk) - 1 as place from cards) select n_claim as version, pk from (select unnest(range(1, 5)) as n_claim), n, w where (place - (n_claim - 1) * 600 % n + n) % n < 600")
def _(i):
    """Four claims in turn of 600 rows each, wrapping at the table's end; a rival's claim on the second version loses."""
    rows = i.cards.select("pk")
    claims = i.spark.createDataFrame([], "version long, worker string, cursor long, wrapped boolean")
    out = None
    for turn in range(1, 5):
        walked, more = V.claimed_walk(rows, "pk", claims, "ann", 600)
        _, rival = V.claimed_walk(rows, "pk", claims, "bob", 10)
        claims = checkpointed(V.winners(more.unionByName(rival)))
        part = walked.select(F.lit(turn).cast("long").alias("version"), "pk")
        out = part if out is None else out.unionByName(part)
    return out


@query("stm_4_claimed_ranges", "select pk, cast(1 as bigint) as n_claims from cards where status <> 'RESOLVED'")
def _(i):
    """Two workers race along one cursor until the lap ends: each eligible row is claimed once, by one of them."""
    folder, name, fits = shared_folder(i.spark), uuid.uuid4().hex, F.col("status") != "RESOLVED"
    rows, kept = i.cards.select("pk", "status"), f"{folder}/claims-{name}"

    def walked(worker: str) -> None:
        """Claims are written some walks at a time: the driver never holds a lap."""
        cursor, ahead, keys, ended = C.Cursor(folder, f"cursor-{name}", i.spark), C.Ahead(rows, "pk", fits), [], False
        while not ended:
            walk = C.claimed(ahead, "pk", cursor, worker, fits, 1500, 1000, 3000, lap=0)
            keys, ended = keys + walk.found, walk.lap_ended
            if ended or len(keys) >= KEYS_HELD:
                i.spark.createDataFrame(pa.table({"pk": pa.array(keys, pa.int64())})).write.mode("append").parquet(f"{kept}-{worker}")
                keys = []

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(walked, ("ann", "bob")))
    return i.spark.read.schema("pk long").parquet(f"{kept}-ann", f"{kept}-bob").groupBy("pk").agg(F.count("*").alias("n_claims"))


@query("stm_5_lap_evidence", "select count(*) as n, count(*) filter (where status = 'UNRESOLVED') as n_found, count(*) filter (where status = 'UNRESOLVED') = 0 as drained from (select status from cards order by pk <= 100, pk limit 500)")
def _(i):
    return V.lap_complete(V.cursor_walk(i.cards.select("pk", "status"), "pk", 100, 500).withColumn("found", F.col("status") == "UNRESOLVED"))


@query("stm_6_high_water", "select run_id, max(pk) as pk from scans group by 1")
def _(i):
    return V.high_water(i.scans, "run_id", "pk")


def arriving(i: Inputs, rows: DataFrame, name: str, step) -> str:
    """Rows that arrive in two lots of two files, one file a batch; the stream stops between the lots and starts anew.  Gives the folder of its results."""
    folder = f"{shared_folder(i.spark)}/{name}-{uuid.uuid4().hex}"
    for lot in (0, 1):
        rows.where(F.pmod(F.xxhash64(rows.columns[0]), F.lit(2)) == lot).repartition(2).write.mode("append").parquet(f"{folder}/in")
        step(V.change_stream(i.spark, f"{folder}/in", rows.schema, 1), folder, f"{folder}/checkpoint")
    return folder


@query("stm_6_streamed_marks", "select run_id, max(pk) as pk from scans group by 1")
def _(i):
    """The marks of all scopes as keyed state of a stream that is stopped and started anew."""
    out = arriving(i, i.scans.select("pk", "run_id"), "marks", lambda stream, out, cp: K.advance_marks(stream, "run_id", "pk", out, cp))
    return K.marks(i.spark, out).select(F.col("scope").alias("run_id"), F.col("position").alias("pk"))


@query("win_7_streamed_rings", "select user_id as owner, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as int) as place, event_id as pk from events qualify place <= 5")
def _(i):
    """The five newest events of each user as keyed state of a stream that is stopped and started anew."""
    rows = i.events.select("event_id", "user_id", "ts")
    return K.rings(i.spark, arriving(i, rows, "rings", lambda stream, out, cp: K.fill_rings(stream, "user_id", "ts", "event_id", out, cp)))


@query("stm_7_backstop_sweep", "select pk from cards where pk not in (select card_pk from scans where reason <> 'no-text') order by pk limit 250")
def _(i):
    return V.backlog(i.cards.select("pk"), i.scans.where("reason <> 'no-text'").select(F.col("card_pk").alias("pk")), "pk", 250)


def finished(df: DataFrame, name: str) -> DataFrame:
    """A windowed stream run to its end in complete mode, from a table in memory."""
    table = f"{name}_{uuid.uuid4().hex}"
    folder = f"{shared_folder(df.sparkSession)}/{table}"
    df.writeStream.format("memory").queryName(table).outputMode("complete").option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(table)


@query("ext_tumbling_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def _(i):
    stream = V.change_stream(i.spark, f"{i.sf_dir}/events.parquet*", i.events.schema)
    return finished(V.windowed(stream, "ts", ["event_type"], "1 hour", "2 hours"), "tumbling")


@query("ext_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6' hour then 0 else 1 end as first from events), s as (select user_id, ts, sum(first) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, max(ts) + interval '6' hour as end, count(*) as n from s group by user_id, s")
def _(i):
    return V.sessions(i.events, "ts", "user_id", "6 hours", "1 day")
