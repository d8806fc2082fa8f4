"""Whole runs: stages one behind the other, with checks before, a ledger between and resume behind the last finished stage.

A run is a folder in the shared folder.  Each stage's rows are written there and then its ledger row, so a
stage counts as finished only with all its rows; a run that is started again under the same id reads
the finished stages and computes the others.  Also here: what calculators report, verdicts of two
engines, and verdicts that groups of equal pictures share.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "ordinal int, stage string, status string, rows_out long, detail string, finished_at double"
Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """A step from the inputs and the stages before to rows; ``gates`` name rows that must not be in its result."""

    name: str
    run: Callable[[Tables], DataFrame]
    gates: Mapping[str, Callable[[Tables], DataFrame]] = field(default_factory=dict)


class Halted(RuntimeError):
    """A check before the run, or a gate behind a stage, found rows."""


class Run:
    def __init__(self, spark: SparkSession, folder: str, run_id: str, stages: list[Stage], preflight: Mapping[str, Callable[[Tables], DataFrame]] | None = None) -> None:
        if len({s.name for s in stages}) < len(stages):
            raise ValueError("two stages have one name")
        self.spark, self.root, self.run_id, self.stages, self.preflight = spark, f"{folder}/{run_id}", run_id, stages, preflight or {}

    def _exists(self, path: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _note(self, ordinal: int, stage: str, status: str, rows_out: int, detail: str = "") -> None:
        row = self.spark.createDataFrame([(ordinal, stage, status, rows_out, detail, time.time())], LEDGER)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def ledger(self) -> DataFrame:
        """All that was noted, attempt by attempt."""
        path = f"{self.root}/ledger"
        return self.spark.read.schema(LEDGER).parquet(path) if self._exists(path) else self.spark.createDataFrame([], LEDGER)

    def _checked(self, ordinal: int, name: str, checks: Mapping[str, Callable[[Tables], DataFrame]], tables: Tables) -> None:
        for check, rows in checks.items():
            n = rows(tables).limit(1).count()
            if n:
                self._note(ordinal, name, "failed", 0, check)
                raise Halted(f"{check} in {name} of run {self.run_id}")

    def go(self, inputs: Tables) -> dict[str, DataFrame]:
        """Run what is not finished; gives the rows of every stage.  An error is noted and raised; started again, the run goes on there."""
        tables = dict(inputs)
        done = {r.stage for r in self.ledger().where("status = 'completed'").select("stage").distinct().collect()}  # a row a stage
        self._checked(0, "preflight", self.preflight, tables)
        for ordinal, stage in enumerate(self.stages, 1):
            path = f"{self.root}/{stage.name}"
            if stage.name not in done:
                try:
                    rows = stage.run(tables)
                    rows.write.mode("overwrite").parquet(path)
                    schema = rows.schema
                except Exception as e:
                    self._note(ordinal, stage.name, "failed", 0, type(e).__name__)
                    raise
                tables[stage.name] = self.spark.read.schema(schema).parquet(path)
                self._checked(ordinal, stage.name, stage.gates, tables)
                self._note(ordinal, stage.name, "completed", tables[stage.name].count())
            else:
                tables[stage.name] = self.spark.read.parquet(path)
        return {s.name: tables[s.name] for s in self.stages}

    def rehearse(self, inputs: Tables) -> dict[str, int]:
        """What each stage would give: all is computed, nothing is written or noted."""
        tables = dict(inputs)
        for name, rows in self.preflight.items():
            if rows(tables).limit(1).count():
                raise Halted(f"{name} in preflight of run {self.run_id}")
        counts = {}
        for stage in self.stages:
            tables[stage.name] = stage.run(tables)
            counts[stage.name] = tables[stage.name].count()
        return counts


def calculator_counts(judged: DataFrame, stored: DataFrame, key: str, outcome: Column, skip: Column, dry_run: bool = False) -> DataFrame:
    """(counter, n) of one calculator's run: considered, cast, written, already, withheld, and ``skipped: <reason>``.

    judged: a row a key; stored: (key, outcome) of what the calculator voted before.  A cast verdict
    that is stored already is not written again; a dry run withholds all that it would write.  Cast and
    skipped add up to considered, and written, already and withheld to cast.
    """
    old = stored.select(F.col(key), F.col("outcome").alias("stored_")).distinct()
    rows = judged.select(F.col(key), outcome.alias("outcome_"), F.coalesce(skip, F.lit("")).alias("skip_"))
    known = rows.join(old.withColumn("known_", F.lit(True)), (rows[key] == old[key]) & (rows["outcome_"] == old["stored_"]), "left").select(rows[key], "outcome_", "skip_", F.col("known_").isNotNull().alias("known_"))
    cast, new = F.col("outcome_").isNotNull(), F.lit("withheld" if dry_run else "written")
    counters = F.array(F.lit("considered"), F.when(cast, "cast").otherwise(F.concat(F.lit("skipped: "), "skip_")), F.when(cast, F.when(F.col("known_"), "already").otherwise(new)))
    return known.select(F.explode(counters).alias("counter")).where("counter is not null").groupBy("counter").agg(F.count("*").alias("n"))


def two_engines(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(key, outcome, engine, skip_reason) of two engines' verdicts (key, outcome): both, one or neither.

    Where both have an outcome and differ, none is cast (``engines-disagree``); what one alone says stands
    under its name; rows of neither abstain as ``no-engine``.
    """
    a, b = (df.select(key, F.col("outcome").alias(n), F.lit(True).alias(f"has_{n}")) for df, n in ((one, "a_"), (two, "b_")))
    both = a.join(b, key, "full")
    differ = F.col("a_").isNotNull() & F.col("b_").isNotNull() & (F.col("a_") != F.col("b_"))
    outcome = F.when(~differ, F.coalesce("a_", "b_"))
    engine = F.when(differ | outcome.isNull(), F.lit(None).cast("string")).when(F.col("b_").isNull(), "one").when(F.col("a_").isNull(), "two").otherwise("both")
    return both.select(key, outcome.alias("outcome"), engine.alias("engine"), F.when(differ, "engines-disagree").when(outcome.isNull(), "no-engine").otherwise("").alias("skip_reason"))


def shared_verdicts(rows: DataFrame, verdicts: DataFrame, key: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(given, conflicts): rows without a verdict take that of the rows with their checksum, else of those with their hash.

    values: columns of rows, the stronger first; null and empty values group nothing.  A group whose
    verdicts differ gives none and is listed in conflicts (via, value, n: its verdicts).  given: (key,
    outcome, source, via), the source being the smallest key with the verdict.  Groups are sums
    by value, not pairs of rows.
    """
    voted = rows.join(verdicts.select(key, "outcome"), key)
    open_rows = rows.join(verdicts.select(key), key, "left_anti")
    given = conflicts = None
    for name in values:
        value = F.nullif(F.col(name).cast("string"), F.lit(""))
        groups = voted.withColumn("value", value).where("value is not null").groupBy("value").agg(F.min("outcome").alias("outcome"), F.max("outcome").alias("other"), F.min(key).alias("source"), F.countDistinct("outcome").alias("n"))
        agreed = groups.where("outcome = other").select("value", "outcome", "source")
        taken = open_rows.withColumn("value", value).join(agreed, "value").select(key, "outcome", "source", F.lit(name).alias("via"))
        torn = groups.where("outcome <> other").select(F.lit(name).alias("via"), "value", "n")
        given = taken if given is None else given.unionByName(taken.join(given.select(key), key, "left_anti"))
        conflicts = torn if conflicts is None else conflicts.unionByName(torn)
    return given, conflicts
