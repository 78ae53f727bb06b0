"""Seen-state deduplication: one run, whole history, and the state table."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from hiretide import vocab as V
from hiretide.functions.posting import fingerprint
from hiretide.functions.text import col
from hiretide.operators.ranking import first_per_key
from hiretide.operators.scratch import drop
from hiretide.schemas import SEEN_SCHEMA

RUN_HOURS = 12


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fp", fingerprint("company", "title", "location"))


def run_bucket(ts: Column | str) -> Column:
    """Start of the half-day run a timestamp belongs to."""
    return F.window(col(ts), f"{RUN_HOURS} hours")["start"]


def run_label(run_ts: Column | str) -> Column:
    return F.when(F.hour(col(run_ts)) < 12, F.lit(V.RUN_LABELS["morning"])).otherwise(
        F.lit(V.RUN_LABELS["evening"])
    )


def moment(at: datetime, kind: DataType) -> Column:
    """A wall-clock literal of the column's own timestamp type."""
    return F.lit(at.isoformat(sep=" ")).cast(kind)


# --- one run ----------------------------------------------------------------

def live_state(seen: DataFrame, now: datetime) -> DataFrame:
    """Entries younger than the retention; exactly 14 days old is expired."""
    cutoff = now - timedelta(days=V.STATE_DAYS)
    return seen.filter(F.col("emitted_at") > moment(cutoff, seen.schema["emitted_at"].dataType))


def first_in_batch(postings: DataFrame, order: list[str]) -> DataFrame:
    """First posting per fingerprint; ``order`` stands for the ingest order."""
    return first_per_key(postings, ["fp"], order)


def anti_seen(postings: DataFrame, live: DataFrame) -> DataFrame:
    """Postings without a live state entry.

    The state keeps one row per fingerprint; AQE broadcasts it while it is
    small, else it splits the partition of a posting seen very often.  A run
    takes the first sighting of each fingerprint before (``dedup_run``).
    """
    return postings.join(live.select("fp"), "fp", "left_anti")


def dedup_run(postings: DataFrame, seen: DataFrame, now: datetime, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new postings, next state).  One ``now`` rules the whole run."""
    live = live_state(seen, now)
    fresh = anti_seen(first_in_batch(with_fingerprint(postings), order), live)
    return fresh, state_merge(live, fresh, now)


def state_merge(live: DataFrame, fresh: DataFrame, now: datetime) -> DataFrame:
    kind = live.schema["emitted_at"].dataType
    return live.select("fp", "emitted_at").unionByName(
        fresh.select("fp", moment(now, kind).alias("emitted_at"))
    )


# --- history ----------------------------------------------------------------

def dedup_history(postings: DataFrame, run_ts: str, order: list[str]) -> DataFrame:
    """Replay of all runs: emitted postings with the run that emitted them.

    A fingerprint is emitted when it was never emitted or its last emission is
    at least 14 days old; suppressed sightings do not refresh it.  Sightings
    shrink to one row per (fingerprint, run) with map-side combine before the
    per-fingerprint fold, so what is collected is bounded by the run calendar,
    not by how often a posting was seen.
    """
    seen = with_fingerprint(postings)
    keep = [c for c in seen.columns if c not in ("fp", run_ts)]
    firsts = first_per_key(seen, ["fp", run_ts], order)
    folded = firsts.groupBy("fp").agg(
        F.array_sort(F.collect_list(F.struct(F.col(run_ts), F.struct(*keep).alias("row")))).alias("runs")
    )
    emitted = F.aggregate(
        "runs",
        F.slice("runs", 1, 0),
        lambda out, r: F.when(
            (F.size(out) == 0)
            | (r[run_ts] >= F.try_element_at(out, F.lit(-1))[run_ts] + F.expr(f"INTERVAL {V.STATE_DAYS} DAYS")),
            F.concat(out, F.array(r)),
        ).otherwise(out),
    )
    return folded.select("fp", F.explode(emitted).alias("e")).select("fp", f"e.{run_ts}", "e.row.*")


def dedup_onto(postings: DataFrame, seen: DataFrame, run_ts: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The replay continued: (emissions of these postings' runs, next state) from the state of the runs before.

    Only the new runs are folded, each fingerprint from its last emission on, so
    a calendar cut anywhere gives what the whole replay gives.  Runs are not
    older than those the state comes from.  The state keeps the last emission of
    a fingerprint; ``live_state`` cuts what has expired.
    """
    rows = with_fingerprint(postings)
    kind = rows.schema[run_ts].dataType
    keep = [c for c in rows.columns if c not in ("fp", run_ts)]
    firsts = first_per_key(rows, ["fp", run_ts], order)
    last = seen.groupBy("fp").agg(F.max("emitted_at").cast(kind).alias("__last"))
    folded = firsts.groupBy("fp").agg(
        F.array_sort(F.collect_list(F.struct(F.col(run_ts), F.struct(*keep).alias("row")))).alias("runs")
    ).join(last, "fp", "left")
    emitted = F.aggregate(
        "runs", F.struct(F.col("__last").alias("last"), F.slice("runs", 1, 0).alias("out")),
        lambda acc, r: F.when(
            acc["last"].isNull() | (r[run_ts] >= acc["last"] + F.expr(f"INTERVAL {V.STATE_DAYS} DAYS")),
            F.struct(r[run_ts].alias("last"), F.concat(acc["out"], F.array(r)).alias("out")),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    out = folded.select("fp", F.explode(emitted).alias("e")).select("fp", f"e.{run_ts}", "e.row.*")
    every = seen.select("fp", "emitted_at").unionByName(out.select("fp", F.col(run_ts).cast(seen.schema["emitted_at"].dataType).alias("emitted_at")))
    return out, every.groupBy("fp").agg(F.max("emitted_at").alias("emitted_at"))


# --- state table ------------------------------------------------------------

def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SEEN_SCHEMA)


def table_or_none(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_state(spark: SparkSession, path: str, corrupt: str = "raise") -> DataFrame:
    """Latest snapshot; a missing state is empty, a broken one is an error.

    The list of complete snapshots has a row a run; only the last one's files
    are read.  With ``corrupt="empty"`` files that cannot be read hold no entry
    instead, so a run starts over with what they told.
    """
    if corrupt not in ("raise", "empty"):
        raise ValueError(corrupt)
    done = table_or_none(spark, "run string", f"{path}/complete")
    latest = done.agg(F.max("run").alias("run")).first()["run"] if done is not None else None
    if latest is None:
        return empty_state(spark)
    lenient = str(corrupt == "empty").lower()
    return spark.read.schema(SEEN_SCHEMA).option("ignoreCorruptFiles", lenient).parquet(f"{path}/snapshots/{latest}")


def write_state(state: DataFrame, path: str, now: datetime, keep: int | None = None) -> str:
    """A new snapshot folder, then its line in the list; readers take the last complete one.

    Runs are named by time to the microsecond and a random part, so two of one
    moment do not meet.  ``keep`` removes all but that many snapshots.
    """
    spark = state.sparkSession
    run = f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    target = f"{path}/snapshots/{run}"
    state.select("fp", F.col("emitted_at").cast("timestamp").alias("emitted_at")).write.parquet(target)
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{path}/complete")
    if keep is not None:
        runs = [r["run"] for r in table_or_none(spark, "run string", f"{path}/complete").orderBy(F.desc("run")).collect()]
        for old in runs[keep:]:
            drop(f"{path}/snapshots/{old}")
    return target


def clear_state(spark: SparkSession, path: str, now: datetime) -> str:
    return write_state(empty_state(spark), path, now)
