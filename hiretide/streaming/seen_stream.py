"""The deduplication as an unbounded stream of sightings.

Two ways.  ``dedup_stream`` keeps the runs that emitted a fingerprint in a state
store with event-time timers: an entry leaves when no row that may still come
could be suppressed by it.  ``run_by_batches`` runs the batch deduplication once
per micro-batch over the state table; a batch that is run again after a failure
finds what it had committed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hiretide import vocab as V
from hiretide.functions.posting import fingerprint
from hiretide.operators import dedup, seen_table

# The state function travels with the job, so executors need no copy of this
# package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KEEP_US = V.STATE_DAYS * 24 * 3600 * 1_000_000
LATENESS = "2 days"
#: Buckets of fingerprints that share their state calls; fixed for the life of a checkpoint.
BUCKETS = 2048
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _firsts(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values("tie_no", kind="stable").drop_duplicates(["fp", "run_us"])


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First row per (fingerprint, run) of each Arrow batch.

    A combine step ahead of the shuffle: a posting seen a million times in one
    micro-batch reaches its state task once per batch of rows, not a million
    times.
    """
    for pdf in batches:
        yield _firsts(pdf)


class _Emitter(StatefulProcessor):
    """Per bucket of fingerprints: the runs that emitted each, as long as they can suppress a row that is not late.

    A state call costs about a millisecond, so a bucket's entries are read and written together.
    """

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.emitted = handle.getListState("emitted", "fp string, runs array<long>")
        self.timer = handle.getValueState("timer", "at long")

    @staticmethod
    def _leaves(emitted: list[int]) -> int:
        """When the watermark has passed all that the entry can suppress, in milliseconds."""
        return (max(emitted) + _KEEP_US) // 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one row a run and fingerprint is held, however many sightings come
        best: pd.DataFrame | None = None
        for pdf in rows:
            best = _firsts(pdf if best is None else pd.concat([best, pdf], ignore_index=True))
        passed = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        held = {fp: list(runs) for fp, runs in self.emitted.get()}
        new: dict[str, list[int]] = {}
        again, picked, kinds = False, [], []
        fps, at_run = best["fp"].tolist(), best["run_us"].tolist()
        for at in sorted(range(len(fps)), key=at_run.__getitem__):
            fp, run = fps[at], int(at_run[at])
            # a suppressed sighting does not refresh the entry
            late = run < passed
            before = held.get(fp)
            if late or not any(run - _KEEP_US < e <= run for e in before or new.get(fp, ())):
                picked.append(at)
                kinds.append("late" if late else "new")
                if not late and before is None:
                    new.setdefault(fp, []).append(run)
                elif not late:
                    before.append(run)
                    again = True
        if again:
            self.emitted.put([(fp, sorted(runs)) for fp, runs in {**held, **new}.items()])
        elif new:
            self.emitted.appendList(list(new.items()))
        if again or new:
            self._wake(min(map(self._leaves, [*held.values(), *new.values()])))
        if picked:
            yield best.iloc[picked][self.columns].assign(decision=kinds)

    def _wake(self, at: int) -> None:
        """One timer a bucket, at its first entry to leave or before."""
        before = self.timer.get()
        if not before or at < before[0]:
            if before:
                self.handle.deleteTimer(before[0])
            self.timer.update((at,))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [(fp, list(runs)) for fp, runs in self.emitted.get()]
        stay = [(fp, runs) for fp, runs in held if self._leaves(runs) >= now]
        self.timer.clear()
        if not stay:
            self.emitted.clear()
            return iter(())
        if len(stay) < len(held):
            self.emitted.put(stay)
        self._wake(min(self._leaves(runs) for _, runs in stay))
        return iter(())

    def close(self) -> None:
        pass


def _marked(sightings: DataFrame, run_ts: str, seq: str) -> DataFrame:
    return sightings.select(
        "*", fingerprint("company", "title", "location").alias("fp"),
        F.unix_micros(F.col(run_ts).cast("timestamp")).alias("run_us"), F.col(seq).cast("long").alias("tie_no"),
    )


def dedup_stream(sightings: DataFrame, run_ts: str, seq: str, lateness: str = LATENESS, buckets: int = BUCKETS) -> DataFrame:
    """Emissions of a stream of postings: the whole posting, with ``fp``, ``run_us`` and ``decision``.

    ``run_us`` is the run start in epoch microseconds; within one run the row
    with the lowest ``seq`` counts, and a run's rows come in one micro-batch or
    its first ones come first.  The watermark follows the run start by
    ``lateness``.  A row behind it can no longer be decided, for the entries that
    would decide it may be gone: it comes out with the decision ``late``, to be
    kept beside; ``new`` are the emissions.  A fingerprint's entry leaves when the
    watermark is 14 days past its last emission, that is 14 days and ``lateness``
    after it.  State is kept by ``buckets`` of fingerprints, each read and written
    whole.  Needs the RocksDB state store (``run_available`` sets it).
    """
    # the watermark's own column ends here: rows behind it are told apart below, not dropped unseen
    timed = sightings.withColumn("event_at", F.col(run_ts).cast("timestamp")).withWatermark("event_at", lateness)
    rows = _marked(timed, run_ts, seq).drop("event_at")
    columns = [f for f in rows.schema if f.name != "tie_no"]
    out = T.StructType([*columns, T.StructField("decision", T.StringType())])
    combined = rows.mapInPandas(_combine, rows.schema)
    dealt = combined.withColumn("__bucket", F.pmod(F.xxhash64("fp"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("__bucket").transformWithStateInPandas(_Emitter([f.name for f in columns]), out, "append", "eventTime")


def run_available(stream: DataFrame, path: str, checkpoint: str, late_path: str | None = None) -> None:
    """Process what has landed, then stop: emissions into one Parquet table, late rows into another.

    Each batch's files lie in a folder of the batch's own, which a repeated
    batch replaces.
    """
    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for decision, target in (("new", path), ("late", late_path)):
            if target:
                held.filter(F.col("decision") == decision).drop("decision").write.mode("overwrite").parquet(f"{target}/batch={number}")
        held.unpersist()

    with_rocks(stream.sparkSession, lambda: (
        stream.writeStream.foreachBatch(write).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    ))


def with_rocks(spark: SparkSession, run: Callable[[], None]) -> None:
    """The state store provider is a setting of the session when the query starts; it is put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)
    try:
        run()
    finally:
        spark.conf.set(name, before)


def run_by_batches(sightings: DataFrame, run_ts: str, order: list[str], path: str, checkpoint: str, buckets: int = seen_table.BUCKETS) -> None:
    """The same stream by ``foreachBatch``: the batch deduplication, run for run, over the state table at ``path``/state.

    A micro-batch's runs are taken in order; its emissions go to
    ``path``/out/batch=<number> and the state it leaves is committed under its
    number.  A batch that comes again (the driver died before the stream noted
    it) starts from the state of the batch before and replaces its own output, so
    nothing is emitted twice and nothing is lost.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = seen_table.read(spark, f"{path}/state", before=number)
        emitted, state = dedup.dedup_onto(batch, seen, run_ts, order)
        emitted.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        # the state follows from what was written, which a lost executor cannot change
        told = spark.read.schema(emitted.schema).parquet(f"{path}/out/batch={number}")
        seen_table.commit(spark, f"{path}/state", told.select("fp", F.col(run_ts).cast("timestamp").alias("emitted_at")), number, buckets)

    (
        sightings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
