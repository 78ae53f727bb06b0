"""Seen state: one run, history, stream, storage."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hiretide.operators import dedup, seen_table
from hiretide.operators.scratch import scratch_path
from hiretide.streaming import seen_stream

DAY0 = datetime(2024, 1, 1)
COLS = "company string, title string, location string, run_ts timestamp, seq long"


def sightings(spark, days, title="t"):
    rows = [("c", title, "l", DAY0 + timedelta(days=d), i) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, COLS)


def days_of(df):
    return sorted((r.run_ts - DAY0) / timedelta(days=1) for r in df.collect())


def greedy(days):
    out = []
    for d in sorted(set(days)):
        if not out or d - out[-1] >= 14:
            out.append(d)
    return out


def test_suppressed_sightings_do_not_refresh(spark):
    got = dedup.dedup_history(sightings(spark, [0, 5, 13.99, 14, 20, 28]), "run_ts", ["seq"])
    assert days_of(got) == [0, 14, 28]


def test_history_keeps_the_first_row_of_a_run(spark):
    rows = [("c", "t", "l", DAY0, 5), ("C", "T", "L", DAY0, 3), ("c", "t", "l", DAY0 + timedelta(days=3), 1)]
    got = dedup.dedup_history(spark.createDataFrame(rows, COLS), "run_ts", ["seq"]).collect()
    assert [(r.seq, r.title) for r in got] == [(3, "T")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 60), max_size=12), min_size=1, max_size=4))
def test_history_is_the_greedy_fold(spark, runs):
    frames = [sightings(spark, d, f"t{i}") for i, d in enumerate(runs)]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    got = {}
    for r in dedup.dedup_history(df, "run_ts", ["seq"]).collect():
        got.setdefault(r.title, []).append((r.run_ts - DAY0).days)
    assert {k: sorted(v) for k, v in got.items()} == {f"t{i}": greedy(d) for i, d in enumerate(runs) if d}


def test_second_run_of_the_same_batch_is_silent(spark):
    batch = sightings(spark, [0, 0]).unionByName(sightings(spark, [0], "u"))
    fresh, state = dedup.dedup_run(batch, dedup.empty_state(spark), DAY0, ["seq"])
    assert sorted(r.title for r in fresh.collect()) == ["t", "u"]
    again, state2 = dedup.dedup_run(batch, state, DAY0 + timedelta(days=1), ["seq"])
    assert again.count() == 0 and state2.count() == 2
    assert {r.emitted_at for r in state2.collect()} == {DAY0}
    # exactly 14 days later the entries have expired
    back, state3 = dedup.dedup_run(batch, state, DAY0 + timedelta(days=14), ["seq"])
    assert back.count() == 2 and state3.count() == 2


def test_state_storage(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert dedup.read_state(spark, path).count() == 0
    state = spark.createDataFrame([("x", DAY0)], "fp string, emitted_at timestamp")
    dedup.write_state(state, path, DAY0)
    assert [r.fp for r in dedup.read_state(spark, path).collect()] == ["x"]
    dedup.clear_state(spark, path, DAY0 + timedelta(hours=12))
    assert dedup.read_state(spark, path).count() == 0
    target = dedup.write_state(state, path, DAY0 + timedelta(days=1))
    for file in (tmp_path / "seen" / "snapshots").glob("20240102*/*.parquet"):
        file.write_bytes(b"broken")
    assert "/snapshots/20240102T000000000000-" in target
    with pytest.raises(Exception):
        dedup.read_state(spark, path).count()


def test_two_snapshots_of_one_moment_do_not_meet_and_old_ones_can_go(spark, tmp_path):
    path = str(tmp_path / "seen")
    for i in range(3):
        dedup.write_state(spark.createDataFrame([(str(i), DAY0)], "fp string, emitted_at timestamp"), path, DAY0 + timedelta(days=i // 2), keep=2)
    assert len(list((tmp_path / "seen" / "snapshots").glob("2024*"))) == 2
    assert [r.fp for r in dedup.read_state(spark, path).collect()] == ["2"]


def test_stream_agrees_with_history_over_several_batches(spark, tmp_path):
    landing, out = tmp_path / "landing", scratch_path(spark, "stream-test")
    days = [[0, 5], [13.5, 14, 14], [20, 27.5], [28, 60], [44]]  # the last comes late
    every = None
    for batch in days:
        df = sightings(spark, batch).unionByName(sightings(spark, [d + 1 for d in batch], "u"))
        df.coalesce(1).write.mode("append").parquet(str(landing))
        every = df if every is None else every.unionByName(df)
        stream = spark.readStream.schema(COLS).parquet(str(landing))
        seen_stream.run_available(seen_stream.dedup_stream(stream, "run_ts", "seq", "60 days"), f"{out}/out", f"{out}/cp")
    got = spark.read.parquet(f"{out}/out").select("fp", F.timestamp_micros("run_us").alias("run_ts")).collect()
    want = dedup.dedup_history(every, "run_ts", ["seq"]).select("fp", "run_ts").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 10
    assert {r.title for r in spark.read.parquet(f"{out}/out").collect()} == {"t", "u"}


def test_run_window_and_label(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 11, 59),), (datetime(2024, 1, 1, 12),)], "ts timestamp")
    run = dedup.run_bucket("ts")
    got = rows.select(run.alias("r"), dedup.run_label(run).alias("l")).collect()
    assert [(r.r.hour, r.l) for r in got] == [(0, "Morning (9 AM)"), (12, "Evening (6 PM)")]


def land(spark, path, df):
    df.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(COLS).parquet(f"{path}/in")


def test_stream_state_expires_and_late_rows_are_kept_beside(spark):
    """A new title every day for 80 days: the state holds those of the last 14 days and the lateness."""
    path = scratch_path(spark, "stream-expiry")
    for start in range(0, 80, 10):
        rows = [("c", f"t{d}", "l", DAY0 + timedelta(days=d), d) for d in range(start, start + 10)]
        rows += [("c", "always", "l", DAY0 + timedelta(days=d), 1000 + d) for d in range(start, start + 10)]
        if start == 40:
            rows += [("c", "t3", "l", DAY0 + timedelta(days=3), 5000), ("c", "t38", "l", DAY0 + timedelta(days=39), 5001)]
        seen_stream.run_available(
            seen_stream.dedup_stream(land(spark, path, spark.createDataFrame(rows, COLS)), "run_ts", "seq"),
            f"{path}/out", f"{path}/cp", f"{path}/late")
    got = spark.read.parquet(f"{path}/out")
    assert sorted(r.title for r in got.filter("title <> 'always'").collect()) == sorted(f"t{d}" for d in range(80))
    assert [r.seq - 1000 for r in got.filter("title = 'always'").orderBy("seq").collect()] == list(range(0, 80, 14))
    late = spark.read.parquet(f"{path}/late").collect()
    assert [(r.title, r.seq) for r in late] == [("t3", 5000)]  # what is within the lateness is decided
    held = (spark.read.format("statestore").option("stateVarName", "emitted").load(f"{path}/cp")).count()
    assert held <= 14 + 2 + 10 + 1  # the last batch's own ten days count until the watermark has passed


def test_stream_state_is_kept_by_buckets(spark):
    """Sightings of many postings share the state calls of their bucket; an entry that emits again stays one."""
    path = scratch_path(spark, "stream-buckets")
    titles = [f"t{n}" for n in range(60)]
    for days in ([0, 3, 13.5], [14, 15], [28]):
        rows = [("c", t, "l", DAY0 + timedelta(days=d), n) for d in days for n, t in enumerate(titles)]
        seen_stream.run_available(
            seen_stream.dedup_stream(land(spark, path, spark.createDataFrame(rows, COLS)), "run_ts", "seq", "60 days", buckets=4),
            f"{path}/out", f"{path}/cp")
    got = spark.read.parquet(f"{path}/out").groupBy("title").agg(F.sort_array(F.collect_list(F.timestamp_micros("run_us"))).alias("at")).collect()
    assert {r.title: [(a - DAY0).days for a in r["at"]] for r in got} == {t: [0, 14, 28] for t in titles}
    held = spark.read.format("statestore").option("stateVarName", "emitted").load(f"{path}/cp")
    assert held.count() == 60 and held.select("key").distinct().count() <= 4


def test_foreach_batch_run_again_emits_nothing_twice(spark):
    path = scratch_path(spark, "foreach-again")
    days = [[0, 5], [13.5, 14, 20], [28, 29]]
    every = None
    for batch in days:
        df = sightings(spark, batch).unionByName(sightings(spark, [d + 1 for d in batch], "u"))
        every = df if every is None else every.unionByName(df)
        seen_stream.run_by_batches(land(spark, path, df), "run_ts", ["seq"], path, f"{path}/cp", buckets=4)
    # the driver died after the commit of batch 1 and before the stream noted it: batch 1 comes again, alone
    again = sightings(spark, days[1]).unionByName(sightings(spark, [d + 1 for d in days[1]], "u"))
    want = sorted(map(tuple, spark.read.parquet(f"{path}/out").select("fp", "run_ts").collect()))
    seen = seen_table.read(spark, f"{path}/state", before=1)
    emitted, _ = dedup.dedup_onto(again, seen, "run_ts", ["seq"])
    emitted.write.mode("overwrite").parquet(f"{path}/out/batch=1")
    seen_table.commit(spark, f"{path}/state", emitted.select("fp", F.col("run_ts").alias("emitted_at")), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{path}/out").select("fp", "run_ts").collect())) == want
    assert want == sorted(map(tuple, dedup.dedup_history(every, "run_ts", ["seq"]).select("fp", "run_ts").collect()))
    assert seen_table.manifest(spark, f"{path}/state")[0]["version"].startswith("0" * 11)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=10), min_size=1, max_size=3), st.integers(0, 60))
def test_replay_cut_anywhere_is_the_whole_replay(spark, runs, cut):
    df = sightings(spark, runs[0], "t0")
    for i, d in enumerate(runs[1:], 1):
        df = df.unionByName(sightings(spark, d, f"t{i}"))
    edge = F.lit(DAY0 + timedelta(days=cut))
    first, state = dedup.dedup_onto(df.filter(F.col("run_ts") < edge), dedup.empty_state(spark), "run_ts", ["seq"])
    second, _ = dedup.dedup_onto(df.filter(F.col("run_ts") >= edge), state, "run_ts", ["seq"])
    whole = dedup.dedup_history(df, "run_ts", ["seq"])
    assert sorted(map(tuple, first.unionByName(second).select("fp", "run_ts", "seq").collect())) == sorted(
        map(tuple, whole.select("fp", "run_ts", "seq").collect()))


def entries(spark, names, day):
    return spark.createDataFrame([(f"fp{n}", DAY0 + timedelta(days=day)) for n in names], "fp string, emitted_at timestamp")


def test_a_commit_rewrites_only_the_buckets_it_hits(spark):
    path = scratch_path(spark, "buckets")
    first = seen_table.commit(spark, path, entries(spark, range(400), 0), 0, buckets=16)
    assert len(first) == 16 and sum(e["n_rows"] for e in first) == 400
    second = seen_table.commit(spark, path, entries(spark, [1000, 1001], 3), 1)
    touched = {r["b"] for r in entries(spark, [1000, 1001], 3).select(seen_table.bucket_of("fp", 16).alias("b")).collect()}
    assert {e["bucket"] for e, f in zip(second, first) if e["version"] != f["version"]} == touched
    assert seen_table.read(spark, path).count() == 402 and seen_table.read(spark, path, before=1).count() == 400
    # entries are dropped once their bucket is rewritten after they expired
    third = seen_table.commit(spark, path, entries(spark, range(400, 800), 14), 2)
    assert seen_table.read(spark, path).count() == 402
    assert len(seen_table.forget(spark, path, keep=1)) == 2 and seen_table.read(spark, path).count() == 402
    assert sum(e["n_rows"] for e in third) == 402
    # an empty commit changes nothing
    assert [e["version"] for e in seen_table.commit(spark, path, entries(spark, [], 15), 3)] == [e["version"] for e in third]


def test_merging_does_not_shuffle_the_state(spark):
    path = scratch_path(spark, "buckets")
    old = seen_table.commit(spark, path, entries(spark, range(100), 0), 0, buckets=4)
    merged = seen_table.live(seen_table._rows(spark, path, old), F.lit(DAY0)).withColumn("bucket", seen_table.bucket_of("fp", 4))
    plan = merged.unionByName(merged)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_filters_drop_nothing_and_spare_the_join(spark, limit):
    path = scratch_path(spark, "filters")
    seen_table.commit(spark, path, entries(spark, range(3000), 0), 0, buckets=8)
    postings = spark.createDataFrame([(f"fp{n}", n) for n in range(1500, 9000)], "fp string, n int")
    fresh, counted = seen_table.anti_seen(postings, path, F.lit(DAY0 - timedelta(days=1)), filter_bytes=limit)
    assert sorted(r.n for r in fresh.collect()) == list(range(3000, 9000))
    if limit:
        assert counted.get["looked_up"] + counted.get["skipped"] == 7500
        assert 1500 <= counted.get["looked_up"] < 1500 + 6000 * 0.03
    else:
        assert counted is None
    # without a state all are new; expired entries suppress nothing
    assert seen_table.anti_seen(postings, f"{path}/none", F.lit(DAY0))[0].count() == 7500
    assert seen_table.anti_seen(postings, path, F.lit(DAY0))[0].count() == 7500


def test_corrupt_state(spark, tmp_path):
    from hiretide.operators.scratch import overwrite_bytes

    path = str(tmp_path / "seen")
    target = dedup.write_state(entries(spark, range(5), 0), path, DAY0)
    assert overwrite_bytes(spark, target, "*.parquet", b"broken") > 0
    assert dedup.read_state(spark, path, corrupt="empty").count() == 0
    with pytest.raises(Exception):
        dedup.read_state(spark, path).count()
    with pytest.raises(ValueError):
        dedup.read_state(spark, path, corrupt="ignore")
