"""The seen state as a table in hash buckets, with a Bloom filter of each.

A commit rewrites the buckets its new fingerprints fall into and no other; a
manifest names the version of every bucket.  Rows of the state are never
shuffled: a bucket's old rows and its new ones are read and written side by side.

Beside each version lie its buckets' filters, in blocks of 32768 bits.  A
fingerprint belongs to one block of its bucket; postings whose bits are not all
set there are new for sure and skip the join with the state.

``{path}/complete``       number, time and manifest of every finished commit
``{path}/manifests/<id>`` bucket, number of buckets, version, rows, blocks
``{path}/data/<version>/bucket=<b>``   fp, emitted_at
``{path}/filters/<version>``           bucket, block, bits
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.operators import dedup
from hiretide.operators.scratch import drop, materialise
from hiretide.schemas import SEEN_SCHEMA

BUCKETS = 64
#: Bits and hashes of a fingerprint in its filter: one in a hundred unseen ones is looked up in vain.
BITS, HASHES = 10, 5
BLOCK_BITS = 32768
#: Bytes of filters that travel to the tasks; a larger state is joined without them.
FILTER_BYTES = 64 << 20
_COMPLETE = "number long, at long, manifest string"
_MANIFEST = "bucket int, buckets int, version string, n_rows long, n_blocks long"


def bucket_of(fp: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(fp), F.lit(buckets)).cast("int")


def _commits(spark: SparkSession, path: str) -> list:
    done = dedup.table_or_none(spark, _COMPLETE, f"{path}/complete")
    return [] if done is None else done.orderBy("number", "at").collect()  # a row a commit


def manifest(spark: SparkSession, path: str, before: int | None = None) -> list:
    """Rows of the last finished commit, or of the last one numbered below ``before``; one a bucket."""
    commits = [c for c in _commits(spark, path) if before is None or c["number"] < before]
    if not commits:
        return []
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/{commits[-1]['manifest']}").orderBy("bucket").collect()


def _rows(spark: SparkSession, path: str, entries: list) -> DataFrame:
    folders = [f"{path}/data/{e['version']}/bucket={e['bucket']}" for e in entries]
    return spark.read.schema(SEEN_SCHEMA).parquet(*folders) if folders else dedup.empty_state(spark)


def read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All entries, expired ones included until their bucket is next rewritten."""
    return _rows(spark, path, manifest(spark, path, before))


def live(entries: DataFrame, newest: Column) -> DataFrame:
    """Entries that can still suppress something at ``newest`` or later; exactly 14 days old is expired."""
    return entries.filter(F.col("emitted_at") > newest - F.expr(f"INTERVAL {V.STATE_DAYS} DAYS"))


def _positions() -> Column:
    return F.array(*[F.pmod(F.xxhash64("fp", F.lit(i + 1)), F.lit(BLOCK_BITS)) for i in range(HASHES)])


def _block(n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64("fp", F.lit(0)), n_blocks)


def _by_bucket(entries: list, field: str) -> Column:
    table = {e["bucket"]: e[field] for e in entries}
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("bucket"))


def commit(spark: SparkSession, path: str, fresh: DataFrame, number: int, buckets: int = BUCKETS) -> list:
    """Add the emissions ``fresh(fp, emitted_at)`` to the state before ``number``; the manifest's rows.

    Of a commit that is made again the last one counts.  The number of buckets
    is that of the first commit.  Touched buckets lose their expired entries.
    """
    old = manifest(spark, path, before=number)
    buckets = old[0]["buckets"] if old else buckets
    version = f"{number:012d}-{uuid.uuid4().hex[:8]}"
    placed = fresh.select("fp", F.col("emitted_at").cast("timestamp").alias("emitted_at")).withColumn("bucket", bucket_of("fp", buckets))
    hit = {r["bucket"]: r["newest"] for r in placed.groupBy("bucket").agg(F.max("emitted_at").alias("newest")).collect()}
    now: dict[int, tuple] = {e["bucket"]: tuple(e) for e in old}
    if hit:
        newest = max(hit.values())
        kept = live(_rows(spark, path, [e for e in old if e["bucket"] in hit]), F.lit(newest))
        merged = kept.withColumn("bucket", bucket_of("fp", buckets)).unionByName(placed)
        merged.write.partitionBy("bucket").parquet(f"{path}/data/{version}")
        written = spark.read.schema(f"{SEEN_SCHEMA}, bucket int").parquet(f"{path}/data/{version}")
        for r in written.groupBy("bucket").agg(F.count("*").alias("n")).collect():
            now[r["bucket"]] = (r["bucket"], buckets, version, r["n"], max(1, -(-r["n"] * BITS // BLOCK_BITS)))
        blocks = F.lit(1) if len(now) == 0 else _by_bucket([{"bucket": b, "n_blocks": e[4]} for b, e in now.items()], "n_blocks")
        (
            written.select("bucket", _block(blocks).alias("block"), F.explode(_positions()).alias("at"))
            .groupBy("bucket", "block").agg(F.bitmap_construct_agg("at").alias("bits"))
            .write.parquet(f"{path}/filters/{version}")
        )
    name = f"{version}-manifest"
    spark.createDataFrame([now[b] for b in sorted(now)], _MANIFEST).coalesce(1).write.parquet(f"{path}/manifests/{name}")
    # from here on the commit counts
    done = spark.createDataFrame([(number, time.time_ns(), name)], _COMPLETE)
    done.coalesce(1).write.mode("append").parquet(f"{path}/complete")
    return manifest(spark, path)


def forget(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove the versions that none of the last ``keep`` commits names; the versions removed."""
    names = [c["manifest"] for c in _commits(spark, path)]
    if len(names) <= keep:
        return []

    def versions(of: list[str]) -> set[str]:
        return {r["version"] for r in spark.read.schema(_MANIFEST).parquet(*[f"{path}/manifests/{n}" for n in of]).select("version").distinct().collect()}

    gone = sorted(versions(names[:-keep]) - versions(names[-keep:]))
    for version in gone:
        drop(f"{path}/data/{version}")
        drop(f"{path}/filters/{version}")
    return gone


def maybe_seen(postings: DataFrame, path: str, entries: list, filter_bytes: int = FILTER_BYTES) -> DataFrame | None:
    """The postings with ``maybe``: false where no entry of the state has their ``fp``.  None if the filters are too large to send."""
    size = sum(e["n_blocks"] for e in entries) * BLOCK_BITS // 8
    if size > filter_bytes:
        return None
    if not entries:
        return postings.withColumn("maybe", F.lit(False))
    spark = postings.sparkSession
    current = spark.createDataFrame([(e["bucket"], e["version"]) for e in entries], "bucket int, version string")
    versions = sorted({e["version"] for e in entries})
    filters = None
    for v in versions:
        own = spark.read.schema("bucket int, block long, bits binary").parquet(f"{path}/filters/{v}").withColumn("version", F.lit(v))
        filters = own if filters is None else filters.unionByName(own)
    filters = filters.join(F.broadcast(current), ["bucket", "version"]).drop("version")
    keyed = postings.withColumn("bucket", bucket_of("fp", entries[0]["buckets"]))
    keyed = keyed.withColumn("block", _block(F.coalesce(_by_bucket(entries, "n_blocks"), F.lit(1))))

    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (at % 8).cast("int")) == 1

    held = keyed.join(F.broadcast(filters), ["bucket", "block"], "left")  # its size was checked
    return held.withColumn("maybe", F.coalesce(F.forall(_positions(), is_set), F.lit(False))).drop("bucket", "block", "bits")


def anti_seen(postings: DataFrame, path: str, live_from: Column, before: int | None = None, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, Observation | None]:
    """Postings (with ``fp``) that no live entry of the state has, and the count of those that skipped the join.

    ``live_from``: entries emitted at or before that are expired.  The observation has ``looked_up`` and ``skipped``
    once the result's first table is written; it is None where the filters are too large and all are joined.
    """
    spark = postings.sparkSession
    entries = manifest(spark, path, before)
    state = _rows(spark, path, entries).filter(F.col("emitted_at") > live_from).select("fp")
    flagged = maybe_seen(postings, path, entries, filter_bytes)
    if flagged is None:
        return postings.join(state, "fp", "left_anti"), None
    counted = Observation()
    flagged = materialise(flagged.observe(counted, F.count_if("maybe").alias("looked_up"), F.count_if(~F.col("maybe")).alias("skipped")), "flagged")
    sure = flagged.filter(~F.col("maybe"))
    return sure.unionByName(flagged.filter("maybe").join(state, "fp", "left_anti")).drop("maybe"), counted
