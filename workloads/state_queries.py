"""Queries over streams, the seen state, counters, and the tokeniser in SQL."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hiretide import vocab as V
from hiretide.operators import dedup, reports, seen_table
from hiretide.operators.normalize import build_posting, posting_filter
from hiretide.operators.scratch import materialise, overwrite_bytes, scratch_path
from hiretide.schemas import RAW_PAYLOAD_SCHEMA
from hiretide.sources import payloads, tokeniser
from hiretide.streaming import page_stream, seen_stream
from workloads import derive as X
from workloads import sql as S
from workloads.queries import (
    _LIVE, _NOW, _NOW_AT, _PAGE_ANCHORS, _SPLIT, CA, ROLE, SQL_TS, K, _assembly_sql, _normal, _page_facts_sql, _split, _wanted, query, text_ts,
)

_EMITTED = "SELECT fp, strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run, seq, title, company, location, category FROM h"
_FIELDS = ["fp", "run", "seq", "title", "company", "location", "category"]


@query("seen_dedup_foreach", S.history() + _EMITTED)
def seen_dedup_foreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay as a file stream in three parts, each micro-batch deduplicated over the state table."""
    path = scratch_path(spark, "seen-foreach")
    events = X.table(spark, sf_dir, "events")
    part = F.least(X.div(F.dayofmonth("ts") - 1, 10), F.lit(2))
    for n in range(3):
        events.filter(part == n).write.mode("append").parquet(f"{path}/in")
        landed = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        rows = X.postings_of(landed).select("seq", "run_ts", "company", "title", "location")
        postings = posting_filter(build_posting(rows, X.companies(spark, sf_dir)))
        seen_stream.run_by_batches(postings, "run_ts", ["company", "seq"], path, f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").withColumn("run", text_ts("run_ts")).select(*_FIELDS)


@query("seen_history_incremental", S.history() + _EMITTED)
def seen_history_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay in four parts of the calendar, each continued from the state the part before left."""
    wanted = materialise(_wanted(spark, sf_dir).select("seq", "run_ts", "company", "title", "location", "category"), "wanted")
    part = F.least(X.div(F.dayofmonth("run_ts") - 1, 8), F.lit(3))
    state, found = dedup.empty_state(spark), None
    for n in range(4):
        emitted, _ = dedup.dedup_onto(wanted.filter(part == n), state, "run_ts", ["company", "seq"])
        emitted = materialise(emitted, f"part{n}")
        new = emitted.select("fp", F.col("run_ts").cast("timestamp").alias("emitted_at"))
        state = materialise(state.unionByName(new), "state")
        found = emitted if found is None else found.unionByName(emitted)
    return found.withColumn("run", text_ts("run_ts")).select(*_FIELDS)


def _committed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The state of the first half of the month in buckets, and the batch of the second half."""
    path = scratch_path(spark, "seen-table")
    state, batch = _split(spark, sf_dir)
    seen_table.commit(spark, path, state.select("fp", F.col("emitted_at").cast("timestamp").alias("emitted_at")), 0)
    return path, batch


def _live_from():
    return F.lit(_NOW).cast("timestamp") - F.expr("INTERVAL 14 DAYS")


@query("anti_seen_filtered", S.ctes(S.P, S.D, S.N, S.W, _LIVE) + "SELECT seq, fp FROM b WHERE fp NOT IN (SELECT fp FROM lv)")
def anti_seen_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that the filters of the state rule out skip the join with it."""
    path, batch = _committed(spark, sf_dir)
    fresh, _ = seen_table.anti_seen(batch.select("seq", "fp"), path, _live_from())
    return fresh.select("seq", "fp")


@query("sink_seen_buckets", S.ctes(S.P, S.D, S.N, S.W, _LIVE) + f"""
SELECT fp, {SQL_TS.format('emitted_at')} AS emitted_at FROM lv
UNION ALL SELECT DISTINCT fp, '{_NOW}' FROM b WHERE fp NOT IN (SELECT fp FROM lv)""")
def sink_seen_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run over the bucketed state: what it emits is committed, then the live entries are read."""
    path, batch = _committed(spark, sf_dir)
    firsts = dedup.first_in_batch(batch, ["company", "seq"]).select("fp")
    fresh, _ = seen_table.anti_seen(firsts, path, _live_from())
    seen_table.commit(spark, path, fresh.withColumn("emitted_at", F.lit(_NOW).cast("timestamp")), 1)
    return dedup.live_state(seen_table.read(spark, path), _NOW_AT).select("fp", text_ts("emitted_at").alias("emitted_at"))


@query("run_counters_observed", S.ctes(S.P, S.D, S.N) + f"""
SELECT count(*) AS scraped, count(*) FILTER ({CA} AND {ROLE}) AS wanted, count(DISTINCT company) FILTER ({CA} AND {ROLE}) AS companies FROM n""")
def run_counters_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters taken while the wanted postings are written, without a second pass over their source."""
    counted = reports.Counters()
    normal = counted.scraped(_normal(spark, sf_dir))
    wanted = counted.wanted(normal.filter(K.is_canada("location") & K.is_data_role("title")))
    written = materialise(wanted, "wanted")
    companies = written.agg(F.count_distinct("company").alias("companies"))
    return companies.select(*[F.lit(v).cast("long").alias(k) for k, v in counted.get().items()], "companies")


@query("corrupt_state_as_empty", S.ctes(S.P, S.D, S.N, S.W) + """
SELECT fp, min(run_ts) IS NOT NULL AS emitted FROM w WHERE run_ts >= TIMESTAMP '{0}' GROUP BY fp""".format(_SPLIT))
def corrupt_state_as_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose state cannot be read starts over: every posting of the batch is new."""
    path = scratch_path(spark, "state")
    state, batch = _split(spark, sf_dir)
    target = dedup.write_state(state, path, datetime.fromisoformat(_SPLIT))
    overwrite_bytes(spark, target, "*.parquet", b"no state")
    seen = dedup.read_state(spark, path, corrupt="empty")
    fresh, _ = dedup.dedup_run(batch.drop("fp"), seen, _NOW_AT, ["company", "seq"])
    return fresh.select("fp", F.lit(True).alias("emitted"))


@query("src_elements_lateral", f"""WITH {_PAGE_ANCHORS},
h AS (SELECT page_id, 'h1' AS tag, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS txt FROM pages WHERE html LIKE '%<h1>%')
SELECT page_id, 'a' AS tag, href, {S.strip('txt')} AS txt FROM pa
UNION ALL SELECT page_id, tag, NULL, {S.strip("replace(txt, '&amp;', '&')")} FROM h""")
def src_elements_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and headings of the driver's pages by the table function, in SQL."""
    tokeniser.register_sql(spark)
    X.table(spark, sf_dir, "pages").createOrReplaceTempView("landed_pages")
    return spark.sql("""
        SELECT page_id, tag, CASE WHEN tag = 'a' THEN href END AS href, text AS txt
        FROM landed_pages, LATERAL page_elements(html, array('a', 'h1'), false)""")


_PAGED = {
    "smartrecruiters": ('{"totalFound":', ',"content":', "}"), "oracle_hcm": ('{"items":[{"TotalJobsCount":', ',"requisitionList":', "}]}"),
    "workday": ('{"total":', ',"jobPostings":', "}"), "netflix": ('{"count":', ',"positions":', "}"),
}


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days as the pages of a company, under four sources; of every third company the first attempt failed."""
    u, n = F.col("user_id"), F.col("page_no")
    days = X.table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    pages = days.withColumn("page_no", F.row_number().over(W.partitionBy("user_id").orderBy("day")) - 1)
    found = []
    for source, (before, between, after) in _PAGED.items():
        n_items = F.when((u + n) % 23 == 22, F.lit(0)).otherwise(F.col("n")).cast("int")
        total = (u % 25 + 1) * V.PAGE_SIZE[source] - u % 3
        records = F.concat(F.lit("["), F.substring(F.repeat(F.lit(",{}"), n_items), 2, 1 << 30), F.lit("]"))
        failed = (u * 3 + n) % 17 == 16
        body = F.concat(F.lit(before), total.cast("string"), F.lit(between), records, F.lit(after))
        found.append(pages.select(
            F.lit(source).alias("source"), F.concat(F.lit("User "), u.cast("string")).alias("company"),
            F.when(u % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("attempt"), "page_no",
            F.when(failed, F.lit(500)).otherwise(F.lit(200)).alias("status"),
            F.timestamp_seconds(F.lit(1704067200) + n * 60).alias("fetched_at"), F.when(~failed, body).alias("body")))
    landed = reduce(DataFrame.unionByName, found)
    missed = landed.filter("attempt = 1 and page_no = 0").withColumns({"attempt": F.lit(0), "status": F.lit(404), "body": F.lit(None).cast("string")})
    return landed.unionByName(missed)


def _landed_sql() -> str:
    sql = _assembly_sql()
    for source in _PAGED:
        size = V.PAGE_SIZE[source]
        sql = sql.replace(_page_facts_sql(size), f"""f AS (
  SELECT 'User ' || user_id AS company, page_no, CASE WHEN (user_id * 3 + page_no) % 17 = 16 THEN 500 ELSE 200 END AS status,
         CASE WHEN (user_id + page_no) % 23 = 22 THEN 0 ELSE n END AS n_items, (user_id % 25 + 1) * {size} - user_id % 3 AS total
  FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS page_no, n
        FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)))""")
    return sql


@query("src_page_assembly_stream", _landed_sql())
def src_page_assembly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that come out of order in three micro-batches; what paging leaves open is settled by time."""
    path = scratch_path(spark, "page-stream")
    landed = materialise(landed_pages(spark, sf_dir), "landed")
    part = F.pmod(F.xxhash64("company", "page_no"), F.lit(3))
    later = landed.limit(1).withColumns({"company": F.lit("later"), "page_no": F.lit(0), "fetched_at": F.col("fetched_at") + F.expr("INTERVAL 30 DAYS")})
    for batch in (*(landed.filter(part == n) for n in range(3)), later, later.withColumn("company", F.lit("last"))):
        batch.write.mode("append").parquet(f"{path}/in")
        stream = payloads.read_payloads(spark, f"{path}/in", stream=True)
        page_stream.run_available(page_stream.assemble_stream(stream), f"{path}/out", f"{path}/checkpoint")
    out = payloads.with_facts(spark.read.schema(RAW_PAYLOAD_SCHEMA).parquet(f"{path}/out")).filter("company like 'User %'")
    return out.select("source", "company", F.col("page_no").cast("long").alias("page_no"), "n_items")


@query("src_page_assembly_landed", _landed_sql())
def src_page_assembly_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as one landed table, bodies and all."""
    landed = materialise(landed_pages(spark, sf_dir), "landed")
    read = reduce(DataFrame.unionByName, [payloads.with_facts(payloads.assembled(landed, source)) for source in _PAGED])
    return read.select("source", "company", F.col("page_no").cast("long").alias("page_no"), "n_items")
