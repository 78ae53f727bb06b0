"""Landed payloads: reading, attempt choice, page assembly, fallback.

Every choice below is computed from narrow page facts and applied to the
extracted rows.  Bodies are parsed where they lie and are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from hiretide import vocab as V
from hiretide.schemas import BODY, RAW_PAYLOAD_SCHEMA

_VARIANT = {"mode": "PERMISSIVE"}


def read_payloads(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    """The landed payload table, as a batch or as a file stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(RAW_PAYLOAD_SCHEMA).format(fmt).load(path)


def ok_payloads(raw: DataFrame, source: str) -> DataFrame:
    return raw.filter((F.col("source") == source) & (F.col("status") == 200))


def parse(raw: DataFrame, source: str) -> DataFrame:
    """Payloads of one source with their body parsed into ``b`` (null if bad)."""
    return ok_payloads(raw, source).withColumn("b", F.from_json("body", BODY[source], _VARIANT))


#: Records and total of a page, by paged source.
_COUNTS = {
    "smartrecruiters": lambda b: (b["content"], b["totalFound"]),
    "amazon": lambda b: (b["jobs"], b["hits"]),
    "netflix": lambda b: (b["positions"], b["count"]),
    "workday": lambda b: (b["jobPostings"], b["total"]),
    "oracle_hcm": lambda b: (F.get(b["items"], F.lit(0))["requisitionList"], F.get(b["items"], F.lit(0))["TotalJobsCount"]),
}

PAGED = list(_COUNTS)


def _fact(source: str) -> Column:
    """(readable, n_items, total) of a JSON body, which is parsed once.

    A body that is not JSON at all is not readable; one whose fields merely have odd types is.
    """
    schema = BODY[source]
    whole = schema.startswith("array<")
    fields = [] if whole else T._parse_datatype_string(schema).fieldNames()
    parsed = F.from_json("body", schema if whole else f"{schema}, _corrupt_record string", _VARIANT)

    def read(b: Column) -> Column:
        broken = b.isNull() if whole else reduce(lambda x, y: x & y, [b[f].isNull() for f in fields], b["_corrupt_record"].isNotNull())
        records, total = _COUNTS[source](b) if source in _COUNTS else (None, None)
        return F.struct(
            (~F.coalesce(broken, F.lit(True))).alias("readable"),
            (F.lit(0) if records is None else F.coalesce(F.size(records), F.lit(0))).cast("long").alias("n_items"),
            (F.lit(0) if total is None else F.coalesce(total, F.lit(0))).cast("long").alias("total"),
        )

    return F.transform(F.array(parsed), read)[0]  # binds the parsed body for all that is read from it


def with_facts(raw: DataFrame) -> DataFrame:
    """The payloads with ``readable``, ``n_items`` and ``total``; each body is parsed once.

    Feeds and pages are readable; a body that did not answer 200 is not looked at.
    """
    other = F.struct(F.lit(True).alias("readable"), F.lit(0).cast("long").alias("n_items"), F.lit(0).cast("long").alias("total"))
    fact = reduce(lambda c, s: c.when((F.col("status") == 200) & (F.col("source") == s), _fact(s)), BODY, F.when(F.lit(False), other)).otherwise(other)
    return raw.withColumn("__f", fact).select(*raw.columns, "__f.*")


def payload_facts(raw: DataFrame) -> DataFrame:
    """What paging, attempts and fallback need to know of each landed body, without it; one pass.

    ``(source, company, attempt, page_no, status, readable, n_items, total)``.
    """
    return with_facts(raw).select("source", "company", "attempt", "page_no", "status", "readable", "n_items", "total")


def items(raw: DataFrame, source: str, path) -> DataFrame:
    """One row per record ``j`` of each parsed body, in body order."""
    return parse(raw, source).select(
        "source", "company", "fetched_at", "attempt", "page_no", F.posexplode(path(F.col("b"))).alias("pos", "j")
    )


def bad_payloads(raw: DataFrame) -> DataFrame:
    """Payloads that yield nothing because of their status or their text."""
    is_json = F.col("source").isin(list(BODY))
    unparsed = is_json & F.try_parse_json("body").isNull()
    return (
        raw.withColumn(
            "reason",
            F.when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string")))
            .when(unparsed, F.lit("not json")),
        )
        .filter(F.col("reason").isNotNull())
        .select("source", "company", "attempt", "page_no", "status", "reason")
    )


# --- attempts ---------------------------------------------------------------

def slug_candidates(cfg: DataFrame) -> DataFrame:
    """(company, attempt, slug) in the order they are tried."""
    slug = F.col("slug")
    tries = F.when(F.col("company").isin(V.VERIFIED_SLUGS), F.array(slug)).otherwise(
        F.array(slug, F.replace(slug, F.lit("-"), F.lit("")), F.concat(slug, F.lit("inc")), F.concat(slug, F.lit("hq")))
    )
    return cfg.select("company", F.posexplode(tries).alias("attempt", "slug"))


def first_ok_attempt(raw: DataFrame, by: list[str]) -> DataFrame:
    """First attempt that answered 200, even with an empty body."""
    return raw.groupBy(*by).agg(
        F.min(F.when(F.col("status") == 200, F.col("attempt"))).alias("attempt")
    ).filter(F.col("attempt").isNotNull())


def pick_attempt(rows: DataFrame, raw: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(first_ok_attempt(raw, by), [*by, "attempt"], "left_semi")


# --- pages ------------------------------------------------------------------

def page_facts(facts: DataFrame, source: str) -> DataFrame:
    """(company, page_no, status, n_items, total) of the attempt that counts; of all pages where no attempt answered.

    A 200 whose body does not parse is a failed page, status 0.
    """
    own = facts.filter(F.col("source") == source)
    first = first_ok_attempt(own, ["company"]).withColumnRenamed("attempt", "__first")
    kept = own.join(first, "company", "left").filter(F.col("__first").isNull() | (F.col("attempt") == F.col("__first")))
    status = F.when((F.col("status") == 200) & ~F.col("readable"), F.lit(0)).otherwise(F.col("status"))
    return kept.select("company", "page_no", status.alias("status"), "n_items", "total")


def page_plan(facts: DataFrame, source: str, by: list[str] = ["company"], max_pages: int | None = None) -> DataFrame:
    """Per company: last page to keep (``keep_to``) and whether it counts.

    Sources differ in when paging ends and in what a failed page does.
    keep-partial (smartrecruiters, amazon, oracle_hcm): pages before the
    failure stay.  discard-all (netflix, workday): the company is unavailable.
    ``max_pages`` stops the loop early (customary for oracle_hcm: 5).
    """
    size = V.PAGE_SIZE[source]
    fetched = (F.col("page_no") + 1) * size
    failed = F.col("status") != 200
    empty = ~failed & (F.col("n_items") == 0)
    if source == "oracle_hcm":
        # the total of the first page rules all pages
        first = facts.filter("page_no = 0").select(*by, F.col("total").alias("first_total"))
        facts = facts.join(first, by, "left")
        done = fetched >= F.coalesce("first_total", F.lit(0))
    elif source == "netflix":
        # ends when the records read so far reach the total; narrow rows, one
        # partition per company's own pages
        so_far = F.sum("n_items").over(W.partitionBy(*by).orderBy("page_no"))
        facts = facts.withColumn("so_far", so_far)
        done = F.col("so_far") >= F.col("total")
    else:
        done = fetched >= F.col("total")

    if max_pages is not None:
        done = done | (F.col("page_no") + 1 >= max_pages)

    def first_page(cond: Column) -> Column:
        return F.min(F.when(cond, F.col("page_no")))

    ends = facts.groupBy(*by).agg(
        first_page(failed).alias("bad"),
        first_page(empty).alias("blank"),
        first_page(~failed & done).alias("last"),
        F.max("page_no").alias("top"),
    )
    stop = F.least(
        F.coalesce(F.col("last"), F.col("top")),
        F.coalesce(F.col("blank"), F.col("top")),
    )
    if source in ("netflix", "workday"):
        return ends.select(
            *by, stop.alias("keep_to"),
            (F.col("bad").isNull() | (F.col("bad") > stop)).alias("available"),
        )
    return ends.select(
        *by, F.least(stop, F.coalesce(F.col("bad") - 1, F.col("top"))).alias("keep_to"),
        F.lit(True).alias("available"),
    )


def assemble_pages(rows: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """Rows (of any width) whose page the paging loop would have read."""
    kept = rows.join(plan.filter("available"), by).filter(F.col("page_no") <= F.col("keep_to"))
    return kept.drop("keep_to", "available")


def assembled(raw: DataFrame, source: str, max_pages: int | None = None) -> DataFrame:
    """The payloads of one source that its attempts and its paging loop would have read."""
    own = raw.filter(F.col("source") == source)
    facts = payload_facts(own)
    read = pick_attempt(own, facts, ["company"])
    if source not in _COUNTS:
        return read
    return assemble_pages(read, page_plan(page_facts(facts, source), source, max_pages=max_pages), ["company"])


# --- fallback ---------------------------------------------------------------

def primary_else_fallback(primary: DataFrame, fallback: DataFrame, answered: DataFrame) -> DataFrame:
    """Rows of the structured source, plus fallback rows of companies whose
    structured source did not answer.  Answered-but-empty does not fall back."""
    rest = fallback.join(answered.select("company").distinct(), "company", "left_anti")
    return primary.unionByName(rest)
