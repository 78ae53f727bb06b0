"""Per-company counts, source-health audit, run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.operators.joins import name_lookup

# Per-company outcome codes of the audit.
STATUSES = ["ok", "zero", "error", "selenium", "skip"]


# --- routing ----------------------------------------------------------------

def route(
    dim: DataFrame,
    dedicated: dict[str, str] = V.DEDICATED_EXTRACTORS,
    types: dict[str, str] = V.TYPE_EXTRACTORS,
) -> DataFrame:
    """Add ``extractor`` and ``route`` (api / dedicated / skipped).

    A dedicated extractor by name beats the board type; the maps are fixed and
    small, so they are literals in the expression rather than joins.
    """
    extractor = F.coalesce(
        name_lookup(dedicated, F.col("name")), name_lookup(types, F.coalesce("scraper", F.lit("custom"))), F.lit(V.GENERIC)
    )
    return dim.withColumn("extractor", extractor).withColumn(
        "route",
        F.when(F.coalesce("scraper", F.lit("custom")).isin(V.API_TYPES), F.lit("api"))
        .when(F.col("extractor") != V.GENERIC, F.lit("dedicated"))
        .otherwise(F.lit("skipped")),
    )


def route_by_tables(dim: DataFrame, dedicated: DataFrame, types: DataFrame) -> DataFrame:
    """The same with the maps as tables (name, extractor) / (scraper, extractor)."""
    return (
        dim.join(dedicated.withColumnRenamed("extractor", "by_name"), "name", "left")
        .join(types.withColumnRenamed("extractor", "by_type"), "scraper", "left")
        .withColumn("extractor", F.coalesce("by_name", "by_type", F.lit(V.GENERIC)))
        .drop("by_name", "by_type")
    )


# --- counts -----------------------------------------------------------------

def company_counts(postings: DataFrame, dim: DataFrame) -> DataFrame:
    """(company, n) for every company, zero included.

    Postings are counted (map-side combine) before they meet the dimension.
    """
    counts = postings.groupBy("company").agg(F.count("*").alias("n"))
    return dim.select(F.col("name").alias("company")).join(counts, "company", "left").select(
        "company", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def broad_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count("*").alias("companies"),
        F.count_if(F.col("n") > 0).alias("working"),
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_jobs"),
    )


def top_counts(counts: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Most postings first, ties in input order; optionally the top rows."""
    ranked = counts.orderBy(F.desc("n"), order)
    return ranked if limit is None else ranked.limit(limit)


# --- audit ------------------------------------------------------------------

def _cut(text: str, chars: int | None) -> Column:
    return F.col(text) if chars is None else F.left(F.col(text), F.lit(chars))


def audit_status(outcomes: DataFrame, broad: bool = False, error_chars: int | None = None) -> DataFrame:
    """(name, scraper, jobs, status, note) per company; customary cut of an error: 80 characters.

    ``outcomes`` is the routed dimension with ``n`` (rows extracted without a
    role-independent geography recheck), ``error`` (text or null) and
    ``needs_page`` (the structured source was unavailable).
    """
    scraper = F.coalesce("scraper", F.lit("custom"))
    rendered = F.col("name").isin(V.AUDIT_RENDERED_ONLY)
    unhandled = ~scraper.isin(V.API_TYPES) & (F.col("extractor") == V.GENERIC)
    status = (
        F.when(rendered, F.lit("selenium"))
        .when(unhandled, F.lit("skip"))
        .when(F.col("needs_page"), F.lit("selenium"))
        .when(F.col("error").isNotNull(), F.lit("error"))
        .when(F.col("n") > 0, F.lit("ok"))
        .otherwise(F.lit("zero"))
    )
    kind = "any" if broad else "data"
    note = (
        F.when(rendered, F.lit("only readable as a rendered page"))
        .when(unhandled, F.lit("no extractor of its own"))
        .when(F.col("needs_page"), F.lit("structured source did not answer"))
        .when(F.col("error").isNotNull(), _cut("error", error_chars))
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(f" {kind} jobs")))
    )
    counted = status.isin("ok", "zero")
    return outcomes.select(
        "*",
        F.when(counted, F.col("n")).otherwise(F.lit(0)).cast("long").alias("jobs"),
        status.alias("status"),
        note.alias("note"),
    )


def audit_rollup(status: DataFrame) -> DataFrame:
    """Status counts per section (top100 / rest) and overall."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    section = F.when(F.grouping("top100") == 1, F.lit("overall")).when(
        F.col("top100"), F.lit("top100")
    ).otherwise(F.lit("rest"))
    return (
        status.withColumn("top100", F.coalesce("top100", F.lit(False)))
        .rollup("top100")
        .agg(section.alias("section"), F.count("*").alias("companies"), *counts)
        .withColumn("confirmed", F.col("ok") + F.col("zero"))
        .drop("top100")
    )


def outcome_rows(outcomes: DataFrame, error_chars: int | None = None) -> DataFrame:
    """(outcome, name, jobs, note, in_outcome): pass / zero / error, one row
    per company; ``in_outcome`` is the size of its list.

    The lists stay rows: a collected list would grow with the dimension.
    """
    outcome = (
        F.when(F.col("error").isNotNull(), F.lit("error")).when(F.col("n") > 0, F.lit("pass")).otherwise(F.lit("zero"))
    )
    rows = outcomes.select(
        outcome.alias("outcome"), "name",
        F.when(outcome == "pass", F.col("n")).otherwise(F.lit(0)).cast("long").alias("jobs"),
        F.coalesce(_cut("error", error_chars), F.lit("")).alias("note"),
    )
    # three rows at most, whatever the dimension's size
    sizes = rows.groupBy("outcome").agg(F.count("*").alias("in_outcome"))
    return rows.join(F.broadcast(sizes), "outcome")


def api_health_counts(outcomes: DataFrame) -> DataFrame:
    """Counts of the unattended check: generic and page-only are skipped."""
    skipped = (F.col("extractor") == V.GENERIC) | F.col("needs_page")
    failed = F.col("error").isNotNull()
    return outcomes.agg(
        F.count("*").alias("total"),
        F.count_if(~skipped & ~failed & (F.col("n") > 0)).alias("ok"),
        F.count_if(~skipped & ~failed & (F.col("n") == 0)).alias("zero"),
        F.count_if(~skipped & failed).alias("err"),
        F.count_if(skipped).alias("skipped"),
    )


def run_counters(postings: DataFrame, fresh_flag: Column, by: list[str]) -> DataFrame:
    """Scraped and new totals per run."""
    return postings.groupBy(*by).agg(
        F.count("*").alias("scraped"), F.count_if(fresh_flag).alias("new"),
        F.count_distinct("company").alias("companies"),
    )


class Counters:
    """Counters of one run, taken from the rows as they pass on to the sink.

    Each is an observation at its place in the plan, so nothing is read twice.
    They can be read once the sink's write has ended.  Tasks that Spark runs again
    for a lost executor may count their rows again; where a counter must be
    exact to the row, use ``run_counters`` on the written table.
    """

    def __init__(self) -> None:
        self._taken: dict[str, Observation] = {}

    def _observe(self, name: str, df: DataFrame) -> DataFrame:
        self._taken[name] = Observation()
        return df.observe(self._taken[name], F.count(F.lit(1)).alias(name))

    def scraped(self, df: DataFrame) -> DataFrame:
        return self._observe("scraped", df)

    def wanted(self, df: DataFrame) -> DataFrame:
        return self._observe("wanted", df)

    def new(self, df: DataFrame) -> DataFrame:
        return self._observe("new", df)

    def get(self) -> dict[str, int]:
        return {name: taken.get[name] for name, taken in self._taken.items()}


def find_companies(dim: DataFrame, query: str) -> DataFrame:
    return dim.filter(F.lower("name").contains(query.lower()))


def display_row(title: Column, location: Column, url: Column, widths: tuple[int, int, int] | None = None) -> list[Column]:
    """Columns of the one-company check's table; customary widths: 54, 34, 70."""
    shown = [title, location, url]
    if widths:
        shown = [F.left(c, F.lit(w)) for c, w in zip(shown, widths)]
    return [c.alias(name) for c, name in zip(shown, ("title", "location", "url"))]


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
