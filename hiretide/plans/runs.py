"""The jobs: alert run, broad run, source-health audit, history replay."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.functions.classify import Rules
from hiretide.operators import dedup, digest, ranking, reports
from hiretide.operators.normalize import build_posting, posting_filter
from hiretide.operators.scratch import materialise

ORDER = ["company", "source", "page_no", "page_id", "pos"]


@dataclass(frozen=True)
class AlertResult:
    postings: DataFrame
    fresh: DataFrame
    state: DataFrame
    digest: DataFrame
    counters: dict[str, int]


def alert_run(
    postings: DataFrame,
    seen: DataFrame,
    now: datetime,
    n_companies: int,
    label: str = "daily",
    rules: Rules = Rules(),
    order: list[str] = ORDER,
) -> AlertResult:
    """One run: filter, deduplicate, order, chunk, digest.

    ``rules`` are those the postings were extracted by (``all_sources``).

    The new postings are written once: state, chunks and digest all start from
    the same rows even if an executor is lost in between.  ``counters`` (scraped,
    wanted, new) are taken from the rows during that write.
    """
    counted = reports.Counters()
    wanted = posting_filter(postings, rules)
    passing = counted.wanted(posting_filter(counted.scraped(postings), rules))
    fresh, _ = dedup.dedup_run(passing, seen, now, order)
    fresh = materialise(counted.new(fresh), "fresh")
    state = dedup.state_merge(dedup.live_state(seen, now), fresh, now)
    run_label, run_date = F.lit(V.RUN_LABELS.get(label, label)), F.lit(f"{now:%b %d, %Y}")
    report = digest.digest(ranking.chunk_rows(fresh, order), ["chunk_no"], run_label, run_date, n_companies)
    day = fresh.sparkSession.range(1).select(F.lit(now).alias("run_ts"))
    digests = with_quiet_runs(report.withColumn("run_ts", F.lit(now)), day, run_label, run_date, n_companies)
    return AlertResult(wanted, fresh, state, digests, counted.get())


def with_quiet_runs(digests: DataFrame, every_run: DataFrame, run_label, run_date, n_companies: int) -> DataFrame:
    """The digests, and the "nothing new" row of each run that has none."""
    quiet = every_run.select("run_ts").distinct().join(digests.select("run_ts"), "run_ts", "left_anti")
    return digests.unionByName(digest.empty_digest(quiet, run_label, run_date, n_companies))


def broad_run(postings: DataFrame, dim: DataFrame, include_us: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counts per company, one-row summary) of any title; no deduplication.

    ``postings`` are normalised and not yet filtered by role; geography is
    tested here.
    """
    counts = reports.company_counts(posting_filter(postings, Rules.of(broad=True, include_us=include_us)), dim)
    return counts, reports.broad_summary(counts)


def audit(dim: DataFrame, counts: DataFrame, failures: DataFrame, broad: bool = False) -> tuple[DataFrame, DataFrame]:
    """(status per company, roll-up).

    ``counts(company, n)``; ``failures(company, error, needs_page)`` for the
    companies whose source failed.
    """
    outcomes = (
        reports.route(dim)
        .join(counts.withColumnRenamed("company", "name"), "name", "left")
        .join(failures.withColumnRenamed("company", "name"), "name", "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        .withColumn("needs_page", F.coalesce("needs_page", F.lit(False)))
    )
    status = reports.audit_status(outcomes, broad)
    return status, reports.audit_rollup(status)


def history(rows: DataFrame, dim: DataFrame, run_ts: str, seq: str) -> DataFrame:
    """All runs replayed: normalise, filter, deduplicate, order, chunk."""
    postings = posting_filter(build_posting(rows, dim))
    emitted = dedup.dedup_history(postings, run_ts, ["company", seq])
    return ranking.chunk_rows(emitted, ["company", seq], by=[run_ts])


def history_digests(rows: DataFrame, dim: DataFrame, run_ts: str, seq: str, n_companies: int) -> DataFrame:
    """The digests of all runs replayed, runs without news included."""
    chunks = history(rows, dim, run_ts, seq).withColumnRenamed(run_ts, "run_ts")
    label, day = dedup.run_label("run_ts"), F.date_format("run_ts", "MMM dd, yyyy")
    found = digest.digest(chunks, ["run_ts", "chunk_no"], label, day, n_companies)
    return with_quiet_runs(found, rows.select(F.col(run_ts).alias("run_ts")), label, day, n_companies)
