"""Extractors by name, and their union.

A new board is one function ``(raw, dim, cfg, rules) -> postings`` registered
under its source name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide.functions.classify import Rules
from hiretide.operators import reports
from hiretide.operators.joins import company_side, join_blocks
from hiretide.operators.normalize import LINEAGE, complete, without_company
from hiretide.operators.scratch import materialise
from hiretide.schemas import POSTING_COLUMNS
from hiretide.sources import embedded, feeds, json_boards, payloads, saved_pages
from hiretide.sources.selectors import CARDS, ICIMS_LOCATIONS, LINKS

Extractor = Callable[[DataFrame, DataFrame, DataFrame, Rules], DataFrame]

EXTRACTORS: dict[str, Extractor] = {
    "greenhouse": json_boards.greenhouse,
    "lever": json_boards.lever,
    "ashby": json_boards.ashby,
    "smartrecruiters": json_boards.smartrecruiters,
    "workday": json_boards.workday,
    "oracle_hcm": json_boards.oracle_hcm,
    "amazon": json_boards.amazon,
    "netflix": json_boards.netflix,
    "ibm": json_boards.ibm,
    "meta": json_boards.meta,
    "bamboohr": json_boards.bamboohr,
    "avature": feeds.avature,
    "boc_rss": feeds.boc_rss,
    "phenom": embedded.phenom,
    "shopify": embedded.shopify,
    "canadalife": embedded.canadalife,
}
# These need their company's own address, and a registered extractor returns postings; the
# others can leave the dimension to a join of all of them.
WITH_COMPANY = [json_boards.workday, json_boards.oracle_hcm]
WITHOUT_COMPANY = [e for e in EXTRACTORS.values() if e not in WITH_COMPANY]
PAGED = payloads.PAGED
SITES = [*LINKS, *CARDS, "njoyn"]
# Structured source -> saved-page site used when it does not answer.
FALLBACK_SITE = {"workday": "workday_cards", "ibm": "ibm_cards", "meta": "meta_links"}


# Extractors by name whose pages go by another site's rules.
SITE_OF = {"google": "google_cards", "apple": "apple_cards", "oracle_hcm": "oracle_links"}


def register(source: str, extractor: Extractor) -> None:
    EXTRACTORS[source] = extractor


def union_sources(*frames: DataFrame) -> DataFrame:
    """Bag union; nothing is deduplicated here."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def from_payloads(raw: DataFrame, dim: DataFrame, cfg: DataFrame, source: str, rules: Rules, max_pages: int | None = None,
                  facts: DataFrame | None = None) -> DataFrame:
    """Postings of one structured source with its paging and attempt rules.

    Of several answered attempts of a company the first one counts.  ``facts``
    are ``payload_facts`` made before, for callers of several sources.  A company
    outside ``dim`` has no postings, so its bodies are not read.
    """
    own = of_companies(raw.filter(F.col("source") == source), dim)
    facts = payloads.payload_facts(own) if facts is None else facts.filter(F.col("source") == source)
    rows = EXTRACTORS[source](own, dim, cfg, rules)
    rows = payloads.pick_attempt(rows, facts, ["company"])
    if source in PAGED:
        plan = payloads.page_plan(payloads.page_facts(facts, source), source, max_pages=max_pages)
        rows = payloads.assemble_pages(rows, plan, ["company"])
    return rows.withColumn("page_id", F.lit(None).cast("long"))


def of_companies(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """The rows of companies that the dimension has, ahead of any work on them."""
    return rows.join(dim.select(F.col("name").alias("company")), "company", "left_semi")


def answered(facts: DataFrame, source: str) -> DataFrame:
    """Companies whose structured source answered, even with nothing."""
    if source in PAGED:
        plan = payloads.page_plan(payloads.page_facts(facts, source), source)
        return plan.filter("available").select("company")
    own = facts.filter((F.col("source") == source) & (F.col("status") == 200) & F.col("readable"))
    return own.select("company").distinct()


def reads(facts: DataFrame, sources: list[str]) -> DataFrame:
    """(source, company, first, paged, keep_to): the attempt that counts, and up to which page; a company without has no postings."""
    first = payloads.first_ok_attempt(facts, ["source", "company"]).withColumnRenamed("attempt", "first")
    plans = [
        payloads.page_plan(payloads.page_facts(facts, source), source).filter("available")
        .select(F.lit(source).alias("source"), "company", "keep_to")
        for source in sources if source in PAGED
    ]
    paged = F.col("source").isin(PAGED)
    if not plans:
        return first.select("*", paged.alias("paged"), F.lit(None).cast("int").alias("keep_to"))
    return first.filter(~paged).select("*", F.lit(False).alias("paged"), F.lit(None).cast("int").alias("keep_to")).unionByName(
        first.join(union_sources(*plans), ["source", "company"]).select("source", "company", "first", F.lit(True).alias("paged"), "keep_to")
    )


def as_read(rows: DataFrame, read: DataFrame) -> DataFrame:
    """Rows of the attempts and pages that count, by ``reads``."""
    kept = rows.join(read, ["source", "company"]).filter(F.col("attempt") == F.col("first"))
    return kept.filter(~F.col("paged") | (F.col("page_no") <= F.col("keep_to"))).drop("first", "paged", "keep_to")


def _of_page(site: str) -> dict:
    """The lineage of postings from saved pages."""
    return {"source": F.lit(site), "fetched_at": F.lit(None).cast("timestamp"), "attempt": F.lit(0), "page_no": F.lit(0)}


def page_rows(pages: DataFrame, dim: DataFrame, site: str, rules: Rules, whole: bool = True) -> DataFrame:
    """A site's postings with lineage, or the ``unfinished`` rows."""
    own = of_companies(pages.filter(F.col("site") == site), dim).select("company", "page_id", "url", "html")
    default = None
    if site == "icims":
        table = F.create_map(*[F.lit(x) for kv in ICIMS_LOCATIONS.items() for x in kv])
        default = F.coalesce(F.try_element_at(table, F.col("company")), F.lit("Canada"))
    return saved_pages.extract(own, site, dim if whole else None, rules, default).withColumns(_of_page(site))


def from_pages(pages: DataFrame, dim: DataFrame, site: str, rules: Rules) -> DataFrame:
    """``pages`` holds (company, site, page_id, url, html)."""
    return page_rows(pages, dim, site, rules).select(*POSTING_COLUMNS, *LINEAGE, "page_id")


def all_sources(
    raw: DataFrame,
    pages: DataFrame | None,
    dim: DataFrame,
    cfg: DataFrame,
    rules: Rules = Rules(),
    sources: list[str] | None = None,
    sites: list[str] | None = None,
) -> DataFrame:
    """Every company's postings, each from the extractor its route names.

    A dedicated extractor beats the board type, companies without either are
    skipped; fallbacks apply per company.  Unknown companies drop out of every
    extractor.  Bodies of routed companies are written by source with what
    paging, attempts and fallbacks need to know of them, so the whole payload
    table is read once, and an extractor reads its own part.  What depends on the
    company alone is done once for all sources: attempts and pages that count,
    and the join with the dimension, so the plan has one join instead of several
    a source.
    """
    names = sources if sources is not None else list(EXTRACTORS)
    routed = reports.route(dim).filter("route <> 'skipped'").drop("route")
    # two steps, so that a body is parsed after the companies routed elsewhere are gone
    own = raw.filter(F.col("source").isin(names)).join(
        routed.select(F.col("extractor").alias("source"), F.col("name").alias("company")), ["source", "company"], "left_semi")
    own = materialise(payloads.with_facts(own), "payloads", by="source")
    facts = own.drop("body", "fetched_at")
    read = materialise(reads(facts, names), "reads")

    def routed_to(extractor: str) -> DataFrame:
        return routed.filter(F.col("extractor") == extractor).drop("extractor")

    none = F.lit(None).cast("long").alias("page_id")
    finished, rows = [], []
    for source in names:
        extractor, bodies = EXTRACTORS[source], own.filter(F.col("source") == source)
        if extractor in WITHOUT_COMPANY:
            rows.append(extractor(bodies, None, cfg, rules))
        else:
            finished.append(extractor(bodies, routed_to(source), cfg, rules).select(*POSTING_COLUMNS, *LINEAGE))
    rows = [as_read(union_sources(*rows), read).select("*", F.col("source").alias("extractor"), none)] if rows else []
    finished = [as_read(union_sources(*finished), read).select("*", none)] if finished else []
    if pages is not None:
        def of_site(site: str, extractor: str) -> DataFrame:
            return page_rows(pages, routed_to(extractor), site, rules, whole=False).withColumn("extractor", F.lit(extractor))

        used = {source: site for source, site in FALLBACK_SITE.items() if source in names}
        if used:
            answers = union_sources(*[answered(facts, s).select(F.lit(s).alias("extractor"), "company") for s in used])
            fallbacks = [of_site(site, source) for source, site in used.items()]
            rows.append(union_sources(*fallbacks).join(materialise(answers, "answers"), ["extractor", "company"], "left_anti"))
        extractor_of = {site: extractor for extractor, site in SITE_OF.items()}
        for site in (sites if sites is not None else [s for s in SITES if s not in used.values()]):
            rows.append(of_site(site, extractor_of.get(site, site)))
    if rows:
        side = company_side(routed, "extractor").drop("careers_url")
        joined = join_blocks(without_company(union_sources(*rows)), side, ["extractor", "company"])
        finished.append(complete(joined, [*LINEAGE, "page_id"]))
    return union_sources(*finished)
