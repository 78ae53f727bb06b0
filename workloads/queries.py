"""Every registered query: a Spark function and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.functions import classify as K
from hiretide.functions import location as L
from hiretide.functions import urls as U
from hiretide.functions.posting import fingerprint, posting_html
from hiretide.functions.text import resolve_href, slugify
from hiretide.operators import dedup, digest, joins, ranking, reports
from hiretide.operators.normalize import build_posting, posting_filter
from hiretide.operators.scratch import materialise, scratch_path
from hiretide.plans import runs
from hiretide.schemas import BODY, POSTING_COLUMNS
from hiretide.sources import payloads, registry, saved_pages
from hiretide.sources.companies import with_defaults
from hiretide.sources.selectors import CARDS, LINKS
from hiretide.streaming import seen_stream
from workloads import derive as X
from workloads import sql as S
from workloads.fixed import MONITORED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def flat(df: DataFrame) -> DataFrame:
    """Posting columns with skills as text, so both engines hash the same."""
    return df.select(*[c for c in POSTING_COLUMNS if c != "skills"], F.concat_ws(",", "skills").alias("skills"))


def text_ts(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


SQL_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


# === structured sources =====================================================

def _source(name: str, source: str, sql: str) -> None:
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(
            registry.EXTRACTORS[source](
                X.payloads(spark, sf_dir, source), X.companies(spark, sf_dir),
                X.source_config(spark, sf_dir, source), K.Rules(),
            )
        )

    query(name, sql)(fn)


ROLE = S.is_data_role("title")
CA = S.is_canada("location")

_source("src_greenhouse", "greenhouse", S.ctes(S.P, S.D, S.C, S.rows(
    url="'https://gh.example/' || seq", skills=S.extract_skills("snippet"),
    where=f"{ROLE} AND {CA} AND company IN (SELECT company FROM c)")) + S.norm())

_source("src_lever", "lever", S.ctes(S.P, S.D, S.C, f"""q AS (
  SELECT *, snippet || ' ' || CASE WHEN seq % 2 = 0 THEN {S.pick(X.SNIPPETS, '(seq + 5) % 12')} ELSE '' END AS txt FROM p)""",
    S.rows(source="q", url="'https://lever.example/' || seq", skills=S.extract_skills("txt"),
           where=f"{ROLE} AND {CA} AND company IN (SELECT company FROM c)")) + S.norm())

_ASHBY = f"""a AS (
  SELECT *, CASE WHEN seq % 5 = 0 AND seq % 2 = 1 THEN 'Regina' ELSE location END AS city,
         CASE WHEN seq % 5 = 0 THEN 'SK' ELSE '' END AS region,
         seq % 5 = 0 OR lower(location) = 'canada' OR {S.has('location', V.ASHBY_CITIES)} AS primary_ca FROM p),
q AS (
  SELECT company, seq, title, snippet,
         CASE WHEN primary_ca AND city <> '' AND region <> '' THEN city || ', ' || region || ', Canada'
              WHEN primary_ca AND city <> '' THEN city || ', Canada' WHEN primary_ca THEN 'Canada'
              WHEN seq % 4 = 1 THEN 'Toronto, ON, Canada' WHEN seq % 4 = 2 THEN 'Canada' ELSE '' END AS location,
         CASE WHEN seq % 3 <> 0 THEN 'https://ashby.example/' || seq
              WHEN seq % 6 <> 0 THEN 'https://apply.example/' || seq ELSE '' END AS url FROM a)"""
_source("src_ashby", "ashby", S.ctes(S.P, S.D, S.C, _ASHBY, S.rows(
    source="q", url="url", skills=S.extract_skills("snippet"),
    where=f"{ROLE} AND location <> '' AND company IN (SELECT company FROM c)")) + S.norm())

_SMART = f"""q AS (
  SELECT p.company, seq, title, c.slug,
         CASE WHEN seq % 2 = 0 THEN coalesce(nullif(CASE WHEN seq % 3 <> 0 THEN location ELSE '' END, ''),
                CASE WHEN seq % 4 = 0 THEN 'Regina, Canada' ELSE 'Canada' END)
              WHEN seq % 3 <> 0 AND {CA} THEN location END AS location
  FROM p JOIN c USING (company))"""
_source("src_smartrecruiters", "smartrecruiters", S.ctes(S.P, S.D, S.C, _SMART, S.rows(
    source="q", url="CASE WHEN seq % 7 <> 0 THEN 'https://jobs.smartrecruiters.com/' || slug || '/' || seq ELSE '' END",
    where=f"{ROLE} AND location IS NOT NULL")) + S.norm())

_WORKDAY_LOC = """CASE WHEN seq % 3 <> 0 AND location <> '' THEN location
              WHEN seq % 6 = 0 AND location <> '' THEN location
              WHEN seq % 9 = 0 THEN 'Remote - US' WHEN seq % 9 = 3 THEN 'Toronto office' ELSE 'Canada' END"""
_WORKDAY = f"""q AS (
  SELECT p.company, seq, title, d.careers_url, d.id, {_WORKDAY_LOC} AS location
  FROM p JOIN d ON d.name = p.company WHERE d.id % 4 <> 3)"""
_source("src_workday", "workday", S.ctes(S.P, S.D, _WORKDAY, S.rows(
    source="q", posted="CASE WHEN seq % 2 = 0 THEN 'Posted Today' END",
    url="CASE WHEN seq % 8 <> 0 THEN 'https://t' || id || '.wd' || (id % 12 + 1) || '.myworkdayjobs.com/Board' || id || '/job/' || seq ELSE careers_url END",
    where=f"{ROLE} AND {CA}")) + S.norm())

_source("src_oracle_hcm", "oracle_hcm", S.ctes(S.P, S.D, S.C, f"""q AS (
  SELECT p.company, seq, title, CASE WHEN seq % 10 <> 0 THEN location ELSE 'Canada' END AS location, c.slug, c.site, d.careers_url
  FROM p JOIN c USING (company) JOIN d ON d.name = p.company WHERE seq % 2 = 0)""", S.rows(
    source="q", posted="CASE WHEN seq % 3 = 1 THEN '2024-01-01' END",
    url="CASE WHEN seq % 7 <> 0 THEN 'https://' || slug || '/hcmUI/CandidateExperience/en/sites/' || site || '/requisitions/' || seq ELSE careers_url END",
    where=ROLE)) + S.norm())

_source("src_amazon", "amazon", S.ctes(S.P, S.D, S.rows(
    location="CASE WHEN seq % 3 = 0 THEN 'Toronto, ON, Canada' WHEN seq % 11 <> 0 THEN location ELSE 'Canada' END",
    posted="CASE WHEN seq % 2 = 0 THEN 'January 1, 2024' END",
    url="CASE WHEN seq % 5 <> 0 THEN 'https://www.amazon.jobs/en/jobs/' || seq ELSE '' END", where=ROLE)) + S.norm())

_source("src_netflix", "netflix", S.ctes(S.P, S.D, """q AS (
  SELECT company, seq, title, CASE WHEN seq % 5 <> 0 THEN location ELSE 'Canada' END AS location FROM p)""", S.rows(
    source="q", url="'https://nf.example/' || seq", where=f"{ROLE} AND {CA}")) + S.norm())

_source("src_ibm_api", "ibm", S.ctes(S.P, S.D, """q AS (
  SELECT company, seq, title, CASE WHEN seq % 3 <> 2 AND location <> '' THEN location ELSE 'Canada' END AS location FROM p)""", S.rows(
    source="q", where=f"{ROLE} AND {CA}",
    url="CASE seq % 4 WHEN 0 THEN 'https://ibm.example/' || seq WHEN 1 THEN 'https://apply.example/' || seq"
        f" WHEN 2 THEN {S.lit(V.IBM_JOB)} || seq ELSE {S.lit(V.IBM_JOB)} END")) + S.norm())

_source("src_meta_graphql", "meta", S.ctes(S.P, S.D, S.rows(
    location=f"CASE WHEN {CA} THEN location WHEN seq % 2 = 1 THEN 'Toronto, ON' ELSE 'Canada' END",
    url="'https://www.metacareers.com/jobs/' || seq || '/'", where=ROLE)) + S.norm())

_source("src_bamboohr", "bamboohr", S.ctes(S.P, S.D, S.C, f"""q AS (
  SELECT p.company, seq, title, slug,
         CASE seq % 4 WHEN 0 THEN 'Regina, SK, Canada' WHEN 1 THEN 'Toronto' WHEN 2 THEN 'Canada' END AS location
  FROM p JOIN c USING (company) WHERE seq % 4 <> 3)""", S.rows(
    source="q", url="'https://' || slug || '.bamboohr.com/careers/' || seq", where=ROLE)) + S.norm())

_AV_PREFIX = ["", "[TOR] - ", "[NYC] ", "[XXX] ", "[mtl] ", "[VAN]"]
_source("src_avature_rss", "avature", S.ctes(S.P, S.D, S.C, f"""q AS (
  SELECT company, seq, {S.strip('title')} AS title,
         CASE seq % 6 WHEN 0 THEN 'Canada' WHEN 1 THEN 'Toronto, Ontario, Canada' WHEN 4 THEN 'Montreal, Quebec, Canada'
              WHEN 5 THEN 'Vancouver, BC, Canada' END AS location
  FROM p WHERE seq % 6 NOT IN (2, 3) AND company IN (SELECT company FROM c))""", S.rows(
    source="q", url="'https://rss.example/' || seq", where=ROLE)) + S.norm())

_source("src_boc_rss", "boc_rss", S.ctes(S.P, S.D, f"""q AS (
  SELECT company, seq, {S.strip('title')} AS title,
         CASE seq % 3 WHEN 0 THEN 'Ottawa' WHEN 1 THEN 'Toronto' ELSE 'Halifax (Downtown)' END AS location FROM p)""", S.rows(
    source="q", url="'https://rss.example/' || seq", where=ROLE)) + S.norm())

_source("src_phenom_html", "phenom", S.ctes(S.P, S.D, S.C, f"""q AS (
  SELECT company, seq, title, url_template,
         coalesce(nullif(trim(location), ''), 'Regina') || CASE seq % 3 WHEN 0 THEN ', ON, Canada' WHEN 1 THEN ', TX'
           ELSE ', British Columbia, Canada' END AS location
  FROM p JOIN c USING (company))""", S.rows(
    source="q", url=f"replace(replace(url_template, '{{jobSeqNo}}', 'J' || seq), '{{slug}}', {S.slugify('title')})",
    where=f"{ROLE} AND {CA}")) + S.norm())

_UUID_SQL = "substr({0},1,8)||'-'||substr({0},9,4)||'-'||substr({0},13,4)||'-'||substr({0},17,4)||'-'||substr({0},21,12)"
_source("src_shopify_html", "shopify", S.ctes(S.P, S.D, """q AS (
  SELECT *, md5('Company ' || cid || (seq % 97)) AS h FROM p
  QUALIFY row_number() OVER (PARTITION BY company, page_no, h ORDER BY seq) = 1)""", S.rows(
    source="q", location="'Remote Canada'",
    url=f"'https://www.shopify.com/careers/' || {S.slugify('title')} || '_' || {_UUID_SQL.format('h')}", where=ROLE)) + S.norm())

_source("src_canadalife_html", "canadalife", S.ctes(S.P, S.D, f"""q AS (
  SELECT company, seq, {S.strip("title || ' & more'")} AS title,
         CASE WHEN trim(location) = '' THEN 'Regina, SK, Canada'
              ELSE regexp_replace(CASE WHEN seq % 4 = 0 THEN ltrim(location) || ', CA' ELSE trim(location) END,
                                  ',\\s*CA\\s*$', ', Canada') END AS location
  FROM p QUALIFY row_number() OVER (PARTITION BY company, page_no, seq % 89 ORDER BY seq) = 1)""", S.rows(
    source="q", url="'https://jobs.canadalife.com/job/' || (seq % 89)", where=f"{ROLE} AND {CA}")) + S.norm())


# === saved pages ============================================================

_LINK_PAGES = f"""pg AS (
  SELECT *, seq // 120 AS page_id, (seq // 120) % 4 AS variant, '/job/' || (seq % 83) AS href,
         CASE WHEN seq % 10 = 9 THEN '' ELSE trim(title, ' ' || chr(9)) END AS shown FROM p)"""


def _links_sql(chosen: str, location: str = "'Canada'") -> str:
    return S.ctes(S.P, S.D, _LINK_PAGES, f"""ch AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS k FROM pg WHERE {chosen}),
f AS (
  SELECT * FROM ch WHERE shown <> ''
  QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY seq) = 1),
g AS (
  SELECT 'Company ' || page_id AS company, shown AS title, {location} AS location,
         'https://site.example' || href AS url FROM f)""",
        S.rows(source="g", url="url", where=ROLE)) + S.norm()


@query("src_html_links", _links_sql("variant <> 3 OR seq % 6 = 0"))
def src_html_links(spark, sf_dir):
    return flat(saved_pages.extract(X.j2w_pages(spark, sf_dir), "j2w", X.companies(spark, sf_dir)))


@query("src_html_links_native", _links_sql("true"))
def src_html_links_native(spark, sf_dir):
    """Link rules that look only at the link itself stay in the JVM."""
    return flat(saved_pages.extract(X.bare_pages(spark, sf_dir), "scotiabank", X.companies(spark, sf_dir)))


# every anchor of the driver's pages in document order, resolved against its page
_PAGE_ANCHORS = """pa AS (
  SELECT page_id, url AS base, i, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)[i] AS href,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)[i] AS txt
  FROM (SELECT *, unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) + 1)) AS i FROM pages))"""


@query("src_html_links_pages", f"""WITH {_PAGE_ANCHORS},
n AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS hits,
        row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM pa),
f AS (SELECT page_id, {S.strip('txt')} AS title, regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) || href AS url, k
      FROM n WHERE hits >= 2 AND {S.strip('txt')} <> '')
SELECT page_id, title, 'Quebec City' AS location, url FROM f
QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY k) = 1""")
def src_html_links_pages(spark, sf_dir):
    """Every link list of the driver's pages, any title."""
    rows = saved_pages.link_rows(X.table(spark, sf_dir, "pages"), LINKS["coveo"], K.Rules.of(broad=True))
    return rows.select("page_id", "title", "location", "url")


@query("src_html_cards", S.ctes(S.P, S.D, f"""ch AS (
  SELECT *, seq // 120 AS page_id, row_number() OVER (PARTITION BY seq // 120 ORDER BY seq) AS k FROM p),
g AS (
  SELECT 'Company ' || page_id AS company, trim(title, ' ' || chr(9)) AS title, seq,
         coalesce(nullif(trim(location), ''), 'Canada') AS location FROM ch)""",
    S.rows(source="g", url="'https://site.example/careers/JobDetail?jobId=' || seq", where=f"{ROLE} AND {CA}")) + S.norm())
def src_html_cards(spark, sf_dir):
    return flat(saved_pages.extract(X.card_pages(spark, sf_dir), "ibm_cards", X.companies(spark, sf_dir)))


_TABLE_LOC = "trim(CASE seq % 3 WHEN 0 THEN trim(location) || ' Canada' WHEN 1 THEN trim(location) || ' India' ELSE trim(location) END)"


@query("src_html_table_rows", S.ctes(S.P, S.D, f"""ch AS (
  SELECT *, seq // 120 AS page_id, row_number() OVER (PARTITION BY seq // 120 ORDER BY seq) AS k FROM p),
f AS (
  SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY page_id, seq % 83 ORDER BY seq) = 1),
g AS (
  SELECT 'Company ' || page_id AS company, trim(title, ' ' || chr(9)) AS title, seq,
         coalesce(nullif({_TABLE_LOC}, ''), 'Canada') AS location, page_id FROM f)""",
    S.rows(source="g", url="'https://site.example/list/xweb.asp?Page=jobdetails&id=' || (seq % 83)",
           where=f"{ROLE} AND {CA}")) + S.norm())
def src_html_table_rows(spark, sf_dir):
    return flat(saved_pages.extract(X.table_pages(spark, sf_dir), "njoyn", X.companies(spark, sf_dir)))


def _site(site: str) -> None:
    """One site's rules over pages in its own markup."""
    rules = LINKS.get(site) or CARDS[site]
    place, where = S.lit(rules.location), ROLE
    if site in CARDS:
        place = f"coalesce(nullif(trim(location), ''), {place})"
        where = "true" if not rules.role else ROLE
        if rules.geo:
            where += f" AND (location = '' OR {CA})"

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(saved_pages.extract(X.site_pages(spark, sf_dir, site), site, X.companies(spark, sf_dir)))

    kind = "links" if site in LINKS else "cards"
    query(f"src_{kind}_{site.removesuffix('_links').removesuffix('_cards')}", S.ctes(S.P, S.D, f"""g AS (
  SELECT 'Company ' || (seq // 120) AS company, trim(title, ' ' || chr(9)) AS title, {place} AS location,
         'https://site.example/{X.site_path(site)}/' || seq AS url FROM p)""", S.rows(source="g", url="url", where=where)) + S.norm())(fn)


for _name in [*LINKS, *CARDS]:
    _site(_name)


_TITLE_WORDS = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query("src_title_from_url", S.ctes(S.P) + f"""
SELECT seq, {_TITLE_WORDS.format("replace(slug, '-', ' ')")} AS details_title,
       {_TITLE_WORDS.format("replace(slug, '-', ' ')")} AS ey_title
FROM (SELECT seq, {S.slugify("regexp_replace(title, '[0-9]', '', 'g')")} AS slug FROM p)""")
def src_title_from_url(spark, sf_dir):
    slug = slugify(F.regexp_replace("title", "[0-9]", ""))
    p = X.postings(spark, sf_dir).select(
        "seq",
        F.concat(F.lit("https://a.example/en/details/"), F.col("seq").cast("string"), F.lit("/"), slug, F.lit("?team=X")).alias("u1"),
        F.concat(F.lit("https://e.example/ey/job/"), slug, F.lit("/"), F.col("seq").cast("string"), F.lit("/")).alias("u2"),
    )
    return p.select("seq", U.title_from_url("u1", "details").alias("details_title"), U.title_from_url("u2", "ey").alias("ey_title"))


@query("src_blocked_pages", """
SELECT 'ibm_cards' AS site, page_id, length(html) AS n_chars FROM pages WHERE page_id % 7 NOT IN (0, 1)
  AND NOT contains(html, 'AwsWafIntegration') AND NOT contains(html, 'challenge-container')
UNION ALL SELECT 'infosys', page_id, length(html) FROM pages WHERE page_id % 7 NOT IN (2, 3, 4)
  AND NOT contains(url, 'infosys.com/404') AND NOT contains(html, 'Access Denied')
UNION ALL SELECT 'scotiabank', page_id, length(html) FROM pages""")
def src_blocked_pages(spark, sf_dir):
    """The driver's pages with bot-wall marks planted in five of seven, as three sites' pages."""
    k, html = F.col("page_id") % 7, F.col("html")
    planted = X.table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(k == 2, F.concat("url", F.lit("?next=infosys.com/404"))).otherwise(F.col("url")).alias("url"),
        html.alias("original"),
        F.when(k == 0, F.concat(html, F.lit("<script>AwsWafIntegration</script>")))
        .when(k == 1, F.concat(html, F.lit('<div id="challenge-container">')))
        .when(k == 3, F.concat(F.lit("<h1>Access Denied</h1>"), html))
        .when(k == 4, F.concat(html, F.lit("Access Denied"))).otherwise(html).alias("html"),
    )
    return registry.union_sources(*[
        saved_pages.drop_blocked_pages(planted, site).select(
            F.lit(site).alias("site"), "page_id", F.length("original").cast("long").alias("n_chars"))
        for site in ("ibm_cards", "infosys", "scotiabank")
    ])


# === assembly ===============================================================

def _page_facts(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """(company, page_no, status, n_items, total): a user's days as its pages."""
    u, n = F.col("user_id"), F.col("page_no")
    first_day = F.lit("2024-01-01").cast("date")
    return (
        X.table(spark, sf_dir, "events")
        .groupBy("user_id", F.datediff(F.to_date("ts"), first_day).alias("page_no"))
        .agg(F.count("*").alias("n"))
        .select(
            F.concat(F.lit("User "), u.cast("string")).alias("company"), "page_no",
            F.when((u * 3 + n) % 17 == 16, F.lit(500)).otherwise(F.lit(200)).alias("status"),
            F.when((u + n) % 23 == 22, F.lit(0).cast("long")).otherwise(F.col("n")).alias("n_items"),
            ((u % 25 + 1) * size - u % 3).alias("total"),
        )
    )


def _page_facts_sql(size: int) -> str:
    return f"""f AS (
  SELECT 'User ' || user_id AS company, page_no, CASE WHEN (user_id * 3 + page_no) % 17 = 16 THEN 500 ELSE 200 END AS status,
         CASE WHEN (user_id + page_no) % 23 = 22 THEN 0 ELSE n END AS n_items, (user_id % 25 + 1) * {size} - user_id % 3 AS total
  FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS page_no, count(*) AS n FROM events GROUP BY 1, 2))"""


def _assembly_sql() -> str:
    """Pages read, per paging rule, by counting stops among earlier pages."""
    parts = []
    for source in ("smartrecruiters", "oracle_hcm", "workday", "netflix"):
        size = V.PAGE_SIZE[source]
        done = f"(page_no + 1) * {size} >= total"
        if source == "oracle_hcm":
            done = f"((page_no + 1) * {size} >= coalesce(max(CASE WHEN page_no = 0 THEN total END) OVER (PARTITION BY company), 0))"
        if source == "netflix":
            done = "sum(n_items) OVER (PARTITION BY company ORDER BY page_no) >= total"
        base = f"""(WITH {_page_facts_sql(size)}, g AS (
  SELECT *, status <> 200 AS bad, status = 200 AND n_items = 0 AS blank, status = 200 AND {done} AS done FROM f),
v AS (
  SELECT *, coalesce(bool_or(done OR blank OR bad) OVER w, false) AS over,
         coalesce(bool_or(done OR blank) OVER w, false) AS finished
  FROM g WINDOW w AS (PARTITION BY company ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
        if source in ("smartrecruiters", "oracle_hcm"):
            base += f"SELECT '{source}' AS source, company, page_no, n_items FROM v WHERE NOT over AND NOT bad)"
        else:
            base += f"""SELECT '{source}' AS source, company, page_no, n_items FROM v
WHERE NOT finished AND company NOT IN (SELECT company FROM v WHERE bad AND NOT finished))"""
        parts.append(base)
    return "\nUNION ALL\n".join(parts)


@query("src_page_assembly", _assembly_sql())
def src_page_assembly(spark, sf_dir):
    frames = []
    for source in ("smartrecruiters", "oracle_hcm", "workday", "netflix"):
        facts = _page_facts(spark, sf_dir, V.PAGE_SIZE[source])
        plan = payloads.page_plan(facts, source)
        kept = payloads.assemble_pages(facts, plan, ["company"])
        frames.append(kept.select(F.lit(source).alias("source"), "company", F.col("page_no").cast("long").alias("page_no"), "n_items"))
    return registry.union_sources(*frames)


@query("src_slug_attempt_pick", S.ctes(S.C, """t AS (
  SELECT company, unnest([0, 1, 2, 3]) AS attempt, unnest([slug, replace(slug, '-', ''), slug || 'inc', slug || 'hq']) AS slug FROM c),
r AS (SELECT *, CASE WHEN (CAST(replace(company, 'Company ', '') AS BIGINT) + attempt) % 3 = 0 THEN 200 ELSE 404 END AS status FROM t)""") + """
SELECT company, CAST(attempt AS BIGINT) AS attempt, slug FROM r WHERE status = 200
QUALIFY row_number() OVER (PARTITION BY company ORDER BY attempt) = 1""")
def src_slug_attempt_pick(spark, sf_dir):
    tries = payloads.slug_candidates(X.source_config(spark, sf_dir, "greenhouse"))
    number = F.regexp_extract("company", r"(\d+)", 1).cast("long")
    raw = tries.withColumn("status", F.when((number + F.col("attempt")) % 3 == 0, F.lit(200)).otherwise(F.lit(404)))
    return payloads.pick_attempt(raw, raw, ["company"]).select("company", F.col("attempt").cast("long"), "slug")


@query("src_primary_else_fallback", S.ctes(S.P) + f"""
SELECT seq, title, company, 'api' AS via FROM p WHERE cid % 4 = 0 AND {ROLE}
UNION ALL SELECT seq, title, company, 'page' AS via FROM p WHERE cid % 4 <> 0 AND cid % 4 <> 2""")
def src_primary_else_fallback(spark, sf_dir):
    """Every second company answers; half of those answer with nothing."""
    p = X.postings(spark, sf_dir).withColumn("url", F.lit(""))
    answered = p.filter("cid % 2 = 0").select("company")
    primary = p.filter("cid % 4 = 0").filter(K.is_data_role("title")).withColumn("via", F.lit("api"))
    fallback = p.withColumn("via", F.lit("page"))
    return payloads.primary_else_fallback(primary, fallback, answered).select("seq", "title", "company", "via")


# a dimension where every tenth company carries a name with its own extractor
_DED = list(V.DEDICATED_EXTRACTORS)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return X.companies(spark, sf_dir).withColumn(
        "name", F.when(i % 10 == 0, X.pick(_DED, X.div(i, 10) % len(_DED))).otherwise(F.col("name"))
    )


_NAMED = f"""dn AS (
  SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN {S.pick(_DED, f'(id // 10) % {len(_DED)}')} ELSE name END AS name) FROM d)"""


def _lookup_sql(mapping: dict[str, str], key: str) -> str:
    whens = " ".join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, v in mapping.items())
    return f"CASE {key} {whens} END"


_ROUTED = f"""r AS (
  SELECT *, CASE WHEN scraper IN ({', '.join(S.lit(t) for t in V.API_TYPES)}) THEN 'api'
                 WHEN extractor <> 'generic' THEN 'dedicated' ELSE 'skipped' END AS route
  FROM (SELECT *, coalesce({_lookup_sql(V.DEDICATED_EXTRACTORS, 'name')}, {_lookup_sql(V.TYPE_EXTRACTORS, 'scraper')}, 'generic') AS extractor FROM dn))"""


@query("src_dispatch", S.ctes(S.D, _NAMED, _ROUTED) + "SELECT id, name, scraper, extractor, route FROM r")
def src_dispatch(spark, sf_dir):
    return reports.route(_named(spark, sf_dir)).select("id", "name", "scraper", "extractor", "route")


@query("src_config_gaps", S.ctes(S.D) + """
SELECT name AS company, scraper AS source, 'no settings' AS reason FROM d
WHERE scraper IN ('greenhouse', 'lever', 'ashby', 'smartrecruiters', 'phenom', 'oracle_hcm', 'avature') AND id % 10 = 7
UNION ALL SELECT name, scraper, 'board url does not parse' FROM d WHERE scraper = 'workday' AND id % 4 = 3""")
def src_config_gaps(spark, sf_dir):
    boards = ["greenhouse", "lever", "ashby", "smartrecruiters", "phenom", "oracle_hcm", "avature"]
    cfg = registry.union_sources(*[X.source_config(spark, sf_dir, b) for b in boards])
    return joins.config_gaps(X.companies(spark, sf_dir), cfg, boards)


# === scalars ================================================================

def _scalar(name: str, spark_cols: Callable[[], dict[str, Column]], sql_cols: dict[str, str]) -> None:
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.postings(spark, sf_dir).select("seq", *[c.alias(k) for k, c in spark_cols().items()])

    cols = ", ".join(f"{v} AS {k}" for k, v in sql_cols.items())
    query(name, S.ctes(S.P) + f"SELECT seq, {cols} FROM p")(fn)


_scalar("is_canada", lambda: {"location": F.col("location"), "hit": K.is_canada("location")},
        {"location": "location", "hit": CA})
_scalar("is_us_or_canada", lambda: {"location": F.col("location"), "hit": K.is_us_or_canada("location")},
        {"location": "location", "hit": S.is_us_or_canada("location")})
_scalar("is_data_role", lambda: {"title": F.col("title"), "hit": K.is_data_role("title")}, {"title": "title", "hit": ROLE})
_scalar("detect_level", lambda: {"title": F.col("title"), "level": K.detect_level("title")},
        {"title": "title", "level": S.detect_level("title")})
_scalar("level_rank", lambda: {"level_rank": K.level_rank(K.detect_level("title")).cast("long")},
        {"level_rank": f"CAST({S.level_rank('(' + S.detect_level('title') + ')')} AS BIGINT)"})
_scalar("level_badge", lambda: {"badge": K.level_badge("title")}, {"badge": S.level_badge("title")})
_scalar("category_icon", lambda: {"category": F.col("category"), "icon": K.category_icon("category")},
        {"category": "category", "icon": S.category_icon("category")})
_scalar("fingerprint", lambda: {"fp": fingerprint("company", "title", "location")},
        {"fp": S.fingerprint("company", "title", "location")})
_scalar("slugify", lambda: {"slug": slugify("title")}, {"slug": S.slugify("title")})
_scalar(
    "smartrecruiters_location",
    lambda: {"label": L.smartrecruiters_location(
        F.when(F.col("seq") % 2 == 0, F.lit("Ca")).otherwise(F.lit("gb")),
        F.when(F.col("seq") % 3 != 0, F.col("location")), F.when(F.col("seq") % 4 == 0, F.lit("Regina")))},
    {"label": f"""CASE WHEN seq % 2 = 0 THEN CASE WHEN seq % 3 <> 0 AND location <> '' THEN location
                       WHEN seq % 4 = 0 THEN 'Regina, Canada' ELSE 'Canada' END
                  WHEN seq % 3 <> 0 AND {CA} THEN location END"""})
_scalar(
    "workday_location",
    lambda: {"label": L.workday_location(
        F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.col("location")),
        F.when(F.col("seq") % 6 == 0, F.col("location")),
        F.when(F.col("seq") % 9 == 0, F.array(F.lit("R-1"), F.lit("Remote - US")))
        .when(F.col("seq") % 9 == 3, F.array(F.lit("x"), F.lit("Toronto office"))))},
    {"label": _WORKDAY_LOC})
_scalar(
    "phenom_location",
    lambda: {"label": L.phenom_location(F.trim("location"), X.pick(["ON", "TX", "British Columbia", ""], F.col("seq") % 4))},
    {"label": """CASE WHEN trim(location) = '' THEN 'Canada' WHEN seq % 4 = 0 THEN trim(location) || ', ON, Canada'
                 WHEN seq % 4 = 2 THEN trim(location) || ', British Columbia, Canada'
                 WHEN seq % 4 = 1 THEN trim(location) || ', TX' ELSE trim(location) || ', ' END"""})
_scalar(
    "amazon_location",
    lambda: {"label": L.amazon_location(F.when(F.col("seq") % 3 == 0, F.concat(F.lit("CA, ON ,"), "location")).otherwise(F.col("location")))},
    {"label": "CASE WHEN seq % 3 = 0 AND NOT contains(location, ',') THEN trim(location) || ', ON, Canada' WHEN seq % 3 = 0 THEN 'CA, ON ,' || location ELSE location END"})


@query("avature_prefix", S.ctes(S.P) + f"""
SELECT seq, CASE seq % 6 WHEN 0 THEN title ELSE trim(title, ' -–') END AS title,
       CASE seq % 6 WHEN 0 THEN 'Canada' WHEN 1 THEN 'Toronto, Ontario, Canada' WHEN 4 THEN 'Montreal, Quebec, Canada'
            WHEN 5 THEN 'Vancouver, BC, Canada' END AS location FROM p""")
def avature_prefix(spark, sf_dir):
    p = X.postings(spark, sf_dir)
    got = L.avature_prefix(F.concat(X.pick(_AV_PREFIX, F.col("seq") % 6), F.col("title")))
    return p.select("seq", got.alias("g")).select("seq", "g.title", "g.location")


@query("boc_title_location", S.ctes(S.P) + f"""
SELECT seq, CASE WHEN seq % 3 = 0 THEN title ELSE {S.strip('title')} END AS title,
       CASE seq % 3 WHEN 0 THEN 'Ottawa' WHEN 1 THEN 'Toronto' ELSE 'Halifax (Downtown)' END AS location FROM p""")
def boc_title_location(spark, sf_dir):
    p = X.postings(spark, sf_dir)
    suffix = X.pick(["", " (Toronto, ON)", " (Halifax (Downtown), NS)"], F.col("seq") % 3)
    return p.select("seq", L.boc_title_location(F.concat("title", suffix)).alias("g")).select("seq", "g.title", "g.location")


@query("ashby_location", S.ctes(S.P, _ASHBY) + "SELECT seq, location FROM q")
def ashby_location(spark, sf_dir):
    """The location rule over the parsed job, before any filter."""
    element = BODY["ashby"].removeprefix("jobs array<").removesuffix(">")
    jobs = X.postings(spark, sf_dir).select("seq", F.from_json(X.RENDER["ashby"]()[0], element).alias("j"))
    return jobs.select("seq", L.ashby_location("j").alias("location"))


@query("extract_skills", f"""
SELECT doc_id, array_to_string({S.extract_skills("(text || ' ' || " + S.pick(X.SNIPPETS, 'doc_id % 12') + ")")}, ',') AS skills FROM documents""")
def extract_skills(spark, sf_dir):
    """Whole document texts, each with one tool-naming sentence appended."""
    text = F.concat("text", F.lit(" "), X.pick(X.SNIPPETS, F.col("doc_id") % 12))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", K.extract_skills(text)).alias("skills"))


@query("broaden_url", S.ctes(S.D) + """
SELECT id, replace(replace(replace(replace(u, 'data+engineer', 'engineer'), 'data%20engineer', 'engineer'), 'data engineer', 'engineer'),
       'keywords=data', 'keywords=engineer') AS url
FROM (SELECT id, careers_url || CASE id % 3 WHEN 0 THEN '&q=data%20engineer' WHEN 1 THEN '&keywords=data' ELSE '&t=data engineer' END AS u FROM d)""")
def broaden_url(spark, sf_dir):
    tail = X.pick(["&q=data%20engineer", "&keywords=data", "&t=data engineer"], F.col("id") % 3)
    return X.companies(spark, sf_dir).select("id", U.broaden_url(F.concat("careers_url", tail)).alias("url"))


@query("find_companies", S.ctes(S.D) + """
SELECT name AS title, category AS location, careers_url AS url FROM d
WHERE contains(lower(name), 'company 1')""")
def find_companies(spark, sf_dir):
    found = reports.find_companies(X.companies(spark, sf_dir), "COMPANY 1")
    return found.select(*reports.display_row(F.col("name"), F.col("category"), F.col("careers_url")))


@query("workday_url_parts", S.ctes(S.D) + """
SELECT id, CASE WHEN id % 4 <> 3 THEN 't' || id END AS tenant, CASE WHEN id % 4 <> 3 THEN 'wd' || (id % 12 + 1) END AS wd,
       CASE WHEN id % 4 <> 3 THEN 'Board' || id END AS board,
       CASE WHEN id % 4 <> 3 THEN 'c' || id || '|x y' ELSE 'x y' END AS countries FROM d""")
def workday_url_parts(spark, sf_dir):
    parts = U.workday_url_parts(F.concat("careers_url", F.lit("&locationCountry=x%20y")))
    return X.companies(spark, sf_dir).select("id", parts.alias("p")).select(
        "id", "p.tenant", "p.wd", "p.board", F.concat_ws("|", "p.facets.locationCountry").alias("countries"))


@query("workday_page_url", S.ctes(S.D) + """
SELECT id, CASE WHEN id % 4 <> 3 THEN split_part(careers_url, '?', 1) || '?locationCountry=c' || id || '&x=a+b'
       ELSE split_part(careers_url, '?', 1) || '?location=Canada&x=a+b' END AS url FROM d""")
def workday_page_url(spark, sf_dir):
    return X.companies(spark, sf_dir).select("id", U.workday_page_url(F.concat("careers_url", F.lit("&x=a%20b&x=c"))).alias("url"))


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived postings, normalised; ``seq`` and ``run_ts`` ride along."""
    rows = X.postings(spark, sf_dir).select("seq", "run_ts", "company", "title", "location", K.extract_skills("snippet").alias("skills"))
    return build_posting(rows, X.companies(spark, sf_dir))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_filter(_normal(spark, sf_dir))


_POSTING_SQL = "title, company, category, location, level, type, posted, url, salary, array_to_string(skills, ',') AS skills"


@query("build_posting", S.ctes(S.P, S.D, S.N) + f"SELECT seq, {_POSTING_SQL} FROM n")
def build_posting_q(spark, sf_dir):
    return _normal(spark, sf_dir).select("seq", *[c for c in POSTING_COLUMNS if c != "skills"], F.concat_ws(",", "skills").alias("skills"))


@query("posting_filter", S.ctes(S.P, S.D, S.N) + f"SELECT seq, {_POSTING_SQL} FROM n WHERE {CA} AND {ROLE}")
def posting_filter_q(spark, sf_dir):
    return _wanted(spark, sf_dir).select("seq", *[c for c in POSTING_COLUMNS if c != "skills"], F.concat_ws(",", "skills").alias("skills"))


@query("mode_switches", S.ctes(S.P, S.D, S.N) + f"""
SELECT 'broad' AS mode, seq, title, location FROM n WHERE {CA}
UNION ALL SELECT 'include_us', seq, title, location FROM n WHERE {S.is_us_or_canada('location')} AND {ROLE}
UNION ALL SELECT 'both', seq, title, location FROM n WHERE {S.is_us_or_canada('location')}""")
def mode_switches(spark, sf_dir):
    n = _normal(spark, sf_dir).select("seq", "title", "location")
    modes = {"broad": K.Rules.of(broad=True), "include_us": K.Rules.of(include_us=True), "both": K.Rules.of(True, True)}
    return registry.union_sources(*[
        posting_filter(n, rules).select(F.lit(mode).alias("mode"), "seq", "title", "location") for mode, rules in modes.items()
    ])


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


_HTML_SQL = f"""'<div class="posting"><b>' || {_esc('title')} || '</b><span class="badge">' || {S.level_badge('level')} || '</span>'
  || '<span class="salary">' || {_esc('salary')} || '</span><div class="meta">' || {_esc('company')} || ' · ' || {_esc('location')}
  || ' · Full-time · ' || posted || '</div>'
  || CASE WHEN len(skills) > 0 THEN '<div class="skills">' || array_to_string(list_transform(skills, lambda s: '<span class="skill">' || s || '</span>'), '') || '</div>' ELSE '' END
  || '</div>'"""


@query("posting_html", S.ctes(S.P, S.D, S.N) + f"SELECT seq, {_HTML_SQL} AS html FROM n")
def posting_html_q(spark, sf_dir):
    return _normal(spark, sf_dir).select("seq", posting_html().alias("html"))


# === joins ==================================================================

@query("join_source_config", S.ctes(S.P, S.C) + "SELECT seq, title, slug, site, url_template FROM p JOIN c USING (company)")
def join_source_config(spark, sf_dir):
    cfg = X.source_config(spark, sf_dir, "lever").unionByName(X.source_config(spark, sf_dir, "phenom"))
    rows = X.postings(spark, sf_dir).select("seq", "title", "company")
    return joins.join_source_config(rows, cfg, "phenom").select("seq", "title", "slug", "site", "url_template")


@query("join_company_dim", S.ctes(S.P, S.D) + """
SELECT p.seq, p.title, d.category, d.salary_range AS salary, d.careers_url, array_to_string(d.stack, ',') AS stack
FROM p JOIN d ON d.name = p.company""")
def join_company_dim(spark, sf_dir):
    rows = X.postings(spark, sf_dir).select("seq", "title", "company")
    joined = joins.with_company(rows, X.companies(spark, sf_dir))
    return joined.select("seq", "title", "category", "salary", "careers_url", F.concat_ws(",", "stack").alias("stack"))


@query("join_dispatch", S.ctes(S.D, _NAMED, _ROUTED) + "SELECT id, name, extractor FROM r")
def join_dispatch(spark, sf_dir):
    """The routing maps as tables, as a user who keeps them in storage has it."""
    maps = [spark.createDataFrame(list(m.items()), f"{k} string, extractor string")
            for m, k in ((V.DEDICATED_EXTRACTORS, "name"), (V.TYPE_EXTRACTORS, "scraper"))]
    return reports.route_by_tables(_named(spark, sf_dir), *maps).select("id", "name", "extractor")


_SPLIT, _NOW, _CUT = "2024-01-15 00:00:00", "2024-01-22 12:00:00", "2024-01-08 12:00:00"
_LIVE = f"""st AS (SELECT fp, max(run_ts) AS emitted_at FROM w WHERE run_ts < TIMESTAMP '{_SPLIT}' GROUP BY fp),
lv AS (SELECT * FROM st WHERE emitted_at > TIMESTAMP '{_CUT}'),
b AS (SELECT * FROM w WHERE run_ts >= TIMESTAMP '{_SPLIT}')"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """State from the first half of the month, batch from the second."""
    w = dedup.with_fingerprint(_wanted(spark, sf_dir))
    cut = F.lit(_SPLIT).cast("timestamp_ntz")
    state = w.filter(F.col("run_ts") < cut).groupBy("fp").agg(F.max("run_ts").alias("emitted_at"))
    return state, w.filter(F.col("run_ts") >= cut)


_NOW_AT = datetime.fromisoformat(_NOW)


@query("anti_seen", S.ctes(S.P, S.D, S.N, S.W, _LIVE) + "SELECT seq, fp FROM b WHERE fp NOT IN (SELECT fp FROM lv)")
def anti_seen(spark, sf_dir):
    state, batch = _split(spark, sf_dir)
    return dedup.anti_seen(batch, dedup.live_state(state, _NOW_AT)).select("seq", "fp")


_RENDERED = ", ".join(S.lit(n) for n in V.AUDIT_RENDERED_ONLY)


@query("semi_membership", S.ctes(S.D, _NAMED) + f"""
SELECT id, name, 'rendered' AS list FROM dn WHERE name IN ({_RENDERED})
UNION ALL SELECT id, name, 'probed' FROM dn WHERE name NOT IN ({_RENDERED})""")
def semi_membership(spark, sf_dir):
    d = _named(spark, sf_dir).select("id", "name")
    return registry.union_sources(*[
        joins.matches_in_list(d, "name", V.AUDIT_RENDERED_ONLY, keep).withColumn("list", F.lit(label))
        for keep, label in ((True, "rendered"), (False, "probed"))
    ])


_VOCAB = sorted({s.lower() for s in V.SKILLS})


@query("vocab_join", f"""
WITH t AS (SELECT doc_id, lower(text || ' ' || {S.pick(X.SNIPPETS, 'doc_id % 12')}) AS t FROM documents),
v AS (SELECT unnest({S.arr(_VOCAB)}) AS term UNION SELECT lower(n_name) FROM nation UNION SELECT lower(r_name) FROM region)
SELECT doc_id, term FROM t JOIN v ON contains(t.t, v.term)""")
def vocab_join(spark, sf_dir):
    """Whole documents against a vocabulary read from tables."""
    docs = X.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("text", F.lit(" "), X.pick(X.SNIPPETS, F.col("doc_id") % 12)).alias("text"))
    vocab = (
        spark.createDataFrame([(t,) for t in _VOCAB], "term string")
        .union(X.table(spark, sf_dir, "nation").select(F.lower("n_name")))
        .union(X.table(spark, sf_dir, "region").select(F.lower("r_name")))
    )
    return joins.match_terms(docs, "doc_id", "text", vocab)


# === aggregations ===========================================================

_CHUNKS = """k AS (
  SELECT *, row_number() OVER (ORDER BY {rank}, company, seq) - 1 AS rn, count(*) OVER () AS n_all FROM w),
ch AS (SELECT *, rn // 50 AS chunk_no, (n_all + 49) // 50 AS n_chunks FROM k)""".format(rank=S.level_rank("level"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.chunk_rows(_wanted(spark, sf_dir), ["company", "seq"])


_STATS = """count(*) AS total, count(*) FILTER (contains(level, 'Senior')) AS senior,
  count(*) FILTER (contains(level, 'Mid')) AS mid, count(*) FILTER (contains(level, 'Entry')) AS entry"""


@query("digest_stats", S.ctes(S.P, S.D, S.N, S.W, _CHUNKS) + f"SELECT chunk_no, {_STATS} FROM ch GROUP BY chunk_no")
def digest_stats(spark, sf_dir):
    return digest.digest_stats(_chunks(spark, sf_dir), ["chunk_no"])


@query("digest_by_category", S.ctes(S.P, S.D, S.N, S.W, _CHUNKS) + """
SELECT chunk_no, category, count(*) AS n, min(rn) AS first_rn, string_agg(title, ' | ' ORDER BY rn) AS titles
FROM ch GROUP BY chunk_no, category""")
def digest_by_category(spark, sf_dir):
    return digest.digest_by_category(_chunks(spark, sf_dir), ["chunk_no"])


_COUNTS = "cc AS (SELECT d.id, d.name AS company, count(w.seq) AS n FROM d LEFT JOIN w ON w.company = d.name GROUP BY d.id, d.name)"


@query("company_counts", S.ctes(S.P, S.D, S.N, S.W, _COUNTS) + "SELECT company, n FROM cc")
def company_counts(spark, sf_dir):
    return reports.company_counts(_wanted(spark, sf_dir), X.companies(spark, sf_dir))


# any title, geography applied
_BROAD = f"""bc AS (SELECT d.id, d.name AS company, count(g.seq) AS n
  FROM d LEFT JOIN (SELECT * FROM n WHERE {CA}) g ON g.company = d.name GROUP BY d.id, d.name)"""


@query("broad_summary", S.ctes(S.P, S.D, S.N, _BROAD) + """
SELECT count(*) AS companies, count(*) FILTER (n > 0) AS working, CAST(sum(n) AS BIGINT) AS total_jobs FROM bc""")
def broad_summary(spark, sf_dir):
    return runs.broad_run(_normal(spark, sf_dir), X.companies(spark, sf_dir))[1]


# outcomes: counts of all derived postings, every seventh company fails
_ERROR_SQL = "CASE WHEN id % 7 = 5 THEN 'HTTP 503 from board ' || id || repeat('!', 90) END"
_OUTCOMES = f"""o AS (
  SELECT r.*, coalesce(pc.n, 0) AS n, {_ERROR_SQL} AS error, r.id % 13 = 4 AS needs_page
  FROM r LEFT JOIN (SELECT company, count(*) AS n FROM p WHERE {ROLE} GROUP BY company) pc ON pc.company = r.name)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    postings = X.postings(spark, sf_dir).filter(K.is_data_role("title"))
    counts = postings.groupBy("company").agg(F.count("*").alias("n")).withColumnRenamed("company", "name")
    return (
        reports.route(_named(spark, sf_dir)).join(counts, "name", "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        .withColumn("error", F.when(i % 7 == 5, F.concat(F.lit("HTTP 503 from board "), i.cast("string"), F.lit("!" * 90))))
        .withColumn("needs_page", i % 13 == 4)
    )


_AUDIT = f"""au AS (
  SELECT id, name, scraper, top100, n,
         CASE WHEN name IN ({_RENDERED}) THEN 'selenium' WHEN scraper = 'custom' AND extractor = 'generic' THEN 'skip'
              WHEN needs_page THEN 'selenium' WHEN error IS NOT NULL THEN 'error' WHEN n > 0 THEN 'ok' ELSE 'zero' END AS status,
         CASE WHEN name IN ({_RENDERED}) THEN 'only readable as a rendered page'
              WHEN scraper = 'custom' AND extractor = 'generic' THEN 'no extractor of its own'
              WHEN needs_page THEN 'structured source did not answer' WHEN error IS NOT NULL THEN error
              ELSE n || ' data jobs' END AS note
  FROM o)"""
_AUDIT_CTES = S.ctes(S.P, S.D, _NAMED, _ROUTED, _OUTCOMES, _AUDIT)


@query("audit_status", _AUDIT_CTES + """
SELECT id, name, scraper, CASE WHEN status IN ('ok', 'zero') THEN n ELSE 0 END AS jobs, status, note FROM au""")
def audit_status(spark, sf_dir):
    return reports.audit_status(_outcomes(spark, sf_dir)).select("id", "name", "scraper", "jobs", "status", "note")


_ROLLUP = """SELECT section, count(*) AS companies, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'zero') AS zero,
  count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'selenium') AS selenium,
  count(*) FILTER (status = 'skip') AS skip, count(*) FILTER (status IN ('ok', 'zero')) AS confirmed
FROM (SELECT status, CASE WHEN top100 THEN 'top100' ELSE 'rest' END AS section FROM au UNION ALL SELECT status, 'overall' FROM au)
GROUP BY section"""


@query("audit_rollup", _AUDIT_CTES + _ROLLUP)
def audit_rollup(spark, sf_dir):
    return reports.audit_rollup(reports.audit_status(_outcomes(spark, sf_dir)))


@query("join_audit_results", _AUDIT_CTES + """
SELECT d.id, d.name, au.status FROM (SELECT id, name FROM dn) d LEFT JOIN (SELECT id, status FROM au WHERE status <> 'skip') au USING (id)""")
def join_audit_results(spark, sf_dir):
    """Report order from the dimension, results looked up by its key."""
    status = reports.audit_status(_outcomes(spark, sf_dir)).filter("status <> 'skip'").select("id", "status")
    return joins.audit_results(_named(spark, sf_dir).select("id", "name"), status, "id")


@query("validate_summary", S.ctes(S.P, S.D, _NAMED, _ROUTED, _OUTCOMES) + """
SELECT outcome, name, CASE WHEN outcome = 'pass' THEN n ELSE 0 END AS jobs, coalesce(error, '') AS note,
       count(*) OVER (PARTITION BY outcome) AS in_outcome
FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN n > 0 THEN 'pass' ELSE 'zero' END AS outcome FROM o)""")
def validate_summary(spark, sf_dir):
    return reports.outcome_rows(_outcomes(spark, sf_dir))


@query("api_health_counts", S.ctes(S.P, S.D, _NAMED, _ROUTED, _OUTCOMES) + """
SELECT count(*) AS total, count(*) FILTER (NOT sk AND error IS NULL AND n > 0) AS ok,
  count(*) FILTER (NOT sk AND error IS NULL AND n = 0) AS zero, count(*) FILTER (NOT sk AND error IS NOT NULL) AS err,
  count(*) FILTER (sk) AS skipped
FROM (SELECT *, extractor = 'generic' OR needs_page AS sk FROM o)""")
def api_health_counts(spark, sf_dir):
    return reports.api_health_counts(_outcomes(spark, sf_dir))


@query("run_counters", S.ctes(S.P, S.D, S.N) + f"""
SELECT {SQL_TS.format('run_ts')} AS run, count(*) AS scraped, count(*) FILTER ({CA} AND {ROLE}) AS new, count(DISTINCT company) AS companies
FROM n GROUP BY run_ts""")
def run_counters(spark, sf_dir):
    wanted = K.is_canada("location") & K.is_data_role("title")
    counted = reports.run_counters(_normal(spark, sf_dir), wanted, ["run_ts"])
    return counted.withColumn("run", text_ts("run_ts")).drop("run_ts")


@query("chunk_count", S.ctes(S.P, S.D, S.N, S.W) + f"""
SELECT {SQL_TS.format('run_ts')} AS run, count(*) AS n_rows, CAST(ceil(count(*) / 50.0) AS BIGINT) AS n_chunks FROM w GROUP BY run_ts""")
def chunk_count(spark, sf_dir):
    return ranking.chunk_count(_wanted(spark, sf_dir), ["run_ts"]).withColumn("run", text_ts("run_ts")).drop("run_ts")


# === windows, order =========================================================

def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, href, txt, url) of the driver's pages."""
    pages = X.table(spark, sf_dir, "pages")
    found = pages.select(
        "page_id", "url", F.posexplode(saved_pages.native_links(F.col("html"))).alias("pos", "a"))
    return found.select(
        "page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("a")["href"].alias("href"),
        F.col("a")["text"].alias("txt"), resolve_href("url", F.col("a")["href"]).alias("url"))


_MATCHES = """m AS (
  SELECT page_id, i, 0 AS ord FROM pa WHERE contains(href, 'th')
  UNION ALL SELECT page_id, i, 1 FROM pa WHERE contains(href, 'e')
  UNION ALL SELECT page_id, i, 2 FROM pa),
ct AS (SELECT page_id, ord, count(*) AS n FROM m GROUP BY ALL),
pk AS (SELECT page_id, coalesce(min(ord) FILTER (ord < 2 AND n >= 2), max(ord) FILTER (ord = 2)) AS ord FROM ct GROUP BY page_id)"""


@query("pattern_choice", f"""WITH {_PAGE_ANCHORS}, {_MATCHES}
SELECT page_id, CAST(ord AS BIGINT) AS ord FROM pk WHERE ord IS NOT NULL""")
def pattern_choice(spark, sf_dir):
    """First of two patterns with at least two matches, else all links."""
    href = F.col("href")
    hit = F.array_compact(F.array(
        F.when(href.contains("th"), F.lit(0)), F.when(href.contains("e"), F.lit(1)), F.lit(2)))
    matches = _anchors(spark, sf_dir).select("page_id", F.explode(hit).alias("ord"))
    return ranking.choose_pattern(matches, "page_id", "ord", 2, 2).select("page_id", F.col("ord").cast("long"))


@query("first_n_per_page", f"WITH {_PAGE_ANCHORS} SELECT page_id, i AS pos, href FROM pa WHERE i <= 3")
def first_n_per_page(spark, sf_dir):
    return ranking.first_n(_anchors(spark, sf_dir).select("page_id", "pos", "href"), ["page_id"], ["pos"], 3)


@query("first_per_key", f"""WITH {_PAGE_ANCHORS}
SELECT page_id, i AS pos, lower(href) AS href FROM pa QUALIFY row_number() OVER (PARTITION BY page_id, lower(href) ORDER BY i) = 1""")
def first_per_key(spark, sf_dir):
    rows = _anchors(spark, sf_dir).select("page_id", "pos", F.lower("href").alias("href"))
    return ranking.first_per_key(rows, ["page_id", "href"], ["pos"])


@query("first_non_empty_selector", f"""
WITH s AS (
  SELECT page_id, unnest([0, 1, 2]) AS ord, unnest([regexp_extract(html, '<h2>([^<]*)</h2>', 1),
         CASE WHEN page_id % 3 = 0 THEN ' ' ELSE regexp_extract(html, '<h1>([^<]*)</h1>', 1) END,
         regexp_extract(html, '<title>([^<]*)</title>', 1)]) AS txt FROM pages)
SELECT page_id, {S.strip('txt')} AS txt FROM s WHERE {S.strip('txt')} <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord) = 1""")
def first_non_empty_selector(spark, sf_dir):
    def inside(tag: str) -> Column:
        return F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1)

    texts = F.array(inside("h2"), F.when(F.col("page_id") % 3 == 0, F.lit(" ")).otherwise(inside("h1")), inside("title"))
    rows = X.table(spark, sf_dir, "pages").select("page_id", F.posexplode(texts).alias("ord", "txt"))
    rows = rows.withColumn("txt", saved_pages.strip("txt"))
    return ranking.first_non_empty_selector(rows, ["page_id"], "ord", "txt")


@query("first_in_batch", S.ctes(S.P, S.D, S.N, S.W) + """
SELECT fp, seq, company, title, location FROM w QUALIFY row_number() OVER (PARTITION BY fp ORDER BY company, seq) = 1""")
def first_in_batch(spark, sf_dir):
    first = dedup.first_in_batch(dedup.with_fingerprint(_wanted(spark, sf_dir)), ["company", "seq"])
    return first.select("fp", "seq", "company", "title", "location")


@query("sort_by_level", S.ctes(S.P, S.D, S.N, S.W) + f"""
SELECT row_number() OVER (ORDER BY {S.level_rank('level')}, company, seq) - 1 AS rn, level, company, seq FROM w""")
def sort_by_level(spark, sf_dir):
    """The global order made visible as row numbers."""
    wanted = _wanted(spark, sf_dir).select("level", "company", "seq")
    return ranking.number_by_level(wanted, ["company", "seq"]).select("rn", "level", "company", "seq")


@query("chunk_rows", S.ctes(S.P, S.D, S.N, S.W, _CHUNKS) + """
SELECT seq, rn, chunk_no, n_chunks, CASE WHEN n_chunks > 1 THEN '(' || (chunk_no + 1) || '/' || n_chunks || ')' ELSE '' END AS label FROM ch""")
def chunk_rows(spark, sf_dir):
    label = F.when(
        F.col("n_chunks") > 1,
        F.concat(F.lit("("), (F.col("chunk_no") + 1).cast("string"), F.lit("/"), F.col("n_chunks").cast("string"), F.lit(")")),
    ).otherwise(F.lit(""))
    return _chunks(spark, sf_dir).select("seq", "rn", "chunk_no", "n_chunks", label.alias("label"))


@query("top_counts", S.ctes(S.P, S.D, S.N, S.W, _COUNTS) + "SELECT company, n FROM cc")
def top_counts(spark, sf_dir):
    """All companies by postings, ties in input order."""
    dim = X.companies(spark, sf_dir)
    counts = reports.company_counts(_wanted(spark, sf_dir), dim)
    ordered = counts.join(dim.select(F.col("name").alias("company"), "id"), "company")
    return reports.top_counts(ordered, "id").select("company", "n")


# === sets ===================================================================

# --- every board and the link pages of two sites, through attempts, paging and dispatch

def _named_company(number: Column) -> Column:
    """The name a company of that number has in ``_named``."""
    plain = F.concat(F.lit("Company "), number.cast("string"))
    return F.when(number % 10 == 0, X.pick(_DED, X.div(number, 10) % len(_DED))).otherwise(plain)


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumn("company", _named_company(F.regexp_extract("company", r"(\d+)", 1).cast("long")))


def _renamed_sql(number: str) -> str:
    return f"CASE WHEN {number} % 10 = 0 THEN {S.pick(_DED, f'({number} // 10) % {len(_DED)}')} ELSE 'Company ' || {number} END"


_READ_PAGES = {source: "page_no = min(page_no) OVER (PARTITION BY cid)" for source in ("smartrecruiters", "amazon", "oracle_hcm", "workday")}
_READ_PAGES["netflix"] = "coalesce(sum(1) OVER (PARTITION BY cid ORDER BY page_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 50"
_SITES = ("j2w", "scotiabank")


def _dispatched_sql(name: str, extractor: str) -> str:
    """One board's own twin over renamed companies, cut to the companies routed to it."""
    read = _READ_PAGES.get(extractor)
    p = S.P.replace("'Company ' || user_id AS company", f"{_renamed_sql('user_id')} AS company")
    if read:
        p = p.replace("p AS (", "p0 AS (", 1) + f",\np AS (SELECT * FROM p0 QUALIFY {read})"
    sql = SQL[name].replace(S.P, p).replace(S.D, S.D.replace("'Company ' || c_custkey AS name", f"{_renamed_sql('c_custkey')} AS name"))
    sql = sql.replace(S.C, S.C.replace("'Company ' || c_custkey AS company", f"{_renamed_sql('c_custkey')} AS company"))
    sql = sql.replace("'Company ' || page_id AS company", f"{_renamed_sql('page_id')} AS company")
    routed = S.ctes(S.D, _NAMED, _ROUTED) + f"SELECT name FROM r WHERE extractor = '{extractor}' AND route <> 'skipped'"
    return f"SELECT * FROM ({sql}) WHERE company IN ({routed})"


_BOARDS = {name.removeprefix("src_"): name for name in SQL if name.startswith("src_")}
_BOARD_OF = {"greenhouse": "greenhouse", "lever": "lever", "ashby": "ashby", "smartrecruiters": "smartrecruiters", "workday": "workday",
             "oracle_hcm": "oracle_hcm", "amazon": "amazon", "netflix": "netflix", "ibm": "ibm_api", "meta": "meta_graphql",
             "bamboohr": "bamboohr", "avature": "avature_rss", "boc_rss": "boc_rss", "phenom": "phenom_html",
             "shopify": "shopify_html", "canadalife": "canadalife_html"}


@query("union_all_sources", "\nUNION ALL\n".join(
    [_dispatched_sql(_BOARDS[board], source) for source, board in _BOARD_OF.items()]
    + [_dispatched_sql("src_html_links", "j2w"), _dispatched_sql("src_html_links_native", "scotiabank")]))
def union_all_sources(spark, sf_dir):
    """All sixteen boards landed in one payload table and two sites' pages, extracted and united.

    Every body is landed under two attempts; of a third of the companies the first one failed.
    """
    raw = _renamed(X.payloads_of(spark, sf_dir, list(_BOARD_OF)))
    missed = (F.pmod(F.xxhash64("company"), F.lit(3)) == 0) & (F.col("attempt") == 0)
    raw = raw.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1))))
    raw = raw.withColumn("status", F.when(missed, F.lit(404)).otherwise(F.col("status")))
    boards = F.explode(F.array(*[F.lit(source) for source in _BOARD_OF]))
    companies = X.source_config(spark, sf_dir, "").repartition(spark.sparkContext.defaultParallelism)
    cfg = _renamed(companies.withColumn("source", boards))
    pages = registry.union_sources(*[
        _renamed(make(spark, sf_dir)).withColumn("site", F.lit(site)) for site, make in zip(_SITES, (X.j2w_pages, X.bare_pages))])
    # landed, as a user has them
    raw, cfg, pages = (materialise(df, label) for df, label in ((raw, "payloads"), (cfg, "config"), (pages, "pages")))
    return flat(registry.all_sources(raw, pages, _named(spark, sf_dir), cfg, sites=list(_SITES)))


@query("partition_routes", S.ctes(S.D, _NAMED, _ROUTED) + """
SELECT route, CASE WHEN top100 THEN 'top100' ELSE 'rest' END AS section, count(*) AS companies FROM r GROUP BY 1, 2""")
def partition_routes(spark, sf_dir):
    section = F.when(F.col("top100"), F.lit("top100")).otherwise(F.lit("rest"))
    routed = reports.route(_named(spark, sf_dir)).withColumn("section", section)
    return routed.groupBy("route", "section").agg(F.count("*").alias("companies"))


@query("state_merge", S.ctes(S.P, S.D, S.N, S.W, _LIVE) + f"""
SELECT fp, {SQL_TS.format('emitted_at')} AS emitted_at FROM lv
UNION ALL SELECT DISTINCT fp, '{_NOW}' FROM b WHERE fp NOT IN (SELECT fp FROM lv)""")
def state_merge(spark, sf_dir):
    state, batch = _split(spark, sf_dir)
    _, merged = dedup.dedup_run(batch.drop("fp"), state, _NOW_AT, ["company", "seq"])
    return merged.select("fp", text_ts("emitted_at").alias("emitted_at"))


# === state ==================================================================

@query("seen_dedup_batch", S.ctes(S.P, S.D, S.N, S.W, _LIVE) + """
SELECT fp, seq, company, title, location FROM b WHERE fp NOT IN (SELECT fp FROM lv)
QUALIFY row_number() OVER (PARTITION BY fp ORDER BY company, seq) = 1""")
def seen_dedup_batch(spark, sf_dir):
    state, batch = _split(spark, sf_dir)
    fresh, _ = dedup.dedup_run(batch.drop("fp"), state, _NOW_AT, ["company", "seq"])
    return fresh.select("fp", "seq", "company", "title", "location")


_HISTORY = f"SELECT fp, {SQL_TS.format('run_ts')} AS run, seq FROM h"


@query("seen_dedup_history", S.history() + _HISTORY)
def seen_dedup_history(spark, sf_dir):
    emitted = dedup.dedup_history(_wanted(spark, sf_dir), "run_ts", ["company", "seq"])
    return emitted.select("fp", text_ts("run_ts").alias("run"), "seq")


@query("seen_dedup_stream", S.history() + "SELECT fp, strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run, seq, title, company, location, category FROM h")
def seen_dedup_stream(spark, sf_dir):
    """The replay as a file stream that lands in three parts; whole postings come out."""
    path = scratch_path(spark, "seen-stream")
    events = X.table(spark, sf_dir, "events")
    for part in range(3):
        day = F.dayofmonth("ts")
        events.filter(F.least(X.div(day - 1, 10), F.lit(2)) == part).write.mode("append").parquet(f"{path}/in")
        landed = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        rows = X.postings_of(landed).select("seq", "run_ts", "company", "title", "location")
        postings = posting_filter(build_posting(rows, X.companies(spark, sf_dir)))
        seen_stream.run_available(seen_stream.dedup_stream(postings, "run_ts", "seq"), f"{path}/out", f"{path}/checkpoint")
    out = spark.read.parquet(f"{path}/out")
    return out.select("fp", text_ts(F.timestamp_micros("run_us")).alias("run"), "seq", "title", "company", "location", "category")


@query("run_window", S.ctes(S.P) + f"""
SELECT {SQL_TS.format('run_ts')} AS run, CASE WHEN hour(run_ts) < 12 THEN 'Morning (9 AM)' ELSE 'Evening (6 PM)' END AS label, count(*) AS n
FROM p GROUP BY run_ts""")
def run_window(spark, sf_dir):
    runs_ = X.postings(spark, sf_dir).groupBy("run_ts").agg(F.count("*").alias("n"))
    return runs_.select(text_ts("run_ts").alias("run"), dedup.run_label("run_ts").alias("label"), "n")


# === sinks ==================================================================

_RUN_CHUNKS = f"""k AS (
  SELECT *, row_number() OVER (PARTITION BY run_ts ORDER BY {S.level_rank('level')}, company, seq) - 1 AS rn,
         count(*) OVER (PARTITION BY run_ts) AS n_all FROM h),
ch AS (SELECT *, rn // 50 AS chunk_no, (n_all + 49) // 50 AS n_chunks FROM k)"""
_SECTION = f"""hx AS (SELECT *, {_HTML_SQL} AS frag, {S.category_icon('category')} AS icon, {_esc('category')} AS cat FROM ch),
sec AS (
  SELECT run_ts, chunk_no, category, min(rn) AS first_rn,
         '<h3>' || icon || ' ' || cat || ' (' || count(*) || ' jobs)</h3>' || string_agg(frag, '' ORDER BY rn) AS section
  FROM hx GROUP BY run_ts, chunk_no, category, icon, cat),
sx AS (SELECT run_ts, chunk_no, string_agg(section, '' ORDER BY first_rn) AS html FROM sec GROUP BY run_ts, chunk_no),
sk AS (SELECT run_ts, chunk_no, n_chunks, {_STATS} FROM ch GROUP BY run_ts, chunk_no, n_chunks)"""
_DIGEST_SQL = f"""SELECT {SQL_TS.format('run_ts')} AS run, chunk_no, n_chunks,
  CASE WHEN hour(run_ts) < 12 THEN 'Morning (9 AM)' ELSE 'Evening (6 PM)' END
    || CASE WHEN n_chunks > 1 THEN ' (' || (chunk_no + 1) || '/' || n_chunks || ')' ELSE '' END
    || ': ' || total || ' new postings, ' || strftime(run_ts, '%b %d, %Y') AS subject,
  total, senior, mid, entry,
  '<div><h1>New data engineering postings</h1><p>' || total || ' postings not seen before, from a watch list of {MONITORED}</p><p>Total '
    || total || ' · Senior ' || senior || ' · Mid-Level ' || mid || ' · Entry Level ' || entry || '</p>' || html || '</div>' AS html
FROM sk JOIN sx USING (run_ts, chunk_no)
UNION ALL SELECT {SQL_TS.format('run_ts')}, 0, 0,
  CASE WHEN hour(run_ts) < 12 THEN 'Morning (9 AM)' ELSE 'Evening (6 PM)' END || ': nothing new, ' || strftime(run_ts, '%b %d, %Y'), 0, 0, 0, 0,
  '<div><h1>No new postings</h1><p>Nothing changed at the {MONITORED} on the watch list.</p></div>'
FROM (SELECT DISTINCT run_ts FROM p) WHERE run_ts NOT IN (SELECT run_ts FROM ch)"""


def _history_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.postings(spark, sf_dir).select("seq", "run_ts", "company", "title", "location", K.extract_skills("snippet").alias("skills"))
    return runs.history(rows, X.companies(spark, sf_dir), "run_ts", "seq")


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.postings(spark, sf_dir).select("seq", "run_ts", "company", "title", "location", K.extract_skills("snippet").alias("skills"))
    return runs.history_digests(rows, X.companies(spark, sf_dir), "run_ts", "seq", MONITORED)


@query("sink_digest", S.history(_RUN_CHUNKS, _SECTION) + _DIGEST_SQL)
def sink_digest(spark, sf_dir):
    """Digests of every run, written and read back."""
    path = scratch_path(spark, "digest")
    digest.write_digest(_digests(spark, sf_dir), path)
    return spark.read.parquet(path).withColumn("run", text_ts("run_ts")).drop("run_ts")


@query("sink_broad_report", S.ctes(S.P, S.D, S.N, _BROAD) + "SELECT company, n, n > 0 AS working FROM bc")
def sink_broad_report(spark, sf_dir):
    path = scratch_path(spark, "broad")
    counts, _ = runs.broad_run(_normal(spark, sf_dir), X.companies(spark, sf_dir))
    reports.write_report(counts.withColumn("working", F.col("n") > 0), path)
    return spark.read.parquet(path)


@query("sink_seen_state", S.ctes(S.P, S.D, S.N, S.W, _LIVE) + f"""
SELECT fp, {SQL_TS.format('emitted_at')} AS emitted_at FROM lv
UNION ALL SELECT DISTINCT fp, '{_NOW}' FROM b WHERE fp NOT IN (SELECT fp FROM lv)""")
def sink_seen_state(spark, sf_dir):
    """The state before a run and after it, both written; the later one is read."""
    path = scratch_path(spark, "state")
    state, batch = _split(spark, sf_dir)
    dedup.write_state(state, path, datetime.fromisoformat(_SPLIT))
    _, merged = dedup.dedup_run(batch.drop("fp"), dedup.read_state(spark, path), _NOW_AT, ["company", "seq"])
    dedup.write_state(merged, path, _NOW_AT)
    return dedup.read_state(spark, path).select("fp", text_ts("emitted_at").alias("emitted_at"))


@query("clear_state", S.ctes(S.P, S.D, S.N, S.W, _LIVE) + "SELECT 'before' AS moment, count(*) AS n FROM st UNION ALL SELECT 'after', 0")
def clear_state(spark, sf_dir):
    path = scratch_path(spark, "state")
    state, _ = _split(spark, sf_dir)
    dedup.write_state(state, path, datetime.fromisoformat(_SPLIT))
    before = dedup.read_state(spark, path)
    dedup.clear_state(spark, path, _NOW_AT)
    count = lambda df, moment: df.agg(F.count("*").alias("n")).select(F.lit(moment).alias("moment"), "n")
    return count(before, "before").unionByName(count(dedup.read_state(spark, path), "after"))


@query("src_company_dim", S.ctes(S.D) + """
SELECT id, name, CASE WHEN id % 3 = 0 THEN 'custom' ELSE scraper END AS scraper, CASE WHEN id % 5 = 0 THEN '' ELSE salary_range END AS salary_range,
       id % 3 = 0 AND id % 7 <> 0 AS top100, array_to_string(CASE WHEN id % 4 = 1 THEN [] ELSE stack END, ',') AS stack, 0 AS n_titles FROM d""")
def src_company_dim(spark, sf_dir):
    """Companies as a user's file has them, optional fields left out here and there."""
    i = F.col("id")
    raw = X.companies(spark, sf_dir).select(
        "id", "name", "careers_url", "category", F.when(i % 3 != 0, F.col("scraper")).alias("scraper"),
        F.when(i % 5 != 0, F.col("salary_range")).alias("salary_range"), F.when(i % 7 != 0, F.col("top100")).alias("top100"),
        F.lit(None).cast("array<string>").alias("titles"), F.when(i % 4 != 1, F.col("stack")).alias("stack"),
        F.lit(None).cast("array<string>").alias("locations"),
    )
    dim = with_defaults(raw)
    return dim.select("id", "name", "scraper", "salary_range", "top100", F.concat_ws(",", "stack").alias("stack"), F.size("titles").cast("long").alias("n_titles"))


@query("sink_audit_report", _AUDIT_CTES + _ROLLUP)
def sink_audit_report(spark, sf_dir):
    path = scratch_path(spark, "audit")
    reports.write_report(reports.audit_rollup(reports.audit_status(_outcomes(spark, sf_dir))), path)
    return spark.read.parquet(path)


# === flagship ===============================================================

@query("alert_history", S.history(_RUN_CHUNKS) + f"""
SELECT {SQL_TS.format('run_ts')} AS run, chunk_no, {_STATS} FROM ch GROUP BY run_ts, chunk_no""")
def alert_history(spark, sf_dir):
    """The whole pipeline over all runs: normalise, filter, deduplicate,
    order by level, chunk, count."""
    stats = digest.digest_stats(_history_chunks(spark, sf_dir), ["run_ts", "chunk_no"])
    return stats.withColumn("run", text_ts("run_ts")).drop("run_ts")
