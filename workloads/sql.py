"""ANSI-SQL twins of the derivation and of the operators, for DuckDB.

The rules are written out separately here (substring tests instead of regular
expressions, CASE instead of chained columns); only the fixed word lists are
shared.
"""

from __future__ import annotations

from hiretide import vocab as V
from hiretide.functions.text import WHITESPACE
from workloads.fixed import CATEGORIES, LOCATIONS, PAGE_ROWS, SNIPPETS, STACKS, TITLES, TYPES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def pick(values: list[str], index: str) -> str:
    return f"list_extract({arr(values)}, CAST({index} AS INTEGER) + 1)"


WS = lit(WHITESPACE)

P = f"""p AS (
  SELECT event_id AS seq, {pick(TITLES, 'event_id % 40')} AS title,
         {pick(LOCATIONS, '(event_id // 7) % 32')} AS location,
         'Company ' || user_id AS company, user_id AS cid,
         {pick(CATEGORIES, 'user_id % 16')} AS category,
         {pick(SNIPPETS, 'event_id % 12')} AS snippet, ts,
         time_bucket(INTERVAL '12 hours', ts) AS run_ts, event_id // {PAGE_ROWS} AS page_no
  FROM events)"""

D = f"""d AS (
  SELECT c_custkey AS id, 'Company ' || c_custkey AS name,
         CASE WHEN c_custkey % 4 <> 3 THEN 'https://t' || c_custkey || '.wd' || (c_custkey % 12 + 1)
                || '.myworkdayjobs.com/Board' || c_custkey || '?q=data+engineer&locationCountry=c' || c_custkey
              ELSE 'https://careers' || c_custkey || '.example.com/search?keywords=data+engineer&location=Canada' END AS careers_url,
         {pick(CATEGORIES, 'c_custkey % 16')} AS category, {pick(TYPES, 'c_custkey % 9')} AS scraper,
         '$' || (c_custkey % 60 + 70) || 'K-$' || (c_custkey % 90 + 110) || 'K' AS salary_range,
         c_custkey % 3 = 0 AS top100,
         CASE c_custkey % 4 WHEN 0 THEN {arr(STACKS[0])} WHEN 1 THEN {arr(STACKS[1])}
              WHEN 2 THEN {arr(STACKS[2])} ELSE [] END AS stack
  FROM customer)"""

C = """c AS (
  SELECT 'Company ' || c_custkey AS company, 's-' || c_custkey AS slug, 'CX_' || c_custkey AS site,
         'https://jobs' || c_custkey || '.example.com/job/{jobSeqNo}/{slug}' AS url_template
  FROM customer WHERE c_custkey % 10 <> 7)"""


def has(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {lit(t)})" for t in terms) + ")"


def is_canada(col: str) -> str:
    return f"coalesce({has(col, V.CANADA_TERMS)}, false)"


def is_us_or_canada(col: str) -> str:
    return f"coalesce({has(col, V.CANADA_TERMS)} OR {has(col, V.US_TERMS)}, false)"


def is_data_role(col: str) -> str:
    # word boundaries spelled out: \b is ASCII-only here
    words = "|".join(V.ROLE_REJECT_WORDS)
    return (
        f"(NOT {has(col, V.ROLE_REJECT_SUBSTRINGS)}"
        f" AND NOT regexp_matches(lower({col}), '(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])')"
        f" AND NOT {has(col, V.ROLE_REJECT_PHRASES)}"
        f" AND NOT (contains(lower({col}), 'data analyst') AND NOT contains(lower({col}), 'analytics engineer'))"
        f" AND {has(col, V.ROLE_ACCEPT)})"
    )


def detect_level(col: str) -> str:
    whens = " ".join(f"WHEN {has(col, terms)} THEN {lit(level)}" for level, terms in V.LEVEL_TERMS)
    return f"CASE {whens} ELSE 'Mid-Level' END"


def extract_skills(col: str) -> str:
    """List of the skills named in the text."""
    found = ", ".join(f"CASE WHEN contains(lower({col}), {lit(s.lower())}) THEN {lit(s)} END" for s in V.SKILLS)
    return f"list_filter([{found}], lambda x: x IS NOT NULL)"


def level_rank(col: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in V.LEVEL_ORDER.items())
    return f"CASE {col} {whens} ELSE 3 END"


def level_badge(col: str) -> str:
    return (
        f"CASE WHEN contains(lower({col}), 'staff') OR contains(lower({col}), 'lead') THEN 'Staff / Lead'"
        f" WHEN contains(lower({col}), 'senior') THEN 'Senior'"
        f" WHEN contains(lower({col}), 'entry') THEN 'Entry Level' ELSE 'Mid-Level' END"
    )


def category_icon(col: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.CATEGORY_ICONS.items())
    return f"CASE {col} {whens} ELSE {lit(V.CATEGORY_ICON_DEFAULT)} END"


def fingerprint(company: str, title: str, location: str) -> str:
    return f"md5(lower({company}) || '__' || lower({title}) || '__' || lower({location}))"


def strip(col: str) -> str:
    return f"trim({col}, {WS})"


def slugify(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '[^a-z0-9]+', '-', 'g'), '-')"


def norm(x: str = "x", where: str = "true", extra: str = "") -> str:
    """Normalised postings of CTE ``x(company, title, location, url, posted, skills)``."""
    return f"""SELECT {strip(x + '.title')} AS title, {x}.company AS company, d.category AS category,
         coalesce(nullif({strip(f"coalesce({x}.location, '')")}, ''), 'Canada') AS location,
         {detect_level(x + '.title')} AS level, 'Full-time' AS type,
         coalesce({x}.posted, 'Recent') AS posted, coalesce({x}.url, '') AS url,
         array_to_string(CASE WHEN len({x}.skills) > 0 THEN {x}.skills ELSE d.stack END, ',') AS skills,
         d.salary_range AS salary{extra}
  FROM {x} JOIN d ON d.name = {x}.company WHERE {where}"""


def rows(
    title: str = "title", location: str = "location", url: str = "NULL", posted: str = "NULL",
    skills: str = "NULL", source: str = "p", where: str = "true", extra: str = "",
) -> str:
    return (
        f"x AS (SELECT {source}.company, {title} AS title, {location} AS location, CAST({url} AS VARCHAR) AS url,"
        f" CAST({posted} AS VARCHAR) AS posted, CAST({skills} AS VARCHAR[]) AS skills{extra} FROM {source} WHERE {where})"
    )


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# Postings normalised from the plain derivation, all rows.
N = f"""n AS (
  SELECT p.seq, p.run_ts, {strip('p.title')} AS title, p.company, d.category,
         coalesce(nullif({strip('p.location')}, ''), 'Canada') AS location, {detect_level('p.title')} AS level,
         'Full-time' AS type, 'Recent' AS posted, '' AS url,
         CASE WHEN len(sk) > 0 THEN sk ELSE d.stack END AS skills, d.salary_range AS salary
  FROM (SELECT *, {extract_skills('snippet')} AS sk FROM p) p JOIN d ON d.name = p.company)"""
# .. that pass the role and geography filter, with fingerprint.
W = f"""w AS (
  SELECT *, {fingerprint('company', 'title', 'location')} AS fp FROM n
  WHERE {is_canada('location')} AND {is_data_role('title')})"""
# Replay of all runs: greedy 14-day emission per fingerprint.
EMIT = """s AS (
  SELECT fp, run_ts, min(struct_pack(c := company, q := seq)).q AS seq FROM w GROUP BY fp, run_ts),
e AS (
  SELECT fp, min(run_ts) AS run_ts FROM s GROUP BY fp
  UNION ALL
  SELECT e.fp, min(s.run_ts) FROM e JOIN s ON s.fp = e.fp AND s.run_ts >= e.run_ts + INTERVAL 14 DAY GROUP BY e.fp),
h AS (SELECT w.* FROM e JOIN s USING (fp, run_ts) JOIN w USING (fp, run_ts, seq))"""


def history(*more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([P, D, N, W, EMIT, *more]) + "\n"
