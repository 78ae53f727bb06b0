"""Postings from saved rendered pages: links, cards, table rows.

Input is ``(company, page_id, url, html)`` plus the site's rules.  Each page is
resolved inside its row (arrays and higher-order functions); rows appear only
for the links that survive cap and duplicate removal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide.functions.classify import Rules
from hiretide.functions.entities import unescape
from hiretide.functions.text import first_non_empty, let, resolve_href, strip, tag_text, text_or_blank
from hiretide.functions.urls import title_from_url
from hiretide.operators.normalize import build_posting, unfinished
from hiretide.schemas import POSTING_COLUMNS
from hiretide.sources.embedded import first_by
from hiretide.sources.selectors import (
    BLOCK_MARKS, CARDS, JOB_CODE, LINKS, NJOYN, CardRules, LinkRules, anchor_only, own_tag_regexes, selectors_of,
)
from hiretide.sources.tokeniser import with_elements

PAGE_LINEAGE = ["page_id", "pos"]


def blocked(site: str, head: int | None = None) -> Column:
    """Pages served by a bot wall instead of the site, by the site's own marks.

    ``head`` looks at the first characters of the page only (customary for
    infosys: 500).
    """
    marks = BLOCK_MARKS.get(site, {})
    html = F.col("html") if head is None else F.left(F.col("html"), F.lit(head))
    tests = [F.col("url").contains(m) for m in marks.get("url", ())] + [html.contains(m) for m in marks.get("html", ())]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def drop_blocked_pages(pages: DataFrame, site: str, head: int | None = None) -> DataFrame:
    return pages.filter(~blocked(site, head)) if site in BLOCK_MARKS else pages


# --- elements ---------------------------------------------------------------

def native_links(html: Column) -> Column:
    """Links of a page without leaving the JVM: array<struct<own,href,text>>.

    Enough for rules that only look at the link's own tag.
    """
    shown = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    anchor = r"(?is)<a(\s[^>]*)>(.*?)</a\s*>"
    found = F.arrays_zip(
        F.regexp_extract_all(shown, F.lit(anchor), F.lit(1)).alias("attrs"),
        F.regexp_extract_all(shown, F.lit(anchor), F.lit(2)).alias("inner"),
    )

    def link(a: Column) -> Column:
        attrs = F.regexp_replace(F.regexp_replace(a["attrs"], r"\s+", " "), r"=\s?'([^'\"]*)'", '="$1"')
        return F.struct(
            F.concat(F.lit("<a"), attrs, F.lit(">")).alias("own"),
            unescape(F.regexp_extract(attrs, r'(?i)\shref="([^"]*)"', 1)).alias("href"),
            tag_text(a["inner"]).alias("text"),
        )

    return F.transform(found, link)


Known = dict[str, int]  # numbers of the selectors; none of them on the native way


def _below_selectors(rules: LinkRules | CardRules) -> tuple[str, ...]:
    """The selectors that are looked for below other elements."""
    if isinstance(rules, LinkRules):
        return (*rules.title_selectors, *rules.place_selectors)
    return (*rules.titles, *rules.places, *rules.posted, "a")


def _numbers(*rules: LinkRules | CardRules | None) -> tuple[Known, int]:
    """Numbers of all selectors, and how many of them, the first ones, are looked for below other elements."""
    below = dict.fromkeys(s for r in rules if r for s in _below_selectors(r))
    every = dict.fromkeys([*below, *(s for r in rules if r for s in selectors_of(r))])
    return {s: i for i, s in enumerate(every)}, len(below)


def _text(e: Column, native: bool) -> Column:
    if native:
        return e["text"]
    # both are pieces of the one page text, its white space collapsed already
    inside = F.trim(F.substring(F.col("page_text"), e["t0"] + 1, e["t1"] - e["t0"]))
    return F.when(e["text"].isNotNull(), e["text"]).when(e["t0"].isNotNull(), inside)


def _matching(els: Column, selector: str, known: Known | None) -> Column:
    if known is not None:
        return F.filter(els, lambda e: F.array_contains(e["hits"], known[selector]))
    tests = own_tag_regexes(selector)
    return F.filter(els, lambda e: reduce(lambda a, b: a | b, [e["own"].rlike(t) for t in tests]))


def _below(e: Column) -> Column:
    """All descendants; elements are in document order, so they are adjacent."""
    return F.slice(F.col("els"), e["at"] + 2, e["n_below"])


def choose_pattern(els: Column, patterns: tuple[str, ...], hits: int, otherwise: str | None, known: Known | None, keep_last: bool = False) -> Column:
    """Matches of the first pattern with enough of them, else the fallback's."""
    options = []
    for p in patterns:
        options.append(let(_matching(els, p, known), lambda found: F.when(F.size(found) >= hits, found)))
    if keep_last:
        options.append(_matching(els, patterns[-1], known))
    elif otherwise:
        options.append(_matching(els, otherwise, known))
    return F.coalesce(*options, F.filter(els, lambda e: F.lit(False)))


def _firsts(e: Column, selectors: tuple[str, ...], known: Known) -> Column:
    """First match of each selector below an element, in order; null where there is none."""
    places = F.array(*[F.lit(known[s]) for s in selectors])
    return let(e["first"], lambda first: F.transform(places, lambda s: F.get(F.col("els"), F.get(first, s))))


def _first_filled(texts: Column) -> Column:
    """First text that is not blank, else ''; each is worked out once."""
    return text_or_blank(F.get(F.filter(texts, lambda t: t != ""), F.lit(0)))


def _first_text(e: Column, selectors: tuple[str, ...], known: Known) -> Column:
    """First non-blank text below an element, selectors in order, first match of each; else ''."""
    return _first_filled(F.transform(_firsts(e, selectors, known), lambda found: _text(found, False)))


def _ancestor(e: Column, levels: int) -> Column:
    for _ in range(levels):
        e = F.get(F.col("els"), e["parent"])  # none above the outermost, whose parent is -1
    return e


# --- links ------------------------------------------------------------------

def link_records(els: Column, rules: LinkRules, match: Rules, known: Known | None, site_limits: bool = False) -> Column:
    """array<struct<title,url,location,posted>> of one page's links."""
    base, native = F.col("url"), known is None

    def title_of(e: Column) -> Column:
        title = _text(e, native)
        if rules.title_selectors:
            title = _first_filled(F.array(_first_text(e, rules.title_selectors, known), title))
        if rules.title_else == "parent":
            title = first_non_empty(title, let(_ancestor(e, 1), lambda up: _text(up, False)))
        return title

    def place_of(e: Column) -> Column:
        places = [
            let(_ancestor(e, level), lambda up: _first_text(up, rules.place_selectors, known))
            for level in rules.place_levels
        ]
        return _first_filled(F.array(*places)) if places else F.lit("")

    def record(e: Column) -> Column:
        return F.struct(
            title_of(e).alias("title"), resolve_href(base, text_or_blank(e["href"])).alias("url"),
            place_of(e).alias("location"), F.lit(None).cast("string").alias("posted"),
        )

    chosen = choose_pattern(els, rules.patterns, rules.hits, rules.otherwise, known)
    records = F.transform(F.slice(chosen, 1, rules.cap) if site_limits else chosen, record)
    if rules.title_else in ("details", "ey"):
        records = F.transform(
            records,
            lambda r: r.withField("title", first_non_empty(r["title"], title_from_url(r["url"], rules.title_else))),
        )

    def titled(r: Column) -> Column:
        ok = F.length(r["title"]) >= (rules.min_title if site_limits else 1)
        if rules.skip_titles:
            ok = ok & ~F.lower(r["title"]).isin(list(rules.skip_titles))
        return ok

    if rules.need_url:
        records = F.filter(records, lambda r: r["url"] != "")
    if rules.distinct and rules.distinct_before_title:
        records = F.filter(first_by(records, "url"), titled)
    elif rules.distinct:
        records = first_by(F.filter(records, titled), "url")
    else:
        records = F.filter(records, titled)
    records = F.filter(records, lambda r: match.is_role(r["title"]))
    if rules.place_must_match:
        records = F.filter(records, lambda r: (r["location"] == "") | match.is_geo(r["location"]))
    return records


def _produce(pages: DataFrame, records: Column, default: Column) -> DataFrame:
    """A row per record.

    The generator takes the records as they are: from a column of them a filter on its size
    would be inferred, work them out once more and move ahead of the joins below.
    """
    keys = [c for c in pages.columns if c not in ("els", "page_text", "url", "html", "cards")]
    return (
        pages.select(*keys, F.posexplode(records).alias("pos", "r"))
        .select(
            *keys, "pos", F.col("r")["title"].alias("title"), F.col("r")["url"].alias("url"),
            first_non_empty(F.col("r")["location"], default).alias("location"), F.col("r")["posted"].alias("posted"),
        )
    )


def link_rows(
    pages: DataFrame, rules: LinkRules, match: Rules = Rules(), default: Column | None = None,
    native: bool | None = None, site_limits: bool = False,
) -> DataFrame:
    """(.., pos, title, url, location, posted) of every page's posting links.

    ``site_limits`` applies the site's customary cap and least title length.
    """
    default = F.lit(rules.location) if default is None else default
    native = anchor_only(rules) if native is None else native
    if native:
        records = let(native_links(F.col("html")), lambda els: link_records(els, rules, match, None, site_limits))
        return _produce(pages, records, default)
    tree = bool(rules.title_selectors or rules.place_levels or rules.title_else == "parent")
    known, below = _numbers(rules)
    parsed = with_elements(pages, "html", list(known), tree, below)
    return _produce(parsed, link_records(F.col("els"), rules, match, known, site_limits), default)


# --- cards ------------------------------------------------------------------

def card_records(rules: CardRules, match: Rules, known: Known, site_limits: bool = False) -> Column:
    """array<struct<title,url,location,posted>> of one page's cards."""
    base = F.col("url")

    n_titles, n_places = len(rules.titles), len(rules.places)

    def shown(e: Column) -> Column:
        return F.struct(
            e.isNotNull().alias("found"), text_or_blank(_text(e, False)).alias("text"),
            resolve_href(base, text_or_blank(e["href"])).alias("url"),
        )

    # each card: first match per title selector, place selector, posted
    # selector, then its first link, then the card itself
    asked = (*rules.titles, *rules.places, *rules.posted, "a")

    def look(card: Column) -> Column:
        return F.transform(F.concat(_firsts(card, asked, known), F.array(card)), shown)

    def record(found: Column) -> Column:
        titles = F.slice(found, 1, n_titles)
        places = F.slice(found, n_titles + 1, n_places)
        dated = F.slice(found, n_titles + n_places + 1, len(rules.posted))
        anchor, card = F.get(found, F.lit(len(asked) - 1)), F.get(found, F.lit(len(asked)))
        # "first found" takes a matching element even when its text is blank
        usable = F.filter(titles, lambda t: t["found"] if rules.first_found else t["text"] != "")
        if rules.card_text_title:
            link = card if rules.first_found else anchor
            usable = F.concat(usable, F.array(card.withField("url", link["url"])))
        pick = F.get(usable, F.lit(0))
        written = F.filter(places, lambda t: t["text"] != "")
        posted = F.filter(dated, lambda t: t["text"] != "")
        return F.struct(
            text_or_blank(pick["text"]).alias("title"),
            text_or_blank((anchor if rules.url_from_card else pick)["url"]).alias("url"),
            text_or_blank(F.get(written, F.lit(0))["text"]).alias("location"),
            F.get(posted, F.lit(0))["text"].alias("posted"),
            F.exists(places, lambda t: t["found"]).alias("placed"),
        )

    cards = F.slice(F.col("cards"), 1, rules.cap) if site_limits else F.col("cards")
    records = F.transform(F.transform(cards, look), record)
    records = F.filter(records, lambda r: F.length(r["title"]) >= (rules.min_title if site_limits else 1))
    if rules.place_required:
        records = F.filter(records, lambda r: r["placed"])
    if rules.role:
        records = F.filter(records, lambda r: match.is_role(r["title"]))
    if rules.distinct_url:
        records = first_by(records, "url")
    if rules.geo:
        records = F.filter(records, lambda r: (r["location"] == "") | match.is_geo(r["location"]))
    host = F.lit(rules.host)
    return F.transform(
        records,
        lambda r: F.struct(
            r["title"].alias("title"),
            F.when((r["url"] != "") & ~r["url"].startswith("http"), F.concat(host, r["url"])).otherwise(r["url"]).alias("url"),
            first_non_empty(r["location"], F.lit(rules.location)).alias("location"),
            r["posted"].alias("posted"),
        ),
    )


def card_rows(
    pages: DataFrame, rules: CardRules, match: Rules = Rules(), links: LinkRules | None = None, site_limits: bool = False
) -> DataFrame:
    """Posting rows from repeated blocks; pages without blocks use ``links``."""
    known, below = _numbers(rules, links)
    parsed = with_elements(pages, "html", list(known), True, below)
    parsed = parsed.withColumn(
        "cards", choose_pattern(F.col("els"), rules.cards, rules.hits, None, known, rules.keep_last)
    )
    records = card_records(rules, match, known, site_limits)
    if links is not None:
        other = F.transform(
            link_records(F.col("els"), links, match, known, site_limits),
            lambda r: F.struct(
                r["title"].alias("title"), r["url"].alias("url"),
                first_non_empty(r["location"], F.lit(links.location)).alias("location"), r["posted"].alias("posted"),
            ),
        )
        records = F.when(F.size("cards") > 0, records).otherwise(other)
    return _produce(parsed, records, F.lit(""))


# Sites whose cards fall back to their links.
CARD_FALLBACK = {"workday_cards": "workday_links", "ibm_cards": "ibm_links",
                 "google_cards": "google_links", "apple_cards": "apple_links"}

# --- table rows -------------------------------------------------------------

def table_records(match: Rules, known: Known, site_limits: bool = False) -> Column:
    """Title and place from the cells of the row a link stands in."""
    base = F.col("url")

    def cell_texts(row: Column) -> Column:
        cells = F.filter(_below(row), lambda c: c["tag"] == "td")
        return F.transform(cells, lambda c: _text(c, False))

    def look(e: Column) -> Column:
        return F.struct(
            e.alias("link"), let(_ancestor(e, 2), cell_texts).alias("cells"),
            resolve_href(base, text_or_blank(e["href"])).alias("url"),
        )

    def row_text(e: Column) -> Column:
        around = [let(_ancestor(e, k), lambda a: _text(a, False)) for k in (3, 2, 1)]
        return strip(F.regexp_replace(first_non_empty(*around, _text(e, False)), JOB_CODE + r"\s*", ""))

    def record(x: Column) -> Column:
        cells, n = x["cells"], F.coalesce(F.size(x["cells"]), F.lit(0))
        named = F.filter(cells, lambda t, i: (i > 0) & (t != "") & ~t.rlike(JOB_CODE))
        place = F.when(
            n >= 5, F.concat(F.get(cells, F.lit(3)), F.lit(" "), F.get(cells, F.lit(4)))
        ).when(n == 4, F.get(cells, F.lit(3)))
        return F.struct(
            # the row's whole text is only read when no cell gives a title
            F.coalesce(F.get(named, F.lit(0)), row_text(x["link"])).alias("title"),
            x["url"].alias("url"),
            strip(text_or_blank(place)).alias("location"),
            F.lit(None).cast("string").alias("posted"),
        )

    chosen = choose_pattern(F.col("els"), NJOYN.patterns, NJOYN.hits, NJOYN.otherwise, known)
    records = F.transform(F.transform(F.slice(chosen, 1, NJOYN.cap) if site_limits else chosen, look), record)
    records = F.filter(records, lambda r: r["url"] != "")
    return F.filter(
        first_by(records, "url"),
        lambda r: (r["title"] != "") & match.is_role(r["title"])
        & ((r["location"] == "") | (r["location"] == "Canada") | match.is_geo(r["location"])),
    )


def table_rows(pages: DataFrame, match: Rules = Rules(), site_limits: bool = False) -> DataFrame:
    known, _ = _numbers(NJOYN)
    parsed = with_elements(pages, "html", list(known), True)
    return _produce(parsed, table_records(match, known, site_limits), F.lit("Canada"))


# --- postings ---------------------------------------------------------------

def to_postings(rows: DataFrame, dim: DataFrame | None) -> DataFrame:
    """Postings, or without a dimension the ``unfinished`` rows."""
    if dim is None:
        return unfinished(rows, PAGE_LINEAGE)
    return build_posting(rows, dim).select(*POSTING_COLUMNS, *PAGE_LINEAGE)


def extract(
    pages: DataFrame, site: str, dim: DataFrame | None, match: Rules = Rules(), default: Column | None = None, site_limits: bool = False
) -> DataFrame:
    """Postings of one site's saved pages; bot-wall pages contribute nothing."""
    pages = drop_blocked_pages(pages, site)
    if site == "njoyn":
        rows = table_rows(pages, match, site_limits)
    elif site in CARDS:
        rows = card_rows(pages, CARDS[site], match, LINKS.get(CARD_FALLBACK.get(site, "")), site_limits)
    else:
        rows = link_rows(pages, LINKS[site], match, default, site_limits=site_limits)
    return to_postings(rows, dim)
