"""Which elements of a saved page are postings, per site.

The selector strings, caps and default locations are fixed values; results
depend on them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from hiretide.functions.text import quote_regex


@dataclass(frozen=True)
class LinkRules:
    """How one site's links become postings.

    Patterns are tried in order; the first with at least ``hits`` matches is
    used, else ``otherwise`` (if any).  ``cap`` (links looked at, before blank
    links, repeated urls and role) and ``min_title`` are a site's customary
    limits; they apply only when a caller asks for them.
    """

    patterns: tuple[str, ...]
    hits: int
    otherwise: str | None
    cap: int
    location: str = "Canada"
    distinct: bool = True
    distinct_before_title: bool = False
    need_url: bool = True
    min_title: int = 1
    skip_titles: tuple[str, ...] = ()
    title_selectors: tuple[str, ...] = ()
    title_else: str = ""  # "parent", "details", "ey"
    place_levels: tuple[int, ...] = ()
    place_selectors: tuple[str, ...] = ()
    place_must_match: bool = False


@dataclass(frozen=True)
class CardRules:
    """How one site's repeated blocks become postings; limits as for links."""

    cards: tuple[str, ...]
    hits: int
    cap: int
    titles: tuple[str, ...]
    places: tuple[str, ...]
    posted: tuple[str, ...] = ()
    location: str = ""
    url_from_card: bool = False
    card_text_title: bool = False
    first_found: bool = False
    min_title: int = 1
    distinct_url: bool = False
    host: str = ""
    keep_last: bool = False
    role: bool = True
    geo: bool = False
    place_required: bool = False


# --- fixed values: link rules per site --------------------------------------
LINKS = {
    "workday_links": LinkRules(
        ("a[data-automation-id='jobTitle'], a[href*='/job/'], a[href*='myworkdayjobs']",), 1, None, 60),
    "ibm_links": LinkRules(
        ("a[href*='/careers/JobDetail'], a[href*='/en_US/careers/'], a[href*='jobId']",), 1, None, 30,
        distinct=False, need_url=False, min_title=6),
    "google_links": LinkRules(("a[href*='/jobs/results/']",), 1, None, 30, distinct=False, need_url=False),
    "microsoft": LinkRules(
        ("a[href*='/global/en/job/']", "[class*='jobCard'] a", "[class*='job-card'] a", "a[href*='/en/job/']"),
        2, "a[href*='/en/job/']", 30, distinct_before_title=True,
        title_selectors=("[class*='jobTitle']", "[class*='job-title']", "h2", "h3", "[class*='title']"),
        place_levels=(1, 2, 3, 4),
        place_selectors=("[class*='jobLocation']", "[class*='location']", "[class*='Location']", "span[class*='loc']"),
        place_must_match=True),
    "meta_links": LinkRules(
        ("a[href*='/profile/job_details/']",), 1, None, 60, distinct_before_title=True, title_else="parent"),
    "apple_links": LinkRules(
        ("a[href*='/details/']",), 1, None, 50, distinct_before_title=True, title_else="details",
        place_levels=(1,), place_selectors=("span[class*='location'], span[class*='subtitle']",)),
    "j2w": LinkRules(
        ("[class*='jobResultsCard'] a", "[class*='jobResults'] a[href*='/job/']", ".jobResultsCardHeader a",
         ".jobResultsCardBody a", "div[class*='jobResult'] a", "tr.even a.jobTitle, tr.odd a.jobTitle",
         "a.jobTitle", "td.jobTitle a", "a[href*='/job/'][class*='jd']"),
        1, "a[href*='/job/']", 50),
    "ey": LinkRules(("a[href*='/ey/job/']",), 1, None, 60, distinct_before_title=True, title_else="ey"),
    "lululemon": LinkRules(("a[href*='/JobDetail/']",), 1, None, 60),
    "mckinsey": LinkRules(
        ("a[href*='/careers/'][href*='job'], a[href*='mckinsey.com/careers'], [class*='job'] a, [class*='result'] a",),
        1, None, 60),
    "citibank": LinkRules(
        ("a[href*='/job/'], a[href*='jobs.citi.com/job'], [class*='job-title'] a, [class*='jobTitle'] a, h2 a, h3 a",),
        1, None, 60, place_levels=(2,),
        place_selectors=("[class*='location'], [class*='Location'], span:nth-child(2)",), place_must_match=True),
    "scotiabank": LinkRules(("a[href*='/job/']",), 1, None, 80),
    "uber": LinkRules(
        ("a[href*='/careers/list/']", "[data-testid='job-title'] a", "li[class*='job'] a", ".job-title a"),
        2, "a[href*='/careers/']", 50, "Toronto"),
    "intuit": LinkRules(
        (".job-listing-name a", ".job-title-link", "a.job-title", "h3.job-title a", "ul.jobs-list li a",
         ".search-result-jobTitle a", "a[href*='/job/'][href*='intuit']"), 1, "a[href*='/job/']", 50),
    "clio": LinkRules(
        ("a[href*='/clio/']", "[class*='ashby-job'] a", "[class*='posting'] a", "div[class*='job'] a",
         "li a[href*='ashbyhq']"), 2, "a[href*='ashbyhq']", 50),
    "coveo": LinkRules(
        ("li.opening a", ".opening a", "a[href*='/careers/']", "[class*='job'] a", "li a"), 2, None, 80, "Quebec City"),
    "atlassian": LinkRules(
        ("a[href*='/careers/details/']", "[class*='job-listing'] a", "[class*='job-card'] a",
         "[class*='JobResult'] a", "li[class*='job'] a"), 2, "a[href*='/careers/']", 60),
    "dayforce": LinkRules(
        (".job-list-item a", "[class*='job-title'] a", "[class*='JobTitle'] a", "h2 a, h3 a", "a[href*='/jobs/']"),
        2, "a[href*='/jobs/']", 50),
    "ia_financial": LinkRules(
        ("a[href*='/carrieres/job/']", "a[href*='/careers/job/']", "[class*='job'] a", "[class*='posting'] a"),
        2, "a[href*='/job/']", 60),
    "paypal": LinkRules(
        ("[data-ph-id] a", "[class*='job-card'] a", "[class*='position'] a", "a[href*='/careers/job/']",
         "li[class*='job'] a"), 2, "a[href*='eightfold.ai']", 50),
    "oracle_links": LinkRules(
        ("[class*='job-title'] a", "li[class*='job'] a", "a[href*='/job/']", "[class*='requisition'] a"),
        2, "a[href*='careers.oracle.com']", 50),
    "well_health": LinkRules(
        (".job-posting a", "[class*='jobTitle'] a", "[class*='job-title'] a", "a[class*='jobtitle']",
         ".jobDetails a", "a[href*='jobId']"), 2, "a[href*='jobId'], a[href*='recruitment']", 50, "Vancouver"),
    "stantec": LinkRules(
        (".job-title a", "a[href*='/job/']", "[class*='job-listing'] a", "h2 a"), 2, "a[href*='stantec.jobs']", 50),
    "pfizer": LinkRules(
        ("a[href*='/careers/job']", ".job-title a", "[class*='job'] a", "h3 a", "h2 a"), 2, "a[href*='pfizer']", 50),
    "klick": LinkRules(
        ("a[href*='/roles/']", "[class*='job'] a", "[class*='role'] a", "[class*='posting'] a"), 2, None, 60, "Toronto"),
    "cognizant": LinkRules(
        ("[class*='job-title'] a", "[class*='jobTitle'] a", ".job-list-item a", "li[class*='job'] a",
         "a[href*='/ca-en/job/']", "a[href*='/jobs/']"), 2, "a[href*='/job/']", 50),
    "tcs": LinkRules(
        (".job-title a", "[class*='job-title'] a", ".iBeginJobCard a", "a[href*='/candidate/jobs/']",
         "[class*='job-listing'] a", ".card-body a"), 2, "a[href*='/candidate/jobs/']", 50),
    "icims": LinkRules(
        (".iCIMS_JobListingRow .iCIMS_Anchor", ".iCIMS_Anchor", "a.iCIMS_Anchor", ".iCIMS_JobTitleText a",
         "table.iCIMS_JobsTable a", "a[data-details-url]", "[class*='job-title'] a", "[class*='jobTitle'] a",
         "h2 a[href*='/jobs/']", "a[href*='/jobs/'][aria-label]"), 1, "a[href*='icims.com/jobs/']", 50,
        skip_titles=("apply now", "apply", "view job", "learn more")),
    "infosys": LinkRules(
        ("a[href*='/company-job/'], a[href*='/reqid/'], .job-title a, .jobTitle a, h3 a, h2 a",), 1, None, 50),
}
# Sites of the shared icims rules whose default location differs.
ICIMS_LOCATIONS = {"KPMG Canada": "Canada", "Mackenzie Investments": "Toronto", "Kinaxis": "Ottawa"}

# --- fixed values: card rules per site --------------------------------------
WORKDAY_TITLES = (
    "[data-automation-id='jobTitle']", "a[data-automation-id='jobTitle']", "h3 a", "h2 a",
    "a[href*='/job/']", "a[href*='myworkdayjobs']", ".css-19uc56f", "a")
CARDS = {
    "workday_cards": CardRules(
        ("[data-automation-id='jobItem']", "li[data-automation-id='jobItem']",
         "[data-automation-id='compositeContainer'] li", "ul[data-automation-id='jobResults'] li",
         "li[class*='css-'][data-automation-id]",
         "[data-automation-id='jobResults'] [data-automation-id='jobItem']",
         "section[data-automation-id='jobResults'] li", "ul[role='list'] > li", "li[class*='css-']",
         "li.css-1q2dra3", "[class*='job-listing'] li"),
        1, 25, WORKDAY_TITLES,
        ("[data-automation-id='locations']", "[data-automation-id='location']", "dd[class*='css-']",
         ".css-129m7dg", "[class*='location']", "dl dd"),
        posted=("[data-automation-id='postedOn']", "dd[class*='css-']:last-child"), role=False),
    "ibm_cards": CardRules(
        ("[data-ph-id]", ".job-tile", ".ibm-job-tile", "li.job-listing-item", "li[class*='job']",
         ".positions-list li", "article[class*='job']", ".job-result-card", "[class*='job-card']",
         "[class*='position']"),
        2, 30,
        ("[data-ph-id='ph-job-title'] a", ".job-title a", ".position-title a", "h3 a", "h2 a",
         "a[href*='/careers/JobDetail']", "a[href*='/en_US/careers/']", ".title a", "a"),
        ("[data-ph-id='ph-job-location']", ".job-location", ".location", "[class*='location']", "[class*='city']"),
        location="Canada", card_text_title=True, min_title=4, geo=True),
    "google_cards": CardRules(
        ("li.lLd3Je", "li[jsmodel]", ".sMn82b", "[data-job-id]", "li[class*='job']", ".jobs-list li",
         "ul.jobs li", "article[class*='job']"),
        2, 25, ("h3", "h2", ".QJPWVe", ".job-title", "[class*='title']"),
        (".r0wTof", ".location", ".job-location", "[class*='location']"),
        location="Canada", url_from_card=True, keep_last=True),
    "apple_cards": CardRules(
        ("tr.table-row", "div.table-row", "tbody tr", "[class*='table-row']", "li[class*='job']"),
        2, 50, ("a.table--advanced-search__title", "a[href*='/details/']", "a"),
        ("span.table--advanced-search__job-location", ".table-col-2", "[class*='location']", "td:nth-child(2)"),
        location="Canada", distinct_url=True, host="https://jobs.apple.com"),
    "td_bank_cards": CardRules(
        (".job-listing, .job-result, article[class*='job']",), 1, 20, ("a, h2, h3",),
        ("[class*='location'], .job-location",), first_found=True, role=False, place_required=True),
    "generic_cards": CardRules(
        ("li[class*='job'], li[class*='result']", "article[class*='job'], div[class*='job-card']",
         ".job-listing, .job-result, .job-item", "[data-job-id], [data-requisition-id]",
         ".jv-job-list-result", ".opportunity-row"),
        3, 20,
        ("h2 a, h3 a, h4 a", "a[href*='/job'], a[href*='/career']", ".job-title a, .position-title a",
         "[class*='job-title'], [class*='position-name']"),
        (".location", "[class*='location']", ".city"),
        first_found=True, card_text_title=True, min_title=5, keep_last=True, role=False),
}

# --- fixed values: the job-table site ---------------------------------------
NJOYN = LinkRules(
    ("a[href*='Page=jobdetails'], a[href*='njoyn.com'][href*='job'], .joblisting a, table a[href*='xweb.asp']",),
    1, "a[href*='njoyn.com']", 100)
JOB_CODE = r"^J\d{4}-\d{4}"
# --- fixed values: what a bot wall leaves on a site's page -------------------
BLOCK_MARKS = {
    "ibm_cards": {"html": ("AwsWafIntegration", "challenge-container")},
    "infosys": {"url": ("infosys.com/404",), "html": ("Access Denied",)},
}

_STEP = re.compile(r"\s*>\s*|\s+(?![^\[]*\])")
_PART = re.compile(
    r"(?P<tag>^[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)'(?P<val>[^']*)')?\]"
    r"|:nth-child\((?P<nth>\d+)\)|:(?P<last>last)-child"
)


@dataclass(frozen=True)
class Simple:
    """The tests of one element."""

    tag: str = ""
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str, str], ...] = ()
    nth: int = 0
    last: bool = False

    def fits(self, e: dict) -> bool:
        found = e["attrs"]
        return (
            (not self.tag or e["tag"] == self.tag)
            and all(c in e["classes"] for c in self.classes)
            and all(
                name in found and (not op or (found[name] == value if op == "=" else value in found[name]))
                for name, op, value in self.attrs
            )
            and (not self.nth or e["nth"] == self.nth)
            and (not self.last or e["last"])
        )


@dataclass(frozen=True)
class Path:
    """An element and what must stand above it, outermost first."""

    steps: tuple[Simple, ...]
    direct: tuple[bool, ...]  # before each step but the first

    def fits(self, e: dict) -> bool:
        return self.steps[-1].fits(e) and self._above(e["up"], len(self.steps) - 2)

    def _above(self, e: dict | None, step: int) -> bool:
        if step < 0:
            return True
        while e is not None:
            if self.steps[step].fits(e) and self._above(e["up"], step - 1):
                return True
            if self.direct[step]:
                return False
            e = e["up"]
        return False


def _simple(text: str) -> Simple:
    tag, classes, attrs, nth, last = "", [], [], 0, False
    for m in _PART.finditer(text):
        if m["tag"]:
            tag = m["tag"].lower()
        elif m["cls"]:
            classes.append(m["cls"])
        elif m["nth"]:
            nth = int(m["nth"])
        elif m["last"]:
            last = True
        else:
            attrs.append((m["attr"].lower(), m["op"] or "", m["val"] or ""))
    return Simple(tag, tuple(classes), tuple(attrs), nth, last)


def paths(selector: str) -> list[Path]:
    """One per comma-separated option."""
    out = []
    for option in _options(selector):
        steps = tuple(_simple(s) for s in _STEP.split(option.strip()))
        out.append(Path(steps, tuple(">" in j for j in _STEP.findall(option.strip()))))
    return out


# In the JVM a link is its own start tag, <a href="/job/1">, and a selector
# that looks at nothing else is a regular expression over it.
def _tag_regex(simple: Simple) -> str:
    tests = [rf'class="(?:[^">]* )?{quote_regex(c)}(?: [^">]*)?"' for c in simple.classes]
    for name, op, value in simple.attrs:
        shown = quote_regex(value)
        tests.append(f'{name}="{shown}"' if op == "=" else f'{name}="[^">]*{shown}' if op else f'{name}="')
    return f"<{simple.tag}(?= |>)" + "".join(f"(?=[^>]* {t})" for t in tests) + "[^>]*>"


def _options(selector: str) -> list[str]:
    return re.split(r",\s*(?![^\[]*\])", selector.strip())


def own_tag_regexes(selector: str) -> list[str]:
    return [f"^{_tag_regex(p.steps[-1])}$" for p in paths(selector)]


def selectors_of(rules: LinkRules | CardRules) -> list[str]:
    """Every selector the rules mention."""
    if isinstance(rules, LinkRules):
        every = [*rules.patterns, *([rules.otherwise] if rules.otherwise else []), *rules.title_selectors, *rules.place_selectors]
    else:
        every = [*rules.cards, *rules.titles, *rules.places, *rules.posted, "a"]
    return list(dict.fromkeys(every))


def anchor_only(rules: LinkRules) -> bool:
    """True when every selector looks at the link itself, not at its parents."""
    every = [*rules.patterns, *([rules.otherwise] if rules.otherwise else [])]
    plain = all(
        re.fullmatch(r"a(?![\w-])\S*", option.strip())
        for selector in every
        for option in _options(selector)
    )
    return plain and not (rules.title_selectors or rules.place_levels or rules.title_else == "parent")
