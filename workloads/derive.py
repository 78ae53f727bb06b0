"""Postings, companies and payloads derived from the driver tables.

Every expression here has a twin in ``workloads.sql``; the two are compared
through the operators in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiretide.operators.dedup import run_bucket
from hiretide.sources.selectors import CARDS, LINKS, paths
from workloads.fixed import CATEGORIES, LOCATIONS, PAGE_ROWS, SNIPPETS, STACKS, TITLES, TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("long")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, title, location, company, cid, category, snippet, ts, run_ts, page_no)."""
    return postings_of(table(spark, sf_dir, "events"))


def postings_of(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    cid = F.col("user_id")
    return events.select(
        e.alias("seq"),
        pick(TITLES, e % 40).alias("title"),
        pick(LOCATIONS, div(e, 7) % 32).alias("location"),
        F.concat(F.lit("Company "), cid.cast("string")).alias("company"),
        cid.alias("cid"),
        pick(CATEGORIES, cid % 16).alias("category"),
        pick(SNIPPETS, e % 12).alias("snippet"),
        "ts",
        run_bucket("ts").alias("run_ts"),
        div(e, PAGE_ROWS).cast("int").alias("page_no"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company dimension, one row per customer."""
    i = F.col("c_custkey")
    text = i.cast("string")
    return table(spark, sf_dir, "customer").select(
        i.alias("id"),
        F.concat(F.lit("Company "), text).alias("name"),
        F.when(
            i % 4 != 3,
            F.concat(
                F.lit("https://t"), text, F.lit(".wd"), (i % 12 + 1).cast("string"),
                F.lit(".myworkdayjobs.com/Board"), text, F.lit("?q=data+engineer&locationCountry=c"), text,
            ),
        ).otherwise(
            F.concat(F.lit("https://careers"), text, F.lit(".example.com/search?keywords=data+engineer&location=Canada"))
        ).alias("careers_url"),
        pick(CATEGORIES, i % 16).alias("category"),
        pick(TYPES, i % 9).alias("scraper"),
        F.concat(
            F.lit("$"), (i % 60 + 70).cast("string"), F.lit("K-$"), (i % 90 + 110).cast("string"), F.lit("K")
        ).alias("salary_range"),
        (i % 3 == 0).alias("top100"),
        F.array().cast("array<string>").alias("titles"),
        F.when(i % 4 == 0, F.lit(STACKS[0])).when(i % 4 == 1, F.lit(STACKS[1])).when(i % 4 == 2, F.lit(STACKS[2])).alias("stack"),
        F.array().cast("array<string>").alias("locations"),
    )


def source_config(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Settings for one board; every tenth company (7, 17, ..) has none."""
    i = F.col("c_custkey")
    text = i.cast("string")
    return table(spark, sf_dir, "customer").filter(i % 10 != 7).select(
        F.concat(F.lit("Company "), text).alias("company"),
        F.lit(source).alias("source"),
        F.concat(F.lit("s-"), text).alias("slug"),
        F.concat(F.lit("CX_"), text).alias("site"),
        F.lit(None).cast("string").alias("location_id"),
        F.concat(F.lit("https://jobs"), text, F.lit(".example.com/job/{jobSeqNo}/{slug}")).alias("url_template"),
        F.lit(None).cast("string").alias("default_location"),
    )


def xml_text(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _body(els: Column, before: Column | str, between: str, after: str) -> Column:
    first = F.lit(before) if isinstance(before, str) else before
    return F.concat(first, F.array_join(F.transform(els, lambda x: x["el"]), between), F.lit(after))


def _landed(source: Column, body: Column) -> list[Column]:
    return [
        source.alias("source"), F.col("company"), F.lit(0).alias("attempt"), F.col("page_no"),
        F.lit(200).alias("status"), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("fetched_at"), body.alias("body"),
    ]


_PAGE = ["company", "cid", "page_no"]


def bodies(rows: DataFrame, source: str, element: Column, before: Column | str, between: str, after: str) -> DataFrame:
    """One payload per (company, page_no), elements in seq order.

    A page spans ``PAGE_ROWS`` consecutive events, which bounds every body.
    """
    return (
        rows.select(*_PAGE, "seq", element.alias("el"))
        .groupBy(*_PAGE)
        .agg(F.array_sort(F.collect_list(F.struct("seq", "el"))).alias("els"))
        .select(*_landed(F.lit(source), _body(F.col("els"), before, between, after)))
    )


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _wrap(before: Column | str, after: str, between: str = ",") -> dict:
    return {"before": before, "between": between, "after": after}


def payloads(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """The derived postings rendered as one source's payload."""
    element, wrap = RENDER[source]()
    return bodies(postings(spark, sf_dir), source, element, **wrap)


def payloads_of(spark: SparkSession, sf_dir: str, sources: list[str]) -> DataFrame:
    """``payloads`` of several sources; the postings are read, shuffled (before they are rendered) and grouped once."""
    rows = postings(spark, sf_dir).select(*_PAGE, "seq", "title", "location", "snippet").repartition(*_PAGE)
    made = {source: RENDER[source]() for source in sources}
    pages = rows.groupBy(*_PAGE).agg(*[
        F.array_sort(F.collect_list(F.struct("seq", element.alias("el")))).alias(f"els_{source}") for source, (element, _) in made.items()
    ])
    landed = [F.struct(F.lit(source).alias("source"), _body(F.col(f"els_{source}"), **wrap).alias("body")) for source, (_, wrap) in made.items()]
    return pages.select("company", "page_no", F.explode(F.array(*landed)).alias("p")).select(*_landed(F.col("p.source"), F.col("p.body")))


def _s(k: int) -> Column:
    return F.col("seq") % k


def _id() -> Column:
    return F.col("seq").cast("string")


def _none() -> Column:
    return F.lit(None).cast("string")


def _greenhouse():
    title, loc = F.col("title"), F.col("location")
    url = F.concat(F.lit("https://gh.example/"), _id())
    text = F.concat(F.lit("<p>"), F.col("snippet"), F.lit("</p>"))
    plain = _json(title=title, location=loc, absolute_url=url, content=text)
    nested = _json(title=title, location=F.struct(loc.alias("name")), absolute_url=url, content=text)
    return F.when(_s(3) == 0, plain).otherwise(nested), _wrap('{"jobs":[', "]}")


def _lever():
    return _json(
        text=F.col("title"), categories=F.struct(F.col("location")),
        hostedUrl=F.concat(F.lit("https://lever.example/"), _id()),
        descriptionPlain=F.col("snippet"),
        additionalPlain=F.when(_s(2) == 0, pick(SNIPPETS, (F.col("seq") + 5) % 12)),
    ), _wrap("[", "]")


def _ashby():
    address = F.when(
        _s(5) == 0,
        F.struct(F.struct(
            F.lit("Canada").alias("addressCountry"),
            F.when(_s(2) == 1, F.lit("Regina")).otherwise(F.lit("")).alias("addressLocality"),
            F.lit("SK").alias("addressRegion"),
        ).alias("postalAddress")),
    )
    no_address = F.struct(F.struct(_none().alias("addressRegion")).alias("postalAddress"))
    other = F.when(
        _s(4) == 1,
        F.array(
            F.struct(F.lit("Austin, Texas").alias("location"), no_address.alias("address")),
            F.struct(F.lit("Toronto").alias("location"),
                     F.struct(F.struct(F.lit("ON").alias("addressRegion")).alias("postalAddress")).alias("address")),
        ),
    ).when(_s(4) == 2, F.array(F.struct(F.lit("Canada").alias("location"), no_address.alias("address"))))
    return _json(
        title=F.col("title"), location=F.col("location"), address=address, secondaryLocations=other,
        jobUrl=F.when(_s(3) != 0, F.concat(F.lit("https://ashby.example/"), _id())),
        applyUrl=F.when(_s(6) != 0, F.concat(F.lit("https://apply.example/"), _id())),
        descriptionPlain=F.when(_s(2) == 0, F.col("snippet")),
        descriptionHtml=F.concat(F.lit("<i>"), F.col("snippet"), F.lit("</i>")),
    ), _wrap('{"jobs":[', "]}")


def _smartrecruiters():
    return _json(
        id=F.when(_s(7) != 0, _id()), name=F.col("title"),
        location=F.struct(
            F.when(_s(3) != 0, F.col("location")).alias("fullLocation"),
            F.when(_s(2) == 0, F.lit("CA")).otherwise(F.lit("us")).alias("country"),
            F.when(_s(4) == 0, F.lit("Regina")).alias("city"),
        ),
    ), _wrap('{"totalFound":100,"content":[', "]}")


def _workday():
    return _json(
        title=F.col("title"),
        locationsText=F.when(_s(3) == 0, F.lit("")).otherwise(F.col("location")),
        primaryLocation=F.when(_s(6) == 0, F.col("location")),
        bulletFields=F.when(_s(9) == 0, F.array(F.lit("R-1"), F.lit("Remote - US")))
        .when(_s(9) == 3, F.array(F.lit("x"), F.lit("Toronto office"))),
        externalPath=F.when(_s(8) != 0, F.concat(F.lit("/job/"), _id())),
        postedOn=F.when(_s(2) == 0, F.lit("Posted Today")),
    ), _wrap('{"total":20,"jobPostings":[', "]}")


def _oracle_hcm():
    return _json(
        Id=F.when(_s(7) != 0, _id()), Title=F.col("title"),
        PrimaryLocation=F.when(_s(10) != 0, F.col("location")),
        PrimaryLocationCountry=F.when(_s(2) == 0, F.lit("CA")).otherwise(F.lit("US")),
        PostedDate=F.when(_s(3) == 0, F.lit("")).when(_s(3) == 1, F.lit("2024-01-01")),
    ), _wrap('{"items":[{"TotalJobsCount":25,"requisitionList":[', "]}]}")


def _amazon():
    return _json(
        title=F.col("title"),
        location=F.when(_s(3) == 0, F.lit("CA, ON, Toronto")).when(_s(11) != 0, F.col("location")),
        job_path=F.when(_s(5) != 0, F.concat(F.lit("/en/jobs/"), _id())),
        posted_date=F.when(_s(2) == 0, F.lit("January 1, 2024")),
    ), _wrap('{"hits":100,"jobs":[', "]}")


def _netflix():
    return _json(
        name=F.col("title"), location=F.when(_s(5) != 0, F.col("location")),
        canonicalPositionUrl=F.concat(F.lit("https://nf.example/"), _id()),
    ), _wrap('{"count":50,"positions":[', "]}")


def _ibm():
    return _json(
        title=F.when(_s(2) == 0, F.col("title")).otherwise(F.lit("")),
        jobTitle=F.when(_s(2) == 1, F.col("title")),
        location=F.when(_s(3) == 0, F.col("location")),
        primaryLocation=F.when(_s(3) == 1, F.col("location")),
        url=F.when(_s(4) == 0, F.concat(F.lit("https://ibm.example/"), _id())),
        applyUrl=F.when(_s(4) == 1, F.concat(F.lit("https://apply.example/"), _id())),
        jobId=F.when(_s(4) == 2, _id()),
    ), _wrap(F.when(F.col("cid") % 2 == 0, F.lit('{"jobs":[')).otherwise(F.lit('{"results":[')), "]}")


def _meta():
    return _json(
        id=_id(), title=F.col("title"),
        locations=F.when(_s(2) == 1, F.array(F.col("location"), F.lit("Toronto, ON"))).otherwise(F.array(F.col("location"))),
    ), _wrap('{"data":{"job_search_with_featured_jobs":{"all_jobs":[', "]}}}")


def _bamboohr():
    place = F.struct(
        F.when(_s(4) == 0, F.lit("Regina")).when(_s(4) == 1, F.lit(" Toronto ")).when(_s(4) == 3, F.lit("Austin")).alias("city"),
        F.when(_s(4) == 0, F.lit("SK")).when(_s(4) == 3, F.lit("TX")).alias("state"),
        F.when(_s(4) == 2, F.lit("Canada")).when(_s(4) == 3, F.lit("United States")).alias("country"),
    )
    opening = _json(id=_id(), jobOpeningName=F.col("title"), location=place)
    label = _json(id=_id(), title=F.struct(F.col("title").alias("label")), location=place)
    plain = _json(id=_id(), title=F.col("title"), location=place)
    return F.when(_s(3) == 0, opening).when(_s(3) == 1, label).otherwise(plain), _wrap('{"result":[', "]}")


def _rss_item(title: Column) -> Column:
    return F.concat(
        F.lit("<item><title>"), xml_text(title), F.lit("</title><link> https://rss.example/"), _id(), F.lit(" </link></item>")
    )


def _avature():
    prefix = pick(["", "[TOR] - ", "[NYC] ", "[XXX] ", "[mtl] ", "[VAN]"], _s(6))
    return _rss_item(F.concat(prefix, F.col("title"))), _wrap("<rss><channel><title>feed</title>", "</channel></rss>", "")


def _boc_rss():
    suffix = pick(["", " (Toronto, ON)", " (Halifax (Downtown), NS)"], _s(3))
    return _rss_item(F.concat(F.col("title"), suffix)), _wrap("<rss><channel><title>feed</title>", "</channel></rss>", "")


def _phenom():
    city = F.when(F.trim("location") != "", F.trim("location")).otherwise(F.lit("Regina"))
    record = F.concat(
        F.lit('{"title":"'), F.col("title"), F.lit('","city":"'), city, F.lit('","state" : "'),
        pick(["ON", "TX", "British Columbia"], _s(3)), F.lit('","jobSeqNo": "J'), _id(),
        F.lit('","pad":"' + "x" * 120 + '"}'),
    )
    return record, _wrap("<html><script>var jobs=[", "]</script></html>")


def uuid_of(text: Column) -> Column:
    h = F.md5(text)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def _shopify():
    uuid = uuid_of(F.concat(F.col("company"), (F.col("seq") % 97).cast("string")))
    q = r"\""
    record = F.concat(
        F.lit(q), uuid, F.lit(f"{q},{q}"), F.col("title"), F.lit(f"{q},{q}"), uuid_of(_id()),
        F.lit(f"{q},{q}2024-01-01{q},{q}https://www.shopify.com/careers?ashby_jid="), uuid, F.lit(q),
    )
    return record, _wrap("<html><script>[", "]</script></html>")


def _canadalife():
    place = F.when(F.trim("location") == "", F.lit("Regina, SK, CA")).when(
        _s(4) == 0, F.concat(F.col("location"), F.lit(", CA"))
    ).otherwise(F.col("location"))
    record = F.concat(
        F.lit('<div><a href="/job/'), (F.col("seq") % 89).cast("string"), F.lit('" class="jobTitle-link">'),
        xml_text(F.col("title")), F.lit(' &amp; more</a>\n<span class="jobLocation">\n '), place, F.lit(" </span></div>"),
    )
    return record, _wrap("<html><body>", "</body></html>", "\n")


RENDER: dict[str, Callable] = {
    "greenhouse": _greenhouse, "lever": _lever, "ashby": _ashby, "smartrecruiters": _smartrecruiters,
    "workday": _workday, "oracle_hcm": _oracle_hcm, "amazon": _amazon, "netflix": _netflix, "ibm": _ibm,
    "meta": _meta, "bamboohr": _bamboohr, "avature": _avature, "boc_rss": _boc_rss, "phenom": _phenom,
    "shopify": _shopify, "canadalife": _canadalife,
}


# --- saved pages ------------------------------------------------------------

LINK_PAGE_ROWS = 120


def link_pages(spark: SparkSession, sf_dir: str, element: Column, before: str, after: str) -> DataFrame:
    """(company, page_id, url, html): 120 consecutive events per page."""
    page = div(F.col("seq"), LINK_PAGE_ROWS)
    return (
        postings(spark, sf_dir).withColumn("page_id", page).withColumn("variant", page % 4)
        .select("page_id", "seq", element.alias("el"))
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "el"))).alias("els"))
        .select(
            F.concat(F.lit("Company "), F.col("page_id").cast("string")).alias("company"),
            "page_id",
            F.concat(F.lit("https://site.example/list/"), F.col("page_id").cast("string")).alias("url"),
            F.concat(F.lit(before), F.array_join(F.transform("els", lambda x: x["el"]), "\n"), F.lit(after)).alias("html"),
        )
    )


def anchor(href: Column, text: Column) -> Column:
    return F.concat(F.lit('<a href="'), href, F.lit('">'), text, F.lit("</a>"))


def shown_title() -> Column:
    """Every tenth link is an image without text."""
    return F.when(_s(10) == 9, F.lit('<img src="x.png">')).otherwise(F.concat(F.lit("<b>"), F.col("title"), F.lit("</b>")))


def job_href() -> Column:
    return F.concat(F.lit("/job/"), (F.col("seq") % 83).cast("string"))


def _open(step, last: bool) -> tuple[str, str, str]:
    """Start tag without its end, tag and href path of an element that fits one step of a selector."""
    tag = step.tag or ("a" if last else "div")
    classes, attrs, href = list(step.classes), [], []
    for name, _, value in step.attrs:
        if name == "class":
            classes.append(value)
        elif name == "href":
            href.append(value.strip("/"))
        else:
            attrs.append(f' {name}="{value}"')
    shown = f' class="{" ".join(classes)}"' if classes else ""
    return f"<{tag}{shown}{''.join(attrs)}", tag, "/".join(href)


def frame(selector: str, linked: bool) -> tuple[str, str, str, bool]:
    """Before the last start tag's end, after the content, path of links, and whether the element is a link itself."""
    steps = paths(selector)[0].steps
    before, after, path = "", "", "x"
    for i, step in enumerate(steps):
        start, tag, found = _open(step, linked and i == len(steps) - 1)
        path = found or path
        before += start + (">" if i < len(steps) - 1 else "")
        after = f"</{tag}>" + after
    return before, after, path, steps[-1].tag in ("", "a")


def fitting(selector: str, inner: Column, href: Column | None = None) -> Column:
    """Markup that fits the first option of a selector; with ``href`` it is a link, or holds one, to that number."""
    before, after, path, is_link = frame(selector, href is not None)
    if href is None:
        return F.concat(F.lit(before + ">"), inner, F.lit(after))
    link = F.concat(F.lit(f' href="/{path}/'), href, F.lit('">'), inner)
    if is_link:
        return F.concat(F.lit(before), link, F.lit(after))
    return F.concat(F.lit(before + "><a"), link, F.lit("</a>" + after))


# Which of its selectors a site's pages are made for: the first one of this site also fits what stands inside a card.
_OPTION = {"ibm_cards": 1}


def site_pages(spark: SparkSession, sf_dir: str, site: str) -> DataFrame:
    """Pages in the markup that a site's first selectors look for."""
    if site in LINKS:
        element = fitting(LINKS[site].patterns[0], xml_text(F.col("title")), _id())
    else:
        rules, k = CARDS[site], _OPTION.get(site, 0)
        title = fitting(rules.titles[k], xml_text(F.col("title")), _id())
        place = fitting(rules.places[k], xml_text(F.col("location")))
        element = fitting(rules.cards[k], F.concat(title, place))
    return link_pages(spark, sf_dir, element, "<html><body>", "</body></html>")


def site_path(site: str) -> str:
    selector = LINKS[site].patterns[0] if site in LINKS else CARDS[site].titles[_OPTION.get(site, 0)]
    return frame(selector, True)[2]


def j2w_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page variants: card markup, legacy cells, bare links, a few cards only."""
    link = anchor(job_href(), shown_title())
    card = F.concat(F.lit('<div class="x jobResultsCard">'), link, F.lit("</div>"))
    cell = F.concat(F.lit('<table><tr><td class="jobTitle">'), link, F.lit("</td></tr></table>"))
    bare = F.concat(F.lit("<p>"), link, F.lit("</p>"))
    element = (
        F.when(F.col("variant") == 0, card).when(F.col("variant") == 1, cell).when(F.col("variant") == 2, bare)
        .otherwise(F.when(_s(6) == 0, card).otherwise(bare))
    )
    return link_pages(spark, sf_dir, element, '<html><body><a href="/about">About</a>', "</body></html>")


def bare_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    element = F.concat(F.lit("<li>"), anchor(job_href(), shown_title()), F.lit("</li>"))
    return link_pages(spark, sf_dir, element, '<html><body><ul><a href="/about">About</a>', "</ul></body></html>")


def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    element = F.concat(
        F.lit('<li class="job-card"><h3>'),
        anchor(F.concat(F.lit("/careers/JobDetail?jobId="), _id()), F.col("title")),
        F.lit('</h3><span class="location">'), F.col("location"), F.lit("</span></li>"),
    )
    return link_pages(spark, sf_dir, element, "<html><body><ul>", "</ul></body></html>")


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = anchor(
        F.concat(F.lit("xweb.asp?Page=jobdetails&amp;id="), (F.col("seq") % 83).cast("string")),
        F.concat(F.lit("J0124-"), F.lpad((F.col("seq") % 10000).cast("string"), 4, "0")),
    )
    place = F.concat(F.lit("<td>"), F.col("location"), F.lit("</td>"))
    country = F.when(_s(3) == 0, F.lit("<td>Canada</td>")).when(_s(3) == 1, F.lit("<td>India</td>")).otherwise(F.lit(""))
    element = F.concat(
        F.lit("<tr><td>"), link, F.lit("</td><td>"), F.col("title"), F.lit("</td><td>IT</td>"), place, country, F.lit("</tr>")
    )
    return link_pages(spark, sf_dir, element, "<html><body><table><tbody>", "</tbody></table></body></html>")
