"""Saved pages: selectors, pattern choice, caps, fallbacks."""

import re

import pytest
from pyspark.sql import functions as F

from hiretide.functions import entities
from hiretide.functions.classify import Rules
from hiretide.sources import saved_pages as S
from hiretide.sources.selectors import CARDS, LINKS, anchor_only, own_tag_regexes, paths, selectors_of
from hiretide.sources.tokeniser import parse_page, with_elements


@pytest.fixture(scope="module")
def page(spark):
    def make(*htmls, url="https://s.example/list"):
        return spark.createDataFrame([("A", i, url, h) for i, h in enumerate(htmls)],
                                     "company string, page_id long, url string, html string")

    return make


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("page_id", "pos").select("title", *cols).collect()]


def a(href, text):
    return f'<a href="{href}">{text}</a>'


def hits(html, selector):
    text, els = parse_page(html, [paths(selector)], True)
    return [text[e["t0"]:e["t1"]].strip() for e in els if e["hits"]]


def test_selectors():
    html = ('<div class="job card" data-job-id="1"><h3><a href="/a/b" aria-label="x">One</a></h3><p>x</p></div>'
            '<ul role="list"><li class="css-1 z">Two<span>n</span><span>m</span></li><li>Three <b>b</b></li></ul>'
            "<table><tr class=odd><td class='jobTitle'><a class='jobTitle big'>Four</a><td>Five</table>")
    assert hits(html, "h3 a") == hits(html, "[data-job-id] a") == hits(html, ".job a") == hits(html, "a[href*='/b'][aria-label]") == ["One"]
    assert hits(html, ".jo a") == [] and hits(html, "[class*='jo'] h3") == ["One"]
    assert hits(html, "ul[role='list'] > li") == ["Two n m".replace(" n", "n").replace(" m", "m"), "Three b"]
    assert hits(html, "span:nth-child(2)") == ["m"] and hits(html, "li:last-child") == ["Three b"]
    assert hits(html, "tr.odd a.jobTitle, h3") == ["One", "Four"] and hits(html, "td:nth-child(2)") == ["Five"]
    assert hits(html, "ul > span") == [] and hits(html, "ul span") == ["n", "m"]


def test_tokeniser_skips_scripts_and_survives_bad_markup():
    text, els = parse_page("<p>a<p>b<br>c</p></div><script>x<a href=1>no</a></script><a href='u'>A&amp;B <b>c</b>d", [paths("a")], True)
    links = [e for e in els if e["href"]]
    assert [e["text"] for e in links] == ["A&B cd"] and "no" not in text
    assert parse_page(None, [], True) == ("", [])


def test_output_is_linear_in_a_deep_page():
    def size(depth):
        text, els = parse_page("<div class='job'>" * depth + "<a href='/x'>t</a>" + "</div>" * depth, [paths(".job a"), paths(".job")], True)
        return len(text) + sum(len(str(e["text"] or "")) + len(e["hits"]) + 8 for e in els)

    assert size(1600) < 4.2 * size(400)


def test_entities_alike_on_every_way(spark):
    forms = ["&eacute;&#233;&#xE9;", "&amp;lt; &nosuch; &amp &#0; &#x110000; a&b;c", "plain", "&copy;&nbsp;x", "&&amp;&", None]
    got = [r[0] for r in spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, t string").orderBy("i").select(entities.unescape(F.col("t"))).collect()]
    assert got == [entities.unescape_text(f) if f is not None else None for f in forms]
    assert got[:2] == ["ééé", "&lt; &nosuch; &amp \ufffd \ufffd a&b;c"]


def test_pattern_with_one_match_is_skipped_when_two_are_needed(page):
    one = '<li class="job">' + a("/x/1", "Data Engineer") + "</li>" + a("/careers/2", "ETL Developer") + a("/careers/3", "SQL Developer")
    assert rows(S.link_rows(page(one), LINKS["uber"]), "location") == [("ETL Developer", "Toronto"), ("SQL Developer", "Toronto")]
    # the same page where one match is enough
    card = '<div class="jobResultsCard">' + a("/x/1", "Data Engineer") + "</div>" + a("/job/2", "ETL Developer")
    assert rows(S.link_rows(page(card), LINKS["j2w"])) == [("Data Engineer",)]
    assert rows(S.link_rows(page(a("/y", "Data Engineer")), LINKS["coveo"])) == []


def test_site_limits_only_where_asked_for(page):
    html = a("/job/0", "Cook") * 80 + a("/job/1", "Data Engineer")
    assert rows(S.link_rows(page(html), LINKS["scotiabank"]), "url") == [("Data Engineer", "https://s.example/job/1")]
    # the cap comes before duplicates and role
    assert rows(S.link_rows(page(html), LINKS["scotiabank"], site_limits=True)) == []
    assert len(rows(S.link_rows(page(html[len(a("/job/0", "Cook")):]), LINKS["scotiabank"], site_limits=True))) == 1


def test_blank_first_link_hides_the_titled_one_only_where_urls_are_marked_first(page):
    image = a("/ey/job/data-engineer/1", "<img>") + a("/ey/job/data-engineer/1", "ETL Developer")
    assert rows(S.link_rows(page(image), LINKS["ey"])) == [("Data Engineer",)]
    meta = a("/profile/job_details/1", "") + a("/profile/job_details/1", "Data Engineer")
    assert rows(S.link_rows(page(f"<div><p>{meta}</p></div>"), LINKS["meta_links"])) == [("Data Engineer",)]
    other = a("/job/1", "") + a("/job/1", "Data Engineer")
    assert rows(S.link_rows(page(other), LINKS["scotiabank"])) == [("Data Engineer",)]


def test_call_to_action_texts_do_not_use_up_the_url(page):
    html = '<a class="iCIMS_Anchor" href="/1">Apply Now</a><a class="iCIMS_Anchor" href="/1">Data Engineer</a>'
    assert rows(S.link_rows(page(html), LINKS["icims"])) == [("Data Engineer",)]


def test_repeated_urls_stay_where_the_site_keeps_them(page):
    html = a("/jobs/results/1", "Data Engineer") * 2
    assert len(rows(S.link_rows(page(html), LINKS["google_links"]))) == 2


def test_microsoft_nearest_location(page):
    near = '<div><div>' + a("/global/en/job/1", "<h2>Data Engineer</h2><i>x</i>") + '<span class="location">Toronto</span></div>' \
           '<span class="location">Oslo</span></div>'
    far = '<section><div>' + a("/global/en/job/2", "ETL Developer") + '</div><b class="jobLocation">Oslo</b></section>'
    got = rows(S.link_rows(page(f"<main>{near}{far}</main>"), LINKS["microsoft"]), "location")
    assert got == [("Data Engineer", "Toronto")]


def test_citibank_grandparent(page):
    def item(i, place):
        return f'<li><h2>{a(f"/job/{i}", "Data Engineer")}</h2><b class="job-location">{place}</b></li>'

    got = rows(S.link_rows(page("<ul>" + item(1, "Toronto") + item(2, "Oslo") + item(3, "") + "</ul>"), LINKS["citibank"]), "location", "url")
    assert got == [("Data Engineer", "Toronto", "https://s.example/job/1"), ("Data Engineer", "Canada", "https://s.example/job/3")]


def test_apple_title_from_link_and_sibling_place(page):
    html = "<p>" + a("/en/details/1/senior-data-engineer?team=A", "") + '<span class="x-location">Ottawa</span></p>'
    assert rows(S.link_rows(page(html), LINKS["apple_links"]), "location") == [("Senior Data Engineer", "Ottawa")]


def test_native_links_agree_with_the_tokeniser(page):
    html = ("<!-- " + a("/job/9", "no") + " --><A HREF='/job/1'>x</A>" + a("/job/1?a=1&amp;b=2", " Data <b>Engineer</b> &amp; co ")
            + "<a class='c'\n href='/job/2'>ETL\n Developer</a><script>" + a("/job/3", "SQL Developer") + "</script>")
    rules = LINKS["scotiabank"]
    assert anchor_only(rules) and not anchor_only(LINKS["j2w"])
    native, parsed = (rows(S.link_rows(page(html), rules, native=n), "url") for n in (True, False))
    assert native == parsed == [("Data Engineer & co", "https://s.example/job/1?a=1&b=2"), ("ETL Developer", "https://s.example/job/2")]


def card(title, place="", tag="li", cls="job-card", href="/x"):
    return f'<{tag} class="{cls}"><h3>{a(href, title)}</h3><span class="location">{place}</span></{tag}>'


def test_cards_first_non_empty_and_links_when_there_are_none(page):
    blank = '<li class="job-card"><h3><a href="/n"> </a></h3><div class="title"><a href="/t">Data Engineer</a></div><i class="location"></i><b class="city">Toronto</b></li>'
    got = S.card_rows(page(blank + card("ETL Developer", "Oslo") + card("SQL Developer")), CARDS["ibm_cards"], links=LINKS["ibm_links"])
    assert rows(got, "location", "url") == [("Data Engineer", "Toronto", "https://s.example/t"), ("SQL Developer", "Canada", "https://s.example/x")]
    got = S.card_rows(page(a("/careers/JobDetail?jobId=1", "Data Engineer")), CARDS["ibm_cards"], links=LINKS["ibm_links"])
    assert rows(got, "location") == [("Data Engineer", "Canada")]


def test_generic_takes_the_first_found_even_if_blank(page):
    blank = '<li class="job"><h2><a href="/1"></a></h2><a href="/job/1">Data Engineer</a></li>'
    got = S.card_rows(page(blank + card("Cook and more", "Here") * 2), CARDS["generic_cards"])
    assert rows(got, "location") == [("Cook and more", "Here")] * 2
    # fewer than three matches everywhere: only the last selector's matches count
    assert rows(S.card_rows(page(card("Data Engineer") * 2), CARDS["generic_cards"])) == []


def test_apple_cards_drop_repeated_urls_after_the_role_test(page):
    def row(title, href):
        return f'<tr class="table-row"><td>{a(href, title)}</td><td>Toronto</td></tr>'

    html = "<table>" + row("Cook", "/d/1") + row("Data Engineer", "/d/1") + row("ETL Developer", "/d/1") + "</table>"
    assert rows(S.card_rows(page(html), CARDS["apple_cards"]), "location") == [("Data Engineer", "Toronto")]


def test_workday_google_td_cards(page):
    one = ('<li data-automation-id="jobItem"><a data-automation-id="jobTitle" href="/job/1">Cook</a>'
           '<dd class="css-9">Toronto</dd><span data-automation-id="postedOn">Today</span></li>')
    assert rows(S.card_rows(page(one), CARDS["workday_cards"], links=LINKS["workday_links"]), "location", "posted") == [("Cook", "Toronto", "Today")]
    google = '<li class="lLd3Je"><h3>Data Engineer</h3><a href="/g/1">Learn</a></li>' * 2
    assert rows(S.card_rows(page(google), CARDS["google_cards"]), "url", "location") == [("Data Engineer", "https://s.example/g/1", "Canada")] * 2
    td = '<div class="job-listing"><h2>Cook</h2><i class="location">Oslo</i></div><div class="job-listing"><h2>Baker</h2></div>'
    assert rows(S.card_rows(page(td), CARDS["td_bank_cards"]), "location") == [("Cook", "Oslo")]


def test_table_rows(page):
    def row(i, *cells):
        link = a(f"x.asp?Page=jobdetails&amp;id={i}", f"J0124-000{i}")
        return f"<tr><td>{link}</td>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"

    html = "<table>" + "".join([
        row(1, "Data Engineer", "IT", "Toronto", "Canada"), row(2, "", "ETL Developer", "Montréal", "Canada"),
        row(3, "SQL Developer", "IT", "Oslo", "Norway"), row(4, "SQL Developer", "IT", "Ottawa"),
        row(5, "SQL Developer"), row(1, "ETL Developer"),
    ]) + "</table>"
    assert rows(S.table_rows(page(html)), "location") == [
        ("Data Engineer", "Toronto Canada"), ("ETL Developer", "Montréal Canada"), ("SQL Developer", "Ottawa"), ("SQL Developer", "Canada")]


def test_blocked_pages_by_site(page):
    def left(site, **how):
        pages = page("ok", "x AwsWafIntegration", "challenge-container", "Access Denied", "y" * 500 + "Access Denied")
        return [r.page_id for r in S.drop_blocked_pages(pages, site, **how).orderBy("page_id").collect()]

    assert left("ibm_cards") == [0, 3, 4] and left("infosys") == [0, 1, 2] and left("infosys", head=500) == [0, 1, 2, 4]
    assert left("scotiabank") == [0, 1, 2, 3, 4]
    assert S.drop_blocked_pages(page("ok", url="https://infosys.com/404"), "infosys").count() == 0
    assert S.drop_blocked_pages(page("ok", url="https://infosys.com/404"), "ibm_cards").count() == 1


@pytest.mark.parametrize("site", ["mckinsey", "klick", "icims", "infosys", "njoyn", "ibm_cards"])
def test_site_to_postings(page, dim, site):
    html = "<ul>" + card("Data Engineer", "Toronto", href="/job/1") + card("ETL Developer", "Ottawa", href="/job/2") * 2 + "</ul>"
    out = S.extract(page(html), site, dim, Rules.of(broad=True))
    assert out.columns[:3] == ["title", "company", "category"]
    assert {r.category for r in out.collect()} <= {"Banks"}


def test_every_selector_parses():
    for rules in [*LINKS.values(), *CARDS.values()]:
        for s in selectors_of(rules):
            assert all(p.steps and len(p.direct) == len(p.steps) - 1 for p in paths(s))
            assert all(step.tag or step.classes or step.attrs or step.nth or step.last for p in paths(s) for step in p.steps)
        if rules in LINKS.values() and anchor_only(rules):
            assert all(re.compile(t) for s in selectors_of(rules) for t in own_tag_regexes(s))


def test_tokeniser_in_sql_gives_the_same_elements(spark):
    """All selectors of all sites, over pages that hold what they look for and what they do not."""
    from hiretide.sources import selectors as css, tokeniser
    from workloads import derive as X

    names = sorted({s for rules in [*css.LINKS.values(), *css.CARDS.values()] for s in selectors_in(rules)})
    assert len(names) > 40
    pages = X.table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "html").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "<li class=job><a href=/x>T <b>x</b></a><li>y")], "page_id long, html string"))
    pages.createOrReplaceTempView("both_ways")
    tokeniser.register_sql(spark)
    listed = ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names)
    for tree in (False, True):
        sql = spark.sql(f"SELECT page_id, e.* FROM both_ways, LATERAL page_elements(html, array({listed}), {str(tree).lower()}) e")
        frame = tokeniser.with_elements(pages, "html", names, tree).selectExpr("page_id", "page_text", "explode(els) AS e").selectExpr(
            "page_id", "e.tag", "e.hits", "e.at", "e.parent", "e.n_below", "e.href",
            "trim(substring(page_text, e.t0 + 1, e.t1 - e.t0)) AS text", "e.t0", "e.t1")
        assert sorted(map(repr, sql.collect())) == sorted(map(repr, frame.collect()))


def selectors_in(rules):
    """Every selector a site's rules name, wherever it stands in them."""
    import dataclasses

    found = []

    def walk(value, name=""):
        if dataclasses.is_dataclass(value):
            for f in dataclasses.fields(value):
                walk(getattr(value, f.name), f.name)
        elif isinstance(value, (tuple, list)):
            for v in value:
                walk(v, name)
        elif isinstance(value, str) and ("selector" in name or "pattern" in name):
            found.append(value)

    walk(rules)
    return found


def test_first_matches_below_come_with_the_element(spark):
    """The places of links are found without walking over what their parents hold."""
    html = "<div>" + "".join(
        f'<p><a href="/global/en/job/{n}">Data Engineer {n}</a>' + (f'<i class="location">Toronto {n}</i>' if n % 2 else "") + "</p>" for n in range(60)
    ) + "</div>"
    selectors = ["[class*='location']", "i", "b", "a"]
    pages = spark.createDataFrame([(1, "https://s.example/x", html)], "page_id long, url string, html string")
    els = with_elements(pages, "html", selectors, True, 3).first()["els"]
    for e in els:
        below = els[e["at"] + 1:e["at"] + 1 + e["n_below"]]
        want = [next((x["at"] for x in below if n in x["hits"]), None) for n in range(3)]
        assert e["first"] == (want if any(w is not None for w in want) else None)
    rows = S.link_rows(pages, LINKS["microsoft"]).collect()
    # its own paragraph's place, else the first one of the list around it
    assert {r["url"].rsplit("/", 1)[1]: r["location"] for r in rows} == {str(n): f"Toronto {n if n % 2 else 1}" for n in range(60)}


def test_links_are_not_looked_for_ahead_of_the_companies(spark, dim):
    """No filter on the records is inferred, which would search all pages, and those left a second time."""
    from hiretide.sources import registry

    pages = spark.createDataFrame([("A", "scotiabank", 1, "https://s.example/", "<p></p>")], "company string, site string, page_id long, url string, html string")
    plan = registry.page_rows(pages, dim, "scotiabank", Rules())._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and not re.search(r"Filter [^\n]*regexp_extract_all", plan)
