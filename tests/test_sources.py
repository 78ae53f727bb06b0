"""Payloads by hand: shapes, gaps, broken bodies, quirks."""

import json
import re
import time

from pyspark.sql import functions as F

from hiretide.functions.classify import Rules
from hiretide.sources import feeds, json_boards, payloads, registry
from hiretide.sources.embedded import canadalife, phenom, shopify


def titles(df, *cols):
    return [tuple(r) for r in df.orderBy("page_no", "pos").select("title", *cols).collect()]


def test_greenhouse_location_shapes(payload, dim, cfg):
    body = {"jobs": [
        {"title": "Data Engineer", "location": {"name": "Toronto"}, "absolute_url": "u1", "content": "<p>dbt</p>"},
        {"title": "Data Engineer", "location": "Ottawa, Canada"},
        {"title": "Data Engineer", "location": {"id": 1, "city": "Canada"}},
        {"title": "Data Engineer"}, {"location": "Toronto"},
    ]}
    got = json_boards.greenhouse(payload("greenhouse", json.dumps(body), "not json", "[]"), dim, cfg)
    assert titles(got, "location", "url", "skills") == [
        ("Data Engineer", "Toronto", "u1", ["dbt"]), ("Data Engineer", "Ottawa, Canada", "", ["Azure", "SQL"])]


def test_unknown_company_or_settings_give_no_rows(payload, dim, cfg):
    body = json.dumps([{"text": "Data Engineer", "categories": {"location": "Toronto"}}])
    for company, n in (("A", 1), ("B", 0), ("nobody", 0)):
        assert json_boards.lever(payload("lever", body, company=company), dim, cfg).count() == n


def test_bamboohr_title_shapes(payload, dim, cfg):
    place = {"city": "Toronto", "state": "ON", "country": None}
    body = json.dumps({"result": [
        {"id": "1", "jobOpeningName": "Data Engineer", "location": place},
        {"id": "2", "title": {"label": "ETL Developer"}, "location": place},
        {"id": "3", "jobOpeningName": "", "title": "SQL Developer", "location": {"city": "Regina", "country": "CANADA"}},
        {"id": "4", "title": "Data Engineer", "location": "Toronto"}, {"id": "5", "title": "Data Engineer", "location": None},
    ]})
    got = json_boards.bamboohr(payload("bamboohr", body), dim, cfg)
    assert titles(got, "location", "url") == [
        ("Data Engineer", "Toronto, ON, Canada", "https://slug-a.bamboohr.com/careers/1"),
        ("ETL Developer", "Toronto, ON, Canada", "https://slug-a.bamboohr.com/careers/2"),
        ("SQL Developer", "Regina", "https://slug-a.bamboohr.com/careers/3")]


def test_ibm_empty_jobs_key_wins(payload, dim, cfg):
    job = {"jobTitle": "Data Engineer", "jobId": "7"}
    got = json_boards.ibm(payload("ibm", json.dumps({"jobs": [], "results": [job]}), json.dumps({"results": [job]})), dim)
    assert titles(got, "page_no", "location") == [("Data Engineer", 1, "Canada")]


def test_broad_and_us_rules(payload, dim, cfg):
    body = json.dumps({"positions": [{"name": "Cook", "location": "Toronto"}, {"name": "Data Engineer", "location": "Boston"}]})
    raw = payload("netflix", body)
    assert titles(json_boards.netflix(raw, dim)) == []
    assert titles(json_boards.netflix(raw, dim, None, Rules.of(broad=True))) == [("Cook",)]
    assert titles(json_boards.netflix(raw, dim, None, Rules.of(include_us=True))) == [("Data Engineer",)]


def test_feeds(payload, dim, cfg):
    good = ("<rss><channel><item><title> [TOR] - Data Engineer </title><link>u</link></item>"
            "<item><title>[NYC] Data Engineer</title></item><item><link>x</link></item></channel></rss>")
    got = feeds.avature(payload("avature", good, good[:-20], "<rss/>"), dim, cfg)
    assert titles(got, "location", "url", "page_no") == [("Data Engineer", "Toronto, Ontario, Canada", "u", 0)]
    deep = ("<a><b><c><item><title><![CDATA[Data Engineer (Ottawa, ON)]]></title><link>u</link></item></c></b>"
            "<item x='1'><title>ETL &amp; BI Developer</title></item><item><title>Ing&#233;nieur de donn&#xE9;es</title></item></a>")
    got = feeds.boc_rss(payload("boc_rss", deep, deep[:-9]), dim)
    assert titles(got, "location", "url") == [("Data Engineer", "Ottawa", "u"), ("ETL & BI Developer", "Ottawa", ""), ("Ingénieur de données", "Ottawa", "")]


def test_phenom_fields_stand_before_their_key(payload, dim, cfg):
    html = ('{"title":"Data Engineer","city":"Toronto","state":"ON","pad":"' + "x" * 5000 + '","jobSeqNo":"R.1"},'
            '{"title":"ETL Developer","city":"Ottawa","state":"ON","jobSeqNo" : "R.2"},{"jobSeqNo":"R.1"},{"jobSeqNo":""}')
    got = phenom(payload("phenom", html, "", "no record"), dim, cfg)
    assert titles(got, "location", "url") == [
        ("Data Engineer", "Toronto, ON, Canada", "https://a.example/R.1/data-engineer"),
        ("ETL Developer", "Ottawa, ON, Canada", "https://a.example/R.2/etl-developer")]


def test_phenom_time_follows_the_body(payload, dim, cfg):
    def took(n):
        record = '{{"title":"Data Engineer {0}","city":"Toronto","state":"ON","jobSeqNo":"R{0}"}},' + " " * 200
        raw = payload("phenom", "".join(record.format(i) for i in range(n))).cache()
        raw.count()
        start = time.time()
        assert phenom(raw, dim, cfg).count() == n
        return time.time() - start

    took(2000)
    assert took(8000) < 4 * took(2000) + 6


def test_shopify_first_per_uuid(payload, dim):
    u1, u2 = "0" * 8 + "-0000-0000-0000-" + "0" * 12, "1" * 8 + "-0000-0000-0000-" + "0" * 12

    def record(u, title):
        return rf'\"{u}\",\"{title}\",\"{u2}\",\"2024-01-01\",\"https://www.shopify.com/careers?ashby_jid={u}\"'

    long = "SQL Developer" + " x" * 200
    html = record(u1, "Data Engineer") + record(u1, "ETL Developer") + record(u2, long) + record(u2, "SQL Developer")
    got = shopify(payload("shopify", html), dim)
    assert titles(got, "url") == [("Data Engineer", f"https://www.shopify.com/careers/data-engineer_{u1}"),
                                  (long, f"https://www.shopify.com/careers/sql-developer{'-x' * 200}_{u2}")]


def test_canadalife_place_is_the_next_one_however_far(payload, dim):
    link = '<a href="/job/{0}" class="jobTitle-link">{1}</a>'
    place = '<span class="jobLocation"> {} </span>'
    html = (link.format(1, "Data Engineer &amp; more") + place.format("Regina, SK, CA") + link.format(1, "Data Engineer")
            + link.format(2, "ETL Developer") + "x" * 3001 + place.format("Berlin")
            + link.format(3, "ETL Developer") + "\n" + link.format(4, "SQL Developer") + "x" * 3001 + place.format("Toronto") + link.format(5, "SQL Developer"))
    assert titles(canadalife(payload("canadalife", html), dim), "location", "url") == [
        ("Data Engineer & more", "Regina, SK, Canada", "https://jobs.canadalife.com/job/1"),
        ("ETL Developer", "Toronto", "https://jobs.canadalife.com/job/3"),
        ("SQL Developer", "Toronto", "https://jobs.canadalife.com/job/4"),
        ("SQL Developer", "Canada", "https://jobs.canadalife.com/job/5")]


def plan(spark, source, pages, **limits):
    rows = [("A", i, status, n, total) for i, (status, n, total) in enumerate(pages)]
    facts = spark.createDataFrame(rows, "company string, page_no int, status int, n_items long, total long")
    kept = payloads.assemble_pages(facts, payloads.page_plan(facts, source, **limits), ["company"])
    return sorted(r.page_no for r in kept.collect())


def test_page_assembly(spark):
    full = (200, 100, 250)
    assert plan(spark, "smartrecruiters", [full, full, full, full]) == [0, 1, 2]
    assert plan(spark, "smartrecruiters", [full, (500, 0, 0), full]) == [0]
    assert plan(spark, "amazon", [(404, 0, 0)]) == []
    assert plan(spark, "amazon", [full, (200, 0, 250), full])[:1] == [0]
    # a total that shrinks on a later page ends the loop there
    assert plan(spark, "amazon", [(200, 100, 900), (200, 100, 150), full]) == [0, 1]
    # the first total counts; the customary five pages only if asked for
    pages = [(200, 25, 1000)] + [(200, 25, 1)] * 8
    assert plan(spark, "oracle_hcm", pages) == list(range(9)) and plan(spark, "oracle_hcm", pages, max_pages=5) == [0, 1, 2, 3, 4]
    # one failed page discards everything
    assert plan(spark, "netflix", [(200, 50, 120), (500, 0, 0)]) == []
    assert plan(spark, "netflix", [(200, 50, 60), (200, 10, 60), (500, 0, 0)]) == [0, 1]
    assert plan(spark, "workday", [(200, 20, 60), (200, 20, 60), (403, 0, 0)]) == []
    assert plan(spark, "workday", [(200, 0, 0)]) == [0]


def test_attempts(spark):
    cfg = spark.createDataFrame([("Geotab", "geo-tab"), ("X", "a-b")], "company string, slug string")
    got = [(r.company, r.attempt, r.slug) for r in payloads.slug_candidates(cfg).collect()]
    assert got == [("Geotab", 0, "geo-tab"), ("X", 0, "a-b"), ("X", 1, "ab"), ("X", 2, "a-binc"), ("X", 3, "a-bhq")]
    raw = spark.createDataFrame([("X", 0, 404, "a"), ("X", 1, 200, ""), ("X", 2, 200, "b"), ("Y", 0, 500, "c")],
                                "company string, attempt int, status int, body string")
    assert [r.attempt for r in payloads.pick_attempt(raw, raw, ["company"]).collect()] == [1]


def named(dim, name, scraper="custom"):
    return dim.filter("name = 'A'").withColumn("name", F.lit(name)).withColumn("scraper", F.lit(scraper))


PAGE = "company string, site string, page_id long, url string, html string"


def test_fallback_only_when_unanswered(spark, payload, dim, cfg):
    empty = payload("ibm", json.dumps({"jobs": []}), company="IBM Canada")
    down = payload("ibm", "oops", status=503, company="IBM Canada")
    card = '<li class="job-card"><h3><a href="/x">{}</a></h3></li>'
    page = "<ul>" + card.format("Data Engineer") + card.format("ETL Developer") + "</ul>"
    pages = spark.createDataFrame([("IBM Canada", "ibm_cards", 1, "https://i.example/", page)], PAGE)
    for raw, n in ((empty, 0), (down, 2)):
        assert registry.all_sources(raw, pages, named(dim, "IBM Canada"), cfg, sources=["ibm"], sites=[]).count() == n


def test_unparseable_workday_page_falls_back(spark, payload, dim, cfg):
    good = json.dumps({"total": 1, "jobPostings": [{"title": "Data Engineer", "locationsText": "Toronto"}]})
    card = '<li data-automation-id="jobItem"><a data-automation-id="jobTitle" href="/job/1">ETL Developer</a></li>'
    pages = spark.createDataFrame([("A", "workday_cards", 1, "https://w.example/", card)], PAGE)
    for body, want in ((good, ["Data Engineer"]), ("<html>sorry</html>", ["ETL Developer"])):
        got = registry.all_sources(payload("workday", body), pages, dim, cfg, sources=["workday"], sites=[])
        assert [r.title for r in got.collect()] == want


def test_first_answered_attempt_counts(spark, payload, dim, cfg):
    body = json.dumps({"jobs": [{"title": "Data Engineer", "location": "Toronto"}]})
    raw = payload("greenhouse", body, company="X")
    several = (raw.withColumn("status", F.lit(404)).unionByName(raw.withColumn("attempt", F.lit(1)))
               .unionByName(raw.withColumn("attempt", F.lit(2))))
    got = registry.all_sources(several, None, named(dim, "X", "greenhouse"), cfg.withColumn("company", F.lit("X")), sources=["greenhouse"])
    assert [(r.title, r.attempt) for r in got.collect()] == [("Data Engineer", 1)]


def test_only_the_routed_extractor_reads_a_company(spark, payload, dim, cfg):
    jobs = json.dumps({"jobs": [{"title": "Data Engineer", "location": "Toronto"}]})
    for company, scraper, n in (("X", "greenhouse", 1), ("X", "lever", 0), ("X", "custom", 0), ("Shopify", "greenhouse", 0)):
        raw = payload("greenhouse", jobs, company=company)
        got = registry.all_sources(raw, None, named(dim, company, scraper), cfg.withColumn("company", F.lit(company)))
        assert got.count() == n, (company, scraper)


def test_bad_payloads(payload):
    raw = payload("lever", "[]", "{oops").unionByName(payload("ibm", "{}", status=404))
    assert sorted(r.reason for r in payloads.bad_payloads(raw).collect()) == ["not json", "status 404"]


def test_union_of_everything_has_one_schema(payload, dim, cfg):
    got = registry.all_sources(payload("lever", "[]"), None, dim, cfg)
    assert got.count() == 0 and "skills" in got.columns
    assert got.filter(F.col("title") == "x").count() == 0


def test_bodies_are_read_once_for_facts_and_once_a_source(spark, payload, dim, cfg, tmp_path):
    payload("greenhouse", "{}").unionByName(payload("workday", "{}")).write.parquet(f"{tmp_path}/raw")
    raw = payloads.read_payloads(spark, f"{tmp_path}/raw")
    sources = ["greenhouse", "workday", "smartrecruiters", "ibm"]
    got = registry.all_sources(raw, None, dim, cfg, sources=sources)
    def bodies(df):
        return len(re.findall(r"FileScan parquet \[[^\]]*body#", df._jdf.queryExecution().executedPlan().toString()))

    assert bodies(got) == len(sources) and bodies(payloads.payload_facts(raw)) == 1


def test_feed_items_in_comments_and_cdata_do_not_count(payload, dim, cfg):
    item = "<item><title>Data Engineer (Ottawa, ON)</title><link>{}</link></item>"
    body = ("<?xml version='1.0'?><?note " + item.format("in-note") + "?><rss><!-- " + item.format("in-comment") + " <![CDATA[ -->"
            "<channel><about><![CDATA[<!-- " + item.format("in-cdata") + "]]></about>" + item.format("a")
            + "<item/><item ><title>Data <!-- no -->Engineer <![CDATA[& <b>BI</b> (Toronto, ON)]]></title><link><![CDATA[b?x=1&y=2]]></link></item >"
            + "<item><title/><link>none</link></item></channel></rss>")
    got = feeds.boc_rss(payload("boc_rss", body), dim, cfg)
    assert [r["url"] for r in got.orderBy("pos").collect()] == ["a", "b?x=1&y=2"]
    assert got.orderBy("pos").collect()[1]["title"].startswith("Data Engineer &")
    long = "<rss>" + "<!-- x < y -->" * 40000 + item.format("z") + "</rss>"
    start = time.time()
    assert [r["url"] for r in feeds.boc_rss(payload("boc_rss", long), dim, cfg).collect()] == ["z"]
    assert time.time() - start < 20


def test_bodies_of_companies_routed_elsewhere_are_not_parsed(spark, payload, dim, cfg):
    from hiretide.functions.classify import Rules
    from hiretide.sources import registry

    raw = payload("netflix", '{"count":1,"positions":[{"name":"Data Engineer","location":"Toronto"}]}').unionByName(
        payload("netflix", '{"count":1,"positions":[{"name":"Data Engineer","location":"Toronto"}]}', company="unknown"))
    rows = registry.from_payloads(raw, dim, cfg, "netflix", Rules(), facts=None)
    assert [r["company"] for r in rows.collect()] == ["A"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    parsed = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert any("LeftSemi" in line for line in plan[parsed:])  # under the parsing: ahead of it


def test_companies_are_joined_once_for_all_sources(payload, dim, cfg):
    """One join with what is read and two with the companies, however many sources there are."""
    for sources in (["netflix"], ["amazon", "netflix", "ibm", "meta", "shopify", "canadalife"]):
        got = registry.all_sources(payload("netflix", "{}"), None, dim, cfg, sources=sources)
        joins = re.findall(r"\bJoin\b", got._jdf.queryExecution().optimizedPlan().toString())
        assert len(joins) == 3, sources


def test_every_company_of_a_name_and_its_settings(spark, payload, dim, cfg):
    """A name that 20 companies and 3 settings have: all of them, in blocks."""
    jobs = json.dumps({"result": [{"id": i, "jobOpeningName": "Data Engineer", "location": {"city": "Toronto"}} for i in range(5)]})
    one = named(dim, "Vendasta")
    many = one.crossJoin(spark.range(20)).withColumn("category", F.concat(F.lit("c"), F.col("id") % 10)).drop("id")
    settings = cfg.filter("source = 'bamboohr'").withColumn("company", F.lit("Vendasta")).crossJoin(spark.range(3)).withColumn(
        "slug", F.concat(F.lit("s"), F.col("id"))).drop("id")
    got = registry.all_sources(payload("bamboohr", jobs, company="Vendasta"), None, many, settings)
    rows = got.groupBy("category", "url").count().collect()
    assert len(rows) == 10 * 15 and {r["count"] for r in rows} == {2}


def test_blocks_join_as_a_join_does(spark):
    from hiretide.operators.joins import join_blocks

    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "k string, r int")
    side = spark.createDataFrame([("a", i // 2) for i in range(7)] + [("b", 1), ("d", 2), (None, 3)], "k string, s int")
    got = join_blocks(rows, side, ["k"], block_rows=2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(side, ["k"]).collect()))
