"""Hand-written rows for every rule: at least one accept and one reject."""

import pytest
from pyspark.sql import functions as F

from hiretide.functions import classify as K
from hiretide.functions import location as L
from hiretide.functions import text as T
from hiretide.functions import urls as U
from hiretide.functions.posting import fingerprint, posting_html


def values(spark, expr, inputs, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_roles(spark):
    cases = {
        "Internal Data Engineer": False, "International Data Engineer": False, "Data Engineer Co-op": False,
        "Data Product Manager": False, "Data Engineering Managers": False, "Management Data Engineer": True,
        "Director, Data Platform": False, "VP, Data Platform": False, "MVP Data Engineer": True,
        "Head of Data Platform": False, "Pre-Sales Solutions Engineer": False, "Data Analyst": False,
        "Data Analyst / Analytics Engineer": True, "Data Analytics": True, "Data Scientist": False,
        "Data Scientist, ML Platform": True, "Delta Force Rep": True, "Ingénieur de données": True,
        "INGÉNIEUR DONNÉES": True, "Student, Data Warehouse": False, "QA Engineer": False, "": False,
        "Data Engineer (VP)": False, "Data Engineer — director": False, "étudiantmanager data engineer": True,
    }
    assert dict(zip(cases, values(spark, K.is_data_role, list(cases)))) == cases
    assert values(spark, K.is_data_role, [None]) == [False]


def test_levels(spark):
    cases = {
        "Data Engineer II": "Entry Level", "Data Engineer Level 2": "Entry Level", "Principal Data Engineer": "Staff / Lead",
        "Data Engineer Sr ": "Senior", "Data Engineer Sr": "Mid-Level", "Data Architect": "Staff / Lead",
        "Sr. Data Engineer": "Senior", "Senior Lead": "Staff / Lead", "Jr. ETL Developer": "Entry Level",
        "Intermediate Data Engineer": "Mid-Level", "Leadership Engineer": "Staff / Lead", "Data Engineer": "Mid-Level",
    }
    assert dict(zip(cases, values(spark, K.detect_level, list(cases)))) == cases


def test_geography(spark):
    cases = {
        "": False, "Remote - California; Remote - Canada": True, "Ontario, California": True, "London, UK": False,
        "London, ON": True, "Montréal": False, "St. John's": True, "CANADA": True, "Berlin": False,
    }
    assert dict(zip(cases, values(spark, K.is_canada, list(cases)))) == cases
    assert values(spark, K.is_canada, [None]) == [False]
    us = {"Austin, Texas": True, "Remote - US": True, "USA": False, "Boston USA": True, "Toronto": True, "Berlin": False}
    assert dict(zip(us, values(spark, K.is_us_or_canada, list(us)))) == us


def test_skills_keep_vocabulary_order_and_limit(spark):
    got = values(spark, K.extract_skills, ["kafka and python", "mysql", "PySpark", "none", None,
                                           "azure snowflake databricks airflow dbt sql spark"])
    assert got == [["Python", "Kafka"], ["SQL"], ["PySpark", "Spark"], [], [],
                   ["Spark", "SQL", "dbt", "Airflow", "Databricks", "Snowflake", "Azure"]]
    assert values(spark, lambda c: K.extract_skills(c, limit=2), ["sql dbt spark"]) == [["Spark", "SQL"]]


def test_rank_badge_icon(spark):
    levels = ["Staff / Lead", "Principal", "Senior", "Mid-Level", "Entry Level", "?", None]
    assert values(spark, K.level_rank, levels) == [0, 1, 2, 3, 4, 3, 3]
    assert values(spark, K.level_badge, ["Staff Senior", "senior entry", "ENTRY", "x", None]) == [
        "Staff / Lead", "Senior", "Entry Level", "Mid-Level", "Mid-Level"]
    assert values(spark, K.category_icon, ["Banks", "Gaming", None]) == ["🏦", "📁", "📁"]


def test_strip_removes_every_kind_of_space(spark):
    assert values(spark, T.strip, ["\t a b \xa0 ", "   ", "\x1fx\x85"]) == ["a b", "", "x"]


def test_fingerprint_ignores_case_only(spark):
    row = spark.createDataFrame([("A", "É", "x"), ("a", "é", "X"), ("a", "é", None)], "c string, t string, l string")
    got = [r[0] for r in row.select(fingerprint("c", "t", "l")).collect()]
    import hashlib

    assert got[0] == got[1] == hashlib.md5("a__é__x".encode()).hexdigest()
    assert got[2] == hashlib.md5("a__é__".encode()).hexdigest()


def test_avature_and_boc(spark):
    got = values(spark, L.avature_prefix, ["[NYC] Data Engineer", "[XXX] Data", "[TOR] Data Engineer", "[mtl]– Data -", "Data", "[broken"])
    assert [(g["title"], g["location"]) for g in got][2:5] == [
        ("Data Engineer", "Toronto, Ontario, Canada"), ("Data", "Montreal, Quebec, Canada"), ("Data", "Canada")]
    assert [g["location"] for g in got][:2] == [None, None] and got[5]["location"] is None
    got = values(spark, L.boc_title_location, ["Data Engineer (Ottawa, ON)", "Data Engineer", "a (b) c (d, e)", "x (y"])
    assert [tuple(g) for g in got] == [("Data Engineer", "Ottawa"), ("Data Engineer", "Ottawa"), ("a", "b) c (d"), ("x", "Ottawa")]


def test_amazon_phenom_canadalife(spark):
    assert values(spark, L.amazon_location, ["CA, ON, Toronto", "Toronto, ON", None]) == ["Toronto, ON, Canada", "Toronto, ON", "Canada"]
    pairs = [("Toronto", "ON"), ("Austin", "TX"), ("Calgary", ""), ("", "ON"), (None, None)]
    rows = spark.createDataFrame(pairs, "c string, s string").select(L.phenom_location("c", "s")).collect()
    assert [r[0] for r in rows] == ["Toronto, ON, Canada", "Austin, TX", "Calgary, ", "Canada", "Canada"]
    assert values(spark, L.canadalife_location, ["Regina, SK, CA ", "CA"]) == ["Regina, SK, Canada", "CA"]


ASHBY = "struct<location:string,address:struct<postalAddress:struct<addressCountry:string,addressLocality:string,addressRegion:string>>,secondaryLocations:array<struct<location:string,address:struct<postalAddress:struct<addressCountry:string,addressLocality:string,addressRegion:string>>>>>"


@pytest.mark.parametrize("job, label", [
    ('{"location":"Austin","secondaryLocations":[{"location":"Berlin"},{"location":"Toronto","address":{"postalAddress":{"addressRegion":"ON"}}}]}', "Toronto, ON, Canada"),
    ('{"location":"Canada"}', "Canada, Canada"),
    ('{"location":"Remote","address":{"postalAddress":{"addressCountry":"Canada","addressLocality":"Regina","addressRegion":"SK"}}}', "Regina, SK, Canada"),
    ('{"location":"Austin","secondaryLocations":[{"location":"Canada"}]}', "Canada"),
    ('{"location":"","address":{"postalAddress":{"addressCountry":"Canada"}}}', "Canada"),
    ('{"location":"Austin"}', ""),
    ('{}', ""),
])
def test_ashby(spark, job, label):
    row = spark.createDataFrame([(job,)], "t string").select(F.from_json("t", ASHBY).alias("j"))
    assert row.select(L.ashby_location("j")).first()[0] == label


def test_workday_bullets(spark):
    row = spark.createDataFrame([("", "", ["R1", "Remote - US"]), ("", None, ["x"]), (None, "Oslo", ["Toronto"]), ("", "", None)],
                                "a string, b string, c array<string>")
    assert [r[0] for r in row.select(L.workday_location("a", "b", "c")).collect()] == ["Remote - US", "Canada", "Oslo", "Canada"]


def test_urls(spark):
    got = values(spark, U.workday_url_parts, [
        "https://td.wd3.myworkdayjobs.com/Jobs?locationCountry=a&locationCountry=b", "https://x.com", "https://d.wd10.myworkdayjobs.com/en-US/D"])
    assert (got[0]["tenant"], got[0]["wd"], got[0]["board"], got[0]["facets"]["locationCountry"]) == ("td", "wd3", "Jobs", ["a", "b"])
    assert got[1]["tenant"] is None and got[2]["board"] == "en-US"
    assert values(spark, U.workday_page_url, ["https://h/p?q=a&keywords=b&c=1&c=2&d=", "https://h/p?q=a"]) == ["https://h/p?c=1&d=", "https://h/p"]
    assert values(spark, U.broaden_url, ["?q=data+engineer&keywords=data"]) == ["?q=engineer&keywords=engineer"]
    assert values(spark, lambda c: U.title_from_url(c, "details"), [
        "https://j/en/details/1/senior-data-engineer?team=X", "https://j/details/1"]) == ["Senior Data Engineer", ""]
    assert values(spark, lambda c: U.title_from_url(c, "ey"), ["https://j/ey/job/data-engineer/12/"]) == ["Data Engineer"]
    assert values(spark, T.slugify, ["  C++ / Données 2 "]) == ["c-donn-es-2"]


def test_resolve_href(spark):
    base = F.lit("https://h.example/a/b?x=1#f")
    got = values(spark, lambda c: T.resolve_href(base, c), ["/j", "j", "//o/k", "https://z", "?y", "#t", "", " /s "])
    assert got == ["https://h.example/j", "https://h.example/a/j", "https://o/k", "https://z", "https://h.example/a/b?y",
                   "https://h.example/a/b?x=1#t", "", "https://h.example/s"]


def test_posting_html_escapes(spark):
    row = spark.createDataFrame([("<b>&", "C", "Toronto", "Senior", "", "https://u?a=1&b=2", ["x"] * 7, "")],
                                "title string, company string, location string, level string, posted string, url string, skills array<string>, salary string")
    html = row.select(posting_html()).first()[0]
    assert "&lt;b&gt;&amp;" in html and html.count('class="skill"') == 7 and "a=1&amp;b=2" in html and "salary" not in html
