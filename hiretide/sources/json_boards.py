"""Boards that answer with JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.functions import location as L
from hiretide.functions.classify import Rules
from hiretide.functions.text import first_non_empty, text_or_blank
from hiretide.functions.urls import workday_url_parts
from hiretide.operators.joins import join_source_config
from hiretide.operators.normalize import LINEAGE, finish
from hiretide.sources.payloads import items

KEYS = ["company", *LINEAGE]


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _variant_text(v: Column, field: str) -> Column:
    """A field of the object shape, or the value itself if it is a scalar."""
    return F.when(_is_object(v), F.try_variant_get(v, f"$.{field}", "string")).otherwise(
        F.try_variant_get(v, "$", "string")
    )


def greenhouse(raw: DataFrame, dim: DataFrame, cfg: DataFrame, rules: Rules = Rules()) -> DataFrame:
    j = F.col("j")
    rows = items(raw, "greenhouse", lambda b: b["jobs"]).select(
        *KEYS,
        text_or_blank(j["title"]).alias("title"),
        text_or_blank(_variant_text(j["location"], "name")).alias("location"),
        j["absolute_url"].alias("url"),
        j["content"].alias("text"),
    )
    return _configured(rows, cfg, "greenhouse", dim, rules, skills_from="text")


def lever(raw: DataFrame, dim: DataFrame, cfg: DataFrame, rules: Rules = Rules()) -> DataFrame:
    j = F.col("j")
    rows = items(raw, "lever", lambda b: b).select(
        *KEYS,
        text_or_blank(j["text"]).alias("title"),
        text_or_blank(j["categories"]["location"]).alias("location"),
        j["hostedUrl"].alias("url"),
        F.concat_ws(" ", text_or_blank(j["descriptionPlain"]), text_or_blank(j["additionalPlain"])).alias("text"),
    )
    return _configured(rows, cfg, "lever", dim, rules, skills_from="text")


def ashby(raw: DataFrame, dim: DataFrame, cfg: DataFrame, rules: Rules = Rules()) -> DataFrame:
    j = F.col("j")
    rows = items(raw, "ashby", lambda b: b["jobs"]).select(
        *KEYS,
        text_or_blank(j["title"]).alias("title"),
        L.ashby_location(j).alias("location"),
        first_non_empty(j["jobUrl"], j["applyUrl"]).alias("url"),
        first_non_empty(j["descriptionPlain"], j["descriptionHtml"]).alias("text"),
    ).filter("location <> ''")
    # its own country test replaces the shared one
    return _configured(rows, cfg, "ashby", dim, rules, geo=False, skills_from="text")


def smartrecruiters(raw: DataFrame, dim: DataFrame, cfg: DataFrame, rules: Rules = Rules()) -> DataFrame:
    j = F.col("j")
    place = j["location"]
    full = text_or_blank(place["fullLocation"])
    rows = items(raw, "smartrecruiters", lambda b: b["content"]).select(
        *KEYS,
        text_or_blank(j["name"]).alias("title"),
        F.coalesce(
            L.smartrecruiters_location(place["country"], full, place["city"]),
            F.when(rules.is_geo(full), full),
        ).alias("location"),
        text_or_blank(j["id"]).alias("job_id"),
    ).filter(F.col("location").isNotNull() & rules.is_role(F.col("title")))
    rows = join_source_config(rows, cfg, "smartrecruiters").withColumn(
        "url",
        F.when(
            F.col("job_id") != "",
            F.concat(F.lit(V.SMARTRECRUITERS_JOB), F.col("slug"), F.lit("/"), F.col("job_id")),
        ).otherwise(F.lit("")),
    )
    return finish(rows.select(*KEYS, "title", "location", "url"), dim, rules, geo=False)


def workday(raw: DataFrame, dim: DataFrame, cfg: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """Board host and path come from the company's own careers URL."""
    j = F.col("j")
    rows = items(raw, "workday", lambda b: b["jobPostings"]).select(
        *KEYS,
        text_or_blank(j["title"]).alias("title"),
        L.workday_location(j["locationsText"], j["primaryLocation"], j["bulletFields"]).alias("location"),
        text_or_blank(j["externalPath"]).alias("path"),
        j["postedOn"].alias("posted"),
    ).filter(rules.is_role(F.col("title")) & rules.is_geo(F.col("location")))
    parts = workday_url_parts("careers_url")
    board = F.concat(
        F.lit("https://"), parts["tenant"], F.lit("."), parts["wd"],
        F.lit(".myworkdayjobs.com/"), parts["board"],
    )
    boards = dim.withColumn("__tenant", parts["tenant"]).filter("__tenant is not null").drop("__tenant")
    url = F.when(F.col("path") != "", F.concat(board, F.col("path"))).otherwise(F.col("careers_url"))
    return finish(rows, boards, rules, geo=False, url=url)


def oracle_hcm(raw: DataFrame, dim: DataFrame, cfg: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``slug`` is the tenant's domain, ``site`` its site number."""
    j = F.col("j")
    rows = items(raw, "oracle_hcm", lambda b: F.get(b["items"], F.lit(0))["requisitionList"]).filter(
        F.col("j")["PrimaryLocationCountry"] == "CA"
    ).select(
        *KEYS,
        text_or_blank(j["Title"]).alias("title"),
        F.coalesce(j["PrimaryLocation"], F.lit("Canada")).alias("location"),
        text_or_blank(j["Id"]).alias("job_id"),
        F.nullif(j["PostedDate"], F.lit("")).alias("posted"),
    ).filter(rules.is_role(F.col("title")))
    rows = join_source_config(rows, cfg, "oracle_hcm")
    url = F.when(
        F.col("job_id") != "",
        F.concat(
            F.lit("https://"), F.col("slug"), F.lit("/hcmUI/CandidateExperience/en/sites/"),
            F.col("site"), F.lit("/requisitions/"), F.col("job_id"),
        ),
    ).otherwise(F.col("careers_url"))
    return finish(rows, dim, rules, geo=False, url=url)


def amazon(raw: DataFrame, dim: DataFrame, cfg: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """No geography test here; the normalised row is tested later."""
    j = F.col("j")
    path = text_or_blank(j["job_path"])
    rows = items(raw, "amazon", lambda b: b["jobs"]).select(
        *KEYS,
        text_or_blank(j["title"]).alias("title"),
        L.amazon_location(j["location"]).alias("location"),
        F.when(path != "", F.concat(F.lit(V.AMAZON_HOST), path)).otherwise(F.lit("")).alias("url"),
        j["posted_date"].alias("posted"),
    )
    return finish(rows, dim, rules, geo=False)


def netflix(raw: DataFrame, dim: DataFrame, cfg: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    j = F.col("j")
    rows = items(raw, "netflix", lambda b: b["positions"]).select(
        *KEYS,
        text_or_blank(j["name"]).alias("title"),
        F.coalesce(j["location"], F.lit("Canada")).alias("location"),
        j["canonicalPositionUrl"].alias("url"),
    )
    return finish(rows, dim, rules)


def ibm(raw: DataFrame, dim: DataFrame, cfg: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    j = F.col("j")
    rows = items(raw, "ibm", lambda b: F.coalesce(b["jobs"], b["results"])).select(
        *KEYS,
        first_non_empty(j["title"], j["jobTitle"]).alias("title"),
        first_non_empty(j["location"], j["primaryLocation"], F.lit("Canada")).alias("location"),
        first_non_empty(j["url"], j["applyUrl"], F.concat(F.lit(V.IBM_JOB), text_or_blank(j["jobId"]))).alias("url"),
    )
    return finish(rows, dim, rules)


def meta(raw: DataFrame, dim: DataFrame, cfg: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    j = F.col("j")
    rows = items(raw, "meta", lambda b: b["data"]["job_search_with_featured_jobs"]["all_jobs"]).select(
        *KEYS,
        text_or_blank(j["title"]).alias("title"),
        F.coalesce(F.get(F.filter(j["locations"], rules.is_geo), F.lit(0)), F.lit("Canada")).alias("location"),
        F.concat(F.lit(V.META_JOB), text_or_blank(j["id"]), F.lit("/")).alias("url"),
    )
    return finish(rows, dim, rules, geo=False)


def bamboohr(raw: DataFrame, dim: DataFrame, cfg: DataFrame, rules: Rules = Rules()) -> DataFrame:
    j = F.col("j")

    def field(name: str) -> Column:
        return F.try_variant_get(j["location"], f"$.{name}", "string")

    rows = items(raw, "bamboohr", lambda b: b["result"]).select(
        *KEYS,
        first_non_empty(
            _variant_text(j["jobOpeningName"], "label"), _variant_text(j["title"], "label")
        ).alias("title"),
        L.bamboohr_location(field("city"), field("state"), field("country")).alias("location"),
        text_or_blank(j["id"]).alias("job_id"),
    ).filter(F.col("location").isNotNull() & rules.is_role(F.col("title")))
    rows = join_source_config(rows, cfg, "bamboohr").withColumn(
        "url",
        F.concat(F.lit("https://"), F.col("slug"), F.lit(".bamboohr.com/careers/"), F.col("job_id")),
    )
    return finish(rows.select(*KEYS, "title", "location", "url"), dim, rules, geo=False)


def _configured(rows, cfg, source, dim, rules, geo=True, skills_from=None) -> DataFrame:
    """Filter first, then keep the companies that have settings for the board."""
    kept = rows.filter(rules.is_role(F.col("title")))
    if geo:
        kept = kept.filter(rules.is_geo(F.col("location")))
    sided = cfg.filter((F.col("source") == source) & (text_or_blank("slug") != "")).select("company")
    kept = kept.join(sided, "company", "left_semi")
    return finish(kept, dim, rules, geo=False, skills_from=skills_from)

