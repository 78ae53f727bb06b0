"""Location rules of the individual boards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.functions.classify import is_canada
from hiretide.functions.text import (
    col,
    contains_any,
    first_non_empty,
    strip,
    text_or_blank,
)


def _ashby_is_canada(place: Column) -> Column:
    loc = F.lower(text_or_blank(place["location"]))
    return (
        F.coalesce(place["address"]["postalAddress"]["addressCountry"] == "Canada", F.lit(False))
        | (loc == "canada")
        | contains_any(loc, V.ASHBY_CITIES)
    )


def _ashby_city(place: Column) -> Column:
    return first_non_empty(place["address"]["postalAddress"]["addressLocality"], place["location"])


def _ashby_region(place: Column) -> Column:
    return text_or_blank(place["address"]["postalAddress"]["addressRegion"])


def _ashby_label(place: Column) -> Column:
    city, region = _ashby_city(place), _ashby_region(place)
    return (
        F.when((city != "") & (region != ""), F.concat(city, F.lit(", "), region, F.lit(", Canada")))
        .when(city != "", F.concat(city, F.lit(", Canada")))
        .otherwise(F.lit("Canada"))
    )


def ashby_location(job: Column | str) -> Column:
    """Canadian label of an Ashby job, '' when no listed place is Canadian.

    ``job`` is a struct with ``location``, ``address`` and
    ``secondaryLocations`` (array of the same pair).
    """
    job = col(job)
    # filter over a null array is null, and so is get on it
    second = F.get(F.filter(job["secondaryLocations"], lambda s: _ashby_is_canada(s)), F.lit(0))
    return (
        F.when(_ashby_is_canada(job), _ashby_label(job))
        .when(second.isNull(), F.lit(""))
        .when(F.lower(_ashby_city(second)) == "canada", F.lit("Canada"))
        .when(_ashby_region(second) != "", F.btrim(_ashby_label(second), F.lit(", ")))
        .otherwise(_ashby_label(second))
    )


def smartrecruiters_location(country: Column | str, full: Column | str, city: Column | str) -> Column:
    """Label, or null when the row is outside Canada."""
    full_, city_ = text_or_blank(full), text_or_blank(city)
    in_country = F.lower(text_or_blank(country)) == "ca"
    return F.when(
        in_country,
        F.when(full_ != "", full_)
        .when(city_ != "", F.concat(city_, F.lit(", Canada")))
        .otherwise(F.lit("Canada")),
    ).when(is_canada(full_), full_)


def workday_location(locations_text: Column | str, primary: Column | str, bullets: Column | str) -> Column:
    bullet = F.get(
        F.filter(
            F.coalesce(col(bullets), F.array().cast("array<string>")),
            lambda b: contains_any(b, V.WORKDAY_BULLET_TERMS),
        ),
        F.lit(0),
    )
    named = first_non_empty(locations_text, primary)
    return F.when(named != "", named).otherwise(F.coalesce(bullet, F.lit("Canada")))


def phenom_location(city: Column | str, state: Column | str) -> Column:
    city_, state_ = text_or_blank(city), text_or_blank(state)
    return (
        F.when(
            (city_ != "") & F.lower(state_).isin(V.PHENOM_PROVINCES),
            F.concat(city_, F.lit(", "), state_, F.lit(", Canada")),
        )
        .when(city_ != "", F.concat(city_, F.lit(", "), state_))
        .otherwise(F.lit("Canada"))
    )


def avature_prefix(title: Column | str) -> Column:
    """struct(title, location); location is null when the office is not Canadian."""
    t = col(title)
    code = F.upper(F.regexp_extract(t, r"^\[([^\]]*)\]", 1))
    offices = F.create_map(*[F.lit(x) for kv in V.AVATURE_OFFICES.items() for x in kv])
    tagged = t.startswith("[")
    rest = F.btrim(F.regexp_replace(t, r"^[^\]]*\]", ""), F.lit(" -–"))
    return F.struct(
        F.when(tagged, rest).otherwise(t).alias("title"),
        F.when(tagged, F.try_element_at(offices, code)).otherwise(F.lit("Canada")).alias("location"),
    )


def boc_title_location(raw_title: Column | str) -> Column:
    """struct(title, location) of "Title (City, Province)"."""
    raw = col(raw_title)
    title = F.when(raw.contains("("), strip(F.substring_index(raw, "(", 1))).otherwise(raw)
    inner = F.regexp_extract(raw, r"(?s)^[^(]*\((.*)\)", 1)
    has_pair = raw.rlike(r"(?s)^[^(]*\(.*\)")
    # ")" before "(" leaves an empty span rather than no span
    reversed_pair = raw.contains("(") & raw.contains(")")
    return F.struct(
        title.alias("title"),
        F.when(has_pair, strip(F.substring_index(inner, ",", 1)))
        .when(reversed_pair, F.lit(""))
        .otherwise(F.lit(V.BOC_LOCATION))
        .alias("location"),
    )


def amazon_location(raw: Column | str) -> Column:
    raw_ = F.coalesce(col(raw), F.lit("Canada"))
    parts = F.transform(F.split(raw_, ","), lambda p: strip(p))
    return F.when(
        F.size(parts) == 3,
        F.concat(F.get(parts, F.lit(2)), F.lit(", "), F.get(parts, F.lit(1)), F.lit(", Canada")),
    ).otherwise(raw_)


def bamboohr_location(city: Column | str, state: Column | str, country: Column | str) -> Column:
    """Label, or null when the row is outside Canada."""
    c, s, n = (strip(text_or_blank(x)) for x in (city, state, country))
    inside = (
        F.lower(n).contains("canada")
        | F.lower(s).isin(V.BAMBOO_PROVINCES)
        | F.lower(c).isin(V.BAMBOO_CITIES)
    )
    return F.when(
        inside,
        F.when((c != "") & (s != ""), F.concat(c, F.lit(", "), s, F.lit(", Canada")))
        .when(c != "", c)
        .when(s != "", s)
        .otherwise(F.lit("Canada")),
    )


def canadalife_location(raw: Column | str) -> Column:
    return F.regexp_replace(col(raw), r",\s*CA\s*$", ", Canada")
