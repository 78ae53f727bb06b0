"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.functions.text import col, title_case


def broaden_url(url: Column | str) -> Column:
    out = col(url)
    for old, new in V.BROADEN_PAIRS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


_WORKDAY = r"https://([^.]+)\.(wd\d+)\.myworkdayjobs\.com/([^/?]+)"


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _decode(c: Column) -> Column:
    # try_: a stray "%" leaves the text as it is instead of failing the job
    return F.coalesce(F.try_url_decode(c), c)


def query_values(url: Column | str, key: str) -> Column:
    """All non-blank values of one query key, in order, decoded."""
    values = F.regexp_extract_all(_query(col(url)), F.lit(rf"(?:^|&){key}=([^&]+)"), F.lit(1))
    return F.transform(values, _decode)


def workday_url_parts(url: Column | str) -> Column:
    """struct(tenant, wd, board, facets); the first three null if not Workday."""
    u = col(url)

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(u, _WORKDAY, i), F.lit(""))

    return F.struct(
        part(1).alias("tenant"),
        part(2).alias("wd"),
        part(3).alias("board"),
        F.struct(
            query_values(u, "locationCountry").alias("locationCountry"),
            query_values(u, "locationHierarchy").alias("locationHierarchy"),
            query_values(u, "Location_Country").alias("Location_Country"),
        ).alias("facets"),
    )


def workday_page_url(url: Column | str) -> Column:
    """The board URL without its search words; first value of each other key."""
    u = col(url)
    pairs = F.filter(
        F.transform(
            F.filter(F.split(_query(u), "&"), lambda p: p != ""),
            lambda p: F.struct(
                _decode(F.substring_index(p, "=", 1)).alias("k"),
                _decode(F.when(p.contains("="), F.regexp_replace(p, r"^[^=]*=", "")).otherwise(F.lit(""))).alias("v"),
            ),
        ),
        lambda kv: ~kv["k"].isin("q", "keywords"),
    )
    keys = F.array_distinct(F.transform(pairs, lambda kv: kv["k"]))
    first = F.transform(
        keys,
        lambda k: F.concat(
            F.url_encode(k),
            F.lit("="),
            F.url_encode(F.get(F.filter(pairs, lambda kv: kv["k"] == k), F.lit(0))["v"]),
        ),
    )
    query = F.array_join(first, "&")
    fragment = F.regexp_extract(u, r"(#.+)$", 1)
    return F.concat(
        F.regexp_extract(u, r"^([^?#]*)", 1),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        fragment,
    )


def title_from_url(url: Column | str, style: str) -> Column:
    """Title words from a link's slug, '' when the link carries none.

    ``details``: last segment below /details/{id}/.  ``ey``: first segment
    below /ey/job/.
    """
    u = col(url)
    if style == "details":
        tail = F.substring_index(F.substring_index(u, "/details/", -1), "?", 1)
        parts = F.split(tail, "/")
        slug = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))
    elif style == "ey":
        tail = F.btrim(F.substring_index(u, "/ey/job/", -1), F.lit("/"))
        slug = F.substring_index(tail, "/", 1)
    else:
        raise ValueError(f"unknown title style: {style}")
    return title_case(F.translate(slug, "-", " "))
