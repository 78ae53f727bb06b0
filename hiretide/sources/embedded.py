"""Postings embedded in page source, found by regular expression.

Each page is handled inside its own row: matches become an array, duplicates
go while it is still an array, and only then are rows produced.  No shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.functions import location as L
from hiretide.functions.classify import Rules
from hiretide.functions.text import first_non_empty, let, slugify, strip, text_or_blank
from hiretide.operators.joins import join_source_config
from hiretide.operators.normalize import LINEAGE, finish
from hiretide.sources.payloads import ok_payloads

KEYS = ["company", *LINEAGE]

# --- fixed values: patterns of the embedded data ----------------------------
PHENOM_SEQ = r'"jobSeqNo"\s*:\s*"(?=[^"]+")'
SHOPIFY_RECORD = r'\\"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\",\\"[^\\"]+\\",\\"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\",\\"\d{4}-\d{2}-\d{2}\\",\\"https://www\.shopify\.com/careers\?ashby_jid='
CANADALIFE_LINK = r'<a href="(/job/[^"]+" class="jobTitle-link">[^<]+)</a>'
CANADALIFE_PLACE = r'<span class="jobLocation">\s*([^<]+?)\s*</span>'


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_by(records: Column, key: str) -> Column:
    """First record per key of an array of structs, order kept.

    Sorted by (key, place) a first record is one whose predecessor has another
    key; sorted back by place the order is as it was.
    """

    def pick(by_key: Column) -> Column:
        firsts = F.filter(by_key, lambda x, i: (i == 0) | ~x["k"].eqNullSafe(F.get(by_key, i - 1)["k"]))
        placed = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r"))))
        return F.transform(placed, lambda x: x["r"])

    keyed = F.transform(records, lambda r, i: F.struct(r[key].alias("k"), i.alias("i"), r.alias("r")))
    return let(F.array_sort(keyed), pick)


def _last_value(piece: Column, field: str) -> Column:
    return text_or_blank(F.try_element_at(_all(piece, rf'"{field}"\s*:\s*"([^"]+)"', 1), F.lit(-1)))


def phenom(raw: DataFrame, dim: DataFrame, cfg: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Records by their jobSeqNo; title, city and state stand before it.

    The body is cut once at the keys.  A record's fields are the last of their
    kind in the piece before its key, however far that reaches.
    """

    def records(pieces: Column) -> Column:
        def record(piece: Column, i: Column) -> Column:
            return F.struct(F.substring_index(piece, '"', 1).alias("seq_no"), F.get(pieces, i - 1).alias("w"))

        return first_by(F.slice(F.transform(pieces, record), 2, F.greatest(F.size(pieces) - 1, F.lit(0))), "seq_no")

    def fields(r: Column) -> Column:
        place = L.phenom_location(_last_value(r["w"], "city"), _last_value(r["w"], "state"))
        return F.struct(r["seq_no"].alias("seq_no"), _last_value(r["w"], "title").alias("title"), place.alias("location"))

    found = let(F.split("body", PHENOM_SEQ), records)
    rows = (
        ok_payloads(raw, "phenom")
        .select("source", "company", "fetched_at", "attempt", "page_no", F.posexplode(F.transform(found, fields)).alias("pos", "r"))
        .select(*KEYS, "r.seq_no", "r.title", "r.location")
        .filter((F.col("title") != "") & rules.is_role(F.col("title")) & rules.is_geo(F.col("location")))
    )
    url = F.replace(
        F.replace(F.col("url_template"), F.lit("{jobSeqNo}"), F.col("seq_no")), F.lit("{slug}"), slugify("title")
    )
    rows = join_source_config(rows, cfg, "phenom").withColumn("url", url)
    return finish(rows.select(*KEYS, "title", "location", "url"), dim, rules, geo=False)


def shopify(raw: DataFrame, dim: DataFrame, cfg: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """Records of the escaped page data; one scan of the body finds them whole."""

    def fields(record: Column) -> Column:
        parts = F.split(record, r'\\",\\"', 3)
        return F.struct(F.substr(parts[0], F.lit(3)).alias("uuid"), parts[1].alias("title"))

    records = first_by(F.transform(_all(F.col("body"), SHOPIFY_RECORD, 0), fields), "uuid")
    rows = (
        ok_payloads(raw, "shopify")
        .select("source", "company", "fetched_at", "attempt", "page_no", F.posexplode(records).alias("pos", "j"))
        .select(
            *KEYS, F.col("j")["title"].alias("title"),
            F.lit(V.SHOPIFY_LOCATION).alias("location"),
            F.concat(F.lit(V.SHOPIFY_CAREERS + "/"), slugify(F.col("j")["title"]), F.lit("_"), F.col("j")["uuid"]).alias("url"),
        )
    )
    return finish(rows, dim, rules, geo=False)


def canadalife(raw: DataFrame, dim: DataFrame, cfg: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """Links, each with the first place that stands after it, however far.

    The body is cut before every place, so a link's place opens the next piece.
    """

    def records(pieces: Column) -> Column:
        def links(piece: Column, i: Column) -> Column:
            place = F.regexp_extract(text_or_blank(F.get(pieces, i + 1)), "^" + CANADALIFE_PLACE, 1)

            def link(found: Column) -> Column:
                parts = F.split(found, '" class="jobTitle-link">', 2)
                return F.struct(parts[0].alias("path"), parts[1].alias("title"), place.alias("place"))

            return F.transform(_all(piece, CANADALIFE_LINK, 1), link)

        return first_by(F.flatten(F.transform(pieces, links)), "path")

    title = F.col("j")["title"]
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        title = F.replace(title, F.lit(entity), F.lit(char))
    found = let(F.split("body", f"(?={CANADALIFE_PLACE})"), records)
    rows = (
        ok_payloads(raw, "canadalife")
        .select("source", "company", "fetched_at", "attempt", "page_no", F.posexplode(found).alias("pos", "j"))
        .select(
            *KEYS, strip(title).alias("title"),
            L.canadalife_location(first_non_empty(strip(F.col("j")["place"]), F.lit("Canada"))).alias("location"),
            F.concat(F.lit(V.CANADALIFE_HOST), F.col("j")["path"]).alias("url"),
        )
    )
    return finish(rows, dim, rules)
