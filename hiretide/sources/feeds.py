"""RSS feeds.

Records are built inside the generator, so the role and location predicates
below it work on finished columns instead of parsing the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide.functions import location as L
from hiretide.functions.classify import Rules
from hiretide.functions.entities import unescape
from hiretide.functions.text import strip, text_or_blank
from hiretide.operators.normalize import LINEAGE, finish
from hiretide.sources.payloads import ok_payloads

KEYS = ["company", *LINEAGE]
# The item list is only trusted when the whole document is well formed.
_CHANNEL = "struct<channel: struct<item: array<struct<title: string, link: string>>>, _corrupt_record: string>"
_WHOLE = "struct<_corrupt_record: string>"


def _records(raw: DataFrame, source: str, records: Column) -> DataFrame:
    """(keys.., r) per record struct of each well-formed feed."""
    return ok_payloads(raw, source).select(
        "source", "company", "fetched_at", "attempt", "page_no", F.posexplode(records).alias("pos", "r")
    )


def avature(raw: DataFrame, dim: DataFrame, cfg: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """channel/item; the office is a bracket prefix of the title.

    The role test runs on the title with and without its prefix.
    """
    doc = F.from_xml("body", _CHANNEL)

    def record(i: Column) -> Column:
        full = strip(text_or_blank(i["title"]))
        return F.struct(
            full.alias("full_title"), L.avature_prefix(full).alias("p"), strip(text_or_blank(i["link"])).alias("url")
        )

    raw = raw.withColumn("x", doc)
    items = F.when(F.col("x")["_corrupt_record"].isNull(), F.transform(F.col("x")["channel"]["item"], record))
    rows = (
        _records(raw, "avature", items)
        .select(*KEYS, "r.full_title", "r.p.title", "r.p.location", "r.url")
        .filter((F.col("full_title") != "") & F.col("location").isNotNull())
        .filter(rules.is_role(F.col("full_title")) & rules.is_role(F.col("title")))
        .drop("full_title")
    )
    hosts = cfg.filter((F.col("source") == "avature") & (text_or_blank("slug") != "")).select("company")
    rows = rows.join(hosts, "company", "left_semi")
    return finish(rows, dim, rules, geo=False)


#: Comments, instructions, CDATA sections and what lies between them, in the order of a well-formed document.
_PARTS = r"(?s)(<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|[^<]+|<)"


def _elements_only(body: Column) -> Column:
    """The document without comments and instructions, CDATA sections written with entities.

    In what comes out of a well-formed document every ``<`` begins a tag, so an item that
    is only spoken of in a comment or a CDATA section is none.
    """
    def plain(part: Column) -> Column:
        literal = F.substring(part, F.lit(10), F.length(part) - 12)
        escaped = F.replace(F.replace(literal, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        return (
            F.when(part.startswith("<!--") | part.startswith("<?"), "")
            .when(part.startswith("<![CDATA["), escaped)
            .otherwise(part)
        )

    marked = body.contains("<!") | body.contains("<?")
    parts = F.regexp_extract_all(body, F.lit(_PARTS), F.lit(1))
    return F.when(marked, F.array_join(F.transform(parts, plain), "")).otherwise(body)


def _child(item: Column, tag: str) -> Column:
    """Text of the first such child element up to an element inside it, entities undone."""
    inner = F.regexp_extract(item, rf"(?s)<{tag}(?:\s[^>]*)?(?<!/)>([^<]*)", 1)
    return strip(unescape(inner))


def boc_rss(raw: DataFrame, dim: DataFrame, cfg: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """Items at any depth; "Title (City, Province)"."""
    items = F.regexp_extract_all(
        _elements_only(F.col("body")), F.lit(r"(?s)(<item(?:\s[^>]*)?(?<!/)>.*?</item\s*>)"), F.lit(1)
    )

    def record(i: Column) -> Column:
        return F.struct(L.boc_title_location(_child(i, "title")).alias("p"), _child(i, "link").alias("url"))

    well_formed = F.from_xml("body", _WHOLE)["_corrupt_record"].isNull()
    rows = _records(raw, "boc_rss", F.when(well_formed, F.transform(items, record)))
    return finish(rows.select(*KEYS, "r.p.title", "r.p.location", "r.url"), dim, rules, geo=False)
