"""String helpers shared by every expression module."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiretide.functions.entities import unescape

# Every character a Unicode-aware strip removes; Spark's own trim only drops
# the space character.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
# A run of them.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def text_or_blank(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_non_empty(*cols: Column | str) -> Column:
    """First value that is neither null nor the empty string, else ''."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit(""))


def any_term_regex(terms: Iterable[str]) -> str:
    """One pattern that finds any of the literals.

    Terms share their prefixes, so at each position of the text the matcher
    looks at a handful of first letters instead of at every term.
    """
    tree: dict = {}
    for term in terms:
        node = tree
        for char in term:
            node = node.setdefault(char, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        # once a term ends here, longer ones add nothing to a yes/no test
        if "" in node:
            return ""
        options = [quote_regex(char) + pattern(below) for char, below in node.items()]
        return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"

    return pattern(tree)


def contains_any(c: Column | str, terms: Iterable[str]) -> Column:
    """True when the lowercased text holds any term; null text is false.

    One compiled pattern stays inside whole-stage codegen, where a chain of
    ORed ``contains`` over 89 terms would not fit one generated method.
    """
    return F.coalesce(F.lower(col(c)).rlike(any_term_regex(terms)), F.lit(False))


def slugify(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def title_case(c: Column | str) -> Column:
    """Capitalise each run of letters ("3d-artist" -> "3D-Artist")."""
    return F.array_join(
        F.transform(
            F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)),
            lambda w: F.initcap(w),
        ),
        "",
    )


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def tag_text(c: Column | str) -> Column:
    """Visible text of an HTML fragment: tags out, whitespace collapsed."""
    bare = F.regexp_replace(col(c), r"(?s)<[^>]*>", " ")
    return strip(F.regexp_replace(unescape(bare), SPACES, " "))


def resolve_href(base: Column | str, href: Column | str) -> Column:
    """Absolute URL of a link found on a page (what a browser reports)."""
    base, href = col(base), strip(href)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    directory = F.when(
        no_query.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*$"), F.concat(no_query, F.lit("/"))
    ).otherwise(F.regexp_extract(no_query, r"^(.*/)", 1))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href == "", F.lit(""))
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .otherwise(F.concat(directory, href))
    )


def quote_regex(literal: str) -> str:
    """Escape a literal for a Java regular expression."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", literal)
