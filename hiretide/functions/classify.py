"""Row classifiers: geography, role, seniority, skills.  Columns in, Column out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.functions.text import col, contains_any, let, text_or_blank


def is_canada(location: Column | str) -> Column:
    return contains_any(location, V.CANADA_TERMS)


def is_us_or_canada(location: Column | str) -> Column:
    return contains_any(location, V.CANADA_TERMS + V.US_TERMS)


def is_data_role(title: Column | str) -> Column:
    t = F.lower(text_or_blank(title))
    words = r"(?U)\b(" + "|".join(V.ROLE_REJECT_WORDS) + r")\b"
    rejected = (
        contains_any(t, V.ROLE_REJECT_SUBSTRINGS + V.ROLE_REJECT_PHRASES)
        | t.rlike(words)
        | (t.contains(V.ROLE_ANALYST) & ~t.contains(V.ROLE_ANALYST_EXEMPT))
    )
    return ~rejected & contains_any(t, V.ROLE_ACCEPT)


def detect_level(title: Column | str) -> Column:
    """Seniority from the raw (unstripped) title; first matching band wins."""
    (top, top_terms), *rest = V.LEVEL_TERMS
    out = F.when(contains_any(title, top_terms), F.lit(top))
    for level, terms in rest:
        out = out.when(contains_any(title, terms), F.lit(level))
    return out.otherwise(F.lit(V.LEVEL_DEFAULT))


def extract_skills(
    text: Column | str,
    vocabulary: list[str] | None = None,
    limit: int | None = None,
) -> Column:
    """Vocabulary terms found as substrings, vocabulary order; customary limit: 6.

    The whole text is lowercased once and bound; mentioning ``lower(text)`` in
    every test would redo it per term.
    """
    names = vocabulary or V.SKILLS

    def found(lowered: Column) -> Column:
        hits = [F.when(lowered.contains(s.lower()), F.lit(s)) for s in names]
        named = F.array_compact(F.array(*hits))
        return named if limit is None else F.slice(named, 1, limit)

    return let(F.lower(text_or_blank(text)), found)


def level_rank(level: Column | str) -> Column:
    out = None
    for name, rank in V.LEVEL_ORDER.items():
        cond = col(level) == name
        out = F.when(cond, F.lit(rank)) if out is None else out.when(cond, F.lit(rank))
    return out.otherwise(F.lit(V.LEVEL_ORDER_DEFAULT))


def level_badge(level: Column | str) -> Column:
    l = F.lower(text_or_blank(level))
    return (
        F.when(l.contains("staff") | l.contains("lead"), F.lit("Staff / Lead"))
        .when(l.contains("senior"), F.lit("Senior"))
        .when(l.contains("entry"), F.lit("Entry Level"))
        .otherwise(F.lit("Mid-Level"))
    )


def category_icon(category: Column | str) -> Column:
    pairs = [F.lit(x) for kv in V.CATEGORY_ICONS.items() for x in kv]
    # try_element_at: a category outside the table is a miss, not an error
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), col(category)),
        F.lit(V.CATEGORY_ICON_DEFAULT),
    )


@dataclass(frozen=True)
class Rules:
    """The two replaceable predicates every extractor applies."""

    is_role: Callable[[Column], Column] = is_data_role
    is_geo: Callable[[Column], Column] = is_canada

    @classmethod
    def of(cls, broad: bool = False, include_us: bool = False) -> "Rules":
        return cls(
            is_role=(lambda title: F.lit(True)) if broad else is_data_role,
            is_geo=is_us_or_canada if include_us else is_canada,
        )
