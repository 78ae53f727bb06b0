"""Expressions over a normalised posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiretide.functions.classify import level_badge
from hiretide.functions.text import escape_html, text_or_blank


def fingerprint(company: Column | str, title: Column | str, location: Column | str) -> Column:
    parts = [F.lower(text_or_blank(c)) for c in (company, title, location)]
    return F.md5(F.concat_ws("__", *parts))


def posting_html(skills_limit: int | None = None) -> Column:
    """One posting as an HTML fragment, from the posting columns of the row; customary limit: 5 skills."""

    def text(name: str) -> Column:
        return escape_html(text_or_blank(name))

    def optional(name: str, before: str, after: str) -> Column:
        return F.when(
            text_or_blank(name) != "", F.concat(F.lit(before), text(name), F.lit(after))
        ).otherwise(F.lit(""))

    skills = F.coalesce(F.col("skills"), F.array().cast("array<string>"))
    pills = F.array_join(
        F.transform(
            skills if skills_limit is None else F.slice(skills, 1, skills_limit),
            lambda s: F.concat(F.lit('<span class="skill">'), escape_html(s), F.lit("</span>")),
        ),
        "",
    )
    return F.concat(
        F.lit('<div class="posting"><b>'), text("title"), F.lit("</b>"),
        F.lit('<span class="badge">'), level_badge("level"), F.lit("</span>"),
        optional("salary", '<span class="salary">', "</span>"),
        F.lit('<div class="meta">'), text("company"), F.lit(" · "), text("location"),
        F.lit(" · Full-time"), optional("posted", " · ", ""), F.lit("</div>"),
        F.when(pills != "", F.concat(F.lit('<div class="skills">'), pills, F.lit("</div>"))).otherwise(F.lit("")),
        optional("url", '<a href="', '">Apply</a>'),
        F.lit("</div>"),
    )
