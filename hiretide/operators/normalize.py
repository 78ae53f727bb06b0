"""From extracted rows to normalised postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.functions.classify import Rules, detect_level, extract_skills
from hiretide.functions.text import first_non_empty, strip, text_or_blank
from hiretide.operators.joins import with_company
from hiretide.schemas import POSTING_COLUMNS

# Where a row came from and its place there; they order a company's rows.
LINEAGE = ["source", "fetched_at", "attempt", "page_no", "pos"]


_OPTIONAL = {"skills": "array<string>", "posted": "string", "type": "string",
             "level": "string", "url": "string", "location": "string"}


def row_columns() -> dict[str, Column]:
    """The posting fields that a row has without its company, but for the url."""
    title = text_or_blank("title")
    return {
        "title": strip(title),
        "location": first_non_empty(strip(text_or_blank("location")), F.lit(V.DEFAULT_LOCATION)),
        "level": F.coalesce(F.nullif(F.col("level"), F.lit("")), detect_level(title)),
        "type": F.coalesce(F.col("type"), F.lit("Full-time")),
        "posted": F.coalesce(F.col("posted"), F.lit("Recent")),
        "skills": F.coalesce(F.col("skills"), F.array().cast("array<string>")),
    }


def posting_columns(row: dict[str, Column], stack_limit: int | None = None) -> list[Column]:
    """The ten posting fields from a row's own and its company's attributes."""
    stack = F.col("stack") if stack_limit is None else F.slice("stack", 1, stack_limit)
    fields = row | {
        "company": F.col("company"), "category": F.col("category"), "url": text_or_blank("url"), "salary": F.col("salary"),
        "skills": F.when(F.size(row["skills"]) > 0, row["skills"]).otherwise(stack),
    }
    return [fields[c].alias(c) for c in POSTING_COLUMNS]


def _with_optional(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with every field of a posting, and the names of the columns that ride along."""
    missing = {name: F.lit(None).cast(kind) for name, kind in _OPTIONAL.items() if name not in rows.columns}
    extra = [c for c in rows.columns if c not in (*POSTING_COLUMNS, *_OPTIONAL)]
    return (rows.withColumns(missing) if missing else rows), extra


def unfinished(rows: DataFrame, lineage: list[str]) -> DataFrame:
    """Rows with the columns that ``without_company`` takes, for callers that join those of several sources with their companies at once."""
    return _with_optional(rows)[0].select("company", "title", *_OPTIONAL, *lineage)


def without_company(rows: DataFrame) -> DataFrame:
    """``unfinished`` rows with all that a posting has of itself; ``complete`` adds the rest."""
    own = row_columns()
    return rows.select(*[c for c in rows.columns if c not in own], *[c.alias(k) for k, c in own.items()])


def complete(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Postings of rows ``without_company`` that have met their company's attributes."""
    return rows.select(*posting_columns({k: F.col(k) for k in ("title", "location", "level", "type", "posted", "skills")}), *extra)


def build_posting(
    rows: DataFrame,
    dim: DataFrame,
    url: Column | None = None,
    stack_limit: int | None = None,
) -> DataFrame:
    """Normalise extracted rows and attach their company.

    A posting without skills takes its company's stack (customary limit: 5).

    ``rows`` needs company and title; location, level, type, posted, url and
    skills are optional.  Other columns ride along.  ``url`` may be given as an
    expression over the row and its company (``careers_url``), so boards whose
    links start from the company's own address need no second join.  What a row
    has of itself is worked out before the join, once, however many companies
    have its company's name.
    """
    rows, extra = _with_optional(rows)
    own = row_columns()
    joined = with_company(rows.withColumns({f"__{k}": c for k, c in own.items()}), dim)
    if url is not None:
        joined = joined.withColumn("url", url)
    return joined.select(*posting_columns({k: F.col(f"__{k}") for k in own}, stack_limit), *extra)


def posting_filter(postings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Geography and role on the normalised row."""
    return postings.filter(rules.is_geo(F.col("location")) & rules.is_role(F.col("title")))


def finish(
    rows: DataFrame,
    dim: DataFrame | None,
    rules: Rules,
    geo: bool = True,
    skills_from: str | None = None,
    url: Column | None = None,
) -> DataFrame:
    """Shared tail of every extractor: role, geography, skills, normalise.

    Filters come first, so skills are searched and the dimension is joined for
    the surviving rows only.  Without a dimension the rows stay ``unfinished``.
    """
    kept = rows.filter(rules.is_role(F.col("title")))
    if geo:
        kept = kept.filter(rules.is_geo(F.col("location")))
    if skills_from:
        kept = kept.withColumn("skills", extract_skills(skills_from)).drop(skills_from)
    if dim is None:
        return unfinished(kept, LINEAGE)
    return build_posting(kept, dim, url=url).select(*POSTING_COLUMNS, *LINEAGE)
