"""The digest: one row per chunk of at most 50 new postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.functions.classify import category_icon
from hiretide.functions.posting import posting_html
from hiretide.functions.text import escape_html


def _count_level(part: str) -> Column:
    return F.count_if(F.coalesce(F.col("level"), F.lit("")).contains(part))


def digest_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    return chunks.groupBy(*by).agg(
        F.count("*").alias("total"),
        _count_level("Senior").alias("senior"),
        _count_level("Mid").alias("mid"),
        _count_level("Entry").alias("entry"),
    )


def digest_by_category(chunks: DataFrame, by: list[str], order: str = "rn") -> DataFrame:
    """Per chunk and category: count, first appearance, titles in order.

    A chunk holds at most 50 rows, which bounds the ordered collection.
    """
    category = F.coalesce("category", F.lit(V.CATEGORY_DEFAULT))
    return (
        chunks.withColumn("category", category)
        .groupBy(*by, "category")
        .agg(
            F.count("*").alias("n"),
            F.min(order).alias("first_rn"),
            F.array_sort(F.collect_list(F.struct(F.col(order), F.col("title")))).alias("__t"),
        )
        .withColumn("titles", F.array_join(F.transform("__t", lambda t: t["title"]), " | "))
        .drop("__t")
    )


def subject(label: Column, total: Column, run_date: Column) -> Column:
    return F.format_string(V.SUBJECT_NEW, label, total, run_date)


def digest(chunks: DataFrame, by: list[str], run_label: Column, run_date: Column, n_companies: int) -> DataFrame:
    """(by.., n_chunks, subject, total, senior, mid, entry, html) per chunk.

    Totals are the sums of the category sections, so the rows are grouped once.
    """
    rows = chunks.withColumn("category", F.coalesce("category", F.lit(V.CATEGORY_DEFAULT))).withColumn("html", posting_html())
    levels = {"senior": "Senior", "mid": "Mid", "entry": "Entry"}
    sections = rows.groupBy(*by, "n_chunks", "category").agg(
        F.min("rn").alias("first_rn"), F.count("*").alias("n"),
        *[_count_level(part).alias(name) for name, part in levels.items()],
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rn", "html"))), lambda r: r["html"]), ""
        ).alias("body"),
    ).withColumn(
        "section",
        F.concat(
            F.lit('<h3>'), category_icon("category"), F.lit(" "), escape_html("category"),
            F.lit(" ("), F.col("n").cast("string"), F.lit(" jobs)</h3>"), F.col("body"),
        ),
    )
    found = sections.groupBy(*by, "n_chunks").agg(
        F.sum("n").alias("total"), *[F.sum(name).alias(name) for name in levels],
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("first_rn", "section"))), lambda s: s["section"]), ""
        ).alias("html"),
    )
    label = F.concat(
        run_label,
        F.when(
            F.col("n_chunks") > 1,
            F.concat(F.lit(" ("), (F.col("chunk_no") + 1).cast("string"), F.lit("/"), F.col("n_chunks").cast("string"), F.lit(")")),
        ).otherwise(F.lit("")),
    )
    head = F.concat(
        F.lit("<div><h1>New data engineering postings</h1><p>"), F.col("total").cast("string"),
        F.lit(f" postings not seen before, from a watch list of {n_companies}</p><p>Total "), F.col("total").cast("string"),
        F.lit(" · Senior "), F.col("senior").cast("string"), F.lit(" · Mid-Level "), F.col("mid").cast("string"),
        F.lit(" · Entry Level "), F.col("entry").cast("string"), F.lit("</p>"),
    )
    return found.select(
        *by, "n_chunks", subject(label, F.col("total"), run_date).alias("subject"), "total", "senior", "mid", "entry",
        F.concat(head, F.col("html"), F.lit("</div>")).alias("html"),
    )


def empty_digest(runs: DataFrame, run_label: Column, run_date: Column, n_companies: int) -> DataFrame:
    """The "no new jobs" row of runs that emitted nothing."""
    zero = F.lit(0).cast("long")
    return runs.select(
        "*",
        zero.alias("chunk_no"), zero.alias("n_chunks"),
        F.format_string(V.SUBJECT_NONE, run_label, run_date).alias("subject"),
        zero.alias("total"), zero.alias("senior"), zero.alias("mid"), zero.alias("entry"),
        F.lit(
            "<div><h1>No new postings</h1>"
            f"<p>Nothing changed at the {n_companies} on the watch list.</p></div>"
        ).alias("html"),
    )


def write_digest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
