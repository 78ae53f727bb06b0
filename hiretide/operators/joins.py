"""Joins: company dimension, source configuration, vocabularies.

The dimension side is usually small and Catalyst broadcasts it by its
statistics.  A side too big for that has one row per key, so a company owning a
third of the postings makes one partition large, which adaptive execution
splits by its measured size; nothing is salted by a fixed number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def company_side(dim: DataFrame, *more: str) -> DataFrame:
    """What postings take from their company."""
    return dim.select(
        F.col("name").alias("company"),
        "careers_url",
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("salary_range", F.lit("")).alias("salary"),
        F.coalesce("stack", F.array().cast("array<string>")).alias("stack"),
        *more,
    )


def with_company(postings: DataFrame, dim: DataFrame) -> DataFrame:
    """Posting rows with their company's attributes; unknown companies drop out."""
    return postings.join(company_side(dim), "company")


#: Rows of a key on the small side that one task pairs with the key's other rows.
BLOCK_ROWS = 8


def join_blocks(rows: DataFrame, side: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inner join with a side whose keys may repeat.

    Rows times companies of one name can be many where neither side is large, so
    adaptive execution sees nothing to split.  The side's rows of a key are dealt
    out in blocks, a row goes to each block of its key, and blocks are joined on
    their own.  Equal rows may change their numbers, so the numbers are fixed.
    """
    order = [c for c in side.columns if c not in keys]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    blocks = side.withColumn("__block", F.floor((place - 1) / block_rows).cast("int"))
    repeated = side.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > block_rows)
    last = F.floor((F.coalesce(F.col("__n"), F.lit(1)) - 1) / block_rows).cast("int")
    dealt = rows.join(repeated, keys, "left").withColumn("__block", F.explode(F.sequence(F.lit(0), last))).drop("__n")
    return dealt.join(blocks, [*keys, "__block"]).drop("__block")


def join_source_config(df: DataFrame, cfg: DataFrame, source: str) -> DataFrame:
    """Rows with their board settings; a company without settings has no rows."""
    side = cfg.filter(F.col("source") == source).select(
        "company", "slug", "site", "location_id", "url_template", "default_location"
    )
    return df.join(side, "company")


def audit_results(dim: DataFrame, status: DataFrame, key: str = "name") -> DataFrame:
    """The dimension in its own order with each company's outcome, null where there is none."""
    return dim.join(status, key, "left")


def config_gaps(dim: DataFrame, cfg: DataFrame, sources: list[str]) -> DataFrame:
    """Companies typed for a board but without usable settings for it."""
    from hiretide.functions.urls import workday_url_parts

    typed = dim.select(F.col("name").alias("company"), F.col("scraper").alias("source"), "careers_url")
    unset = typed.filter(F.col("source").isin(sources)).join(
        cfg.filter(F.nullif("slug", F.lit("")).isNotNull()), ["company", "source"], "left_anti"
    )
    unparsed = typed.filter(
        (F.col("source") == "workday") & workday_url_parts("careers_url")["tenant"].isNull()
    )
    return (
        unset.select("company", "source", F.lit("no settings").alias("reason"))
        .unionByName(unparsed.select("company", "source", F.lit("board url does not parse").alias("reason")))
    )


def name_lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def matches_in_list(df: DataFrame, column: str, names: list[str], keep: bool) -> DataFrame:
    """Semi (keep) or anti membership in a fixed list."""
    hit = F.col(column).isin(names)
    return df.filter(hit if keep else ~F.coalesce(hit, F.lit(False)))


_GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters, found in one walk over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


#: A vocabulary of at most so many characters travels to the tasks as it is.
AUTOMATON_CHARS = 4 << 20


def match_terms(df: DataFrame, key: str, text: str, vocab: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Distinct (key, term) for every vocabulary term that is a substring of a text of the key.

    ``vocab(term)`` is user data of any size, which is measured first.  Up to
    ``automaton_chars`` characters it goes to the tasks as one automaton that
    reads each text once.  Beyond, a text has to hold every run of three
    characters of a term to hold the term, so a term waits at the run that the
    fewest texts hold (a shorter term is its own run): runs of the vocabulary are
    counted over the texts, combined before the shuffle, then texts meet the
    terms waiting at their runs.  A run that every text holds is no term's key
    unless the term has no rarer one.  Only (key, run) pairs travel to the join;
    the text is fetched back once for the pairs that met a term and is read by an
    automaton of these terms.  Either way time follows the lengths of the texts.
    Case is Spark's on both sides.
    """
    terms = vocab.select("term").filter(F.col("term") != "").distinct().withColumn("__needle", F.lower("term"))
    length = F.length("__needle")
    size = terms.agg(F.sum(length).alias("n"), F.collect_set(F.when(length < _GRAM, length)).alias("short")).first()
    lowered = df.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    schema = T.StructType([df.schema[key], vocab.schema["term"]])
    if (size["n"] or 0) <= automaton_chars:
        every = [r.asDict() for r in terms.collect()]  # bounded by what was measured
        return lowered.mapInArrow(_terms_in(key, every), schema).distinct()
    waiting = terms.withColumn("__gram", F.explode(
        F.when(length < _GRAM, F.array("__needle")).otherwise(_grams(F.col("__needle"), _GRAM))
    ))
    lowered = lowered.withColumn("__h", F.xxhash64("__t"))
    pairs = lowered.select(
        key, "__h", F.explode(F.concat(*[_grams(F.col("__t"), k) for k in [*sorted(size["short"]), _GRAM]])).alias("__gram")
    )
    held = pairs.join(waiting.select("__gram").distinct(), "__gram", "left_semi").groupBy("__gram").agg(F.count("*").alias("__n"))
    # a term with a run that no text holds is in none
    rarest = F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("r")
    side = (
        waiting.join(held, "__gram", "left").groupBy("term", "__needle").agg(rarest)
        .filter("r.n > 0").select("term", "__needle", F.col("r.__gram").alias("__gram"))
    )
    met = pairs.join(side, "__gram").groupBy(key, "__h").agg(F.collect_set(F.struct("term", "__needle")).alias("__c"))
    return lowered.join(met, [key, "__h"]).select(key, "__t", "__c").mapInArrow(_terms_in(key), schema).distinct()


def _terms_in(key: str, every: list[dict] | None = None):
    """The (key, term) that a text holds, of all terms, or of those in the third column."""
    def find(batches):
        import ahocorasick
        import pyarrow as pa

        def reader(terms):
            automaton, spelled = ahocorasick.Automaton(), {}
            for t in terms:
                spelled.setdefault(t["__needle"], []).append(t["term"])
            for needle in spelled:
                automaton.add_word(needle, needle)
            automaton.make_automaton()
            return lambda text: [t for n in {n for _, n in automaton.iter(text)} for t in spelled[n]] if spelled else []

        common = None if every is None else reader(every)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("__t").to_pylist()):
                found += (common or reader(batch.column("__c")[i].as_py()))(text)
                rows += [i] * (len(found) - len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=[key, "term"])

    return find
