"""First-of-group, first-n, order and chunk operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hiretide import vocab as V
from hiretide.functions.classify import level_rank
from hiretide.operators.scratch import materialise


def first_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows per group.

    Spark limits each group inside every map task before the shuffle
    (WindowGroupLimit), so a group holding a third of all rows sends at most
    ``n`` rows per task.
    """
    rn = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rn", rn).filter(F.col("__rn") <= n).drop("__rn")


def first_per_key(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return first_n(df, by, order, 1)


def first_non_empty_selector(df: DataFrame, by: list[str], ord_col: str, text: str) -> DataFrame:
    """Per group the text of the lowest selector whose text is not blank."""
    return (
        df.filter(F.coalesce(F.col(text), F.lit("")) != "")
        .groupBy(*by)
        .agg(F.min_by(text, ord_col).alias(text))
    )


def choose_pattern(matches: DataFrame, page: str, ord_col: str, hits: int, otherwise: int | None) -> DataFrame:
    """(page, ord) of the first pattern with at least ``hits`` matches.

    ``matches`` has one row per (page, pattern, element).  ``otherwise`` is the
    pattern used when none reaches it; it is not itself a candidate.  Two
    aggregations with map-side combine; elements are not shuffled.
    """
    counts = matches.groupBy(page, ord_col).agg(F.count("*").alias("n"))
    regular = F.col(ord_col) != F.lit(otherwise) if otherwise is not None else F.lit(True)
    picked = F.min(F.when(regular & (F.col("n") >= hits), F.col(ord_col)))
    fallback = (
        F.max(F.when(F.col(ord_col) == F.lit(otherwise), F.col(ord_col))) if otherwise is not None
        else F.lit(None).cast("int")
    )
    return (
        counts.groupBy(page).agg(F.coalesce(picked, fallback).alias(ord_col))
        .filter(F.col(ord_col).isNotNull())
    )


def by_level(df: DataFrame, order: list[str]) -> list[Column]:
    return [level_rank("level"), *[F.col(c) for c in order]]


def sort_by_level(df: DataFrame, order: list[str]) -> DataFrame:
    """Stable sort: level rank, then ingest order."""
    return df.orderBy(*by_level(df, order))


def number_rows(df: DataFrame, sort: list[Column], label: str = "numbered") -> DataFrame:
    """Add ``rn`` (0-based position in the global order) and ``n_total``.


    No task sorts everything: rows are range-partitioned and sorted, written with their partition and
    index, then each partition's offset (a sum over partition sizes, one row
    per partition) is added.
    """
    at = F.monotonically_increasing_id()
    rows = materialise(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .withColumn("__at", at)
        .withColumn("__part", F.shiftright("__at", 33))
        .withColumn("__idx", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__at"),
        label,
    )
    # one row per partition of the write: bounded by the partition count
    sizes = rows.groupBy("__part").agg((F.max("__idx") + 1).alias("__n"))
    everything = W.partitionBy()
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        F.sum("__n").over(everything).alias("n_total"),
    )
    return (
        rows.join(F.broadcast(offsets), "__part")
        .withColumn("rn", F.col("__off") + F.col("__idx"))
        .drop("__part", "__idx", "__off")
    )


#: Rows that are numbered together, on average.
RANGE_ROWS = 10_000


def _matching(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``side``, which has one row per value of the keys; nulls match."""
    other = side.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(other, on).drop(*[f"__k_{k}" for k in keys])


def number_by_level(df: DataFrame, order: list[str], by: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``rn`` (0-based place in level order, per group of ``by``) and ``n_total`` (rows of the group).

    Two-level prefix sums, without a written copy.  Rows fall into groups of
    level and the leading columns of ``order``, and a group into ranges of the
    first whole-number column after these, as wide as leaves some ``range_rows``
    to each, so that a company owning a third of the rows is many ranges.  Rows
    are numbered inside their range; counts per range, which combine before they
    are shuffled, are summed up inside a level, and levels inside a group.
    """
    by = by or []
    whole = {f.name for f in df.schema if f.dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")}
    line = next((c for c in order if c in whole), None)
    lead = ["__rank", *order[: order.index(line)]] if line else ["__rank", *order]
    keys = [*by, *lead]
    rows = df.withColumn("__rank", level_rank("level"))
    if line:
        span = F.max(line).cast("decimal(20,0)") - F.min(line) + 1
        width = F.greatest(F.lit(1), F.ceil(span * range_rows / F.count("*"))).cast("decimal(20,0)")
        bounds = rows.groupBy(*keys).agg(F.min(line).alias("__low"), width.alias("__width"))
        rows = _matching(rows, bounds, keys).withColumn(
            "__range", F.coalesce(F.floor((F.col(line).cast("decimal(20,0)") - F.col("__low")) / F.col("__width")).cast("long"), F.lit(-1))
        ).drop("__low", "__width")
    else:
        rows = rows.withColumn("__range", F.lit(0).cast("long"))
    ranges = rows.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    levels = ranges.groupBy(*by, "__rank").agg(F.sum("__n").alias("__m"))
    # a row a level: a handful in each group
    earlier = W.partitionBy(*by).orderBy("__rank").rowsBetween(W.unboundedPreceding, -1)
    levels = levels.select(
        *by, "__rank", F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__level_off"), F.sum("__m").over(W.partitionBy(*by)).alias("n_total")
    )
    before = W.partitionBy(*by, "__rank").orderBy(*lead[1:], "__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    offsets = _matching(offsets, levels, [*by, "__rank"])
    inside = W.partitionBy(*keys, "__range").orderBy(*order)
    placed = _matching(rows.withColumn("__at", F.row_number().over(inside) - 1), offsets, [*keys, "__range"])
    return placed.withColumn("rn", F.col("__level_off") + F.col("__off") + F.col("__at")).drop("__rank", "__range", "__at", "__off", "__level_off")


def chunk_rows(df: DataFrame, order: list[str], by: list[str] | None = None, size: int = V.CHUNK_SIZE) -> DataFrame:
    """Add ``rn``, ``chunk_no`` and ``n_chunks`` in level order, per group."""
    return (
        number_by_level(df, order, by)
        .withColumn("chunk_no", F.floor(F.col("rn") / size).cast("long"))
        .withColumn("n_chunks", F.ceil(F.col("n_total") / size).cast("long"))
        .drop("n_total")
    )


def chunk_count(df: DataFrame, by: list[str], size: int = V.CHUNK_SIZE) -> DataFrame:
    n = F.count("*")
    return df.groupBy(*by).agg(n.alias("n_rows"), F.ceil(n / size).cast("long").alias("n_chunks"))
