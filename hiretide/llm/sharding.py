"""Sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; a row's
fractional rank is (rank + 1/2) / rows of its source.  Sorted by it, the sources
interleave in proportion, so any stretch of the order has the mixture of the
whole.  The order is cut into shards of equal row counts (at most one apart).

Both rankings are two-level and never order a source or the whole in one task:
hash values and fractional ranks fall into ranges of like size, counts per range
are summed up, in blocks of ranges and then over the blocks, and rows are numbered
inside their range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiretide.llm.common import positional, restored
from hiretide.operators.scratch import materialise

SHARDS = 24
SEED = 7
#: Rows in one range of the two orderings, on average.
RANGE_ROWS = 10_000


#: Ranges whose counts are summed up in one group.
BLOCK_RANGES = 1024


def _running(counts: DataFrame, *by: str) -> DataFrame:
    """(by.., g, n) with ``before``, the sum of n over lower g of the same group, and ``of``, the group's sum."""
    dealt = counts.withColumn("block", F.expr(f"g div {BLOCK_RANGES}"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.col(c) for c in by] or [F.lit(0)]
    blocks = dealt.groupBy(*by, "block").agg(F.sum("n").alias("n")).select(
        *[F.col(c).alias(f"{c}_") for c in by], F.col("block").alias("block_"),
        F.coalesce(F.sum("n").over(earlier(*whole).orderBy("block")), F.lit(0)).alias("below"),
        F.sum("n").over(Window.partitionBy(*whole)).alias("of"),
    )
    inside = F.coalesce(F.sum("n").over(earlier(*by, "block").orderBy("g")), F.lit(0))
    same = F.col("block") == F.col("block_")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    return dealt.withColumn("inside", inside).join(blocks, same).select(*by, "g", (F.col("below") + F.col("inside")).alias("before"), "of")


def interleaved_shards(rows: DataFrame, key: str = "doc_id", source: str = "source", shards: int = SHARDS,
                       seed: int = SEED, range_rows: int = RANGE_ROWS, tie: str | None = None) -> DataFrame:
    """Every row with ``shard`` (0 to shards - 1), ``slot`` (gapless from 0 in its shard) and ``rank_fraction``.

    Null sources are one source, null and repeated keys are shuffled by ``tie`` as well; rows alike in key, source
    and tie are interchangeable.  With fewer rows than shards, some shards are empty.  An empty table gives none.
    Columns named like an output are replaced by it; key, source and tie may be among them.
    """
    plain, names = positional(rows)
    key, source = names[key], names[source]
    ties = [names[tie]] if tie else []
    shuffle = F.xxhash64(F.lit(seed), key, *ties)
    total = rows.count()
    ranges = max(1, -(-total // range_rows))
    width = min((1 << 63) // ranges + 1, (1 << 63) - 1)
    dealt = materialise(
        plain.withColumn("hash", F.shiftrightunsigned(shuffle, 1)).withColumn("range", F.expr(f"hash div {width}L")), "shuffled"
    )
    # rank within the source
    per_range = _running(dealt.groupBy(F.col(source).alias("s"), F.col("range").alias("g")).agg(F.count("*").alias("n")), "s")
    order = Window.partitionBy(source, "range").orderBy("hash", key, *ties)
    ranked = (
        dealt.withColumn("place", F.row_number().over(order) - 1)
        .join(per_range, F.col(source).eqNullSafe(F.col("s")) & (F.col("range") == F.col("g")))
        .withColumn("rank_fraction", (2 * (F.col("before") + F.col("place")) + 1) / (2 * F.col("of")))
        .select(*plain.columns, "hash", "rank_fraction")
        .withColumn("range", F.floor(F.col("rank_fraction") * ranges).cast("bigint"))
    )
    ranked = materialise(ranked, "ranked")
    # place in the whole order; one count per range
    per_range = _running(ranked.groupBy(F.col("range").alias("g")).agg(F.count("*").alias("n")))
    order = Window.partitionBy("range").orderBy("rank_fraction", source, "hash", key, *ties)
    placed = ranked.withColumn("place", F.row_number().over(order) - 1).join(per_range, F.col("range") == F.col("g"))
    place = F.col("before") + F.col("place")
    # the first (total mod shards) shards hold one row more
    small, more = divmod(total, shards)
    edge = more * (small + 1)
    later = F.floor((place - edge) / max(small, 1))
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(more + later)
    slot = F.when(place < edge, place % (small + 1)).otherwise((place - edge) % max(small, 1))
    placed = placed.select(*plain.columns, "rank_fraction", shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))
    return restored(placed, names, ["rank_fraction", "shard", "slot"])
