import zlib
from collections import Counter

import pytest

from hiretide.llm import queries, sharding

SF = "/root/testdata/sf0.01"


def verify(rows, shards, total):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(0 <= s < shards for s in by)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_sharding"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    verify(rows, 24, len(docs))
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "rows" and r["grown_shard"] is None
    # every shard has the mixture of the whole, to a row or two a source
    whole = Counter(r["source"] for r in rows)
    for s in range(24):
        own = Counter(r["source"] for r in rows if r["shard"] == s)
        for source, n in whole.items():
            assert abs(own[source] - n / 24) <= 2


@pytest.mark.parametrize("range_rows", [7, 1000])
def test_order_against_brute_force(spark, range_rows):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(400)] + [(None, None)] * 5 + [(1, "hot")] * 4
    frame = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    got = sharding.interleaved_shards(frame, shards=6, range_rows=range_rows).collect()
    verify(got, 6, len(rows))
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ranks = [r["rank_fraction"] for r in ordered]
    assert ranks == sorted(ranks)
    of = Counter(s for _, s in rows)
    for source, n in of.items():
        assert sorted(r["rank_fraction"] for r in got if r["source"] == source) == pytest.approx([(2 * i + 1) / (2 * n) for i in range(n)])


def test_same_order_however_the_rows_lie(spark):
    rows = [(i, f"s{i % 4}") for i in range(300)]
    a, b = (
        {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleaved_shards(spark.createDataFrame(x, "doc_id long, source string"), range_rows=n).collect()}
        for x, n in ((rows, 50), (rows[::-1], 120))
    )
    assert a == b
    other = sharding.interleaved_shards(spark.createDataFrame(rows, "doc_id long, source string"), seed=8).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in other} != a


def test_edges(spark):
    schema = "doc_id long, source string, hash_ int, range_ int, place_ int"
    assert sharding.interleaved_shards(spark.createDataFrame([], schema)).count() == 0
    few = sharding.interleaved_shards(spark.createDataFrame([(1, "a", 4, 5, 6), (2, None, 4, 5, 6)], schema), shards=5).collect()
    assert sorted(r["shard"] for r in few) == [0, 1] and {(r["hash_"], r["range_"], r["place_"]) for r in few} == {(4, 5, 6)}


def test_counts_are_summed_up_over_blocks_of_ranges(spark, monkeypatch):
    """The same order, however many ranges a block has; null sources are one."""
    frame = spark.createDataFrame([(i, None if i % 5 == 0 else f"s{i % 3}") for i in range(300)], "doc_id long, source string")
    whole = sorted(map(tuple, sharding.interleaved_shards(frame, shards=7, range_rows=1000).collect()))
    monkeypatch.setattr(sharding, "BLOCK_RANGES", 3)
    got = sorted(map(tuple, sharding.interleaved_shards(frame, shards=7, range_rows=9).collect()))
    assert got == whole


def test_input_columns_named_like_outputs_are_replaced(spark):
    rows = [(i, "a", 0.5, i + 7, "x", i, i) for i in range(30)]
    schema = "doc_id long, source string, rank_fraction double, shard long, slot string, n long, g long"
    got = sharding.interleaved_shards(spark.createDataFrame(rows, schema), shards=4)
    assert got.columns == ["doc_id", "source", "n", "g", "rank_fraction", "shard", "slot"]
    verify(got.collect(), 4, 30)
    # a key that is called like an output still shuffles
    keyed = sharding.interleaved_shards(spark.createDataFrame(rows, schema), key="shard", shards=4)
    verify(keyed.collect(), 4, 30)
