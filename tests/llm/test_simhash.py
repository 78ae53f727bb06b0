import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hiretide.llm import queries, simhash
from hiretide.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(fps, bits):
    """Of distinct fingerprints, by comparing all."""
    a = np.array(sorted(fps), np.uint64)
    root = list(range(len(a)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= bits) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return {int(v): find(i) for i, v in enumerate(a)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in docs}
    group = components(set(fps.values()), 4)
    least = {}
    for d, f in fps.items():
        least[group[f]] = min(d, least.get(group[f], d))
    found = queries.QUERIES["op9_simhash"](spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == least[group[fps[r["doc_id"]]]]


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 6])
@pytest.mark.parametrize("block", [2, 4096])
def test_links_of_planted_fingerprints(spark, bits, block):
    rng = random.Random(bits)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 30])):
            fps.add(base)
            if rng.random() < 0.8:
                for bit in rng.sample(range(64), rng.randint(0, bits + 2)):
                    base ^= 1 << bit
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(nodes, bits, block)).collect()}
    group = components(fps, bits)
    want = {}
    for f, g in group.items():
        want.setdefault(g, []).append(signed(f))
    for members in want.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_edges_of_input(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text, "a"), (3, text, "a"), (None, text, "b"), (9, None, None), (8, "", "c"), (7, " \t", "c"), (5, "x", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs)
    by = {}
    for r in found.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[3] + by[None]] == [3, 3, 3]
    assert sum(r["kept"] for r in by[3]) == 1 and not by[None][0]["kept"]
    assert {by[d][0]["component_id"] for d in (7, 8, 9)} == {7} and by[9][0]["fingerprint"] == "0" * 16
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 5, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    nobody = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    assert simhash.one_of_each(nobody).count() == 1 and simhash.near_duplicates(nobody).where("component_id is null").count() == 2


def test_long_texts_are_read_whole():
    words = [f"w{i}" for i in range(200_000)]
    assert simhash.fingerprint_of(" ".join(words).encode(), 4) != simhash.fingerprint_of(" ".join(words[:100_000]).encode(), 4)
    few = " ".join(words[:300])
    assert simhash.fingerprint_of(few.encode(), 4) & (2**64 - 1) == fingerprint(few)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 400)] + [(500, 500), (601, 600), (600, 601), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(51)} == {0} and {found[i] for i in range(100, 400)} == {100}
    assert found[601] == 600 and 500 not in found and None not in found
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_pairs_of_a_group_are_written(spark):
    base = random.Random(1).getrandbits(64)
    nodes = spark.createDataFrame([(signed(base ^ (1 << a) ^ (1 << b)),) for a in range(64) for b in range(a)], "fp long")
    links = simhash.fingerprint_links(nodes.distinct(), 4)
    assert connected_components(links).select("component").distinct().count() == 1
    assert links.count() < 12 * 66 * nodes.count() and links.agg(F.count("*")).first()[0] > 0
