import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiretide.llm import lm_scoring as M
from hiretide.llm import queries

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*"".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split(), "\n"]


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    c = Counter(w for d, t in docs.items() if not out[d] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = queries.QUERIES["op8_lm_scoring"](spark, SF).collect()
    assert len(got) == len(docs)
    gain = 0
    for r in got:
        own = tokens(docs[r["doc_id"]])
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[r["doc_id"]], len(own), n)
        assert r["n_known"] == sum(c[w] > 0 for w in own) and r["base_score"] == pytest.approx(base)
        assert r["score"] < 0 and math.isfinite(r["score"])
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0  # better than the baseline on what it has not seen


def test_chunks_and_ranges_do_not_change_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 7 <> 0 as learn").repartition(3)
    want = {r["doc_id"]: r for r in M.score(docs, "learn").collect()}
    some = {r["doc_id"]: r for r in M.score(docs, "learn", chunk_bytes=20_000, range_keys=3000).collect()}
    for d, r in some.items():
        assert r["n_known"] == want[d]["n_known"] and r["base_score"] == pytest.approx(want[d]["base_score"])
        assert r["score"] == pytest.approx(want[d]["score"])


def test_packing_is_exact():
    rng = np.random.default_rng(1)
    for top in (1, 2, 255, 256, 1 << 20, 1 << 40, 1 << 63):
        values = rng.integers(0, top, 1000, dtype=np.uint64, endpoint=True)
        assert M.unpacked(M.packed(values)).tolist() == values.tolist()
    assert M.unpacked(M.packed(np.empty(0, np.uint64))).tolist() == []


def test_contexts_tell(spark):
    train = ["a b c a b", "a b d", "c a b e"] * 40
    rows = [(i, t, True) for i, t in enumerate(train)] + [(1000, "a b d", False), (1001, "d b a", False), (1002, "a b never", False)]
    got = {r["doc_id"]: r["score"] for r in M.score(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), "learn").collect()}
    assert got[1000] > got[1001] > -math.inf and got[1000] > got[1002] > -math.inf


def brute_score(rows, key):
    """Whole counts, events and expectation-maximisation in plain Python; rows are (id, text, kind)."""
    def grams(text):
        w = ["\n", "\n", *tokens(text)]
        return [(tuple(w[i - 2:i + 1]), tuple(w[i - 1:i + 1]), w[i], tuple(w[i - 2:i]), w[i - 1], i == 2) for i in range(2, len(w))]

    def counts(kinds):
        three, two, one = Counter(), Counter(), Counter()
        for _, t, k in rows:
            if k in kinds:
                for g3, g2, g1, *_ in grams(t):
                    three[g3] += 1
                    two[g2] += 1
                    one[g1] += 1
        return three, two, one

    v = len(counts((0, 1))[2])

    def estimates(text, c):
        three, two, one = c
        total = sum(one.values())
        for g3, g2, g1, uv, u, first in grams(text):
            below2, below1 = (one["\n"], one["\n"]) if first else (two[uv], one[u])
            p = [three[g3] / below2 if below2 else 0, two[g2] / below1 if below1 else 0, one[g1] / total, 1 / (v + 1)]
            yield min(int(math.log2(below2 + 1)), M.BUCKETS - 1), p

    events = [e for _, t, k in rows if k == 1 for e in estimates(t, counts((0,)))]
    everywhere = M.learned(np.array([p for _, p in events]), np.ones(len(events)))
    weights = {b: M.learned(np.array([p for x, p in events if x == b]), np.ones(sum(x == b for x, _ in events))) for b in {x for x, _ in events}}
    c = counts((0, 1))
    return {i: sum(math.log10(float(weights.get(b, everywhere) @ np.array(p))) for b, p in estimates(t, c)) for i, t, _ in rows}


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "substring(text, 1, 600) text", "doc_id % 5 <> 0 as learn").limit(60)
    kind = F.when(~F.col("learn"), 2).when(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(M.PARTS)) == 0, 1).otherwise(0)
    rows = [tuple(r) for r in docs.select("doc_id", "text", kind).collect()]
    assert {k for *_, k in rows} == {0, 1, 2}
    want = brute_score(rows, "doc_id")
    for r in M.score(docs, "learn", chunk_bytes=5000, range_keys=500).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=0.02)  # events are counted together in steps


def test_edges(spark):
    rows = [(1, None, True, 5), (1, None, True, 5), (None, "", False, 6), (2, "a " * 50000, True, 7), (3, "A a\tB", None, 8), (4, "new words", False, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, known int")
    got = M.score(docs, "learn").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == 1 and by[2]["n_tokens"] == 50001 and by[3]["n_tokens"] == 4 and by[4]["n_known"] == 1
    assert by[None]["n_tokens"] == 1 and {r["known"] for r in got} == {5, 6, 7, 8, 9} and by[1]["train_tokens"] == 50003
    nothing = M.score(docs.withColumn("learn", docs.doc_id.isNull() & docs.doc_id.isNotNull()), "learn").collect()
    assert {r["train_tokens"] for r in nothing} == {0} and all(abs(r["score"]) < 1e-9 and abs(r["base_score"]) < 1e-9 for r in nothing)
    assert M.score(docs.limit(0), "learn").count() == 0
    clash = M.score(docs.withColumn("score", docs.known).withColumn("chunk", docs.known), "learn")
    assert clash.columns == ["doc_id", "learn", "known", "chunk", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {r["chunk"] for r in clash.collect()} == {5, 6, 7, 8, 9}


def test_order_of_rare_words_tells(spark):
    """Words beyond any fixed number of frequent ones: their pairs and triples are counted as well."""
    texts = [[f"w{i:04}{c}" for c in "abcdef"] for i in range(1200)]
    rows = [(i * 10 + k, " ".join(t), True) for i, t in enumerate(texts) for k in range(10)]
    asked = range(600, 1200, 60)
    rows += [(100_000 + i, " ".join(texts[i]), False) for i in asked] + [(200_000 + i, " ".join(texts[i][::-1]), False) for i in asked]
    got = {r["doc_id"]: r["score"] for r in M.score(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), "learn").collect()}
    assert all(got[100_000 + i] > got[200_000 + i] + 6 for i in asked)


def test_all_pairs_and_triples_are_counted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("text", "cast(pmod(doc_id, 3) as int) kind")
    chunks = M.deal(docs, 30_000).persist()
    want = [Counter(), Counter()]
    for r in docs.collect():
        w = ["\n", "\n", *tokens(r["text"])]
        grams = [tuple(w[i - n + 1:i + 1]) for i in range(2, len(w)) for n in (1, 2, 3)]
        want[0].update(grams if r["kind"] < 2 else [])
        want[1].update(grams if r["kind"] == 0 else [])
    told = {}
    for r in M.answers(M.requests(chunks, 64, 2, 4)).where("chunk is not null").collect():
        told.setdefault(r["chunk"], {})[r["range"]] = r
    found = 0
    for c in chunks.collect():
        own = M.Chunk(M._rows([bytes(c["rows"])])["text"].cast("binary").to_pylist(), 64)
        texts = M._rows([bytes(c["rows"])])["text"].to_pylist()
        ranges = told[c["chunk"]]
        column = "kept" if c["kind"] == M.DELETED else "n"
        words = np.concatenate([M.unpacked(ranges[r][column]) for r in sorted((r for r in ranges if r < 0), reverse=True)])
        grams = np.concatenate([M.unpacked(ranges[r][column]) for r in sorted(r for r in ranges if r >= 0)])
        at = 0
        for t in texts:
            w = ["\n", "\n", *tokens(t)]
            for i in range(2, len(w)):
                side = want[1 if column == "kept" else 0]
                assert words[own.word_at[at]] == side[(w[i],)]
                assert grams[own.pair_at[at]] == side[tuple(w[i - 1:i + 1])] and grams[own.triple_at[at]] == side[tuple(w[i - 2:i + 1])]
                at, found = at + 1, found + 1
    assert found > 10_000 and len(told) > 5
