"""Position-table checksums and importance resampling, against zlib and brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hiretide.llm import importance as I
from hiretide.llm.common import plain_words

SCHEMA = "doc_id long, text string"


def test_checksums_of_spans_of_every_length(monkeypatch):
    rng = random.Random(2)
    buffer = bytes(rng.randrange(256) for _ in range(70_000))
    spans = [(rng.randrange(500), n) for n in [*range(1, 260), 511, 512, 513, 4096, 65_537]]
    start, length = (np.array(c) for c in zip(*spans))
    want = [zlib.crc32(buffer[a: a + n]) for a, n in spans]
    assert I.PositionCrc().of(np.frombuffer(buffer, np.uint8), start, length).tolist() == want
    monkeypatch.setattr(I, "CHUNK", 100)
    assert I.PositionCrc().of(np.frombuffer(buffer, np.uint8), start, length).tolist() == want


def brute(docs, target, max_words=1, least=20, share=10, buckets=10_000, seed=2024):
    def features(text):
        w = plain_words((text or "").encode())
        return [b" ".join(w[i: i + n]) for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]

    def buckets_of(texts):
        return Counter(zlib.crc32(f) % buckets for t in texts for f in features(t))

    s, t = buckets_of([d[1] for d in docs]), buckets_of(target)
    ss, tt = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))

    rows, able = [], []
    for at, (doc_id, text) in enumerate(docs):
        found = features(text)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None])
        if len(plain_words((text or "").encode())) >= least:
            able.append(at)
    able.sort(key=lambda i: (-rows[i][3], rows[i][0] is not None, rows[i][0] or 0))
    for rank, i in enumerate(able[: share * len(able) // 100]):
        rows[i][4] = rank + 1
    return sorted((tuple(r) for r in rows), key=repr)


def texts(n, seed=4):
    rng = random.Random(seed)
    words = ["Der", "the", "cat", "naïve", "日本" * 40, "x" * 65, "42", "data", "model", "query", "Straße"]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 19, 20, 21, 60]))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"max_words": 3, "share": 50}, {"buckets": 7, "least": 1, "share": 33}], ids=str)
def test_equals_brute_force(spark, options):
    docs = [*enumerate(texts(150)), (7, "tie " * 30), (7, "tie " * 30), (None, "no id " * 20), (500, None), (501, "!?"), (502, "w" * 100_000 + " x" * 25)]
    target = [*texts(5, 8), None, ""]
    found = I.resample(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), keep_text=False, **options)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, target, **options)


def test_edges(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert I.resample(none, target).collect() == []
    rows = [(i, "word " * 25, "keep", -1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string, rank long")
    found = I.resample(docs, target)
    assert found.columns == ["doc_id", "text", "at", "n_features", "weight", "score", "rank"]
    got = found.collect()
    assert {r["at"] for r in got} == {"keep"} and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        I.resample(docs.withColumn("score", docs["doc_id"]), target, key="score")
