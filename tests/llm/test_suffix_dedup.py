"""Suffix arrays and the removal of repeated strings, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hiretide.llm import suffix_dedup as D
from hiretide.llm.suffix_array import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("letters", [1, 2, 3, 20, 256])
def test_suffix_array_and_common_prefixes(letters):
    rng = random.Random(letters)
    for n in [0, 1, 2, 3, 5, 17, 40, 80]:
        for again in (False, True):
            text = bytes(rng.randrange(letters) for _ in range(n))
            text = text + text + text[: n // 2] if again else text
            order = suffix_array(np.frombuffer(text, np.uint8))
            want = sorted(range(len(text)), key=lambda i: text[i:])
            assert order.tolist() == want
            shared = common_prefixes(np.frombuffer(text, np.uint8), order)
            for a, b in zip(want, want[1:]):
                x, y = text[a:], text[b:]
                assert shared[b] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_every_window_has_one_segment_whatever_the_pieces(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab ") for _ in range(n)) for n in (0, 9, 10, 11, 300, 2000)] + [None]

    def windows(piece):
        monkeypatch.setattr(D, "PIECE", piece)
        found = Counter()
        for part in D.Anchors(10, 4).of(texts):
            for number, key, _, place in zip(*part):
                for i in range(place >> 8, (place >> 8) + (place & 255) + 1):
                    found[number, i] += 1
                    assert keys.setdefault(texts[number][i: i + 10], key) == key  # equal windows, equal anchors
        return found

    keys = {}
    want = Counter({(n, i): 1 for n, t in enumerate(texts) for i in range(len(t or b"") - 9)})
    assert windows(1 << 20) == windows(64) == want


def brute(texts, window):
    """(bytes, removed, runs, digest) of each text."""
    seen = Counter(t[i: i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i: i + window]] > 1:
                gone[i: i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    found = D.remove_repeated_bytes(docs, **options).orderBy("doc_id").collect()
    for r in found:
        if "kept" in r:
            assert hashlib.sha256(r["kept"] or b"").hexdigest() == r["kept_sha256"]
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found]


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gämma", "δέλτα", "eps", "zeta", "日本語", "x"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))

    passage, copy = prose(60), prose(120)
    texts = [prose(80) + passage + prose(rng.randrange(30)) for _ in range(12)]
    texts += [copy] * 5 + [copy[:-1], copy[5:]]  # exact and near copies
    texts += ["a" * 1000, "ab" * 300, "a" * 199, "a" * 200, "", None, prose(3)]  # runs, and texts just at the window
    texts += [prose(20) + "=" * 450 + passage[:150] + passage]  # overlaps, repeated inside one text
    return texts


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000}, {"most": 3}, {"window": 60, "anchor": 20}], ids=str)
def test_equals_brute_force(spark, options):
    texts = corpus()
    want = brute([(t or "").encode() for t in texts], options.get("window", 200))
    assert run(spark, texts, **options) == want
    assert sum(w[1] for w in want) > 5000


def test_the_query(spark, tmp_path):
    from hiretide.llm.queries import QUERIES

    texts = corpus(9)
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_suffix_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == brute([(t or "").encode() for t in texts], 200)


def test_long_text_and_clean_ones(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(300_000))
    texts = [long, long[1000:1500], "clean " * 3, long[-200:], long[-199:]]
    assert run(spark, texts, shard_bytes=1 << 14) == brute([t.encode() for t in texts], 200)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert D.remove_repeated_bytes(none).collect() == []
    rows = [(None, None, 1, "a"), (None, None, 1, "a"), (1, "x" * 250, 2, "b"), (1, "x" * 250, 2, "b"), (2, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed long, h string")
    found = D.remove_repeated_bytes(docs)
    assert found.columns == ["doc_id", "h", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted(((r["doc_id"], r["kept"], r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in found.collect()), key=str)
    assert got == sorted([(None, None, 0, 0, 0, "a")] * 2 + [(1, b"", 250, 250, 1, "b")] * 2 + [(2, b"", 0, 0, 0, None)], key=str)
    with pytest.raises(ValueError):
        D.remove_repeated_bytes(docs, window=400, anchor=48)
