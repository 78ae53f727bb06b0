import hashlib
import re
import time

import numpy as np
import pytest

from hiretide.llm import decontamination as D
from hiretide.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for text in docs:
        own = words(text)
        hit, found = set(), set()
        for name, item in items:
            w = words(item)
            if not w:
                continue
            size = min(window, len(w))
            for i in range(len(w) - size + 1):
                for j in range(len(own) - size + 1):
                    if own[j] == w[i] and own[j:j + size] == w[i:i + size]:
                        hit.update(range(j, j + size))
                        found.add(name)
        out.append((len(own), len(hit), sorted(found)))
    return out


def check(spark, docs, items, window=13):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: r for r in D.contamination(d, b, window=window).collect()}
    for i, (n, hit, names) in enumerate(brute(docs, items, window)):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"], r["n_items"]) == (n, hit, names, len(names)), i
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        assert sum(s["end"] - s["first"] for s in r["spans"]) == hit


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
DOCS = [
    ITEM, f"before {ITEM.upper()} after", ITEM.replace("eta theta", "eta, theta."), " ".join(ITEM.split()[1:14]), " ".join(ITEM.split()[1:13]),
    "the of " * 200 + ITEM, "the of " * 100 + ITEM, None, "", "...", "short one", "a short one two", "one", "é à über", "1 2 3 4 5",
    ITEM + " " + ITEM, "x " + "the the the " * 9, "straße 42" * 3,
]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # everything is worked on in small parts, and the bit map is full
        monkeypatch.setattr(D, "_WINDOWS", 2)
        monkeypatch.setattr(D, "_BYTES", 50)
        monkeypatch.setattr(D, "in_map", lambda bits, keys: np.ones(len(keys), bool))
    items = [("7", ITEM), ("10", "short one"), ("9", "one"), ("11", "the " * 15), ("12", "...",), ("13", ""), ("13", None), ("14", "über É"), ("7", ITEM + " pi"), ("15", "2 3 4 5")]
    check(spark, DOCS, items)
    check(spark, DOCS, items, window=4)


def test_no_items_and_no_documents(spark):
    check(spark, DOCS, [])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert D.contamination(none, spark.createDataFrame([("1", ITEM)], "item_id string, text string")).count() == 0


def test_repeated_rows_null_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, ITEM, 5), (1, ITEM, 5), (None, "clean", None)], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(None, ITEM), (3, ITEM), (3, ITEM)], "item_id long, text string")
    left = D.clean_documents(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(None, "clean", None)]
    found = D.contamination(docs.drop("n_words"), items).collect()
    assert found[0]["items"] == ["3", "null"] and found[0]["n_items"] == 2


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_decontamination"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d, (n, hit, names) in zip(docs, brute([d["text"] for d in docs], items)):
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_rarest_shingle_leads(spark):
    item = spark.createDataFrame([("1", "a b c d e f g")], "item_id string, text string")
    windows = D.benchmark_windows(item, "item_id", "text", 5)
    keys, _ = D.Words([b"a b c d e f g"]).keys(3)
    counts = spark.createDataFrame([(int(k), 1 if i == 2 else 9) for i, k in enumerate(keys)], "key long, n long")
    got = D.prefixes(windows, counts).collect()
    assert {r["key"] for r in got} == {int(keys[2])} and sorted(r["offset"] for r in got) == [0, 1, 2]
    # a shingle that the corpus lacks: no window with it can occur
    assert D.prefixes(windows, counts.where("n < 9")).count() == 0


def test_repeated_words_are_linear(spark):
    """An item and a document of one word, repeated: one window, as many candidates as words."""
    docs = spark.createDataFrame([(1, "no " * 20_000), (2, "no " * 12)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "no " * 20_000), ("b", "no " * 13), ("c", "no " * 12)], "item_id string, text string")
    start = time.time()
    got = {r["doc_id"]: r for r in D.contamination(docs, items, keep_text=False).collect()}
    assert time.time() - start < 60
    assert (got[1]["n_hit"], got[1]["items"], got[2]["n_hit"], got[2]["items"]) == (20_000, ["a", "b", "c"], 12, ["c"])
    assert [tuple(x) for x in got[1]["spans"]] == [(0, 20_000)]


def test_bit_map(spark):
    rng = np.random.default_rng(3)
    keys, others = (rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64) for n in (5000, 50_000))
    bits = D.bit_map(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert D.in_map(bits, keys).all() and D.in_map(bits, others).mean() < 0.01
