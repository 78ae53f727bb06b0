import numpy as np
import pytest
from pyspark.sql import functions as F

from hiretide.llm import language_id as L
from hiretide.llm import queries

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("out"))
    want = {r["doc_id"]: r for r in docs.collect()}
    got = queries.QUERIES["op3_language_id"](spark, SF).collect()
    assert len(got) == len(want)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == want[r["doc_id"]]["out"] and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == want[r["doc_id"]]["lang"] for r in held]) > 0.97
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "es", "und"}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "the cat and the hat with that " * (1 + i % 3), "en") for i in range(40)]
    rows += [(100 + i, "der hund und die katze mit dem " * (1 + i % 3), "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "12 34", "xx"), (202, "no label", None), (203, "", "en")]
    return L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_edges(spark, model):
    rows = [(1, None, "a"), (1, "", "a"), (2, "123 !?", "a"), (3, "the hat and the cat", "a"), (3, "der hund mit der katze " * 20000, None), (None, "🙂", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    found = [r[2:] for r in L.identify(docs, model, lang="guess").collect()]
    assert [f[1] for f in found] == ["und", "und", "und", "en", "de", "und"]
    assert [f[2] for f in found][:3] == [0.0, 0.0, 0.0]
    left = L.identified_only(docs, model)
    assert left.columns == docs.columns and left.count() == 2
    assert L.identify(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    none = L.train(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert L.identify(docs, none).collect()[0]["lang_pred"] == "und"


def test_features_are_of_the_whole_text():
    own, tf = L.features("abc" * 500_000 + "z")
    counts = np.round(np.exp(tf - 1)).astype(int)
    assert counts.sum() == 3 * 1_500_001 - 3
    small, _ = L.features("ab")
    assert len(small) == 3


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        label = i % 3
        own = np.sort(np.concatenate([[label], rng.choice(np.arange(10, 3000), 5, replace=False)]))
        rows.append((own, np.ones(6) / np.sqrt(6), label))
    old = L.L1
    L.L1 = 0.5
    try:
        w = L.ftrl(rows, 3, 5, 0)
    finally:
        L.L1 = old
    right = np.mean([np.argmax(x @ w[own] + w[-1]) == y for own, x, y in rows])
    assert right == 1 and (w != 0).any(axis=1).sum() < 1500


def test_temperature_softens_what_is_too_sure():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 3000)
    sure = np.eye(3)[np.where(rng.random(3000) < 0.7, y, rng.integers(0, 3, 3000))] * 20
    t = L.fit_temperature(sure, y)
    assert t > 5 and abs(L.softmax(sure / t).max(1).mean() - 0.8) < 0.05


def test_scores_recomputed_from_the_weights(spark):
    """Plain sums over the features, ties to the first language, and output names that the input has."""
    rng = np.random.default_rng(1)
    model = L.Model(["aa", "bb", "cc"], rng.random(L.DIM) + 1, rng.normal(size=(L.DIM + 1, 3)), 1.7)
    texts = ["abc", "Abc abc", "\u00e9t\u00e9 ", "x" * 5000, "12", "", None, "abc"]
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred int, score string")
    got = L.identify(docs, model)
    assert sorted(got.columns) == ["doc_id", "lang_pred", "score", "text"]
    for r in got.collect():
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own, tf = L.features(r["text"])
        x = [float(t) * float(model.idf[f]) for f, t in zip(own, tf)]
        norm = sum(v * v for v in x) ** 0.5
        z = [(model.weights[-1][k] + sum(v / norm * model.weights[f][k] for f, v in zip(own, x))) / 1.7 for k in range(3)]
        e = [float(np.exp(v - max(z))) for v in z]
        assert r["lang_pred"] == model.languages[z.index(max(z))] and abs(r["score"] - max(e) / sum(e)) < 1e-9
    even = L.Model(["aa", "bb"], np.ones(L.DIM), np.zeros((L.DIM + 1, 2)), 1.0)
    assert even.predict("abc") == ("aa", 0.5)
