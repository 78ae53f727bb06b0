import numpy as np
from pyspark.sql import functions as F

from hiretide.llm import queries
from hiretide.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.join(labels, "doc_id").selectExpr("doc_id", "text", "quality = 0 as low_quality", "toxic = 1 as toxic").withColumn("out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    chain = X.train(rows.where("not out"), ["low_quality", "toxic"])
    got = X.predict(rows.where("out").withColumnRenamed("toxic", "is_toxic").withColumnRenamed("low_quality", "is_low"), chain).toPandas()
    toxic = got[got.is_toxic]
    assert len(toxic) > 50 and toxic.toxic.mean() > 0.85 and got[~got.is_toxic].toxic.mean() < 0.01  # some labels have no trace in the text
    assert (got.is_low == got.low_quality).mean() > 0.88
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_toxicity"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id", suffixes=("_label", ""))
    assert ((labels.toxic_label == 1) == labels.toxic).mean() > 0.95


def test_later_models_see_out_of_fold_predictions(spark):
    """The first category is noise that a model can learn by heart: in its fold it would tell the second, out of it not."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        noise = bool(rng.random() < 0.5)
        rows.append((i, f"word{i % 50} own{i} own{i} pad{i % 7}", noise, noise))
    frame = spark.createDataFrame(rows, "doc_id long, text string, a boolean, b boolean")
    chain = X.train(frame, ["a", "b"])
    assert chain.weights[1][len(chain.place) + X.STYLES] < 1


def test_chain_passes_probabilities_on(spark):
    rows = [(i, ("bad " if i % 2 else "good ") * 5 + f"x{i}", i % 2 == 1, i % 2 == 1) for i in range(200)]
    chain = X.train(spark.createDataFrame(rows, "doc_id long, text string, a boolean, b boolean"), ["a", "b"])
    assert chain.probabilities(b"bad bad")[1] > 0.9 > 0.1 > chain.probabilities(b"good")[1]
    assert chain.weights[1][len(chain.place) + X.STYLES] > 0


def test_edges(spark):
    rows = [(1, None, True, None), (1, "", False, True), (2, "bad", True, True), (2, "bad", True, True), (3, "fine " * 100000, False, False), (None, "é ü", None, False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, a boolean, b boolean")
    chain = X.train(frame, ["a", "b"])
    got = X.predict(frame.select("doc_id", "text"), chain).collect()
    assert len(got) == len(rows) and all(0 <= r["a_prob"] <= 1 and 0 <= r["b_prob"] <= 1 for r in got)
    empty = X.train(frame.limit(0), ["a"])
    assert {r["a_prob"] for r in X.predict(frame.select("text", "doc_id"), empty).collect()} == {0.5}
    assert X.predict(frame.select("text").limit(0), chain).count() == 0


def test_sample_is_bounded_under_repeated_ids(spark):
    """An id, and a text, that holds half of the rows: each is in the sample, and the sample keeps its bound."""
    rows = [(5 if i % 2 else i, f"text {i}", i % 3 == 0) for i in range(8000)]
    few = [(5 if i % 2 else i, "text" if i % 2 else f"text {i}", i % 3 == 0) for i in range(8000)]
    for seed in range(3):
        for some, hot in ((rows, 0.3), (few, 0.0)):
            frame = spark.createDataFrame([(k + seed, t, y) for k, t, y in some], "doc_id long, text string, a boolean").repartition(8)
            got = [r["text"] for r in X._sampled(frame, ["a"], "text", "doc_id", 1000).collect()]
            assert (800 if hot else 400) <= len(got) <= 1000
            own = sum(t != "text" and int(t.split()[1]) % 2 for t in got)
            assert own >= hot * len(got) and got.count("text") <= 10
    assert X._sampled(frame, ["a"], "text", "doc_id", 8000).count() == 8000


def test_ties_and_input_columns_named_like_outputs(spark):
    """Zero weights give one half everywhere; a probability at its threshold is positive."""
    chain = X.Chain(["a", "b"], {})
    chain.weights = [np.zeros(X.STYLES + k + 1) for k in range(2)]
    chain.thresholds = [0.5, 0.6]
    docs = spark.createDataFrame([(1, "words", "x", 3), (1, "words", "x", 3), (2, None, "y", 4)], "doc_id long, text string, a string, b_prob int")
    got = X.predict(docs, chain)
    assert sorted(got.columns) == ["a", "a_prob", "b", "b_prob", "doc_id"]
    assert [(r["a_prob"], r["a"], r["b_prob"], r["b"]) for r in got.collect()] == [(0.5, True, 0.5, False)] * 3
