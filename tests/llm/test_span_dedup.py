import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from hiretide.llm import queries, span_dedup as S

SF = "/root/testdata/sf0.01"


def sentences(text):
    return [s for s in re.split(r"(?<=[.!?])[ \t]+|[\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]*", text) if s.strip(" \t\n\r\x0b\x0c")]


def brute(docs, words=20, long=50):
    """Which sentences of each (id, text) go: every run of two or more, of any length, and every long sentence is looked at."""
    first, gone = {}, {}
    for doc, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        own = [" ".join(x.lower().split()) for x in sentences(text or "")]
        covered = set()
        for i in range(len(own)):
            for end in range(i + 1, len(own) + 1):
                if end - i == 1 and len(own[i].split()) < long:
                    continue
                if first.setdefault(tuple(own[i:end]), (doc, text, i)) != (doc, text, i):
                    covered.update(range(i, end))
        gone[doc, text] = drop = set()
        run = []
        for i in [*sorted(covered), None]:
            if run and (i is None or i != run[-1] + 1):
                if sum(len(own[k].split()) for k in run) >= words:
                    drop.update(run)
                run = []
            if i is not None:
                run.append(i)
    return gone


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n\r\t", max_size=60))
def test_sentences(text):
    raw = text.encode()
    bounds = S.sentence_bounds(raw)
    assert [raw[a:b].decode() for a, b in bounds] == sentences(text)
    assert S.without(raw, []) .strip() == raw[bounds[0][0]:].strip() if bounds else True
    kept = [raw[a:b].decode().strip() for i, (a, b) in enumerate(bounds) if i % 2]
    left = S.without(raw, [i for i in range(len(bounds)) if i % 2 == 0]).decode()
    assert [s.strip() for s in sentences(left)] == kept


def test_query_against_brute_force(spark, tmp_path):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in read.collect() if len(sentences(r["text"] or "")) <= 300]  # brute force is cubic
    assert len(docs) > 900
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gone = brute(docs)
    rows = queries.QUERIES["op6_span_dedup"](spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        text = texts[r["doc_id"]]
        drop = gone[r["doc_id"], text]
        assert r["n_removed"] == len(drop), r["doc_id"]
        assert sentences(r["text"]) == [s for i, s in enumerate(sentences(text)) if i not in drop]
        if not drop:
            assert r["text"] == text
    assert sum(len(g) > 0 for g in gone.values()) > 50


def make(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(n)).capitalize() + "."


def test_planted_passages_go_and_the_rest_stays(spark):
    rng = random.Random(3)
    passage = " ".join(make(rng, 12) for _ in range(5))
    docs = [(i, " ".join([make(rng, 11) for _ in range(6)] + ([passage] if i % 4 == 0 else []) + [make(rng, 9)])) for i in range(40)]
    out = {r["doc_id"]: r for r in S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        if i % 4 or i == 0:
            assert out[i]["text"] == text and out[i]["n_removed"] == 0
        else:
            assert passage not in out[i]["text"] and out[i]["n_removed"] == 5 and out[i]["text"] == text.replace(passage + " ", "")


def test_short_sentences_long_ones_and_what_is_left_alone(spark):
    rng = random.Random(8)
    few = [make(rng, 7) for _ in range(3)]  # three short sentences, 21 words together
    alone = make(rng, 55)  # one long sentence between others
    tail = [make(rng, 26), make(rng, 2), make(rng, 1)]  # ends in short sentences
    phrase = "Thank you. Good bye."
    docs = []
    for i in range(3):
        parts = [make(rng, 9), *few, make(rng, 8), alone, make(rng, 9), phrase, make(rng, 9), *tail]
        docs.append((i, " ".join(parts)))
    gone = brute(docs)
    out = {r["doc_id"]: r for r in S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        drop = gone[i, text]
        assert out[i]["n_removed"] == len(drop) == (7 if i else 0)
        assert sentences(out[i]["text"]) == [s for k, s in enumerate(sentences(text)) if k not in drop]
        assert phrase in out[i]["text"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["A b.", "C d e.", "F!", "g h i j k?", "L m."]), min_size=0, max_size=9), min_size=1, max_size=5))
def test_small_texts_equal_brute_force(texts):
    from pyspark.sql import SparkSession

    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    gone = brute(docs, words=4, long=5)
    found = S.remove_repeats(SparkSession.active().createDataFrame(docs, "doc_id long, text string"), words=4, long=5)
    for r in found.collect():
        text = docs[r["doc_id"]][1]
        assert sentences(r["text"]) == [s for k, s in enumerate(sentences(text)) if k not in gone[r["doc_id"], text]]


def test_edges(spark):
    rng = random.Random(4)
    text = " ".join(make(rng, 12) for _ in range(4))
    rows = [(2, text, 1), (2, text, 1), (1, text + " " + text, 2), (None, None, 3), (7, "", 4), (8, "one sentence only", 5), (None, text, 6), (9, "\n\n", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed int")
    found = S.remove_repeats(docs.drop("removed")).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert sorted(r["n_removed"] for r in by[None]) == [0, 0]  # null ids come first
    assert by[1][0]["text"] == "" and by[1][0]["n_removed"] == 8
    assert [r["text"] for r in by[2]] == ["", ""] and by[7][0]["text"] == "" and by[9][0]["text"] == "\n\n"
    assert {r["text"] for r in by[None]} == {None, text}
    clash = S.remove_repeats(docs).toPandas()
    assert len(clash) == len(rows)
    assert S.remove_repeats(docs.limit(0).drop("removed")).count() == 0
