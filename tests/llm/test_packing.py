import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hiretide.llm import packing, queries

SF = "/root/testdata/sf0.001"


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


ODD = [
    None, "", "   ", "a", "Hello, World", "it's we'll\tTAB\r\nline", "<|endoftext|> <|startoftext|>x <|ENDOFTEXT|>", "é é İI ΑΣ ΣΑΣ.",
    "a|b | c || d|", "日本語 テキスト 12345", "x y  z \x1c w", "“quotes” — dash.", "loooong" * 40 + " end", "ÀÉ!!! .,; a.b,c?", "𝔘𝔫𝔦 🙂🙂",
]


def test_ids_are_the_tokenizers():
    encoder = packing.WordIds(packing.tokenizer_path())
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.ids([t.encode() if t is not None else None for t in ODD])]
    assert found == whole(ODD)
    again = [np.frombuffer(x, "<u4").tolist() for x in encoder.ids([t.encode() if t is not None else None for t in ODD])]
    assert again == found


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_ids_of_any_text(texts):
    encoder = packing.WordIds(packing.tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids([t.encode() for t in texts])] == whole(texts)


def test_ids_survive_small_caches(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    texts = [f"w{i} x{i % 3} same, w{i % 7}" for i in range(300)]
    encoder = packing.WordIds(packing.tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids([t.encode() for t in texts])] == whole(texts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 9), max_size=20))
def test_plan_places_every_length_once(counts):
    plan, n = packing.plan_lengths(counts, 32)
    filled = defaultdict(list)
    given_ = Counter()
    for length, first, k, sequence, offset, times in plan.tolist():
        assert first == given_[length]
        given_[length] += k * times
        for t in range(times):
            filled[sequence + t] += [(offset + i * length, length) for i in range(k)]
    assert given_ == Counter(counts) and sorted(filled) == list(range(n))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    total = sum(k * v for k, v in counts.items())
    # never more than one sequence is at most half full, as any two such would have been put together
    assert n <= 2 * total // 32 + 1


def test_exact_complements_fill():
    plan, n = packing.plan_lengths({30: 4, 2: 4, 20: 2, 7: 2, 5: 2, 10: 3, 11: 3, 8: 3, 3: 3}, 32)
    assert n == 9  # pairs, triples and quadruples, none short


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_packing"](spark, SF).collect()
    ids = dict(zip(docs, whole(docs.values())))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(docs)
    for doc, pieces in by_doc.items():
        own = [*ids[doc], 1]
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(own) // 4096)))
        for r in pieces:
            part = own[r["start"]: r["start"] + 4096]
            assert r["start"] == 4096 * r["piece"] and r["length"] == len(part)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(x) + 1 for x in ids.values())
    assert len(by_sequence) <= -(-total // 4096) + 1


def test_edges(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", None), (2, "word " * 9000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "length_")
    pieces = packing.tokenise(docs)
    packed = packing.pack(pieces).collect()
    assert sorted(r["length"] for r in packed) == [1, 1, 1, 9001 - 8192, 4096, 4096]
    assert {r["length_"] for r in packed} == {"x", "y", None}
    whole_ = packing.sequences(packing.pack(pieces)).collect()
    assert sum(r["length"] for r in whole_) == 9004 and all(len(r["ids"]) == 4 * r["length"] for r in whole_)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.tokenise(docs)).count() == 0


@pytest.mark.parametrize("clash", ["part", "nth", "number"])
def test_clashing_names(spark, clash):
    docs = spark.createDataFrame([(1, "a b c", "kept")], f"doc_id long, text string, {clash} string")
    assert packing.pack(packing.tokenise(docs)).collect()[0][clash] == "kept"


def test_ids_are_the_tokenizers_own():
    """Words of every kind the caches treat apart, through more words than are remembered."""
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    texts = ["É|a <|endoftext|> X", "a  b\n\n c", "word' it's don't'", "naïve café ÷×", "ÀÞß ẞ", "́a é", "日本語 x y", "tab\r\nz\tq", "f<|g", "",
             "zürich!!! $$$ #&", "ÄÖÜ.", "ı İ ſ K", "x" * 300 + "!" * 300, " ", "\n", "a" * 60 + " " + "a" * 60]
    for _ in range(2):
        for text, got in zip(texts, own.ids([t.encode() for t in texts])):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
        own.known, own.older = {}, own.known


def test_output_names_in_the_input(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6, 7)], "doc_id long, text string, piece int, sequence_id int, offset int")
    got = packing.pack(packing.tokenise(docs))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    assert [(r["piece"], r["sequence_id"], r["offset"]) for r in got.collect()] == [(0, 0, 0)]
