"""The five stages against their parts, and the queries against SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
import check  # noqa: E402

import corpus_pipeline as C  # noqa: E402
from hiretide.llm import decontamination, language_id, queries, simhash, span_dedup  # noqa: E402
from hiretide.llm.common import fold  # noqa: E402
from hiretide.operators.scratch import materialise  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    verdict, _ = check.compare(spark, check.duck(SF), queries.QUERIES[name], queries.SQL[name], SF)
    assert verdict.startswith("ok"), verdict


def test_stages_and_their_order(spark):
    assert [name for name, _ in C.STAGES] == ["language_id", "simhash", "span_dedup", "decontamination", "packing"] and C.ORACLE_SQL is None
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    stage = dict(C.STAGES)
    # each stage against the decisions of its operator on the same input
    identified = materialise(stage["language_id"](spark, docs, SF), "t")
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    want = {r["doc_id"] for r in language_id.identify(docs, model).collect() if r["lang_pred"] != "und"}
    assert {r["doc_id"] for r in identified.collect()} == want and identified.columns == columns
    distinct = materialise(stage["simhash"](spark, identified, SF), "t")
    want = {r["doc_id"] for r in simhash.near_duplicates(identified).collect() if r["kept"]}
    assert {r["doc_id"] for r in distinct.collect()} == want and distinct.columns == columns and len(want) < identified.count()
    unrepeated = materialise(stage["span_dedup"](spark, distinct, SF), "t")
    want = {r["doc_id"]: r["text"] for r in span_dedup.remove_repeats(distinct).collect()}
    assert {r["doc_id"]: r["text"] for r in unrepeated.collect()} == want and unrepeated.columns == columns
    assert all(r["n_chars"] == len(r["text"]) for r in unrepeated.collect())
    clean = materialise(stage["decontamination"](spark, unrepeated, SF), "t")
    found = decontamination.contamination(unrepeated, queries.table(spark, SF, "benchmark")).collect()
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in found if not r["contaminated"]} and clean.columns == columns
    packed = stage["packing"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.collect()}
    got = C.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_nulls_and_empty_tables_pass_every_stage(spark):
    docs = queries.table(spark, SF, "documents")
    none = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0)], docs.schema)
    mixed = docs.limit(40).unionByName(none)
    for rows in (mixed, docs.limit(0)):
        for name, stage in C.STAGES[:-1]:
            rows = materialise(stage(spark, rows, SF), name)
            assert rows.columns == docs.columns
        assert C.STAGES[-1][1](spark, rows, SF).count() >= 0
