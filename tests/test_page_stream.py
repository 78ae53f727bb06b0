"""Page assembly on a stream: the decision against the batch rules, and what the state keeps."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.operators.scratch import scratch_path
from hiretide.schemas import RAW_PAYLOAD_SCHEMA
from hiretide.sources import payloads
from hiretide.streaming import page_stream

FACTS = "source string, company string, attempt int, page_no int, status int, readable boolean, n_items long, total long"


@pytest.mark.parametrize("source", sorted(payloads.PAGED))
def test_decision_is_that_of_the_landed_table(spark, source):
    rng = random.Random(source)
    size = V.PAGE_SIZE[source]
    companies = {}
    for c in range(250):
        total = rng.choice([0, 1, size, size + 1, 3 * size, 9 * size])
        rows = []
        for attempt in range(rng.randint(1, 3)):
            down = rng.random() < 0.4
            for page in range(rng.randint(1, 5)):
                status = rng.choice([404, 500]) if down else 200 if page == 0 else rng.choice([200] * 9 + [500])
                rows.append((attempt, page, status, rng.random() > 0.05, rng.choice([0, size, size, size, 1]), total))
        companies[f"c{c}"] = rows
    facts = spark.createDataFrame([(source, c, *r) for c, rows in companies.items() for r in rows], FACTS)
    for max_pages in (None, 2):
        plan = payloads.page_plan(payloads.page_facts(facts, source), source, max_pages=max_pages)
        batch = {r["company"]: r["keep_to"] for r in plan.filter("available").collect()}
        first = {r["company"]: r["attempt"] for r in payloads.first_ok_attempt(facts, ["company"]).collect()}
        for company, rows in companies.items():
            pages = [dict(zip(("attempt", "page_no", "status", "readable", "n_items", "total"), r)) for r in rows]
            got = page_stream.settle(source, size, pages, True, max_pages)
            want = (first[company], batch[company]) if company in first and batch.get(company, -1) >= 0 else None
            assert (got if got and got[1] >= 0 else None) == want, (company, rows)
            # whatever has come so far, a decision once made is the last one
            rng.shuffle(pages)
            for n in range(1, len(pages)):
                early = page_stream.settle(source, size, pages[:n], False, max_pages)
                assert early in (False, got) and isinstance(early, type(got)) or early is False


def test_bodies_leave_the_state_and_open_paging_is_settled_by_time(spark):
    path = scratch_path(spark, "page-state")
    start = datetime(2024, 1, 1)

    def page(company, number, n, total, hours=0.0, source="smartrecruiters", attempt=0, status=200):
        body = json.dumps({"totalFound": total, "content": [{"id": str(i)} for i in range(n)]})
        return (source, company, attempt, number, status, start + timedelta(hours=hours), body if status == 200 else None)

    def land(*rows):
        spark.createDataFrame(rows, RAW_PAYLOAD_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = payloads.read_payloads(spark, f"{path}/in", stream=True)
        page_stream.run_available(page_stream.assemble_stream(stream), f"{path}/out", f"{path}/cp")
        out = spark.read.schema(RAW_PAYLOAD_SCHEMA).parquet(f"{path}/out").collect()
        return sorted((r["company"], r["attempt"], r["page_no"]) for r in out if r["company"] != "clock")

    size = V.PAGE_SIZE["smartrecruiters"]
    assert land(page("whole", 1, 5, size + 5), page("open", 0, size, 9 * size), page("late try", 0, 1, 1, attempt=1),
                page("feed", 0, 1, 1, source="lever")) == [("feed", 0, 0)]
    assert land(page("whole", 0, size, size + 5), page("late try", 0, 0, 0, status=404), page("feed", 1, 1, 1, source="lever")) == [
        ("feed", 0, 0), ("feed", 0, 1), ("late try", 1, 0), ("whole", 0, 0), ("whole", 0, 1)]
    held = spark.read.format("statestore").option("stateVarName", "bodies").load(f"{path}/cp")
    assert {r["c"] for r in held.select(F.col("key.company").alias("c")).collect()} == {"open"}
    land(page("clock", 0, 1, 1, hours=100))
    got = land(page("clock", 0, 1, 1, hours=200))
    assert ("open", 0, 0) in got and len(got) == 6


class _Counted:
    """A state variable, or the handle itself, that counts its calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def getValueState(self, *_):
        return _Counted(self.calls)

    getListState = getMapState = getValueState

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def appendList(self, values):
        self.calls.append("appendList")
        self.held = [*(self.held or []), *values]

    def updateValue(self, *_):
        self.calls.append("updateValue")

    def clear(self):
        self.calls.append("clear")
        self.held = None

    def registerTimer(self, at):
        self.calls.append("registerTimer")

    deleteTimer = registerTimer


def test_state_calls_of_a_company_do_not_grow_with_its_pages():
    size = V.PAGE_SIZE["smartrecruiters"]
    columns = ["source", "company", "attempt", "page_no", "status", "fetched_us", "body"]

    def pages(first, last):
        return pd.DataFrame([(0, n, 200, n, f"b{n}", True, size, 300 * size) for n in range(first, last)],
                            columns=["attempt", "page_no", "status", "fetched_us", "body", "readable", "n_items", "total"])

    calls = []
    assembler = page_stream._Assembler(columns, {"smartrecruiters": size}, 1000, None)
    assembler.init(_Counted(calls))
    key = ("smartrecruiters", "A")
    assert list(assembler.handleInputRows(key, iter([pages(1, 200)]), None)) == [] and len(calls) <= 4
    calls.clear()
    out = pd.concat(list(assembler.handleInputRows(key, iter([pages(200, 300), pages(0, 1), pages(150, 151)]), None)))
    assert sorted(out["page_no"]) == list(range(300)) and set(out["body"]) == {f"b{n}" for n in range(300)}
    assert len(calls) <= 4
