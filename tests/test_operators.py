"""Order, chunks, joins, reports, whole runs."""

import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hiretide import vocab as V
from hiretide.operators import digest, joins, ranking, reports, scratch
from hiretide.plans import runs


@pytest.fixture(scope="module")
def leveled(spark):
    """A third of all rows belong to one company."""
    rnd = random.Random(7)
    levels = [*V.LEVEL_ORDER, "odd"]
    rows = [(i, "hot" if rnd.random() < 0.34 else f"c{rnd.randrange(40)}", rnd.choice(levels), rnd.randrange(3)) for i in range(5000)]
    return rows, spark.createDataFrame(rows, "seq long, company string, level string, run int").repartition(8)


def expected(rows, by_run):
    key = lambda r: (r[3] if by_run else 0, V.LEVEL_ORDER.get(r[2], 3), r[1], r[0])
    out, at = {}, {}
    for r in sorted(rows, key=key):
        g = r[3] if by_run else 0
        out[r[0]] = at[g] = at.get(g, -1) + 1
    return out, at


def test_chunks_partition_the_sorted_rows(leveled):
    rows, df = leveled
    want, last = expected(rows, False)
    got = ranking.chunk_rows(df, ["company", "seq"]).collect()
    assert {r.seq: r.rn for r in got} == want
    assert all(r.chunk_no == r.rn // 50 and r.n_chunks == 100 for r in got)


def test_chunks_per_run(leveled):
    rows, df = leveled
    want, last = expected(rows, True)
    got = ranking.chunk_rows(df, ["company", "seq"], by=["run"]).collect()
    assert {r.seq: r.rn for r in got} == want and len(got) == len(rows)
    assert {r.run: r.n_chunks for r in got} == {g: last[g] // 50 + 1 for g in last}


def test_sort_is_stable(spark):
    rows = [("Senior", 2), ("Entry Level", 1), ("Senior", 1), ("x", 0), ("Staff / Lead", 9)]
    df = spark.createDataFrame(rows, "level string, seq long")
    assert [tuple(r) for r in ranking.sort_by_level(df, ["seq"]).collect()] == [
        ("Staff / Lead", 9), ("Senior", 1), ("Senior", 2), ("x", 0), ("Entry Level", 1)]


def test_choose_pattern_counts_the_fallback_only_last(spark):
    m = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 9), (2, 0), (2, 9), (3, 0)], "page int, ord int")
    got = {r.page: r.ord for r in ranking.choose_pattern(m, "page", "ord", 2, 9).collect()}
    assert got == {1: 1, 2: 9}
    assert {r.page: r.ord for r in ranking.choose_pattern(m, "page", "ord", 1, None).collect()} == {1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("n", [5, 600])
@pytest.mark.parametrize("chars", [0, joins.AUTOMATON_CHARS])
def test_vocabulary(spark, n, chars):
    terms = ["a", "sq", "sql", "data eng", "İ", "😀", "x😀y", "\n"] + [f"term{i}" for i in range(n)]
    texts = [(1, "MySQL Data Engineer term7x"), (2, ""), (3, None), (4, "qs term599"), (1, "MySQL Data Engineer term7x"), (1, "sq"),
             (5, "ab😀c x😀y\nz"), (6, "x😀")]
    df = spark.createDataFrame(texts, "id int, text string")
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted({(i, t) for i, x in texts for t in terms if t.lower() in (x or "").lower()})
    assert sorted(tuple(r) for r in joins.match_terms(df, "id", "text", vocab, chars).collect()) == want


def test_vocabulary_beyond_one_automaton_is_linear(spark):
    """100 000 terms that share a run every text holds; a text of 160 000 characters."""
    rng = random.Random(1)
    letters = "abcdefghij"
    terms = {"the " + "".join(rng.choice(letters) for _ in range(rng.randint(3, 6))) for _ in range(100_000)}
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")
    long = "the ".join("".join(rng.choice(letters) for _ in range(12)) for _ in range(10_000))
    texts = spark.createDataFrame([(0, long), *((i, "the end " + long[i * 40: i * 40 + 40]) for i in range(1, 2000))], "id int, text string")
    start = time.time()
    got = {(r.id, r.term) for r in joins.match_terms(texts, "id", "text", vocab, 0).collect()}
    assert time.time() - start < 60
    assert {t for i, t in got if i == 0} == {long[a: a + n] for a in range(len(long)) for n in range(7, 11)} & terms
    assert sorted(got) == sorted((r.id, r.term) for r in joins.match_terms(texts, "id", "text", vocab).collect())


def test_routing(spark):
    rows = [("Scotiabank", "custom"), ("PayPal Canada", "workday"), ("X", "lever"), ("Y", "custom"), ("Z", None), ("W", "odd")]
    got = {r.name: (r.extractor, r.route) for r in reports.route(spark.createDataFrame(rows, "name string, scraper string")).collect()}
    assert got == {"Scotiabank": ("scotiabank", "dedicated"), "PayPal Canada": ("paypal", "api"), "X": ("lever", "api"),
                   "Y": ("generic", "skipped"), "Z": ("generic", "skipped"), "W": ("generic", "skipped")}


def test_audit(spark):
    dim = spark.createDataFrame(
        [("Shopify", "custom", True), ("L", "lever", True), ("G", "greenhouse", False), ("H", "ashby", None), ("Y", "custom", False), ("K", "workday", False)],
        "name string, scraper string, top100 boolean")
    counts = spark.createDataFrame([("L", 3), ("G", 0)], "company string, n long")
    failures = spark.createDataFrame([("H", "x" * 100, False), ("K", None, True)], "company string, error string, needs_page boolean")
    status, rollup = runs.audit(dim, counts, failures)
    assert {r.name: (r.status, r.jobs, r.note[:12]) for r in status.collect()} == {
        "Shopify": ("selenium", 0, "only readabl"), "L": ("ok", 3, "3 data jobs"), "G": ("zero", 0, "0 data jobs"),
        "H": ("error", 0, "x" * 12), "Y": ("skip", 0, "no extractor"), "K": ("selenium", 0, "structured s")}
    assert max(len(r.note) for r in status.collect()) == 100
    got = {r.section: (r.companies, r.ok, r.zero, r.error, r.selenium, r.skip, r.confirmed) for r in rollup.collect()}
    assert got == {"top100": (2, 1, 0, 0, 1, 0, 1), "rest": (4, 0, 1, 1, 1, 1, 1), "overall": (6, 1, 1, 1, 2, 1, 2)}


def test_broad_run_counts_any_title_in_the_country(spark):
    dim = spark.createDataFrame([("a",), ("b",)], "name string")
    rows = [("a", "Cook", "Toronto"), ("a", "Data Engineer", "Canada"), ("zz", "Cook", "Toronto"), ("b", "Data Engineer", "Berlin")]
    counts, summary = runs.broad_run(spark.createDataFrame(rows, "company string, title string, location string"), dim)
    assert {tuple(r) for r in counts.collect()} == {("a", 2), ("b", 0)}
    assert tuple(summary.first()) == (2, 1, 2)


POSTING = ("title string, company string, category string, location string, level string, type string, posted string, "
           "url string, skills array<string>, salary string, source string, page_no int, page_id long, pos int")


def alert_rows(spark, n):
    rows = [(f"Data Engineer {i}", f"C{i % 7}", ["Banks", "Gaming", None][i % 3], "Toronto", ["Senior", "Mid-Level", "Entry Level", "Staff / Lead"][i % 4],
             "Full-time", "Recent", "", ["SQL"], "", "lever", 0, None, i) for i in range(n)]
    rows.append(("Cook", "C1", "Banks", "Toronto", "Senior", "Full-time", "Recent", "", [], "", "lever", 0, None, 0))
    return spark.createDataFrame(rows, POSTING)


def test_alert_run(spark):
    from hiretide.operators.dedup import empty_state

    now = datetime(2024, 1, 5, 9)
    result = runs.alert_run(alert_rows(spark, 120), empty_state(spark), now, 7, "morning")
    got = {r.chunk_no: r for r in result.digest.collect()}
    assert sorted(got) == [0, 1, 2] and [got[i].total for i in range(3)] == [50, 50, 20]
    assert got[0].subject == "Morning (9 AM) (1/3): 50 new postings, Jan 05, 2024"
    assert got[0].html.count('class="posting"') == 50 and "🏦 Banks" in got[0].html and "📁 Other" in got[0].html
    assert sum(r.senior for r in got.values()) == 30 and result.state.count() == 120
    again = runs.alert_run(alert_rows(spark, 120), result.state, now, 7)
    rows = again.digest.collect()
    assert again.fresh.count() == 0 and len(rows) == 1 and "nothing new" in rows[0].subject


def test_one_chunk_has_no_label(spark):
    chunks = ranking.chunk_rows(alert_rows(spark, 3), ["company", "pos"])
    row = digest.digest(chunks, ["chunk_no"], F.lit("Daily"), F.lit("d"), 1).first()
    assert row.subject == "Daily: 4 new postings, d"


def test_scratch_folder_is_read_from_the_session(spark):
    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    named = Session(spark_checkpoint_dir="hdfs://shared/cp/", spark_master="yarn")
    assert scratch.scratch_path(named, "x").startswith("hdfs://shared/cp/hiretide/x-")
    # without the setting the warehouse, never a machine's own temporary folder
    assert scratch.shared_dir(Session(**{"spark_sql_warehouse_dir": "hdfs://w"})) == "hdfs://w/_scratch"


def test_scratch_tables_can_be_dropped(spark):
    table, path = scratch.materialise_at(spark.range(5), "drop-test")
    assert table.count() == 5
    scratch.drop(path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


@pytest.mark.parametrize("range_rows", [7, 10_000])
def test_numbers_by_level_without_a_written_copy(spark, leveled, range_rows):
    rows, df = leveled
    for by in ([], ["run"]):
        numbered = ranking.number_by_level(df, ["company", "seq"], by, range_rows)
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan and "RangePartitioning" not in plan and "rangepartitioning" not in plan
        groups = {}
        for r in sorted(rows, key=lambda r: (V.LEVEL_ORDER.get(r[2], V.LEVEL_ORDER_DEFAULT), r[1], r[0])):
            groups.setdefault(r[3] if by else 0, []).append(r[0])
        want = {seq: (i, len(g)) for g in groups.values() for i, seq in enumerate(g)}
        assert {r.seq: (r.rn, r.n_total) for r in numbered.collect()} == want


def test_numbers_with_nulls_and_without_a_number_column(spark):
    rows = [("Mid-Level", None, None), ("Mid-Level", None, 3), ("Mid-Level", "a", 2), ("Mid-Level", "a", 2**62), (None, "b", 1), ("Mid-Level", "a", -(2**62))]
    df = spark.createDataFrame(rows, "level string, company string, seq long")
    got = {(r.company, r.seq): r.rn for r in ranking.number_by_level(df, ["company", "seq"], range_rows=1).collect()}
    assert got == {(None, None): 0, (None, 3): 1, ("a", -(2**62)): 2, ("a", 2): 3, ("a", 2**62): 4, ("b", 1): 5}
    assert sorted(r.rn for r in ranking.number_by_level(df, ["company"]).collect()) == list(range(6))
    assert ranking.number_by_level(df.limit(0), ["company", "seq"]).collect() == []
