"""Attempt choice and page assembly on a stream of landed payloads.

Pages of a company come in any order, over any number of micro-batches.  Its
state holds what is known of each page and the bodies themselves, until it is
settled which attempt counts and where its paging ends; then the pages that the
paging loop would have read come out, as payloads, and the bodies leave the
state.  What comes out goes on to the same extractors as a landed table.

A company whose paging does not end is settled by time: when the watermark is
``patience`` past its last page, what has come is all there is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hiretide import vocab as V
from hiretide.sources import payloads

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PATIENCE = "6 hours"
#: A failed page of these makes the company unavailable; of other paged sources, the pages before it stay.
_ALL_OR_NOTHING = ("netflix", "workday")
_PAGE = "attempt: int, page_no: int, status: int, readable: boolean, n_items: bigint, total: bigint"
_FACTS = ("attempt", "page_no", "status", "readable", "n_items", "total")
_BODY = "attempt int, page_no int, status int, fetched_us long, body string"


def settle(source: str, size: int | None, pages: list[dict], over: bool, max_pages: int | None = None) -> tuple[int, int] | None | bool:
    """(attempt, last page to keep) of a company, None if it is unavailable, False if that is not settled yet.

    ``size`` is the page size of a paged source, None for the others, whose answered attempt counts whole (last page
    -1).  ``over`` says that nothing more will come.
    """
    begun = {p["attempt"] for p in pages if p["page_no"] == 0}
    answered = sorted({p["attempt"] for p in pages if p["status"] == 200})
    if not answered:
        return None if over else False
    first = answered[0]
    if not over and any(a not in begun for a in range(first)):
        return False  # an earlier attempt may still answer; one whose first page failed does not
    if size is None:
        return first, -1
    own = {p["page_no"]: p for p in pages if p["attempt"] == first}
    read, number = 0, 0
    while number in own:
        page = own[number]
        if page["status"] != 200 or not page["readable"]:
            return None if source in _ALL_OR_NOTHING else (first, number - 1)
        read += page["n_items"]
        total = own[0]["total"] if source == "oracle_hcm" else page["total"]
        reached = read if source == "netflix" else (number + 1) * size
        if not page["n_items"] or reached >= total or (max_pages is not None and number + 1 >= max_pages):
            return first, number
        number += 1
    return (first, number - 1) if over else False


class _Assembler(StatefulProcessor):
    """Per (source, company): facts of its pages, their bodies, and the decision once there is one.

    A state call costs more than the rows of a call, so a company is read and written by a fixed number of calls,
    however many pages come.
    """

    def __init__(self, columns: list[str], sizes: dict[str, int], patience_ms: int, max_pages: int | None) -> None:
        self.columns, self.sizes, self.patience, self.max_pages = columns, sizes, patience_ms, max_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the decision, null while it is open, when the company is given up, and what is known of its pages
        self.known = handle.getValueState("known", f"attempt int, keep_to int, until long, facts array<struct<{_PAGE}>>")
        self.bodies = handle.getListState("bodies", _BODY)

    def _kept(self, decision: tuple[int, int], attempt: int, number: int) -> bool:
        return attempt == decision[0] and (decision[1] == -1 or number <= decision[1])

    def _out(self, key, pages: list[tuple]) -> Iterator[pd.DataFrame]:
        if pages:
            yield pd.DataFrame([(key[0], key[1], *page) for page in pages], columns=self.columns)

    def _decide(self, key, facts: list[tuple], over: bool) -> tuple[int, int] | None:
        """The decision, (-1, -2) for a company without any page, None if it is open."""
        pages = [dict(zip(_FACTS, p)) for p in facts]
        found = settle(key[0], self.sizes.get(key[0]), pages, over, self.max_pages)
        if found is False:
            return None
        return (-1, -2) if found is None or (key[0] in self.sizes and found[1] < 0) else found

    def _chosen(self, decision: tuple[int, int], bodies: list[tuple]) -> list[tuple]:
        """The pages that count; one that was landed again is the later one."""
        last = {(body[0], body[1]): body for body in bodies}
        return [body for place, body in last.items() if self._kept(decision, *place)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempt, keep_to, until, facts = self.known.get() or (None, None, None, [])
        decision, facts = None if attempt is None else (attempt, keep_to), [tuple(p) for p in facts]
        begun, latest, bodies = until is not None, 0, []
        for pdf in rows:
            columns = [pdf[c].tolist() for c in ("attempt", "page_no", "status", "fetched_us", "body", "readable", "n_items", "total")]
            for attempt, number, status, fetched, body, readable, n_items, total in zip(*columns):
                attempt, number, status, fetched = int(attempt), int(number), int(status), int(fetched)
                latest = max(latest, fetched // 1000)
                if decision:
                    if decision[1] == -1 and self._kept(decision, attempt, number):  # a further page of an unpaged source
                        bodies.append((attempt, number, status, fetched, body))
                    continue
                facts.append((attempt, number, status, bool(readable), int(n_items), int(total)))
                bodies.append((attempt, number, status, fetched, body))
        until = max(until or 0, latest + self.patience)
        if decision:
            yield from self._out(key, bodies)
        else:
            decision = self._decide(key, facts, over=False)
            if decision:
                if begun:
                    bodies = [*self.bodies.get(), *bodies]
                    self.bodies.clear()
                facts = []
                yield from self._out(key, self._chosen(decision, bodies))
            else:
                self.bodies.appendList(bodies)
        self.known.update((*(decision or (None, None)), until, facts))
        if not begun:
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt, _, until, facts = self.known.get()
        if until >= timerValues.getCurrentWatermarkInMs():  # further pages came since the timer was set
            self.handle.registerTimer(until)
            return
        if attempt is None:
            decision = self._decide(key, [tuple(p) for p in facts], over=True)
            yield from self._out(key, self._chosen(decision, list(self.bodies.get())))
            self.bodies.clear()
        self.known.clear()

    def close(self) -> None:
        pass


def assemble_stream(raw: DataFrame, patience: str = PATIENCE, max_pages: int | None = None) -> DataFrame:
    """The payloads that count, of a stream of landed ones (``payloads.read_payloads(.., stream=True)``), in its schema.

    A page that is landed again replaces itself until its company is settled.  A company's state is gone ``patience``
    after its last page, and pages that come later begin anew.  Needs the RocksDB state store.
    """
    timed = raw.withColumn("event_at", F.col("fetched_at")).withWatermark("event_at", patience).drop("event_at")
    rows = payloads.with_facts(timed).withColumn("fetched_us", F.unix_micros("fetched_at")).drop("fetched_at")
    columns = ["source", "company", "attempt", "page_no", "status", "fetched_us", "body"]
    out = T.StructType([rows.schema[c] for c in columns])
    patience_ms = raw.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp_micros(0) + INTERVAL {patience})")).first()[0]
    sizes = {s: V.PAGE_SIZE[s] for s in payloads.PAGED}
    found = rows.groupBy("source", "company").transformWithStateInPandas(
        _Assembler(columns, sizes, patience_ms, max_pages), out, "append", "eventTime")
    return found.select("source", "company", "attempt", "page_no", "status", F.timestamp_micros("fetched_us").alias("fetched_at"), "body")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has landed into a payload table, then stop; a repeated batch replaces its own files."""
    from hiretide.streaming.seen_stream import with_rocks

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with_rocks(stream.sparkSession, lambda: (
        stream.writeStream.foreachBatch(write).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    ))
