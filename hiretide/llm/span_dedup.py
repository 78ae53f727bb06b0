"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after ., ! or ? and white space, and at line
breaks).  A span is a run of several consecutive sentences; spans are joined
globally on a 128-bit hash of their words and sentence ends, and every sentence
covered by a span that is not the first of its kind is removed.  A run of more
than two sentences repeats only where each two neighbours in it do, and then
these cover it, so the runs of two are hashed and stand for all longer ones.  A
sentence of ``long`` words or more is a span by itself.  Covered sentences in a
row go if they have ``words`` words together, so that common short phrases stay.

Only hashes and places are shuffled.  Half of each hash is counted first, combined
before the shuffle; spans are joined with the repeated halves, one row each, which
adaptive execution splits when one is hot, and only what is left is compared by
the whole hash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide.llm.common import column_bytes, map_rows
from hiretide.operators.scratch import materialise

#: Words that sentences removed in a row have at least.
WORDS = 20
#: Words of a sentence that is a span alone.
LONG = 50
_END = re.compile(rb"(?<=[.!?])[ \t]+|[\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]*")


def sentence_bounds(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the sentences that have a word; what lies between them are separators."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at:m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def spans_of(text: bytes | None, long: int = LONG) -> tuple[list[int], list[int], np.ndarray, int]:
    """First sentence, sentence after the last and hash of each span, and how many sentences there are."""
    bounds = sentence_bounds(text) if text else []
    split = [text[a:b].lower().split() for a, b in bounds]
    joined = [b" ".join(s) for s in split]
    alone = [i for i, s in enumerate(split) if len(s) >= long]
    first = [*range(len(split) - 1), *alone]
    end = [*range(2, len(split) + 1), *(i + 1 for i in alone)]
    digest = xxhash.xxh3_128_digest
    hashes = b"".join([*(digest(b"%s\n%s" % pair) for pair in zip(joined, joined[1:])), *(digest(joined[i]) for i in alone)])
    return first, end, np.frombuffer(hashes, np.int64).reshape(-1, 2), len(split)


def without(text: bytes, gone: list[int]) -> bytes:
    """The text less the sentences numbered; each goes with the separator after it, the last one with the one before."""
    bounds, drop = sentence_bounds(text), set(gone)
    keep = [i for i in range(len(bounds)) if i not in drop]
    if not keep:
        return b""
    pieces, lead = [], text[: bounds[0][0]] if 0 not in drop else b""
    for i in keep:
        stop = bounds[i + 1][0] if i + 1 < len(bounds) else len(text)
        pieces.append(text[bounds[i][0]: stop])
    out = lead + b"".join(pieces)
    return out if keep[-1] == len(bounds) - 1 else out.rstrip()


_SPANS = "spans array<struct<first: int, end: int, h1: bigint, h2: bigint>>"


def repeated_spans(docs: DataFrame, doc_id: str, text: str = "text", long: int = LONG) -> DataFrame:
    """``(_id, _hash, removed)`` of the texts that repeat something: their non-first spans ``[first, end)`` in sentence positions.

    A text is told by its id and the hash of its whole; the first of several equal spans has the smallest (id, hash, position).
    """
    def cut(batch: pa.RecordBatch) -> dict[str, object]:
        found = [spans_of(t, long) for t in column_bytes(batch, "text")]
        ends = np.cumsum([0] + [len(f[0]) for f in found])
        hashes = np.concatenate([f[2] for f in found]) if found else np.empty((0, 2), np.int64)
        flat = pa.StructArray.from_arrays(
            [pa.array([x for f in found for x in f[0]], pa.int32()), pa.array([x for f in found for x in f[1]], pa.int32()),
             pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], ["first", "end", "h1", "h2"])
        return {"spans": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)}

    named = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))
    cut_up = materialise(map_rows(named, cut, _SPANS, ["text"]).where("size(spans) > 0"), "spans")
    counted = cut_up.select(F.explode("spans.h1").alias("h1")).groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1")
    counted = materialise(counted, "repeated")  # a join of plain tables is one that a hot hash can be split in
    spans = cut_up.select("_id", "_hash", F.explode("spans").alias("s")).select("_id", "_hash", "s.*")
    left = materialise(spans.join(counted, "h1"), "repeats")
    kinds = materialise(left.groupBy("h1", "h2").agg(F.min(F.struct("_id", "_hash", "first")).alias("at")), "kinds")
    again = left.join(kinds, ["h1", "h2"]).where(~(F.struct("_id", "_hash", "first").eqNullSafe(F.col("at"))))
    return again.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("removed"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["first"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["first"], s["end"]])
    return [(a, b) for a, b in out]


def _long_enough(text: bytes | None, runs: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """The runs of sentences that have so many words."""
    if not runs:
        return []
    sizes = [len(text[a:b].split()) for a, b in sentence_bounds(text)]
    return [(a, b) for a, b in runs if sum(sizes[a:b]) >= words]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, long: int = LONG) -> DataFrame:
    """Every row, its text without what repeats, with ``n_removed`` sentences and their ``removed`` runs ``[first, end)``.

    The first occurrence is the one with the smallest id (null before all), then text hash, then position; it stays,
    repeats within a text go like others.  Rows alike in id and text are one document and keep the same.  Null texts
    stay null, texts without a span (one sentence of few words) stay as they are, a text of repeats only becomes empty.
    """
    shared = {c: f"__{c}" for c in docs.columns if c in ("n_removed", "removed", "_id", "_hash")}
    names = [shared.get(c, c) for c in docs.columns]
    doc_id, text, docs_ = shared.get(doc_id, doc_id), shared.get(text, text), docs.withColumnsRenamed(shared)
    found = repeated_spans(docs_, doc_id, text, long)
    joined = docs_.join(found, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left").drop("_id", "_hash")

    def drop(batch: pa.RecordBatch) -> dict[str, object]:
        texts, runs, counts = [], [], []
        for t, spans in zip(column_bytes(batch, text), batch.column("removed").to_pylist()):
            own = _long_enough(t, _merged(spans or []), words)
            runs.append([{"first": a, "end": b} for a, b in own])
            counts.append(sum(b - a for a, b in own))
            texts.append(without(t, [i for a, b in own for i in range(a, b)]) if own else t)
        return {text: pa.array(texts, pa.binary()).cast(pa.string()), "n_removed": counts, "removed": runs}

    out = map_rows(joined, drop, f"`{text}` string, n_removed int, removed array<struct<first: int, end: int>>")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], "n_removed", "removed") if not shared else out.select(*names, "n_removed", "removed")
