"""Removal of repeated byte strings with suffix arrays.

A string of ``window`` bytes that starts at two places anywhere in the corpus is
removed at both.  Suffix arrays find them, one per shard; what makes shards
possible is that equal windows are always sent to the same one:

1. Each window has an anchor, the ``ANCHOR`` bytes inside it with the smallest
   hash (the leftmost of equals).  Equal windows have equal anchors.  Windows in
   a row that share an anchor are one segment, some 270 bytes of text.
2. Anchors are counted over the corpus; segments of an anchor met once are done.
   Of equal segments one is kept, with their number.
3. Segments are dealt to shards by anchor.  A shard's segments are joined to one
   text, whose suffix array is made by induced sorting and whose permuted common
   prefixes tell the windows that occur more than once.
4. The windows found go back to all segments equal to theirs, then to the texts.

What is shuffled are hashes and places, one per some 66 bytes, the distinct
repeated segments, and the texts twice.  An anchor with so many different segments
that a shard could not hold them is dealt by its windows' 128-bit hashes instead,
counted before the shuffle; nothing is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide.llm.common import column_bytes, map_rows, positional, restored, slices
from hiretide.llm.suffix_array import common_prefixes, suffix_array, words_of
from hiretide.operators.scratch import materialise

WINDOW = 200
ANCHOR = 48
#: Bytes of segments in a shard, on average.
SHARD_BYTES = 1 << 20
#: Segments of one anchor that a shard takes.
SEGMENTS = 2048
#: Bytes of text worked on at once.
PIECE = 1 << 20
#: Bits of a place within what is worked on at once; the rest of a word is the anchor's hash.
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
#: Never part of UTF-8.
_BETWEEN = b"\xff"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Anchors:
    """Segments of texts."""

    def __init__(self, window: int, anchor: int) -> None:
        self.window, self.anchor = window, anchor
        n = 2 * PIECE + 2 * window + 1
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def _least(self, value: np.ndarray, width: int) -> np.ndarray:
        """The smallest of each ``width`` values in a row, from prefix and suffix minima of blocks."""
        n = len(value) - width + 1
        padded = np.full(-(-len(value) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(value)] = value
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])

    def _piece_segments(self, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of pieces at least a window long: piece, key, first window and last window of each segment."""
        size = np.array([len(p) for p in pieces])
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, k = len(data), self.anchor
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        key = (total[k:] - total[:-k]) * self.down[: n - k + 1]
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        least = self._least((key & ~_PLACE) | np.arange(len(key), dtype=np.uint64), self.window - k + 1)
        windows = size - self.window + 1
        piece = np.repeat(np.arange(len(pieces)), windows)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[piece]
        anchor = (least[at] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        piece = piece[first]
        return piece, key[anchor[first]].view(np.int64), at[first] - begin[piece], at[last] - begin[piece]

    def of(self, texts: list[bytes | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """(text number, key, hash, place) of the segments; a place is the first window's start * 256 + further windows."""
        pieces: list[tuple[int, int, bytes]] = []
        held = 0

        def work() -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
            piece, key, first, last = self._piece_segments([p[2] for p in pieces])
            number, lead = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
            hashes = [xxhash.xxh3_64_intdigest(pieces[p][2][a: b + self.window]) for p, a, b in zip(piece.tolist(), first.tolist(), last.tolist())]
            return number[piece], key, np.array(hashes, np.uint64).view(np.int64), (first + lead[piece]) * 256 + last - first

        for number, text in enumerate(texts):
            for lead in range(0, len(text or b"") - self.window + 1, PIECE):
                pieces.append((number, lead, text[lead: lead + PIECE + self.window - 1]))
                held += len(pieces[-1][2])
                if held >= PIECE:
                    yield work()
                    pieces, held = [], 0
        if pieces:
            yield work()


def shard_runs(segments: list[bytes], numbers: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Of each segment the runs ``[from, to)`` of bytes covered by windows that occur twice or more among all segments.

    ``numbers`` tells how often a segment occurs.
    """
    text = np.frombuffer(_BETWEEN.join(segments), np.uint8)
    size = np.array([len(s) for s in segments])
    begin = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(segments)), np.maximum(size - window + 1, 0))
    place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(segments)))[owner] + begin[owner]
    weight = np.zeros(len(text), np.int64)
    weight[place] = np.array(numbers)[owner]  # what starts a window inside its segment
    words = words_of(text)
    order = suffix_array(text, words)
    shared = common_prefixes(text, order, words)
    group = np.cumsum(shared[order] < window) - 1
    often = np.bincount(group, weight[order]) > 1
    repeated = np.zeros(len(text), bool)
    repeated[order] = often[group]
    repeated &= weight > 0
    at = np.flatnonzero(repeated)
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    if len(at):
        cut = np.flatnonzero(np.diff(at) > 1)
        for a, b in zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist()):
            i = int(np.searchsorted(begin, a, "right")) - 1
            out[i].append((a - int(begin[i]), b - int(begin[i]) + window))
    return out


def _text_id(text: str) -> Column:
    """128 bits that tell a text."""
    return F.unhex(F.md5(F.col(text)))


_SEGMENT = "array<struct<key: bigint, seg: bigint, place: bigint>>"
_RUNS = "array<struct<a: bigint, b: bigint>>"


def _segments(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(h, rid, segments)`` of each text at least a window long."""
    def cut(batch: pa.RecordBatch) -> dict[str, object]:
        found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for part in Anchors(window, anchor).of(column_bytes(batch, "text")):
            for column, values in zip(found, part):
                column.append(values)
        number, key, seg, place = (np.concatenate(c) for c in found)
        flat = pa.StructArray.from_arrays([pa.array(key), pa.array(seg), pa.array(place)], ["key", "seg", "place"])
        ends = np.searchsorted(number, np.arange(batch.num_rows + 1))
        return {"segments": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)}

    found = map_rows(texts.where(F.octet_length("text") >= window), cut, f"segments {_SEGMENT}", ["text"])
    return found.withColumn("rid", F.monotonically_increasing_id())


def _contents(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``(key, seg, n, crowded, content)`` of the segments wanted of each text; once a task."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies of a text that came to this task
        for batch in slices(batches):
            rows = []
            for text, wants in zip(column_bytes(batch, "text"), batch.column("wanted").to_pylist()):
                for w in wants:
                    name = w["key"], w["seg"]
                    if name not in seen:
                        seen.add(name)
                        start = w["place"] >> 8
                        rows.append((*name, w["n"], w["crowded"], text[start: start + (w["place"] & 255) + window]))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()])],
                names=["key", "seg", "n", "crowded", "content"])

    return texts.join(wanted, "h").select("text", "wanted").mapInArrow(cut, "key bigint, seg bigint, n bigint, crowded boolean, content binary")


def _by_suffix_array(contents: DataFrame, shards: int, window: int) -> DataFrame:
    """``(key, seg, runs)`` of the segments that hold a repeated window."""
    def find(table: pa.Table) -> pa.Table:
        rows = {(k, s): (n, c) for k, s, n, c in zip(*(table.column(x).to_pylist() for x in ("key", "seg", "n", "content")))}
        runs = shard_runs([c for _, c in rows.values()], [n for n, _ in rows.values()], window)
        hit = [(k, s, [{"a": a, "b": b} for a, b in r]) for (k, s), r in zip(rows, runs) if r]
        columns = list(zip(*hit)) if hit else [[]] * 3
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "seg", "runs"])

    dealt = contents.select("key", "seg", "n", "content", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(find, f"key bigint, seg bigint, runs {_RUNS}")


def _by_window(contents: DataFrame, window: int) -> DataFrame:
    """The same for anchors with too many segments for a shard: windows are counted by their 128-bit hashes."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for key, seg, n, content in zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "n", "content"))):
                m = len(content) - window + 1
                halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(content[i: i + window]) for i in range(m)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, key)), pa.array(np.full(m, seg)), pa.array(np.full(m, n)), pa.array(np.arange(m)),
                     pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["key", "seg", "n", "i", "w1", "w2"])

    once = contents.dropDuplicates(["key", "seg"])
    windows = materialise(once.mapInArrow(explode, "key bigint, seg bigint, n bigint, i bigint, w1 bigint, w2 bigint"), "windows")
    often = materialise(windows.groupBy("w1", "w2").agg(F.sum("n").alias("t")).where("t > 1").select("w1", "w2"), "often")
    found = windows.join(often, ["w1", "w2"]).groupBy("key", "seg").agg(F.collect_list(F.struct(F.col("i").alias("a"), (F.col("i") + window).alias("b"))).alias("runs"))
    return found


def repeated_runs(docs: DataFrame, text: str, window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES,
                  most: int = SEGMENTS) -> DataFrame:
    """``(h, runs)``: of each text with a repeated window, told by ``h``, the covered bytes ``[a, b)`` in any order."""
    texts = docs.select(_text_id(text).alias("h"), F.col(text).alias("text"))
    cuts = materialise(_segments(texts, window, anchor), "segments")
    anchors = cuts.select("rid", F.explode("segments").alias("s")).select("rid", "s.*")
    live = materialise(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "live")
    left = materialise(anchors.join(live, "key"), "left")
    kinds = left.groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("at"))
    kinds = materialise(kinds.select("key", "seg", "n", "at.*"), "kinds")
    crowded = materialise(kinds.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > most).select("key", F.lit(True).alias("crowded")), "crowded")
    size = kinds.agg(F.sum(F.col("place").bitwiseAND(F.lit(255)) + window).alias("b")).first()["b"] or 0
    names = cuts.select("rid", "h")
    wanted = (
        kinds.join(crowded, "key", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
        .groupBy("rid").agg(F.collect_list(F.struct("key", "seg", "n", "crowded", "place")).alias("wanted"))
        .join(names, "rid").drop("rid")
    )
    contents = materialise(_contents(texts, wanted, window), "contents")
    shards = max(1, -(-size // shard_bytes))
    found = _by_suffix_array(contents.where("not crowded"), shards, window)
    if not crowded.isEmpty():
        found = found.unionByName(_by_window(contents.where("crowded"), window))
    found = materialise(found, "runs")
    start = F.shiftright("place", 8)
    placed = left.join(found, ["key", "seg"]).select(
        "rid", F.transform("runs", lambda r: F.struct((r["a"] + start).alias("a"), (r["b"] + start).alias("b"))).alias("runs"))
    per_text = placed.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs")).join(names, "rid")
    return per_text.groupBy("h").agg(F.first("runs").alias("runs"))  # copies of a text have the same


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeated_bytes(docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES,
                          most: int = SEGMENTS, keep_text: bool = True) -> DataFrame:
    """Every row with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``, without its text.

    Strings are judged on the input: all occurrences go, the first one as well, copies of a text go whole.  ``kept`` is
    binary, as a cut may fall inside a character; ``keep_text=False`` leaves it out.  Null and empty texts have no
    bytes (``kept`` of a null text is null); texts shorter than a window stay whole.  Repeated rows are repeated texts.
    An empty table gives no row.  Columns named like an output are replaced by it.
    """
    if not 0 < anchor <= window <= anchor + 255:
        raise ValueError("a window holds its anchor and at most 255 bytes more")
    plain, names = positional(docs)
    text_ = names[text]
    runs = materialise(repeated_runs(plain, text_, window, anchor, shard_bytes, most), "repeated")
    joined = plain.withColumn("h", _text_id(text_)).join(runs, "h", "left").drop("h")
    outputs = ["kept"] * keep_text + ["n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def remove(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in outputs}
        for t, found in zip(column_bytes(batch, text_), batch.column("runs")):
            gone = merged(found.as_py() or [])
            data, at, rest = t or b"", 0, []
            for a, b in gone:
                rest.append(data[at:a])
                at = b
            rest.append(data[at:])
            kept = b"".join(rest)
            if keep_text:
                out["kept"].append(None if t is None else kept)
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(kept))
            out["n_spans"].append(len(gone))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return out

    kinds = {"kept": "binary", "kept_sha256": "string"}
    added = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in outputs)
    return restored(map_rows(joined, remove, added, [text_, "runs"]), names, outputs)
