"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is read as windows of ``window`` consecutive words (one window
if it has fewer), a window as shingles of three words.  Containing a window
means containing all its shingles, so for that threshold the necessary prefix
is its rarest shingle.  All of it are Spark tables:

1. distinct windows by their content, and which items have them;
2. how often each of their shingles occurs in the corpus, combined in the tasks;
3. each window's rarest shingle, its prefix; a window with a shingle that the
   corpus lacks is done;
4. where a document has a prefix, the words around it, joined with the windows on
   the prefix.  The prefix's place in the window says where the window would
   begin (positional bound); it has to lie inside the document (length bound)
   and to be there word by word (exact containment).

Documents look shingles up in a bit map of fixed size first, so only those that
may be in the benchmark, or lead a window, become rows.  Time follows the number
of words, repeated ones as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide.llm.common import WORD_BYTES, column_bytes, map_rows, plain_words, positional, restored, slices, worker_state
from hiretide.operators.scratch import materialise

WINDOW = 13
SHINGLE = 3
#: A document is contaminated if at least this share of its words is hit: hits * SHARE >= words.
SHARE = 20
#: Blocks of 32768 bits in a bit map, a power of two.
BLOCKS = 1024
#: Windows, and bytes of text, worked on at once.
_WINDOWS = 2048
_BYTES = 1 << 20


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers; a worker keeps those that usual texts need."""
    state = worker_state()
    name = f"powers of {base}"
    if n > len(state.get(name, ())):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        out = np.cumprod(out, dtype=np.uint64)
        if n > 1 << 22:
            return out
        state[name] = out
    return state[name]


_BASE = 0x9E3779B97F4A7C15


class Words:
    """The words of some texts, found and hashed without an object each: places in one buffer."""

    def __init__(self, texts: list[bytes | None]) -> None:
        self.buffer = b"\n".join([t.translate(WORD_BYTES) if t else b"" for t in texts]) + b"\n"
        data = np.frombuffer(self.buffer, np.uint8)
        gap = np.flatnonzero(data <= 32)
        begin = np.concatenate([[0], gap[:-1] + 1])
        owner = np.cumsum(data[gap] == 10) - (data[gap] == 10)
        word = gap > begin
        self.begin, self.stop, self.owner = begin[word], gap[word], owner[word]
        self.sizes = np.bincount(self.owner, minlength=len(texts))
        n = len(data)
        room = max(1 << 21, 1 << n.bit_length())
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, room)[:n], out=total[1:])
        # equal words have equal hashes; what meets by hash is compared word by word
        self.hash = (total[self.stop] - total[self.begin]) * _powers(pow(_BASE, -1, 1 << 64), room)[self.begin]

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit keys of the runs of k words (1 or 3) of each text, and the place of each run's first word among all words."""
        w = self.hash
        if k == 1:
            return _mix(w, w ^ np.uint64(0xFFFF)).view(np.int64), np.arange(len(w))
        at = np.flatnonzero(self.owner[: max(len(w) - k + 1, 0)] == self.owner[k - 1:])
        key = w[at]
        for i in range(1, k):
            key = _mix(key, w[at + i])
        return key.view(np.int64), at

    def run(self, first: int, end: int) -> bytes:
        """The words numbered [first, end), with blanks between."""
        return b" ".join(self.buffer[self.begin[first]: self.stop[end - 1]].split())


# --- the benchmark ----------------------------------------------------------

def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``(item, w1, w2, n, words, keys)``: each window of each item, told by 128 bits of its words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, t in zip(batch.column("item").to_pylist(), column_bytes(batch, "text")):
                own = plain_words(t)
                n = min(window, len(own))
                if not n:
                    continue
                k = SHINGLE if n >= SHINGLE else 1
                keys, _ = Words([b" ".join(own)]).keys(k)
                for at in range(0, len(own) - n + 1, _WINDOWS):
                    starts = range(at, min(at + _WINDOWS, len(own) - n + 1))
                    words = [b" ".join(own[i: i + n]) for i in starts]
                    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.int64).reshape(-1, 2)
                    m = len(words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * m, pa.string()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([n] * m, pa.int32()),
                         pa.array(words, pa.binary()).cast(pa.string()), pa.array([keys[i: i + n - k + 1] for i in starts], pa.list_(pa.int64()))],
                        names=["item", "w1", "w2", "n", "words", "keys"])

    named = benchmark.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text")).distinct()
    return named.mapInArrow(cut, "item string, w1 bigint, w2 bigint, n int, words string, keys array<bigint>")


def bit_map(keys: DataFrame) -> np.ndarray:
    """The keys (column ``key``) as a bit map of fixed size: its blocks are all the driver sees."""
    block = F.shiftrightunsigned("key", 64 - (BLOCKS.bit_length() - 1))
    bits = np.zeros((BLOCKS, 4096), np.uint8)
    found = keys.select(block.alias("block"), F.col("key").bitwiseAND(F.lit(32767)).alias("bit"))
    for r in found.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    unsigned = keys.view(np.uint64)
    block = unsigned >> np.uint64(64 - (BLOCKS.bit_length() - 1))
    bit = unsigned & np.uint64(32767)
    return (bits[block * np.uint64(4096) + (bit >> np.uint64(3))] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


# --- the documents ----------------------------------------------------------

def _some(texts: list[bytes | None]) -> Iterator[tuple[int, Words]]:
    """The words of texts in a row, about a megabyte at a time, with the first one's number."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t or b"")
        if size >= _BYTES:
            yield first, Words(held)
            held, size, first = [], 0, i + 1
    if held:
        yield first, Words(held)


def _occurrences(docs: DataFrame, shared, sizes: list[int]) -> DataFrame:
    """``(key, n)``: how often shingles that may be in the benchmark occur in the texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for _, words in _some(column_bytes(batch, "text")):
                for k in sizes:
                    keys, _ = words.keys(k)
                    keys, n = np.unique(keys[in_map(shared.value, keys)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return docs.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, shared, sizes: list[int], window: int) -> DataFrame:
    """``(h, key, at, first, around)``: where a text may have a prefix, the words around it and the place of the first of them."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("h")
            for number, words in _some(column_bytes(batch, "text")):
                end = np.cumsum(words.sizes)
                begin = end - words.sizes
                for k in sizes:
                    keys, at = words.keys(k)
                    hit = np.flatnonzero(in_map(shared.value, keys))
                    for part in np.split(hit, range(_WINDOWS, len(hit), _WINDOWS)):
                        text = words.owner[at[part]]
                        low = np.maximum(at[part] - window + k, begin[text])
                        high = np.minimum(at[part] + window, end[text])
                        around = [words.run(a, b) for a, b in zip(low.tolist(), high.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(text + number)), pa.array(keys[part]), pa.array(at[part] - begin[text]), pa.array(low - begin[text]),
                             pa.array(around, pa.binary()).cast(pa.string())],
                            names=["h", "key", "at", "first", "around"])

    return docs.select("h", "text").mapInArrow(find, "h binary, key bigint, at bigint, first bigint, around string")


def prefixes(windows: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``(key, offset, w1, w2, n, words)``: each window's rarest shingle and its place; windows with one that never occurs are left out."""
    contents = windows.groupBy("w1", "w2").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.first("keys").alias("keys"))
    shingles = contents.select("w1", "w2", F.posexplode("keys").alias("offset", "key"))
    rarest = shingles.join(occurrences, "key", "left").groupBy("w1", "w2").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset")).alias("r"))
    return rarest.where("r.n > 0").join(contents.drop("keys"), ["w1", "w2"]).select("r.key", "r.offset", "w1", "w2", "n", "words")


def text_id(text: str) -> Column:
    return F.unhex(F.md5(F.col(text)))


def found_windows(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """``(h, starts, items)`` of the texts, told by ``h``, that have a window: where windows begin and their words, sorted items."""
    spark = docs.sparkSession
    windows = materialise(benchmark_windows(benchmark, item_id, item_text, window), "windows")
    sizes = [SHINGLE] + [1] * (not windows.where(F.col("n") < SHINGLE).isEmpty())
    texts = docs.select(text_id(text).alias("h"), F.col(text).alias("text")).where("text is not null")
    every = spark.sparkContext.broadcast(bit_map(windows.select(F.explode("keys").alias("key"))))
    leads = materialise(prefixes(windows, materialise(_occurrences(texts, every, sizes), "occurrences")), "prefixes")
    leading = spark.sparkContext.broadcast(bit_map(leads.select("key")))
    met = materialise(_candidates(texts, leading, sizes, window), "candidates").join(leads, "key")
    start = F.col("at") - F.col("offset")
    there = F.array_join(F.slice(F.split("around", " "), (start - F.col("first") + 1).cast("int"), F.col("n")), " ")
    # copies of a text and repeats inside it say the same
    hits = met.where(start >= F.col("first")).where(there == F.col("words")).select("h", start.alias("start"), "n", "w1", "w2").distinct()
    hits = materialise(hits, "hits")
    starts = hits.groupBy("h").agg(F.collect_set(F.struct("start", "n")).alias("starts"))
    owners = windows.select("w1", "w2", "item").distinct()
    named = hits.select("h", "w1", "w2").distinct().join(owners, ["w1", "w2"]).groupBy("h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return starts.join(named, "h")


_SPANS = "array<struct<first: bigint, end: bigint>>"


def _spans(batch: pa.RecordBatch) -> dict[str, object]:
    """Overlapping and touching windows as one run of words."""
    spans = []
    for starts in batch.column("starts").to_pylist():
        runs: list[dict] = []
        for first, end in sorted((x["start"], x["start"] + x["n"]) for x in starts):
            if runs and first <= runs[-1]["end"]:
                runs[-1]["end"] = max(runs[-1]["end"], end)
            else:
                runs.append({"first": first, "end": end})
        spans.append(runs)
    return {"spans": spans}


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, share: int = SHARE, keep_text: bool = True) -> DataFrame:
    """Every column (the text only if asked), with ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids as text), ``spans`` and ``contaminated``.

    spans are the runs of hit words, ``[first, end)`` in word positions.  Null, empty and wordless texts have no
    words and are clean.  Items without words match nothing, repeated items count once, a null item id is called
    ``null``.  Without items every document is clean.  Columns named like an output are replaced by it.
    """
    plain, names = positional(docs)
    text_ = names[text]
    found = map_rows(found_windows(plain, text_, benchmark, item_id, item_text, window), _spans, f"spans {_SPANS}", ["starts"])
    found = materialise(found, "found")

    def count(batch: pa.RecordBatch) -> dict[str, object]:
        return {"n_words": np.concatenate([w.sizes for _, w in _some(column_bytes(batch, text_))] or [np.empty(0, np.int64)]).astype(np.int64)}

    # the text is counted where it lies; it travels only if it is asked for
    counted = map_rows(plain.withColumn("h", text_id(text_)), count, "n_words bigint", [] if keep_text else [text_])
    out = counted.join(found, "h", "left").drop("h")
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["first"])
    out = out.withColumns({"items": F.coalesce("items", F.array().cast("array<string>")), "spans": F.coalesce("spans", F.array().cast(_SPANS))})
    out = out.withColumn("n_hit", hits)
    out = out.withColumns({"n_items": F.size("items").cast("bigint"), "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))})
    return restored(out, names, ["n_words", "items", "spans", "n_hit", "n_items", "contaminated"])


def digest_items(items: str = "items"):
    """Lowercase hex SHA-256 of the comma-joined ids."""
    return F.sha2(F.array_join(items, ","), 256)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated; columns as given."""
    shared = {"n_words", "items", "spans", "n_hit", "n_items", "contaminated"} & set(docs.columns)
    hidden = {c: f"__{c}" for c in shared}
    found = contamination(docs.withColumnsRenamed(hidden), benchmark, hidden.get(text, text))
    return found.where("not contaminated").select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])
