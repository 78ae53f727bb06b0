"""Language-model scoring by deleted interpolation.

P(w | u v) = l3 P3(w | u v) + l2 P2(w | v) + l1 P1(w) + l0 / (V + 1)

P1 to P3 are maximum-likelihood estimates from the training texts over all
words, pairs and triples there are.  Weights l0 to l3 belong to a bucket of the
context's frequency (how often u v occurred, in powers of two) and are learned
by expectation-maximisation: one part of the training texts is deleted, its
n-grams are met with the counts of the other parts, and the weights that make
them most likely are taken.

Texts are dealt in chunks of some megabytes.  A chunk numbers its distinct words,
pairs and triples by hash and sends them in order, cut into ranges of the hash:
one block a range, of packed differences, with the counts where they are not all
one.  A range adds up what the blocks hold and answers each block with the sums,
in the block's own order, so that no key travels back.  A key comes at most once
from a chunk and hashes fall evenly, so no range is hot; ranges grow in number
with the texts, and what is looked up grows with them.

Words are told by 64 bits, pairs and triples by as many as their number needs and
24 more, so that one in sixteen million meets another's count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide.llm.common import column_bytes, positional, restored, schema_of, slices, spaced_words
from hiretide.operators.scratch import materialise

#: One of so many training texts is deleted to learn the weights.
PARTS = 10
BUCKETS = 40
ROUNDS = 30
#: Add-k smoothing of the unigram baseline.
ADD = 0.1
END = b"\n"
#: Text whose words, pairs and triples are looked up together.
CHUNK_BYTES = 4 << 20
#: Keys in a range, at most and on average.
RANGE_KEYS = 1 << 21
#: Bits of a pair's or triple's key beyond those that number them.
SPARE_BITS = 24
#: Estimates that are interpolated.
PARTS_OF_P = 4
#: Kinds of chunk: learned from, deleted to learn the weights, scored only.
LEARN, DELETED, SCORED = 0, 1, 2


def tokens(text: bytes | None) -> list[bytes]:
    """Words between white space, A-Z lowered, and one end."""
    words = spaced_words(text)
    words.append(END)
    return words


# --- packing ----------------------------------------------------------------

def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, lowest first, as many as the largest needs, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<u8").ravel()


def _packed_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).combine_chunks()


# --- chunks -----------------------------------------------------------------

def deal(rows: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """``(chunk, kind, n_rows, n_bytes, rows)``: neighbouring rows of one kind, some ``size`` bytes of text, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: dict[int, tuple[list[pa.RecordBatch], int]] = {}

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            parts, n_bytes = held.pop(kind)
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([number], pa.int64()), "kind": pa.array([kind], pa.int32()), "n_rows": pa.array([whole.num_rows], pa.int64()),
                "n_bytes": pa.array([n_bytes], pa.int64()), "rows": pa.array([_packed_rows(whole)], pa.binary())})

        for batch in slices(batches):
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            lengths = np.array([len(t or b"") for t in column_bytes(batch, "text")], np.int64)
            for kind in np.unique(kinds).tolist():
                mine = np.flatnonzero(kinds == kind)
                # cut where the chunk is full
                total = np.cumsum(lengths[mine]) + (held[kind][1] if kind in held else 0)
                for step in np.split(mine, np.flatnonzero(np.diff(total // size)) + 1):
                    parts, n_bytes = held.get(kind, ([], 0))
                    held[kind] = [*parts, batch.take(pa.array(step)).drop_columns(["kind"])], n_bytes + int(lengths[step].sum())
                    if held[kind][1] >= size:
                        yield flush(kind)
        for kind in list(held):
            yield flush(kind)

    return rows.mapInArrow(run, "chunk bigint, kind int, n_rows bigint, n_bytes bigint, rows binary")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of two hashes in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each token the 64-bit keys of its word, pair and triple (three rows), and where each text begins."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    of: dict[bytes, int] = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*texts)}
    w = np.fromiter((of[x] for t in texts for x in t), np.uint64, int(sizes.sum()))
    end = np.array([xxhash.xxh3_64_intdigest(END)], np.uint64)
    v = np.concatenate([end, w[:-1]])
    v[starts] = end
    two = _mix(v, w)
    before = np.concatenate([end, two[:-1]])
    before[starts] = _mix(end, end)
    return np.stack([w, two, _mix(before, w)]), starts


class Chunk:
    """A chunk's distinct keys: words, then pairs and triples, each sorted, and where each token's lie among them."""

    def __init__(self, texts: list[bytes | None], bits: int) -> None:
        keys, self.starts = gram_keys([tokens(t) for t in texts])
        self.words, self.word_at = np.unique(keys[0], return_inverse=True)
        self.grams, at = np.unique(keys[1:].ravel() >> np.uint64(64 - bits), return_inverse=True)
        self.pair_at, self.triple_at = at[: len(self.word_at)], at[len(self.word_at):]
        self.end = int(np.searchsorted(self.words, np.uint64(xxhash.xxh3_64_intdigest(END))))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.word_at, minlength=len(self.words)), (
            np.bincount(self.pair_at, minlength=len(self.grams)) + np.bincount(self.triple_at, minlength=len(self.grams)))


def _blocks(keys: np.ndarray, counts: np.ndarray, bits: int, level: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(range, keys, packed differences, packed counts) of the ranges that sorted keys of so many bits fall into."""
    range_ = (keys >> np.uint64(bits - level)).astype(np.int64) if level else np.zeros(len(keys), np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(range_)) + 1, [len(keys)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(range_[a]), b - a, packed(np.concatenate([keys[a: a + 1], np.diff(keys[a:b])])), packed(counts[a:b].astype(np.uint64))


def requests(chunks: DataFrame, bits: int, word_level: int, gram_level: int) -> DataFrame:
    """``(range, chunk, kind, size, keys, counts)``: what each chunk asks of each range; ranges of words are below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, kind, rows in zip(batch.column("chunk").to_pylist(), batch.column("kind").to_pylist(), batch.column("rows")):
                own = Chunk(_rows([rows.as_py()])["text"].cast(pa.binary()).to_pylist(), bits)
                words, grams = own.counts()
                found = [(-1 - r, *rest) for r, *rest in _blocks(own.words, words, 64, word_level)]
                found += _blocks(own.grams, grams, bits, gram_level)
                for at in range(0, len(found), 64):
                    some = list(zip(*found[at: at + 64]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some[0], pa.int64()), pa.array([chunk] * len(some[0]), pa.int64()), pa.array([kind] * len(some[0]), pa.int32()),
                         pa.array(some[1], pa.int64()), pa.array(some[2], pa.binary()), pa.array(some[3], pa.binary())],
                        names=["range", "chunk", "kind", "size", "keys", "counts"])

    return chunks.select("chunk", "kind", "rows").mapInArrow(run, "range bigint, chunk bigint, kind int, size bigint, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """``(range, chunk, n, kept, distinct, total, total_kept)``: the sums for each block, in its order.

    ``n`` counts all training texts; ``kept``, for chunks of the deleted part, those that are not deleted.  A row
    without chunk tells of each range how many distinct keys were learned and how often.
    """

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        keys = [np.cumsum(unpacked(b), dtype=np.uint64) for b in table["keys"].to_pylist()]
        counts = [unpacked(b).astype(np.int64) for b in table["counts"].to_pylist()]
        sizes = [len(k) for k in keys]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        kind, count = np.repeat(kinds, sizes), np.concatenate(counts)
        n, kept = (np.bincount(at, np.where(of, count, 0)).astype(np.int64) for of in (kind < SCORED, kind == LEARN))
        places = np.split(at, np.cumsum(sizes)[:-1])
        rows = len(sizes)
        where = table["range"][0].as_py()
        return pa.table({
            "range": pa.array([where] * (rows + 1), pa.int64()), "chunk": pa.array([*table["chunk"].to_pylist(), None], pa.int64()),
            "n": pa.array([*(packed(n[p].astype(np.uint64)) for p in places), None], pa.binary()),
            "kept": pa.array([*(packed(kept[p].astype(np.uint64)) if k == DELETED else None for p, k in zip(places, kinds)), None], pa.binary()),
            "distinct": pa.array([None] * rows + [int((n > 0).sum())], pa.int64()),
            "total": pa.array([None] * rows + [int(n.sum())], pa.int64()), "total_kept": pa.array([None] * rows + [int(kept.sum())], pa.int64()),
        })

    return asked.groupBy("range").applyInArrow(run, "range bigint, chunk bigint, n binary, kept binary, distinct bigint, total bigint, total_kept bigint")


# --- the model --------------------------------------------------------------

def _estimates(rows: pa.Table, told: pa.Table, bits: int, column: str, total: int, distinct: int) -> tuple[np.ndarray, ...]:
    """Per token of a chunk: the bucket, the four estimates and the word's count; and where its texts begin."""
    own = Chunk(rows["text"].cast(pa.binary()).to_pylist(), bits)
    range_ = told["range"].to_numpy()
    blobs = told[column]
    parts = {int(r): i for i, r in enumerate(range_)}
    words = [unpacked(blobs[parts[r]].as_py()) for r in sorted((r for r in parts if r < 0), reverse=True)]
    grams = [unpacked(blobs[parts[r]].as_py()) for r in sorted(r for r in parts if r >= 0)]
    words, grams = (np.concatenate(x).astype(np.float64) for x in (words, grams))
    one, two, three = words[own.word_at], grams[own.pair_at], grams[own.triple_at]
    # what came before: a text begins after an end, as often as there are texts
    ends = words[own.end]
    v, uv = np.concatenate([[0.0], one[:-1]]), np.concatenate([[0.0], two[:-1]])
    v[own.starts] = uv[own.starts] = ends
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    p = np.stack([over(three, uv), over(two, v), one / total if total else one, np.full(len(one), 1 / (distinct + 1))], axis=1)
    return np.minimum(np.log2(uv + 1).astype(np.int64), BUCKETS - 1), p, one, own.starts


def learned(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that make n events of probabilities p most likely."""
    w = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(ROUNDS):
        part = p * w
        part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
        w = (part * n[:, None]).sum(0) + 1e-3  # no weight is zero
        w /= w.sum()
    return w


def fit_weights(chunks: DataFrame, told: DataFrame, bits: int, total: int, distinct: int) -> np.ndarray:
    """Weights by bucket from expectation-maximisation over the deleted texts.

    Events with the same bucket and like probabilities (in steps of a power of two) are counted together with
    their means, which is what the driver iterates over.
    """
    names = [f"p{i}" for i in range(PARTS_OF_P)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket, p, _, _ = _estimates(_rows(left["rows"].to_pylist()), right, bits, "kept", total, distinct)
        step = np.where(p > 0, np.floor(np.log2(np.maximum(p, 1e-300))), -127).astype(np.int64) + 127
        cell = bucket
        for i in range(PARTS_OF_P - 1):
            cell = cell * 128 + np.clip(step[:, i], 0, 127)
        cell, at, n = np.unique(cell, return_inverse=True, return_counts=True)
        return pa.table({"cell": cell, "bucket": cell >> 21, "n": n} | {c: np.bincount(at, p[:, i], len(cell)) for i, c in enumerate(names)})

    cells = chunks.where(F.col("kind") == DELETED).select("chunk", "rows").groupBy("chunk").cogroup(
        told.where("kept is not null").select("range", "chunk", "kept").groupBy("chunk")
    ).applyInArrow(run, "cell bigint, bucket bigint, n bigint, " + ", ".join(f"{c} double" for c in names))
    cells = cells.groupBy("cell", "bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toPandas()
    if not len(cells):
        return np.tile(np.eye(PARTS_OF_P)[-1] if not total else np.full(PARTS_OF_P, 1 / PARTS_OF_P), (BUCKETS, 1))

    def of(own) -> np.ndarray:
        n = own["n"].to_numpy(float)
        return learned(own[names].to_numpy(float) / n[:, None], n)

    weights = np.tile(of(cells), (BUCKETS, 1))  # for buckets that were not met
    for b, own in cells.groupby("bucket"):
        weights[int(b)] = of(own)
    return weights


def _level(keys: int, per_range: int) -> int:
    """Bits that number the ranges."""
    return max(0, (max(keys, 1) // per_range).bit_length())


def score(docs: DataFrame, learn: str, text: str = "text", key: str = "doc_id", chunk_bytes: int = CHUNK_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """Every row without its text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    learn is a boolean column: the model sees these rows only (null counts as false).  Scores are log10
    probabilities of the whole text, its end included; base_score is the add-0.1 unigram model.  A null or empty
    text is its end alone.  Without a row to learn from every token has probability one in both models.  key only deals the
    training texts to the deleted part; rows are never matched by it.  An empty table gives none.  Columns named like an
    output are replaced by it.
    """
    plain, names = positional(docs)
    outputs = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    taught = F.coalesce(F.col(names[learn]), F.lit(False))
    kind = F.when(~taught, SCORED).when(F.pmod(F.xxhash64(F.col(names[key]).cast("string")), F.lit(PARTS)) == 0, DELETED).otherwise(LEARN)
    columns = [c for old, c in names.items() if old != text]
    rows = plain.select(*columns, F.col(names[text]).alias("text"), kind.alias("kind"))
    chunks = materialise(deal(rows, chunk_bytes), "chunks")
    size = chunks.agg(F.sum("n_rows").alias("rows"), F.sum("n_bytes").alias("bytes")).first()
    most = (size["bytes"] or 0) // 2 + 2 * (size["rows"] or 0)  # tokens there can be
    bits = min(64, (2 * most + 1).bit_length() + SPARE_BITS)
    asked = requests(chunks, bits, _level(most // 16, range_keys), _level(most // 2, range_keys))
    told = materialise(answers(asked), "counts")
    sums = told.where("chunk is null and range < 0").agg(F.sum("distinct"), F.sum("total"), F.sum("total_kept")).first()
    distinct, total, total_kept = (x or 0 for x in sums)
    told = told.where("chunk is not null")
    weights = fit_weights(chunks, told, bits, total_kept, distinct)
    below = total + ADD * (distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _rows(left["rows"].to_pylist())
        bucket, p, n, starts = _estimates(table, right, bits, "n", total, distinct)
        own = np.log10((weights[bucket] * p).sum(1))
        base = np.log10((n + ADD) / below)
        sums = [np.add.reduceat(x, starts) for x in (np.ones(len(n), np.int64), (n > 0).astype(np.int64), base, own)]
        return pa.table([*(table[c] for c in columns), *sums], names=[*columns, "n_tokens", "n_known", "base_score", "score"])

    schema = schema_of([rows.schema[c] for c in columns], "n_tokens bigint, n_known bigint, base_score double, score double")
    scored = chunks.select("chunk", "rows").groupBy("chunk").cogroup(told.select("range", "chunk", "n").groupBy("chunk")).applyInArrow(run, schema)
    return restored(scored.withColumn("train_tokens", F.lit(total).cast("bigint")), names, outputs)
