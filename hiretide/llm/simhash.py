"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits link when they differ in at most ``max_bits``.  Split
into ``m`` segments around a ring, two such fingerprints must have a start from
which every chain of ``l`` consecutive segments differs in at most
``l * max_bits / m`` bits.  Read for two segments that gives the index: one half
differs in at most ``max_bits / 2`` bits.  Both sides emit their half with up to
``max_bits / 4`` bits flipped, so they meet in a common key.  Read for eight
segments it prunes what met before the full Hamming check.

Equal fingerprints are one node, so copies cost one row each.  Within a key the
verified links are contracted to a forest at once; a key with more than ``block``
members is dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiretide.llm.common import clean_name, column_bytes, map_rows, spaced_words
from hiretide.llm.components import connected_components
from hiretide.operators.scratch import materialise

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = 8
BLOCK = 4096
_HALF = 32
_CHUNK = 1 << 16
_PAIRS = 1 << 18


def fingerprint_of(text: bytes | None, k: int) -> int:
    """Signed 64-bit SimHash: a bit is set if over half the shingle hashes set it."""
    words = spaced_words(text)
    if not words:
        return 0
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    joined = b" ".join(words)
    n = max(1, len(words) - k + 1)
    first, last = starts[:n].tolist(), (ends[min(k, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = b"".join([digest(joined[i:j], SEED) for i, j in zip(first[at:at + _CHUNK], last[at:at + _CHUNK])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text: str = "text", k: int = SHINGLE_WORDS, to: str = "fp", drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their fingerprint; null and wordless texts have fingerprint zero."""
    return map_rows(docs, lambda batch: {to: [fingerprint_of(t, k) for t in column_bytes(batch, text)]}, f"{to}: bigint", drop)


def ring_and_hamming(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs of unsigned fingerprints link: the chains first, the whole distance for what they leave."""
    apart = a ^ b
    parts = np.bitwise_count(apart.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    viable = np.zeros(len(apart), bool)
    for start in range(SEGMENTS):
        ok = np.ones(len(apart), bool)
        total = np.zeros(len(apart), np.int16)
        for step in range(SEGMENTS - 1):
            total = total + parts[:, (start + step) % SEGMENTS]
            ok &= total * SEGMENTS <= (step + 1) * max_bits
        viable |= ok
    linked = np.zeros(len(apart), bool)
    linked[viable] = np.bitwise_count(apart[viable]) <= max_bits
    return linked


class Forest:
    """Union-find over what one task has linked; the root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (parent := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(parent, parent)
            x = parent
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]


def _pairs_within(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each group, a bounded number at a time."""
    for size in np.unique(sizes):
        i, j = np.triu_indices(int(size), 1)
        own = starts[sizes == size]
        step = max(1, _PAIRS // max(1, len(i)))
        for at in range(0, len(own), step):
            base = own[at:at + step, None]
            for cut in range(0, len(i), _PAIRS):
                yield (base + i[None, cut:cut + _PAIRS]).ravel(), (base + j[None, cut:cut + _PAIRS]).ravel()


def _link_groups(max_bits: int, block: int):
    """Batches of rows sorted by key to a forest of links; members of larger keys pass on, numbered."""

    def flush(forest: Forest) -> pa.RecordBatch:
        a, b = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names=["a", "b", "key", "nth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        over, passed = None, 0  # the key whose members pass on, and how many have

        def work(keys: np.ndarray, fps: np.ndarray) -> None:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            many = sizes > 1
            unsigned = fps.view(np.uint64)
            for i, j in _pairs_within(sizes[many], starts[many]):
                hit = ring_and_hamming(unsigned[i], unsigned[j], max_bits)
                for a, b in zip(fps[i[hit]].tolist(), fps[j[hit]].tolist()):
                    forest.link(a, b)

        def passing(fps: np.ndarray) -> pa.RecordBatch:
            nonlocal passed
            nth = np.arange(passed, passed + len(fps))
            passed += len(fps)
            return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(np.full(len(fps), over)), pa.array(nth)], names=["a", "b", "key", "nth"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            while len(keys):
                if over is not None:
                    n = int(np.searchsorted(keys, over, "right"))
                    if n:
                        yield passing(fps[:n])
                    keys, fps = keys[n:], fps[n:]
                    if not len(keys):
                        break
                    over = None
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                sizes = np.diff(np.r_[starts, len(keys)])
                large = np.flatnonzero(sizes > block)
                end = int(starts[large[0]]) if len(large) else int(starts[-1])  # the last key may go on
                if end:
                    work(keys[:end], fps[:end])
                    keys, fps = keys[end:], fps[end:]
                if not len(large):
                    break
                over, passed = int(keys[0]), 0
            if len(forest.up) > _PAIRS:
                yield flush(forest)
                forest = Forest()
        if len(keys) and over is None:
            work(keys, fps)
        yield flush(forest)

    return run


def _link_blocks(max_bits: int):
    """All links between the members of one pair of blocks, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(own: list[np.ndarray]) -> pa.RecordBatch:
            forest, fps = Forest(), np.concatenate(own)
            unsigned = fps.view(np.uint64)
            for i, j in _pairs_within(np.array([len(fps)]), np.array([0])):
                hit = ring_and_hamming(unsigned[i], unsigned[j], max_bits)
                for a, b in zip(fps[i[hit]].tolist(), fps[j[hit]].tolist()):
                    forest.link(a, b)
            a, b = forest.edges()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        group, own = None, []
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "x", "y")], axis=1)
            fps = batch.column("a").to_numpy()
            cuts = np.flatnonzero(np.any(ids[1:] != ids[:-1], axis=1)) + 1
            for rows, part in zip(np.split(ids, cuts), np.split(fps, cuts), strict=True):
                if len(part) == 0:
                    continue
                if group != tuple(rows[0]) and own:
                    yield done(own)
                    own = []
                group = tuple(rows[0])
                own.append(part)
        if own:
            yield done(own)

    return run


def fingerprint_links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``(fp long)``, distinct, to edges ``(a, b)`` whose components are those of all links."""
    each = (max_bits // 2 + 1) // 2
    flips = [c for n in range(each + 1) for c in combinations(range(_HALF), n)]
    masks = F.array(*[F.lit(sum(1 << bit for bit in c)).cast("bigint") for c in flips])
    halves = F.array(
        F.struct(F.lit(0).cast("bigint").alias("side"), F.shiftrightunsigned("fp", _HALF).alias("half")),
        F.struct(F.lit(1 << _HALF).cast("bigint").alias("side"), F.col("fp").bitwiseAND(F.lit((1 << _HALF) - 1)).alias("half")),
    )
    keyed = (
        nodes.select("fp", F.explode(halves).alias("h"))
        .select("fp", "h", F.explode(masks).alias("mask"))
        .select(F.col("h.half").bitwiseXOR(F.col("mask")).bitwiseOR(F.col("h.side")).alias("key"), "fp")
        .repartition("key").sortWithinPartitions("key")
    )
    found = materialise(keyed.mapInArrow(_link_groups(max_bits, block), "a bigint, b bigint, key bigint, nth bigint"), "links")
    within = found.where("b is not null").select("a", "b")
    large = found.where("b is null")
    counts = large.groupBy("key").agg((F.floor((F.max("nth")) / block)).alias("top"))
    dealt = (
        large.join(counts, "key").withColumn("own", F.floor(F.col("nth") / block))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))))
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "a")
        .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    )
    return within.unionByName(dealt.mapInArrow(_link_blocks(max_bits), "a bigint, b bigint"))


def _marked(docs: DataFrame, doc_id: str, text: str, k: int, max_bits: int, block: int, keep: list[str]):
    """The rows with row number and fingerprint, written; per fingerprint its component; per component its winner."""
    rid, fp = clean_name(docs, "rid"), clean_name(docs, "fp")
    marked = with_fingerprint(docs.select(*dict.fromkeys([*keep, doc_id, text])), text, k, fp, () if text in keep else (text,))
    marked = materialise(marked.withColumn(rid, F.monotonically_increasing_id()), "fingerprints")
    first = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(rid).alias("rid"))
    nodes = materialise(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(first).alias("first")), "nodes")
    found = connected_components(fingerprint_links(nodes.select("fp"), max_bits, block))
    labelled = nodes.join(found, nodes.fp == found.node, "left").select(
        F.col("fp").alias("__of_fp"), F.coalesce("component", "fp").alias("component"), "first"
    )
    return marked, labelled, labelled.groupBy("component").agg(F.min("first").alias("winner")), rid, fp


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """One row per input row: the id, ``fingerprint``, ``component_id`` and ``kept``.

    component_id is the smallest id reachable over links; exactly one row of each component is ``kept``,
    one that carries that id.  Null and wordless texts have fingerprint zero and link like any other.
    Null ids never win; a component of null ids only has a null component_id and still one kept row.
    Repeated rows and ids are separate rows of one component.  An empty table gives none.
    """
    marked, labelled, winners, rid, fp = _marked(docs, doc_id, text, k, max_bits, block, [doc_id])
    chosen = labelled.join(winners, "component").select(
        "__of_fp", F.col("winner.id").alias("component_id"), F.col("winner.rid").alias("__winner")
    )
    return marked.join(chosen, F.col(fp) == F.col("__of_fp")).select(
        doc_id, F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"), "component_id",
        (F.col(rid) == F.col("__winner")).alias("kept"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS,
                max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """The documents left when one row of each component stays (see ``near_duplicates``); columns as given."""
    marked, _, winners, rid, _ = _marked(docs, doc_id, text, k, max_bits, block, docs.columns)
    stay = winners.select(F.col("winner.rid").alias("__stays"))
    return marked.join(stay, F.col(rid) == F.col("__stays"), "left_semi").select(*docs.columns)
