"""Importance resampling towards a target, with features hashed by a position-table CRC.

A feature is a run of consecutive words; its bucket is the CRC-32 of its bytes,
modulo the number of buckets.  CRC-32 is affine: what one byte adds depends only
on its value and its distance from the end, and the rest only on the length.
So a table of 64 distances by 256 byte values is made once, all features of many
texts are looked up at once, and ``bitwise_xor.reduceat`` over the spans of the
features gives their checksums; a constant per length is added.  Spans of more
than 64 bytes are cut into blocks of 64 from their end, and neighbouring blocks
are folded together in rounds, each shifting the left one past the right one.

Feature counts of the corpus and of the target are summed per task, then by
Spark; what the driver holds are the sums, one per bucket.  A second pass adds
up each text's gains.  The draw is a ranking of narrow rows by Gumbel-perturbed
score: range-partitioned, sorted in their ranges, numbered by range sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiretide.llm.common import WORD_BYTES, column_bytes, map_rows, positional, restored, slices
from hiretide.operators.ranking import number_rows
from hiretide.operators.scratch import materialise

BUCKETS = 10_000
MAX_WORDS = 1
LEAST_FEATURES = 20
SHARE = 10
SEED = 2024
#: Longest span looked up in one step, and the block length of longer ones.
BLOCK = 64
#: Bytes of spans looked up at once.
CHUNK = 1 << 20
_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(_POLYNOMIAL), state >> 1).astype(np.uint32)
    return state


def _position_table(distances: int = BLOCK) -> np.ndarray:
    """What a byte adds at each distance from the end, flat: entry distance * 256 + byte."""
    one = _byte_table()
    rows = [one]
    while len(rows) < distances:
        rows.append((rows[-1] >> 8) ^ one[rows[-1] & 255])
    return np.concatenate(rows)


def _moved(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States shifted by the table's number of zero bytes; a table has a row for each byte of a state."""
    return table[0][state & 255] ^ table[1][state >> 8 & 255] ^ table[2][state >> 16 & 255] ^ table[3][state >> 24]


def _shift_tables(bits: int = 40) -> list[np.ndarray]:
    """Shifts by 1, 2, 4, .. zero bytes, each from the one before applied twice."""
    one, byte = _byte_table(), np.arange(256, dtype=np.uint32)
    tables = [np.stack([one, byte, byte << 8, byte << 16]).astype(np.uint32)]
    while len(tables) < bits:
        tables.append(np.stack([_moved(tables[-1], row) for row in tables[-1]]))
    return tables


class PositionCrc:
    """CRC-32 of many spans of one buffer."""

    def __init__(self) -> None:
        self.table = _position_table()
        self.shifts = _shift_tables()
        self.constants = self._constant(np.arange(BLOCK + 1))

    def _constant(self, lengths: np.ndarray) -> np.ndarray:
        """The checksum of so many zero bytes: all that depends on the length alone."""
        state = np.full(len(lengths), _ONES, np.uint32)
        for k, table in enumerate(self.shifts):
            hit = lengths >> k & 1 == 1
            if hit.any():
                state[hit] = _moved(table, state[hit])
        return state ^ _ONES

    def _looked_up(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Table entries of spans of 1 to 64 bytes, XORed over each span."""
        out = np.empty(len(start), np.uint32)
        ends = np.cumsum(length)
        at = 0
        while at < len(start):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            size = length[at:upto]
            first = np.cumsum(size) - size
            place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
            distance = np.repeat(size, size) - 1 - place
            entries = self.table[distance * 256 + buffer[np.repeat(start[at:upto], size) + place]]
            out[at:upto] = np.bitwise_xor.reduceat(entries, first)
            at = upto
        return out

    def _folded(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Longer spans: blocks from the end, neighbours folded until one state a span is left."""
        blocks = -(-length // BLOCK)
        owner = np.repeat(np.arange(len(start)), blocks)
        number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        stop = start[owner] + length[owner] - (blocks[owner] - 1 - number) * BLOCK
        begin = np.maximum(stop - BLOCK, start[owner])
        states = self._looked_up(buffer, begin, stop - begin)
        step = BLOCK.bit_length() - 1
        while (blocks > 1).any():
            pairs = (blocks + 1) // 2
            even = np.zeros(2 * pairs.sum(), np.uint32)  # a missing left neighbour is a zero state
            lead = np.cumsum(2 * pairs) - 2 * pairs + (blocks & 1)
            even[np.repeat(lead, blocks) + np.arange(len(states)) - np.repeat(np.cumsum(blocks) - blocks, blocks)] = states
            states = _moved(self.shifts[step], even[0::2]) ^ even[1::2]
            blocks, step = pairs, step + 1
        return states

    def of(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Unsigned checksums of the spans, each of one byte or more."""
        out = np.empty(len(start), np.uint32)
        short = length <= BLOCK
        if short.any():
            out[short] = self._looked_up(buffer, start[short], length[short]) ^ self.constants[length[short]]
        if not short.all():
            long = ~short
            out[long] = self._folded(buffer, start[long], length[long]) ^ self._constant(length[long])
        return out


def spans_of(texts: list[bytes | None], max_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of the texts' words, and of all runs of 1 to max_words words: text number, start, length."""
    plain = [b" ".join(t.translate(WORD_BYTES).split()) if t else b"" for t in texts]
    buffer = np.frombuffer(b"\n".join(plain) + b"\n", np.uint8)
    gap = np.flatnonzero(buffer <= 32)
    begin, owner = np.concatenate([[0], gap[:-1] + 1]), np.cumsum(buffer[gap] == 10) - (buffer[gap] == 10)
    word = gap > begin
    begin, stop, owner = begin[word], gap[word], owner[word]
    parts = []
    for size in range(1, max_words + 1):
        last = len(begin) - size + 1
        if last <= 0:
            break
        same = owner[:last] == owner[size - 1:]
        parts.append((owner[:last][same], begin[:last][same], (stop[size - 1:] - begin[:last])[same]))
    if not parts:
        none = np.empty(0, np.int64)
        return buffer, none, none, none
    return buffer, *(np.concatenate(column) for column in zip(*parts))


def _byte_slices(texts: list[bytes | None], limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes | None]]]:
    """Stretches of some 4 MB of text, with the number of their first; a longer text is one by itself."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or b"") > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t or b"")
    if at < len(texts):
        yield at, texts[at:]


def bucket_counts(docs: DataFrame, text: str, buckets: int, max_words: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, total = PositionCrc(), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for _, texts in _byte_slices(column_bytes(batch, "text")):
                buffer, _, start, length = spans_of(texts, max_words)
                total += np.bincount(crc.of(buffer, start, length) % buckets, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])

    summed = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.collect():  # a row a bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much more frequent each bucket is in the target, with one count added to each bucket."""
    size, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((int(t) + 1) * (all_corpus + size) / ((int(s) + 1) * (all_target + size))))
        for s, t in zip(corpus, target, strict=True)
    ], np.int64)


def gumbel(seed: int, key: Column) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of sha256('<seed>:<key>'); a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             buckets: int = BUCKETS, max_words: int = MAX_WORDS, least: int = LEAST_FEATURES, share: int = SHARE,
             seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """Every row with ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn), all long.

    Of the rows with at least ``least`` words, the ``share`` per cent (rounded down) of highest score are ranked from
    1; ties go to the smaller key (null first), then rows alike in both take any order among them.  Null and empty
    texts have no features, weight 0, and are not drawn.  An empty corpus gives no row, an empty target is a uniform
    one.  Columns named like an output are replaced by it; the key may not be.
    """
    outputs = ["n_features", "n_words", "weight", "score", "rank"]
    if key in outputs:
        raise ValueError(f"the key column cannot be named {key}")
    plain, names = positional(docs)
    key_, text_ = names[key], names[text]
    gain = gains(bucket_counts(docs, text, buckets, max_words), bucket_counts(target, target_text, buckets, max_words))

    def weigh(batch: pa.RecordBatch) -> dict[str, object]:
        crc = PositionCrc()
        n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for at, texts in _byte_slices(column_bytes(batch, text_)):
            buffer, owner, start, length = spans_of(texts, max_words)
            here = slice(at, at + len(texts))
            n[here] = np.bincount(owner, minlength=len(texts))
            words[here] = [len(t.translate(WORD_BYTES).split()) if t else 0 for t in texts] if max_words > 1 else n[here]
            np.add.at(weight[here], owner, gain[crc.of(buffer, start, length) % buckets])
        return {"n_features": n, "n_words": words, "weight": weight}

    weighed = map_rows(plain, weigh, "n_features long, n_words long, weight long", () if keep_text else (text_,))
    # one fixed arrangement of rows, so that rows alike in score and key can still be told apart
    scored = materialise(weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col(key_))), "scored")
    scored = scored.withColumn("at", F.monotonically_increasing_id())
    able = F.col("n_words") >= least
    ranked = number_rows(scored.where(able), [F.desc("score"), F.asc(key_), F.asc("at")], "ranked")
    drawn = F.floor(F.lit(share) * F.col("n_total") / 100)
    ranked = ranked.withColumn("rank", F.when(F.col("rn") < drawn, F.col("rn") + 1)).drop("rn", "n_total")
    whole = ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))).drop("at", "n_words")
    return restored(whole, names, ["n_features", "weight", "score", "rank"])
