"""Best-fit packing of token sequences by exact-complement hashing.

Documents become token ids plus an end id and are cut into pieces of at most
``size`` ids only when longer.  How the pieces are packed depends on their
lengths alone, so the plan is made from the histogram of lengths, which has at
most ``size`` rows whatever the corpus:

* the longest open length starts a template; single lengths, pair sums and
  triple sums that are available are indexed, and a combination that fills the
  gap exactly is consumed as often as its counts allow;
* without one, the longest length that fits is added (best fit) and the index
  asked again; what fits nothing is closed short.

Pieces get a number within their length from two passes over one written table
(a count per task, then offsets that each piece meets by task and length), and
the number finds the place in the plan.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiretide.llm.common import clean_name, column_bytes, schema_of, slices, worker_state
from hiretide.operators.scratch import materialise

SIZE = 4096
END_ID = 1
#: Words whose ids a worker remembers, and the longest word it remembers.
CACHE_WORDS = 300_000
CACHE_LENGTH = 48
#: Bytes of text worked on at once.
_TEXT_BYTES = 2 << 20
#: A run of small ASCII or Latin-1 letters (capitals of the latter too) and what may follow it but for ', < and |.
_LETTERS = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:;=-@\[-`{}~]*)")
#: How the vocabulary spells bytes that are no visible Latin-1 characters: the others, in order, from U+0100 on.
_SPELLED = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 512)))


def tokenizer_path() -> str:
    """The installed vocabulary file the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts under a tokenizer that lowers case and never merges across white space.

    A batch of texts is cut into words between blanks and line breaks, and the distinct words are numbered, both by
    Arrow.  Distinct words met lately are remembered in two generations, and so are the runs of letters they begin
    with, which are one unit for the merges, as is what follows; other words are given to the tokenizer whole, many
    to a call with a bar between them.
    """

    def __init__(self, path: str) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.bar = self._plain("|")
        self.marks: dict[bytes, bytes] = {}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        known, older = self.known, self.older
        new, tokens, marks = [], self.tokenizer.model.tokenize, self.marks
        for w in words:
            if (ids := older.get(w)) is not None:
                known[w] = ids
            elif plain := _LETTERS.fullmatch(w):
                word, mark = plain.groups()
                ids = known.get(word) or older.get(word)
                if ids is None:
                    spelled = word.decode() if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(_SPELLED)
                    ids = array("I", [t.id for t in tokens(spelled)]).tobytes()
                known[word] = ids
                if mark:
                    if mark not in marks:
                        if len(marks) > CACHE_WORDS:
                            marks.clear()
                        marks[mark] = self._plain(mark.decode()).tobytes()
                    known[w] = ids + marks[mark]
            elif b"|" in w:
                known[w] = self._plain(w.decode()).tobytes()
            else:
                new.append(w)
        for at in range(0, len(new), 128):
            some = new[at:at + 128]
            ids = self._plain(b" | ".join(some).decode())
            cuts = np.flatnonzero(ids == self.bar[0])
            raw = ids.tobytes()
            begins, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]
            known.update(zip(some, (raw[i:j] for i, j in zip(begins, ends)), strict=True))

    def _some_ids(self, texts: list[bytes]) -> tuple[bytes, list[int]]:
        """The ids of texts in a row, and where each one's begin, in bytes, with the end."""
        # a special token is spelled in small letters: only where none can arise is lowering safe
        plain = [(t if b"<|" in t else t.lower()).replace(b"\n", b" ") for t in texts]
        split = pc.split_pattern(pa.array(plain, pa.binary()), " ")
        numbered = split.values.dictionary_encode()
        words, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known = self.known
        new = [w for w in words if w not in known]
        self._learn(new)
        found = [known[w] for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat = np.frombuffer(b"".join(found), "<u4")
        n = size[number]
        ends = np.cumsum(n)
        first = np.cumsum(size) - size
        ids = flat[np.repeat(first[number] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        for w in new:
            if len(w) > CACHE_LENGTH:
                known.pop(w, None)
        return ids.tobytes(), (4 * np.concatenate([[0], ends])[split.offsets.to_numpy()]).tolist()

    def ids(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        held: list[bytes] = []
        size = 0
        for i, t in enumerate(texts):
            held.append(t or b"")
            size += len(held[-1])
            if size >= _TEXT_BYTES or i == len(texts) - 1:
                raw, at = self._some_ids(held)
                yield from (raw[a:b] for a, b in zip(at, at[1:]))
                held, size = [], 0


def _word_ids(path: str) -> WordIds:
    state = worker_state()
    if path not in state:
        state[path] = WordIds(path)
    return state[path]


def tokenise(docs: DataFrame, text: str = "text", path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The other columns, and per piece ``piece``, ``start``, ``length`` and ``ids`` (little-endian 32-bit).

    Null and empty texts are the end id alone.  A document of more than ``size`` ids, end id included, is cut
    every ``size`` ids.  Columns named like an output are replaced by it.
    """
    path = path or tokenizer_path()
    kept = [c for c in docs.columns if c not in (text, "piece", "start", "length", "ids")]
    end = np.array([end_id], "<u4").tobytes()
    schema = schema_of([docs.schema[c] for c in kept], "piece int, start bigint, length bigint, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_ids(path)
        for batch in slices(batches):
            rows, pieces, starts, ids = [], [], [], []
            for row, found in enumerate(encoder.ids(column_bytes(batch, text))):
                found += end
                for nth, at in enumerate(range(0, len(found), 4 * size)):
                    rows.append(row)
                    pieces.append(nth)
                    starts.append(at // 4)
                    ids.append(found[at:at + 4 * size])
            columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in kept]
            columns += [pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


class _Index:
    """Single lengths, pair sums and triple sums of what is available."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.astype(np.int64)  # by length, 0 unused
        self.open = self.left > 0
        n = len(counts)
        self.pairs = np.zeros(n, np.int64)  # by sum, how many pairs of open lengths
        for a in np.flatnonzero(self.open):
            self._count_pairs(int(a), 1, upto=int(a))

    def _count_pairs(self, a: int, by: int, upto: int) -> None:
        others = np.flatnonzero(self.open[: min(upto, len(self.open) - 1 - a) + 1])
        self.pairs[others + a] += by

    def take(self, template: dict[int, int], times: int) -> None:
        for length, k in template.items():
            self.left[length] -= k * times
            if not self.left[length]:
                self._count_pairs(length, -1, upto=len(self.open) - 1)
                self.open[length] = False

    def _free(self, used: dict[int, int]) -> np.ndarray:
        free = self.left.copy()
        for length, k in used.items():
            free[length] -= k
        return free

    def _pair(self, gap: int, free: np.ndarray) -> tuple[int, int] | None:
        a = np.arange(gap - 1, (gap - 1) // 2, -1)  # the longer one first
        b = gap - a
        ok = (free[a] > 0) & (free[b] > 0) & ((a != b) | (free[a] > 1))
        at = int(ok.argmax()) if len(ok) else 0
        return (int(a[at]), int(b[at])) if len(ok) and ok[at] else None

    def complement(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to the gap."""
        free = self._free(used)
        if free[gap] > 0:
            return (gap,)
        if self.pairs[gap] and (found := self._pair(gap, free)):
            return found
        a = np.arange(gap - 2, 0, -1)
        for first in a[(free[a] > 0) & (self.pairs[gap - a] > 0)]:
            free[first] -= 1
            found = self._pair(gap - int(first), free)
            free[first] += 1
            if found:
                return (int(first), *found)
        return None

    def best_fit(self, gap: int, used: dict[int, int]) -> int | None:
        fits = np.flatnonzero(self._free(used)[: gap + 1] > 0)
        return int(fits[-1]) if len(fits) else None


def plan_lengths(counts: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Rows (length, first number, count in one sequence, first sequence, offset, repeats) and the number of sequences."""
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    index, given, rows, sequences = _Index(have), Counter(), [], 0
    longest = size
    while True:
        while longest and not index.left[longest]:
            longest -= 1
        if not longest:
            break
        used: dict[int, int] = Counter({longest: 1})
        gap = size - longest
        while gap:
            if found := index.complement(gap, used):
                used.update(found)
                break
            fit = index.best_fit(gap, used)
            if fit is None:
                break
            used[fit] += 1
            gap -= fit
        times = min(int(index.left[length]) // k for length, k in used.items())
        offset = 0
        for length, k in sorted(used.items(), reverse=True):
            rows.append((length, given[length], k, sequences, offset, times))
            given[length] += k * times
            offset += k * length
        index.take(used, times)
        sequences += times
    return np.array(rows, np.int64).reshape(-1, 6), sequences


def pack(pieces: DataFrame, length: str = "length", size: int = SIZE) -> DataFrame:
    """Every row with ``sequence_id`` and ``offset``: rows of one sequence lie gapless from 0 and sum to at most ``size``.

    All columns are carried along, but those named like an output, which are replaced; lengths are 1 to ``size``.
    Equal lengths are interchangeable.  An empty table gives none.
    """
    pieces = pieces.drop(*[c for c in ("sequence_id", "offset") if c != length])
    part, nth, place = clean_name(pieces, "part"), clean_name(pieces, "nth"), clean_name(pieces, "number")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            lengths = batch.column(length).to_numpy().astype(np.int64)
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(ordered)])
            ranks = np.empty(len(lengths), np.int64)
            ranks[order] = np.arange(len(ordered)) - np.repeat(starts, sizes) + seen[ordered]
            seen += np.bincount(lengths, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(lengths), task)), pa.array(ranks)], names=[*batch.schema.names, part, nth]
            )

    # written first, so that a task that numbers does not hold a tokenizer beside it
    numbered = materialise(materialise(pieces, "pieces").mapInArrow(number, schema_of(list(pieces.schema), f"`{part}` bigint, `{nth}` bigint")), "numbered")
    tasks = numbered.groupBy(part, length).agg(F.count("*").alias("n"))
    before = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select(
        F.col(part).alias("__of_part"), F.col(length).alias("__of_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")
    )
    histogram = {r["length"]: r["n"] for r in tasks.groupBy(F.col(length).alias("length")).agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_lengths(histogram, size)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    stride = max(histogram.values(), default=0) + 1
    starts = plan[:, 0] * stride + plan[:, 1]

    names = list(pieces.columns)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, number = (batch.column(c).to_numpy().astype(np.int64) for c in (length, place))
            row = plan[np.searchsorted(starts, lengths * stride + number, "right") - 1]
            copy, within = np.divmod(number - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(row[:, 3] + copy), pa.array(row[:, 4] + within * lengths)],
                names=[*names, "sequence_id", "offset"],
            )

    joined = numbered.join(offsets, (F.col(part) == F.col("__of_part")) & (F.col(length) == F.col("__of_length")))
    return joined.select(*pieces.columns, (F.col("__before") + F.col(nth)).alias(place)).mapInArrow(
        put, schema_of(list(pieces.schema), "sequence_id bigint, offset bigint")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_pieces, length, ids)``: the ids of each sequence in order; a sequence is one bounded row."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
        .select("sequence_id", F.size("parts").alias("n_pieces"), "length", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    )
