"""Toxicity by a classifier chain.

Categories are predicted in order.  Each has a linear model over the presence of
telling words and word beginnings, a few measures of style and the probabilities of the categories
before it.  What a model learns of earlier categories are out-of-fold
predictions: each row's come from a model that has not seen it, so a later model
meets probabilities as unsure as it will meet in use.

The chain is fitted on a bounded sample of the labelled rows (``SAMPLE`` at most, by a
hash of key and text, so that rows of one key are not in or out together): words and
beginnings are chosen by chi-square from their document frequencies, weights are
learned with one task per fold.  A category's threshold is the one of best F1 on its
out-of-fold predictions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiretide.llm.common import column_bytes, map_rows, plain_words, slices
from hiretide.operators.scratch import materialise

SAMPLE = 20_000
#: The sample is cut to its size by so many ranges of the hash.
PICK_RANGES = 256
#: Telling units per category, and in how many labelled texts one must be.
WORDS = 1024
LEAST_TEXTS = 3
FOLDS = 5
ROUNDS = 150
RATE = 0.5
PENALTY = 1e-5
#: Bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6)
_FLUSH = 300_000
_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_LETTER = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))
_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
_MARK = bytes(c for c in range(256) if not (33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126))
STYLES = 8


def style(text: bytes, words: int) -> list[float]:
    """Shares of capitals, digits, marks, exclamations and bars, distinct lines, log length, log mean word length."""
    n = max(1, len(text))
    letters = len(text.translate(None, _LETTER))
    lines = text.split(b"\n")
    return [
        len(text.translate(None, _UPPER)) / max(1, letters), len(text.translate(None, _DIGIT)) / n, len(text.translate(None, _MARK)) / n,
        text.count(b"!") / n, text.count(b"|") / n, len(set(lines)) / len(lines), np.log1p(words) / 10, np.log1p(letters / max(1, words)),
    ]


def units(words: list[bytes]) -> set[bytes]:
    """The distinct words, and the beginnings of the longer ones, marked by a star."""
    own = set(words)
    return own.union(*({w[:k] + b"*" for w in own if len(w) > k} for k in BEGINNINGS))


@dataclass
class Chain:
    categories: list[str]
    place: dict[bytes, int]  # of each telling word
    weights: list[np.ndarray] = field(default_factory=list)  # per category: words, styles, earlier categories, constant
    thresholds: list[float] = field(default_factory=list)

    def features(self, text: bytes | None) -> tuple[list[int], list[float]]:
        words = plain_words(text)
        place = self.place
        return sorted(place[w] for w in place.keys() & units(words)), style(text or b"", len(words))

    def probabilities(self, text: bytes | None) -> list[float]:
        at, dense = self.features(text)
        out: list[float] = []
        for w in self.weights:
            out.append(probability(w, at, [*dense, *map(centred, out), 1.0]))
        return out


def centred(p: float) -> float:
    """A probability as a feature."""
    return 2 * p - 1


def probability(w: np.ndarray, at: list[int], dense: list[float]) -> float:
    k = len(w) - len(dense)
    z = w[at].sum() + w[k:] @ np.array(dense)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(columns: np.ndarray, offsets: np.ndarray, dense: np.ndarray, y: np.ndarray, words: int) -> np.ndarray:
    """Weights of penalised logistic loss by full-batch adaptive steps; the constant comes last, unpenalised.

    A row's words are the columns between its offsets.
    """
    rows = np.repeat(np.arange(len(y)), np.diff(offsets))
    d = words + dense.shape[1]
    w, seen = np.zeros(d), np.full(d, 1e-6)
    for _ in range(ROUNDS):
        z = np.bincount(rows, w[columns], len(y)) + dense @ w[words:]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([np.bincount(columns, error[rows], words), dense.T @ error]) / max(1, len(y))
        g[:-1] += PENALTY * w[:-1]
        seen += g * g
        w -= RATE * g / np.sqrt(seen)
    return w


def _telling(labelled: DataFrame, text: str, categories: list[str]) -> list[bytes]:
    """The words whose presence says most about a category, by chi-square over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(len(categories) + 1)]

        def flush() -> pa.RecordBatch:
            words = list(counts[0])
            out = [pa.array(words, pa.binary())] + [pa.array([c[w] for w in words], pa.int64()) for c in counts]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "n", *(f"c{i}" for i in range(len(categories)))])

        for batch in slices(batches):
            marks = [batch.column(c).to_pylist() for c in categories]
            for row, t in enumerate(column_bytes(batch, text)):
                own = units(plain_words(t))
                counts[0].update(own)
                for c, m in zip(counts[1:], marks):
                    if m[row]:
                        c.update(own)
                if len(counts[0]) > _FLUSH:
                    yield flush()
        yield flush()

    names = [f"c{i}" for i in range(len(categories))]
    schema = ", ".join(["word binary", "n bigint", *(f"{c} bigint" for c in names)])
    counted = labelled.select(text, *categories).mapInArrow(run, schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    counted = materialise(counted.where(F.col("n") >= LEAST_TEXTS), "telling")
    totals = labelled.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("bigint")).alias(n) for c, n in zip(categories, names)]).first()
    found: dict[bytes, None] = {}
    for c in names:
        total, positive = totals["n"] or 0, totals[c] or 0
        a, b = F.col(c), F.col("n") - F.col(c)
        # chi-square of the two-by-two table of word and category
        top = a * (total - positive) - b * positive
        below = F.col("n") * (F.lit(total) - F.col("n"))
        strength = F.when(below > 0, top.cast("double") * top / below).otherwise(0.0)
        found.update((bytes(r["word"]), None) for r in counted.select("word", strength.alias("s")).where("s > 0").orderBy(F.desc("s"), "word").limit(WORDS).collect())
    return list(found)


def _fitter(k: int, words: int):
    """The model of category k from one group of rows."""

    def fit(table: pa.Table) -> pa.Table:
        at, dense = table["at"].combine_chunks(), table["dense"].combine_chunks()
        dense = np.hstack([np.asarray(dense.flatten()).reshape(-1, STYLES + k), np.ones((table.num_rows, 1))])
        offsets = np.concatenate([[0], np.cumsum(np.asarray(at.value_lengths()))])
        y = np.array(table[f"y{k}"].to_pylist(), float)
        w = logistic(np.asarray(at.flatten()), offsets, dense, y, words)
        return pa.table({"model": table["model"].slice(0, 1), "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    return fit


def _sampled(labelled: DataFrame, categories: list[str], text: str, key: str, sample: int) -> DataFrame:
    """At most ``sample`` of the rows to learn from, by a hash of key and text; of more rows, a hundredth alike in both at most."""
    known = labelled.where(F.col(key).isNotNull()).dropna(subset=categories)
    usable = known.where(F.col(text).isNotNull()).select(
        F.col(text).alias("text"), *[F.col(c).cast("boolean").alias(f"y{i}") for i, c in enumerate(categories)], F.xxhash64(key, text).alias("pick"),
    )
    total = known.count()
    if total <= sample:
        return usable
    below, place = int((1 << 30) * sample / total), F.pmod("pick", F.lit(1 << 30))
    copy = F.row_number().over(Window.partitionBy("pick").orderBy("pick"))
    some = usable.where(place < below).withColumn("copy", copy).where(F.col("copy") <= max(1, sample // 100)).drop("copy")
    some = materialise(some, "picked")
    # the share is right on average: what is over the bound goes by ranges of the hash
    part = F.floor(place * PICK_RANGES / below)
    taken, rows = [], 0
    for r in some.groupBy(part.alias("part")).count().orderBy("part").collect():
        if rows + r["count"] <= sample:
            taken.append(r["part"])
            rows += r["count"]
    return some.where(part.isin(taken))


def train(labelled: DataFrame, categories: list[str], text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Chain:
    """The chain learned from rows with key, text and a boolean in every category; none of them gives probabilities of 0.5.

    key and text only pick the sample (at most ``sample`` rows) and deal the folds.
    """
    usable = materialise(_sampled(labelled, categories, text, key, sample), "labelled")
    marks = [f"y{i}" for i in range(len(categories))]
    chain = Chain(list(categories), {w: i for i, w in enumerate(_telling(usable, "text", marks))})
    words = len(chain.place)
    if usable.isEmpty():
        chain.weights = [np.zeros(words + STYLES + k + 1) for k in range(len(categories))]
        chain.thresholds = [1.0] * len(categories)
        return chain
    def read(batch: pa.RecordBatch) -> dict[str, object]:
        found = [chain.features(t) for t in column_bytes(batch, "text")]
        return {"at": [f[0] for f in found], "dense": [f[1] for f in found]}

    rows = map_rows(usable, read, "at array<int>, dense array<double>", ["text"])
    rows = materialise(rows.withColumn("fold", F.pmod(F.shiftright("pick", 32), F.lit(FOLDS)).cast("int")), "sample")
    for k in range(len(categories)):
        # model f has not seen fold f, the last one has seen all
        dealt = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).where("model <> fold")
        fitted = {r["model"]: np.array(r["w"]) for r in dealt.groupBy("model").applyInArrow(_fitter(k, words), "model int, w array<double>").collect()}
        whole = fitted[FOLDS]
        chain.weights.append(whole)

        def extend(batch: pa.RecordBatch, fitted: dict = fitted, whole: np.ndarray = whole) -> dict[str, object]:
            out = []
            for at, dense, f in zip(*(batch.column(c).to_pylist() for c in ("at", "dense", "fold"))):
                out.append([*dense, centred(probability(fitted.get(f, whole), at, [*dense, 1.0]))])
            return {"dense": out}

        rows = materialise(map_rows(rows, extend, "dense array<double>"), "sample")
        judged = rows.select(F.element_at("dense", -1).alias("p"), f"y{k}").toPandas()  # the sample's size bounds it
        chain.thresholds.append(best_threshold((judged["p"].to_numpy(float) + 1) / 2, judged[f"y{k}"].to_numpy(bool)))
    return chain


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a row counts as positive, of best F1; halfway to the next lower one."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = np.where(np.append(p[1:] != p[:-1], True), 2 * hits / (np.arange(1, len(p) + 1) + y.sum()), 0)
    at = int(f1.argmax())
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0)) / 2)


def predict(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Every row without its text, with ``<category>_prob`` and, by its threshold, ``<category>`` for each category.

    A null text is read as an empty one, which no word speaks against.  A probability equal to the threshold counts as
    positive.  Input columns named like an output are replaced.
    """
    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = np.array([chain.probabilities(t) for t in column_bytes(batch, text)]).reshape(-1, len(chain.categories))
        return {f"{c}_prob": found[:, i] for i, c in enumerate(chain.categories)} | {c: found[:, i] >= chain.thresholds[i] for i, c in enumerate(chain.categories)}

    added = ", ".join([f"`{c}_prob` double" for c in chain.categories] + [f"`{c}` boolean" for c in chain.categories])
    return map_rows(docs, run, added, [text])
