"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* n-grams of one to three lower-cased characters are hashed into ``DIM`` features
  and weighted by log term count and inverse document frequency; document
  frequencies are counted over all rows learned from.
* Weights are learned by follow-the-regularised-leader with per-coordinate rates
  and elastic-net penalties on a bounded sample (``PER_LANGUAGE`` rows a
  language, the smallest by hash).  The sample is dealt to shards, each learns
  in its own task, and Spark averages their weights by feature.
* One temperature is fitted on the part of the sample that was not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiretide.llm.common import map_rows, slices
from hiretide.operators.scratch import materialise

DIM = 1 << 15
ORDERS = (1, 2, 3)
#: Rows a language gives to the sample; the sample is at most this many times the number of languages.
PER_LANGUAGE = 1500
SHARDS = 4
EPOCHS = 4
#: FTRL: learning rate, its offset, and the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
CALIBRATION = 5  # one shard-th of the sample calibrates
UNKNOWN = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_CHUNK = 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and log term counts; long texts are counted in chunks, whole."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(codes), _CHUNK):
        part = codes[at:at + _CHUNK + max(ORDERS) - 1]
        for n in ORDERS:
            m = min(len(part) - n + 1, _CHUNK)
            if m <= 0:
                continue
            code = part[:m] * _MIX[0]
            for k in range(1, n):
                code = (code ^ (code >> np.uint32(15))) * _MIX[k] + part[k:k + m]
            code = (code ^ (code >> np.uint32(13))) * _MIX[2]
            counts += np.bincount((code >> np.uint32(17)), minlength=DIM)
    own = np.flatnonzero(counts)
    return own, 1 + np.log(counts[own])


def weighted(own: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf * idf[own]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features (the last one a constant) x languages
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        own, tf = features(text)
        return weighted(own, tf, self.idf) @ self.weights[own] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, seed: int) -> np.ndarray:
    """Weights from FTRL-proximal with elastic net; the constant has no penalty."""
    z = np.zeros((DIM + 1, classes))
    n = np.zeros((DIM + 1, classes))
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        l1 = np.where(at == DIM, 0.0, L1)[:, None]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for row in order.permutation(len(rows)):
            own, x, label = rows[row]
            at, v = np.append(own, DIM), np.append(x, 1.0)
            w = weights(at)
            error = softmax(v @ w)
            error[label] -= 1
            g = v[:, None] * error[None, :]
            g2 = g * g
            sigma = (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g2
    return weights(np.arange(DIM + 1))


def _document_frequency(rows: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and how many texts there are; feature -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(DIM, np.int64), 0
        for batch in slices(batches):
            for t in batch.column(text).to_pylist():
                seen[features(t)[0]] += 1
                total += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], total))], names=["feature", "n"])

    found = rows.select(text).mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    seen, total = np.zeros(DIM, np.int64), 0
    for feature, n in zip(found["feature"].tolist(), found["n"].tolist()):
        if feature < 0:
            total = n
        else:
            seen[feature] = n
    return seen, total


def train(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """The model learned from rows with text, a letter and a label; none of them gives a model without languages.

    key only picks the sample and deals it out.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(F.col(key).cast("string"), text).alias("pick")
    )
    seen, total = _document_frequency(usable, "text")
    idf = np.log((1 + total) / (1 + seen)) + 1
    # by hash about twice the rows wanted of each label, so that no more than that is shuffled; then exactly as many.
    # There are as many shares as languages, and the model holds a column of weights for each
    shares = usable.groupBy("label").agg(F.least(F.lit(1.0), 2.0 * per_language / F.count("*")).alias("share"))
    near = usable.join(F.broadcast(shares), "label").where(F.pmod("pick", F.lit(1 << 30)) < F.col("share") * (1 << 30)).drop("share")
    order = Window.partitionBy("label").orderBy("pick")
    sample = materialise(
        near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language).drop("nth"), "sample"
    )
    languages = sorted(r["label"] for r in sample.where(F.col("text").rlike(r"\p{L}")).select("label").distinct().collect())
    if not languages:
        return Model([], idf, np.zeros((DIM + 1, 0)), 1.0)
    held = F.pmod("pick", F.lit(CALIBRATION)) == 0
    place = {name: i for i, name in enumerate(languages)}

    def examples(texts: list[str], labels: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        out = []
        for t, name in zip(texts, labels):
            if name in place and has_letter(t):
                own, tf = features(t)
                out.append((own, weighted(own, tf, idf), place[name]))
        return out

    def learn(table: pa.Table) -> pa.Table:
        w = ftrl(examples(table["text"].to_pylist(), table["label"].to_pylist()), len(languages), EPOCHS, 0)
        at = np.flatnonzero(np.any(w != 0, axis=1))
        return pa.table({"feature": pa.array(at), "w": pa.array(w[at].tolist(), pa.list_(pa.float64()))})

    dealt = sample.where(~held).withColumn("shard", F.pmod(F.shiftright("pick", 8), F.lit(SHARDS)))
    learned = dealt.groupBy("shard").applyInArrow(learn, "feature bigint, w array<double>")
    mean = learned.select("feature", F.posexplode("w").alias("place", "w")).groupBy("feature", "place").agg((F.sum("w") / SHARDS).alias("w"))
    weights = np.zeros((DIM + 1, len(languages)))
    found = mean.toPandas()
    weights[found["feature"].to_numpy(), found["place"].to_numpy()] = found["w"].to_numpy()
    model = Model(languages, idf, weights, 1.0)

    def score(batch: pa.RecordBatch) -> dict[str, object]:
        return {"z": [model.logits(t).tolist() for t in batch.column("text").to_pylist()]}

    judged = map_rows(sample.where(held), score, "z array<double>", ["text"]).select("label", "z").collect()
    pairs = [(r["z"], place[r["label"]]) for r in judged if r["label"] in place]
    if pairs:
        model.temperature = fit_temperature(np.array([z for z, _ in pairs]), np.array([y for _, y in pairs]))
    return model


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(z / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean())

    low, high, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """Every row, without the columns to drop, with the predicted language and its calibrated probability; ``und`` and 0 without a letter.

    Of equal probabilities the language first in alphabetical order counts.  Input columns named like an output are replaced.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = [model.predict(t) for t in batch.column(text).to_pylist()]
        return {lang: [f[0] for f in found], score: [f[1] for f in found]}

    return map_rows(docs, run, f"`{lang}` string, `{score}` double", drop)


def identified_only(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """The documents in a language the model knows; columns as given.

    Rejected are texts that are null or hold no letter; ``min_score`` would reject unsure predictions as well, which
    short and mixed but clean documents are.
    """
    found = identify(docs, model, text, "_lang_pred", "_lang_score")
    return found.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= min_score)).select(*docs.columns)
