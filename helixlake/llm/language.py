"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows. The classifier is fitted by follow-the-regularised-leader with
elastic-net penalties on a bounded sample of them (`rows_per_language` rows of each language in expectation, drawn by
hash): shards learn apart in each epoch, and their states are averaged. A part of the sample is kept out to fit the
temperature. The model's size is bounded by n-gram buckets times languages.

Training rows have a non-null doc_id, lang and text; `train` chooses among them. A prediction depends on the text alone.

Defined cases: a text that is null, empty or without a letter is `und` with score 0; without training rows every text
is; of equally likely languages the first by name is predicted; a text of any length is taken whole; repeated rows are
predicted alike; an empty table gives an empty result; other columns are ignored, and a kept column that is called like
a new one gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import bound_batches, free_name, release, scratch, store

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)


@dataclass(frozen=True)
class Params:
    rows_per_language: int = 1500
    shards: int = 4
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    kept_out: int = 5  # one in so many rows fits the temperature


_ASCII = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)


def gram_counts(text: str) -> np.ndarray:
    """Counts by bucket of the character n-grams of the lower-cased text, with all ASCII but letters as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 128, _ASCII[np.minimum(c, 127)], c)
    c = np.r_[np.uint32(32), c, np.uint32(32)]
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    counts = np.zeros(BUCKETS, np.int64)
    for n in ORDERS:
        h = np.full(max(0, len(c) - n + 1), 2166136261 + n, np.uint32)
        for k in range(n):
            h = (h ^ c[k : k + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return counts


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and normalised TF-IDF weights."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / (np.sqrt((x * x).sum()) or 1.0)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, x = vector(text, self.idf)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not lettered(text):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Per-coordinate FTRL-proximal for one-vs-all columns of a softmax; the last row is the bias."""

    def __init__(self, z: np.ndarray, n: np.ndarray, p: Params):
        self.z, self.n, self.p = z, n, p

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, p = self.z[at], self.p
        return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.r_[at, len(self.z) - 1], np.r_[x, 1.0]
        w = self.weights(at)
        g = softmax(x @ w)
        g[label] -= 1.0
        g = x[:, None] * g[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows: in how many texts each bucket occurs, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df += gram_counts(text.as_py()) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], n])], ["bucket", "n"])

    sums = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS, np.int64)
    own = sums[sums["bucket"] >= 0]
    df[own["bucket"].to_numpy()] = own["n"].to_numpy()
    return df, int(sums.loc[sums["bucket"] < 0, "n"].sum())


def fit(docs: DataFrame, train: Column, p: Params = Params()) -> Model:
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession):  # the sample goes when the model is there
        return _fit(docs, train, p)


def _fit(docs: DataFrame, train: Column, p: Params) -> Model:
    spark = docs.sparkSession
    rows = docs.where(train & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # As many rows as there are languages: a handful of names, for a model that has a column for each.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    rates = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, p.rows_per_language / sizes[lang]))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < rates[F.col("lang")] * (1 << 20)
    known = spark.sparkContext.broadcast((idf, {lang: k for k, lang in enumerate(languages)}))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, number = known.value
        for batch in batches:
            found = [vector(t, weights) for t in batch.column(2).to_pylist()]
            arrays = [batch.column(0), pa.array([number[x] for x in batch.column(1).to_pylist()], pa.int32()), pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "label", "at", "x"])

    sample = rows.where(drawn).mapInArrow(vectors, "doc_id long, label int, at array<long>, x array<double>")
    sample = store(sample.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(p.kept_out))).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(p.shards))), "language-sample")
    z, squares = np.zeros((BUCKETS + 1, len(languages))), np.zeros((BUCKETS + 1, len(languages)))
    for epoch in range(p.epochs):
        z, squares = _epoch(sample.where("part > 0"), z, squares, p, epoch)
    w = Ftrl(z, squares, p).weights()
    model = Model(languages, idf, w[:-1], w[-1])
    model.temperature = _temperature(sample.where("part = 0"), model)
    return model


def _epoch(sample: DataFrame, z: np.ndarray, n: np.ndarray, p: Params, epoch: int) -> tuple[np.ndarray, np.ndarray]:
    start = sample.sparkSession.sparkContext.broadcast((z, n))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        state = Ftrl(*(x.copy() for x in start.value), p)
        frame = frame.sort_values("doc_id", kind="stable")
        for k in np.random.default_rng(epoch).permutation(len(frame)):
            state.learn(np.asarray(frame["at"].iloc[k], np.int64), np.asarray(frame["x"].iloc[k]), int(frame["label"].iloc[k]))
        return pd.DataFrame({"z": [state.z.tobytes()], "n": [state.n.tobytes()]})

    states = sample.groupBy("shard").applyInPandas(learn, "z binary, n binary").toPandas()
    if not len(states):
        return z, n
    return tuple(np.mean([np.frombuffer(x).reshape(z.shape) for x in states[c]], axis=0) for c in ("z", "n"))


def _temperature(sample: DataFrame, model: Model) -> float:
    """The temperature under which the kept-out rows are likeliest."""
    known = sample.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def logits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = known.value
        for f in frames:
            yield pd.DataFrame({"label": f["label"], "z": [np.asarray(x) @ w[np.asarray(at, np.int64)] + b for at, x in zip(f["at"], f["x"])]})

    rows = sample.select("label", "at", "x").mapInPandas(logits, "label int, z array<double>").toPandas()
    if not len(rows):
        return 1.0
    z, y = np.stack(rows["z"].to_numpy()), rows["label"].to_numpy()
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    return float(min(grid, key=lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()))


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, lang_pred and score for every row of docs."""
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("doc_id", "lang_pred", "score")]
    # The text goes to Python once, whether it is kept or not.
    name = "text" if "text" in keep else free_name(docs.columns, "text_")
    rows = docs.select(F.col("doc_id").cast("long"), *keep, *([] if "text" in keep else [F.col("text").alias(name)]))
    at, count = rows.columns.index(name), 1 + len(keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [known.value.predict(t.as_py()) for t in batch.column(at)]
            arrays = [*batch.columns[:count], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:count], "lang_pred", "score"])

    schema = rows.select("doc_id", *keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(predict, schema)
