"""Toxicity: a linear-chain conditional random field over words, and document scores from its marginals.

Labelled tokens come from the document labels: words, and beginnings of words, whose documents are toxic far more often
than chance mark the tokens of toxic documents; tokens of other documents are clean. The two-state field (emission
weights on hashed word features, transition weights) is trained by AdaGrad on the likelihood of these sequences, shards
apart in each epoch with their weights averaged. Forward-backward marginals of all words of a document give its
features (expected number of toxic words, the highest marginal, the chance that any word is toxic), from which a
logistic model gives the score; words with a marginal of at least `offending` give the offending spans.

The field is fitted on a bounded sample: `rows_per_label` documents of each label in expectation, drawn by hash.
Sequences are consecutive runs of SEQUENCE words, so a text of any length is taken in bounded memory.

Defined cases: null and empty texts have no words and get the score of a text without toxic words; without labelled
rows every score is 0; rows without label or doc_id don't train; repeated rows score alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import Memory, bound_batches, scratch, store

FEATURES = 1 << 17
SEQUENCE = 128
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Params:
    rows_per_label: int = 2500
    least_documents: int = 4
    least_odds: float = 12.0
    shards: int = 4
    epochs: int = 4
    rate: float = 0.5
    l2: float = 1e-4
    offending: float = 0.5
    threshold: float = 0.3


def stems(word: str) -> list[str]:
    """The word and its beginnings of four to six letters."""
    return [word, *(f"{word[:k]}-" for k in (4, 5, 6) if len(word) >= k)]


def features(word: str) -> list[int]:
    import xxhash

    names = [*stems(word), f"-{word[-3:]}", f"#{min(len(word), 12)}", "1"]
    return [xxhash.xxh3_64_intdigest(x) & (FEATURES - 1) for x in names]


class _Scores(Memory):
    """Emission scores of words."""

    def __init__(self, weights: np.ndarray):
        super().__init__(lambda word: float(weights[features(word)].sum()))


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1, and pair marginals summed over the chain, for padded rows of emission scores (of state 1
    against state 0). move[i, j] is the weight of going from i to j."""
    rows, width = scores.shape
    emit = np.stack([np.ones_like(scores), np.exp(np.clip(scores, -30, 30))], axis=2)
    step = np.exp(move)
    alpha, beta = np.empty((width, rows, 2)), np.ones((width, rows, 2))
    a = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    alpha[0] = a
    for t in range(1, width):
        a = (a @ step) * emit[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t] = a
    b = np.ones((rows, 2))
    pairs = np.zeros((2, 2))
    for t in range(width - 1, 0, -1):
        b = np.where((lengths > t)[:, None], (emit[:, t] * b) @ step.T, 1.0)
        inside = lengths > t
        if inside.any():
            joint = alpha[t - 1][inside][:, :, None] * step[None] * (emit[inside, t] * beta[t][inside])[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b /= b.sum(axis=1, keepdims=True)
        beta[t - 1] = b
    p = alpha * beta
    return (p[:, :, 1] / p.sum(axis=2)).T, pairs


def padded(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts documents (ends: where each one's values end) into rows of SEQUENCE values; also row lengths and the place
    of each value in the flattened rows."""
    lengths = np.diff(np.r_[0, ends])
    full = -(-lengths // SEQUENCE)
    starts = np.cumsum(np.r_[0, full])[:-1] * SEQUENCE
    at = np.arange(len(values)) + np.repeat(starts - np.r_[0, ends[:-1]], lengths)
    rows = int(full.sum())
    out = np.zeros(rows * SEQUENCE)
    out[at] = values
    own = np.full(rows, SEQUENCE)
    last = np.cumsum(full)[full > 0] - 1
    own[last] = (lengths[full > 0] - 1) % SEQUENCE + 1
    return out.reshape(rows, SEQUENCE), own, at


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray
    #: Logistic weights of bias, log(1 + expected toxic words), highest marginal, and chance of any.
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))
    trained: bool = True

    def marginals(self, texts: list[str], scores: _Scores) -> list[np.ndarray]:
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        ends = np.cumsum([len(w) for w in words])
        flat = np.fromiter((scores[w] for own in words for w in own), float, int(ends[-1]) if len(ends) else 0)
        p = np.zeros(0)
        if len(flat):
            rows, own, at = padded(flat, ends)
            p = np.concatenate([forward_backward(rows[k : k + 4096], own[k : k + 4096], self.move)[0] for k in range(0, len(rows), 4096)]).ravel()[at]
        return np.split(p, ends[:-1]) if len(ends) else []

    def score(self, marginals: np.ndarray) -> float:
        if not self.trained:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(summary(marginals) @ self.document, -30, 30))))


def summary(p: np.ndarray) -> np.ndarray:
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0])
    return np.array([1.0, np.log1p(p.sum()), p.max(), -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())])


def _seeds(sample: DataFrame, p: Params) -> set[str]:
    """Words and beginnings of words that set toxic documents apart: as many as the bounded sample has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update({s for w in set(WORD.findall(text.lower())) for s in stems(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[0][x] for x in names], pa.int64()), pa.array([seen[1][x] for x in names], pa.int64())], ["stem", "clean", "toxic"])

    counts = sample.select("text", "toxic").mapInArrow(count, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    odds = (F.col("toxic") / F.lit(max(1, sizes.get(1, 0)))) / ((F.col("clean") + 0.5) / F.lit(max(1, sizes.get(0, 0))))
    return set(counts.where((F.col("toxic") >= p.least_documents) & (odds >= p.least_odds)).select("stem").toPandas()["stem"])


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """labels: doc_id and toxic (0 or 1)."""
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession):  # the sample goes when the model is there
        return _fit(docs, labels, p)


def _fit(docs: DataFrame, labels: DataFrame, p: Params) -> Model:
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), trained=False)
    rate = F.when(F.col("toxic") == 1, min(1.0, p.rows_per_label / sizes[1])).otherwise(min(1.0, p.rows_per_label / sizes[0]))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < rate * (1 << 20))
    # The sample's ids are bounded (twice rows_per_label in expectation), so texts needn't move to meet them.
    sample = store(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(p.shards))), "toxic-sample")
    seeds = spark.sparkContext.broadcast(_seeds(sample, p))
    weights, move = np.zeros(FEATURES), np.zeros((2, 2))
    for epoch in range(p.epochs):
        weights, move = _epoch(sample, seeds, weights, move, p)
    model = Model(weights, move)
    model.document = _document_weights(sample, model, sizes)
    return model


def _epoch(sample: DataFrame, seeds, weights: np.ndarray, move: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    start = sample.sparkSession.sparkContext.broadcast((weights, move))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        w, m = (x.copy() for x in start.value)
        squares, squares_m = np.full(FEATURES, 1e-2), np.full((2, 2), 1e-2)
        frame = frame.sort_values("doc_id", kind="stable")
        for k in range(0, len(frame), 50):
            part = frame.iloc[k : k + 50]
            words = [WORD.findall(t.lower()) for t in part["text"]]
            ends = np.cumsum([len(x) for x in words])
            if not ends[-1]:
                continue
            number: dict[str, int] = {}
            flat = np.array([number.setdefault(x, len(number)) for own in words for x in own])
            of = [features(x) for x in number]
            at = np.concatenate([np.asarray(x) for x in of])
            owner = np.repeat(np.arange(len(of)), [len(x) for x in of])
            seeded = np.array([any(s in seeds.value for s in stems(x)) for x in number])
            truth = seeded[flat] & np.repeat(part["toxic"].to_numpy() == 1, np.diff(np.r_[0, ends]))
            emission = np.bincount(owner, weights=w[at], minlength=len(of))
            rows, own, place = padded(emission[flat], ends)
            marginal, pairs = forward_backward(rows, own, m)
            g = np.bincount(flat, weights=marginal.ravel()[place] - truth, minlength=len(of))
            y = np.zeros(rows.size)
            y[place] = truth
            y = y.reshape(rows.shape).astype(int)
            inside = np.arange(1, SEQUENCE)[None, :] < own[:, None]
            seen = np.bincount((2 * y[:, :-1] + y[:, 1:])[inside], minlength=4).reshape(2, 2)
            gw = np.bincount(at, weights=g[owner], minlength=FEATURES) + p.l2 * w
            squares += gw * gw
            w -= p.rate * gw / np.sqrt(squares)
            gm = (pairs - seen) / max(1, len(own))
            squares_m += gm * gm
            m -= 0.1 * gm / np.sqrt(squares_m)
        return pd.DataFrame({"w": [w.tobytes()], "m": [m.tobytes()]})

    states = sample.groupBy("shard").applyInPandas(learn, "w binary, m binary").toPandas()
    if not len(states):
        return weights, move
    return np.mean([np.frombuffer(x) for x in states["w"]], axis=0), np.mean([np.frombuffer(x).reshape(2, 2) for x in states["m"]], axis=0)


def _document_weights(sample: DataFrame, model: Model, sizes: dict[int, int]) -> np.ndarray:
    """Logistic regression of the label on the summaries, with the sample's rows weighted to the labels' true shares."""
    known = sample.sparkSession.sparkContext.broadcast(model)

    def summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = _Scores(known.value.weights)
        for f in frames:
            yield pd.DataFrame({"toxic": f["toxic"], "x": [summary(m).tolist() for m in known.value.marginals(f["text"].tolist(), scores)]})

    rows = sample.select("text", "toxic").mapInPandas(summaries, "toxic int, x array<double>").toPandas()
    if not len(rows):
        return np.array([-30.0, 0, 0, 0])
    x, y = np.stack(rows["x"].to_numpy()), rows["toxic"].to_numpy().astype(float)
    weight = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (q - y)) + 0.5 * w
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def toxicity(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, score, predicted, spans (start and end of offending words, in code points) for every row of docs."""
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(known.value.weights)
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            marginals = known.value.marginals(texts, scores)
            score = [known.value.score(m) for m in marginals]
            spans = [_spans(t, m, p.offending) for t, m in zip(texts, marginals)]
            arrays = [batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= p.threshold) for s in score], pa.int32()), pa.array(spans, spans_type)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>")


def _spans(text: str | None, p: np.ndarray, least: float) -> list[dict[str, int]]:
    bad = set(np.flatnonzero(p >= least).tolist())
    if not bad:
        return []
    lower = text.lower()
    if len(lower) != len(text):  # a few letters grow in lower case; then the words are counted off in the text itself
        return [{"start": m.start(), "end": m.end()} for k, m in enumerate(WORD.finditer(text)) if k in bad]
    return [{"start": m.start(), "end": m.end()} for k, m in enumerate(WORD.finditer(lower)) if k in bad]
