"""Quality rules: base counts, and the divergence of a document from its nearest language reference.

A reference is the mean over all documents of a language of two histograms: shares of character classes, and shares of
that language's common words with all other words as one class. Common words have at least `common_share` of the
language's words; such a word has that share in some task, so a first pass names candidates (boundedly many for each
task), and a second counts them over all documents. A document of at least `min_words` words is rejected if the
Jensen-Shannon distance (base 2) to the nearest reference is above `most_classes` for the classes, or above `most_words`
for the words where it has `min_words_for_words` words.

Defined cases: null texts have no words and fail the base rules, like all texts under 20 words; without references only
the base rules hold; rows without a language don't enter references; repeated rows are judged alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import bound_batches
from helixlake.llm.shingles import U, WordHashes, mixed


@dataclass(frozen=True)
class Params:
    common_share: float = 0.005
    min_words: int = 20
    min_words_for_words: int = 100
    most_classes: float = 0.28
    most_words: float = 0.3


#: Character classes: lower-case ASCII, upper-case ASCII, digits, white space, stops, quotes and brackets, the symbols
#: of n_symbols, other ASCII, and all beyond ASCII.
CLASSES = ["a-z", "A-Z", "0-9", "\x20\x09-\x0d", ".,;:!?", "'\"()\\[\\]{}", "#*$%&|<>"]
_CLASS = np.full(256, 7, np.int64)
for _k, _chars in enumerate(CLASSES):
    for _b in range(128):
        if re.fullmatch(f"[{_chars}]", chr(_b)):
            _CLASS[_b] = _k
_CLASS[128:] = 8
N_CLASSES = 9
_STOPS = b".,;:!?'\"()[]{}"


def class_histogram(text: bytes) -> np.ndarray:
    """Counts of bytes by class."""
    return _by_class(np.bincount(np.frombuffer(text, np.uint8), minlength=256))


def _by_class(counts: np.ndarray) -> np.ndarray:
    return np.bincount(_CLASS, weights=counts, minlength=N_CLASSES)


def bare_words(text: bytes) -> list[bytes]:
    """Lower-cased words without the marks at their ends."""
    return [w.strip(_STOPS) for w in text.lower().split()]


def repeated(words: list[bytes], known: WordHashes, width: int = 8) -> int:
    """How many words lie in a run of `width` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = known.of(words)
    odd = mixed(np.arange(1, width + 1, dtype=U)) | U(1)
    h = hashes[:n] * odd[0]
    for k in range(1, width):
        h = h + hashes[k : k + n] * odd[k]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(n + width, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[: len(words)] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of p to each row of q."""
    m = (p + q) / 2

    def kl(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1)

    return np.sqrt(np.maximum(0, (kl(np.broadcast_to(p, q.shape)) + kl(q)) / 2))


@dataclass
class Reference:
    languages: list[str]
    classes: np.ndarray
    common: list[dict[bytes, int]]
    words: list[np.ndarray]

    def divergence(self, classes: np.ndarray, words: list[bytes]) -> tuple[float, float]:
        """Of a document: the class distance to the nearest reference by both distances, and its word distance."""
        if not self.languages:
            return 0.0, 0.0
        by_class = distance(classes / classes.sum(), self.classes)
        counts, total = Counter(bare_words_of(words)), max(1, len(words))
        by_word = []
        for common, share in zip(self.common, self.words):
            own = np.array([counts.get(w, 0) for w in common] + [0.0]) / total
            own[-1] = 1 - own[:-1].sum()
            by_word.append(distance(own, share[None, :])[0])
        k = int(np.argmin(by_class + np.array(by_word)))
        return float(by_class[k]), float(by_word[k])


def bare_words_of(words: list[bytes]) -> list[bytes]:
    return [w.lower().strip(_STOPS) for w in words]


def _words_by_language(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and text is not null").select("lang", "text")


def fit_reference(docs: DataFrame, p: Params = Params()) -> Reference:
    spark = docs.sparkSession
    rows = _words_by_language(docs)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with the share in question among a language's words in this task."""
        counts: dict[str, Counter] = {}
        totals: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist()):
                words = bare_words(text)
                counts.setdefault(lang, Counter()).update(words)
                totals[lang] += len(words)
            for lang, own in counts.items():  # bounded: what lies far below the share so far goes (it is counted exactly later)
                if len(own) > 500_000:
                    floor = p.common_share * totals[lang] / 50
                    counts[lang] = Counter({w: n for w, n in own.items() if n >= floor})
        found = [(lang, w) for lang, own in counts.items() for w, n in own.items() if w and n >= 0.9 * p.common_share * totals[lang]]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([w for _, w in found], pa.binary())], ["lang", "word"])

    # At most 1.2 / common_share words for each language and task, of which few differ between tasks.
    named = rows.mapInArrow(name, "lang string, word binary").distinct().toPandas()
    candidates = spark.sparkContext.broadcast({lang: set(map(bytes, g["word"])) for lang, g in named.groupby("lang")})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist()):
                own, all_words = candidates.value.get(lang, set()), bare_words(text)
                c = words.setdefault(lang, Counter())
                c.update(filter(own.__contains__, all_words))
                c[b""] += len(all_words)
                if text:
                    h = class_histogram(text)
                    classes[lang] = classes.get(lang, 0) + h / h.sum()
        out = [(lang, "word", w, float(n)) for lang, c in words.items() for w, n in c.items()]
        out += [(lang, "class", b"%d" % k, float(n)) for lang, h in classes.items() for k, n in enumerate(h)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.string(), pa.binary(), pa.float64()))], ["lang", "kind", "key", "n"])

    sums = rows.mapInArrow(count, "lang string, kind string, key binary, n double").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toPandas()
    languages, classes, common, shares = [], [], [], []
    for lang, g in sums.groupby("lang"):
        n = {(kind, bytes(key)): v for kind, key, v in zip(g["kind"], g["key"], g["n"])}
        h = np.array([n.get(("class", b"%d" % k), 0.0) for k in range(N_CLASSES)])
        total = n.get(("word", b""), 0.0)
        if not total or not h.sum():
            continue
        own = sorted(w for (kind, w), v in n.items() if kind == "word" and w and v >= p.common_share * total)
        share = np.array([n["word", w] for w in own] + [0.0]) / total
        share[-1] = 1 - share[:-1].sum()
        languages.append(lang)
        classes.append(h / h.sum())
        common.append({w: k for k, w in enumerate(own)})
        shares.append(share)
    return Reference(languages, np.array(classes), common, shares)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
KINDS = [*["long"] * 6, "boolean", "boolean", "double", "double"]


def judge(text: bytes | None, reference: Reference, p: Params, known: WordHashes) -> tuple:
    text = text or b""
    words = text.split()
    n, symbols = len(words), sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    chars = len(b"".join(words).decode())
    again = repeated(words, known)
    failed = n < p.min_words or 100 * again > 30 * n
    by_class, by_word = reference.divergence(class_histogram(text), words) if n else (0.0, 0.0)
    kept = not failed and by_class <= p.most_classes and (n < p.min_words_for_words or by_word <= p.most_words)
    return n, chars, symbols, duplicate_lines(text), again, failed, kept, by_class, by_word


def quality(docs: DataFrame, p: Params = Params()) -> DataFrame:
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(fit_reference(docs, p))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[k] for k in KINDS[1:]]
        hashes = WordHashes()
        for batch in batches:
            found = [judge(t, known.value, p, hashes) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
            columns = zip(*found) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, ", ".join(f"{n} {k}" for n, k in zip(NAMES, KINDS)))
