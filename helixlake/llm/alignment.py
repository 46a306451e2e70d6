"""Alignment of two tokenizers over a corpus: which ids of one stand for the same bytes as which ids of the other.

Each text is encoded by a byte-level BPE (A) and by a sentencepiece model (B). Byte offsets at which tokens of both end cut
the tokens into groups; the last tokens of a group, whose byte ranges end together, are a link.

* An array from A's ids to B's ids of the same bytes is made beforehand. A group of one token each that it maps onto each
  other takes the fast path: it's counted in a vector as long as A's vocabulary, one for each task, and its counts come
  back as such vectors.
* Only the links of other groups become rows: equal ones of a document are one row, counted by pair of ids in a shuffle and
  joined with their counts. The most frequent pairs, as many as a vector holds, get their counts in the task instead.

Defined cases: null and empty texts, and texts whose joined bytes differ from a space and the text (a sentencepiece mark
inside, say), have no tokens: zeros and an empty text of groups. Links of one B id that are equally frequent are all its
best. Repeated rows, shared and null ids are rows like others; a text of any length is taken whole; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import scratch, slices, store
from helixlake.llm.packing import _byte_letters

#: Characters on which both engines of the byte-level BPE split alike without doubt; other texts take the slower one.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ‘-…]*")
#: Pattern by which a byte-level BPE of 50,257 ids splits texts before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: So many irregular pairs, the most frequent ones, have their counts at hand in every task.
FREQUENT = 1 << 17


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and the ids of B with the bytes of A's."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        bare = {t: k for t, k in model["vocab"].items() if not t.startswith("<|")}
        self.a_bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, k in bare.items():
            self.a_bytes[k] = bytes(letters[c] for c in token)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ordered = [bare[t] for t in merged] == list(range(len(bare) - len(merged), len(bare)))
        self.whole = Tokenizer.from_file(a_path)
        self.whole.encode_special_tokens = True
        # Ids in the order of merges are ranks.
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.a_bytes[k]: k for k in bare.values()}, special_tokens={}) if ordered else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(self.pieces.id_to_piece(k)) for k in range(self.pieces.get_piece_size())]
        self.a_size, self.b_size = len(self.a_bytes), len(self.b_bytes)
        self.a_length, self.b_length = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        by_bytes = {own: k for k, own in reversed(list(enumerate(self.b_bytes)))}
        self.same = np.array([by_bytes.get(own, -1) if own else -1 for own in self.a_bytes], np.int64)
        # Ids as they are written: A's before a comma or a bar, B's before a comma or a semicolon.
        self.written = [b"%d%c" % (k, mark) for size, marks in ((self.a_size, b",|"), (self.b_size, b",;")) for mark in marks for k in range(size)]

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encoded(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both, or none of either."""
        if not text:
            return [], []
        spaced = " " + text
        if self.fast and PLAIN.fullmatch(text):
            a = self.fast.encode_ordinary(spaced)
        else:
            a = self.whole.encode(spaced, add_special_tokens=False).ids
        b = self.pieces.encode(text, num_threads=1)
        raw = spaced.encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw or b"".join(map(self.a_bytes.__getitem__, a)) != raw:
            return [], []
        return a, b


@functools.lru_cache(1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One for each worker process: of fixed size."""
    return Vocabularies(a_path, b_path)


def _upto(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)])


def align(v: Vocabularies, coded: list[tuple[list[int], list[int]]]) -> dict[str, list | np.ndarray]:
    """For the ids of some texts, all of them at once: numbers, the text of groups, A's ids of groups on the fast path, and
    pairs (a * size of B + b) of the others with their numbers."""
    of_a, of_b = (np.array([len(x[k]) for x in coded], np.int64) for k in (0, 1))
    a, b = (np.fromiter(chain.from_iterable(x[k] for x in coded), np.int64, int(n.sum())) for k, n in ((0, of_a), (1, of_b)))
    end_a, end_b = np.cumsum(v.a_length[a]), np.cumsum(v.b_length[b])
    total = int(end_a[-1]) if len(a) else 0
    ends = np.zeros(total + 1, bool)
    ends[end_b] = True
    cut_a = ends[end_a]
    ends[:] = False
    ends[end_a] = True
    cut_b = ends[end_b]
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    groups = int(cut_a.sum())
    size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    n_groups = np.diff(_upto(cut_a)[_upto(of_a)])
    last_a, last_b = a[cut_a], b[cut_b]
    plain = (size_a == 1) & (size_b == 1) & (v.same[last_a] == last_b)
    at_plain = _upto(plain)[_upto(n_groups)]
    doc = np.repeat(np.arange(len(coded)), n_groups)[~plain]
    links, times = np.unique(doc * (v.a_size * v.b_size) + last_a[~plain] * v.b_size + last_b[~plain], return_counts=True)
    at_links = np.searchsorted(links, np.arange(len(coded) + 1) * (v.a_size * v.b_size))

    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + _upto(size_b)[group_a]] = a + v.a_size * cut_a
    order[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = b + 2 * v.a_size + v.b_size * cut_b
    written = list(map(v.written.__getitem__, order.tolist()))
    at = _upto(of_a + of_b).tolist()
    return {
        "n_a": of_a, "n_b": of_b, "n_groups": n_groups, "groups": [b"".join(written[i:j])[:-1] for i, j in zip(at, at[1:])],
        "plain": last_a[plain], "at_plain": at_plain, "pairs": links % (v.a_size * v.b_size), "times": times, "at_links": at_links,
    }


def aligned(docs: DataFrame, a_path: str, b_path: str, groups: bool = False) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, groups_sha256, plain (A's ids of groups on the fast path, as
    32-bit numbers), irregular (pairs of ids and how often), and with groups their text."""
    irregular = pa.struct([("pair", pa.int64()), ("n", pa.int32())])
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "plain", "irregular", *(["groups"] if groups else [])]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, row = vocabularies(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in slices(batches, size=1 << 20):
            found = align(v, [v.encoded(t.as_py()) for t in batch.column(1)])
            n = batch.num_rows
            sha = [hashlib.sha256(x).hexdigest() if x else "" for x in found["groups"]]
            flat = pa.StructArray.from_arrays([pa.array(found["pairs"]), pa.array(found["times"].astype(np.int32))], fields=list(irregular))
            raw, at = found["plain"].astype("<i4").tobytes(), (4 * found["at_plain"]).tolist()
            arrays = [
                pa.array(range(row, row + n), pa.int64()), batch.column(0), *(pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")), pa.array(sha, pa.string()),
                pa.array([raw[i:j] for i, j in zip(at, at[1:])], pa.binary()), pa.ListArray.from_arrays(pa.array(found["at_links"].astype(np.int32)), flat),
            ]
            if groups:
                arrays.append(pa.array([x.decode() for x in found["groups"]], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names)
            row += n

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, plain binary, irregular array<struct<pair:long,n:int>>" + (", groups string" if groups else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def plain_counts(found: DataFrame, a_size: int) -> np.ndarray:
    """How often each id of A was on the fast path: vectors by task, summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(a_size, np.int64)
        for batch in batches:
            for own in batch.column(0):
                total += np.bincount(np.frombuffer(own.as_buffer(), "<i4"), minlength=a_size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["a", "n"])

    by_task = found.select("plain").mapInArrow(count, "a int, n long")
    summed = by_task.groupBy("a").agg(F.sum("n").alias("n")).toPandas()  # an id each
    vector = np.zeros(a_size, np.int64)
    vector[summed["a"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return vector


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n: how often corpus-wide, for pairs off the fast path."""
    return found.select(F.explode("irregular").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("n"))


def token_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs."""
    with scratch(docs.sparkSession) as kept:
        result = store(_token_alignment(docs, a_path, b_path), "alignment")
        kept.append(result.stored_at)
    return result


def id_pairs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, n, best: every linked pair of ids, how often it is linked, and whether no other id of A is linked with b more
    often."""
    with scratch(docs.sparkSession) as kept:
        found = store(aligned(docs, a_path, b_path).select("plain", "irregular"), "aligned")
        v = vocabularies(a_path, b_path)
        vector = plain_counts(found, v.a_size)
        at = np.flatnonzero(vector)
        plain = docs.sparkSession.createDataFrame([(int(k), int(v.same[k]), int(vector[k])) for k in at], "a int, b int, n long")
        other = pair_counts(found).select((F.col("pair") / v.b_size).cast("int").alias("a"), (F.col("pair") % v.b_size).cast("int").alias("b"), "n")
        both = store(plain.unionByName(other), "pairs")
        best = both.groupBy("b").agg(F.max("n").alias("most"))
        result = store(both.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "id-pairs")
        kept.append(result.stored_at)
    return result


def _token_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    spark = docs.sparkSession
    found = store(aligned(docs, a_path, b_path), "aligned")
    v = vocabularies(a_path, b_path)
    b_size, vector = v.b_size, plain_counts(found, v.a_size)
    counts = store(pair_counts(found), "pair-counts")
    most = np.zeros(b_size, np.int64)
    by_b = counts.groupBy((F.col("pair") % b_size).cast("int").alias("b")).agg(F.max("n").alias("n")).toPandas()  # an id each
    most[by_b["b"].to_numpy(np.int64)] = by_b["n"].to_numpy(np.int64)
    at = np.flatnonzero(vector)
    np.maximum.at(most, v.same[at], vector[at])
    best_plain = np.zeros(v.a_size, np.int64)
    best_plain[at] = vector[at] == most[v.same[at]]
    frequent = counts.orderBy(F.desc("n"), "pair").limit(FREQUENT).toPandas().sort_values("pair")
    top_pair, top_n = frequent["pair"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((vector, best_plain, most, top_pair, top_n))  # as long as the vocabularies and FREQUENT

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, best_plain, most, top_pair, top_n = shared.value
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(1)]
            sums = np.array([vector[x].sum() for x in own], np.int64)
            good = np.array([best_plain[x].sum() for x in own], np.int64)
            lists = batch.column(2)
            flat = lists.flatten()
            pair, times = flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            if len(top_pair) and len(pair):
                near = np.minimum(np.searchsorted(top_pair, pair), len(top_pair) - 1)
                here = top_pair[near] == pair
                n = top_n[near[here]]
                np.add.at(sums, doc[here], n * times[here])
                np.add.at(good, doc[here], (n == most[pair[here] % b_size]) * times[here])
            else:
                here = np.zeros(len(pair), bool)
            rest = pa.StructArray.from_arrays([pa.array(pair[~here]), pa.array(times[~here].astype(np.int32))], names=["pair", "n"])
            left = np.concatenate([[0], np.cumsum(np.bincount(doc[~here], minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(sums), pa.ListArray.from_arrays(pa.array(left), rest)], ["row", "good", "sum", "rest"])

    told = store(found.select("row", "plain", "irregular").mapInArrow(known, "row long, good long, sum long, rest array<struct<pair:long,n:int>>"), "told")
    # A pair's greatest count of its B id comes with it: the shuffle's other side is a plain table, in which Spark splits frequent pairs.
    rare = told.select("row", F.explode("rest").alias("p")).select("row", "p.pair", F.col("p.n").alias("times"))
    best = spark.createDataFrame([(k, int(n)) for k, n in enumerate(most) if n], "b int, most long")
    judged = counts.withColumn("b", (F.col("pair") % b_size).cast("int")).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    more = rare.join(judged, "pair").select("row", (F.col("times") * F.col("n")).alias("sum"), (F.col("times") * F.col("best")).cast("long").alias("good"))
    sums = told.select("row", "sum", "good").unionByName(more).groupBy("row").agg(F.sum("sum").alias("count_sum"), F.sum("good").alias("n_best"))
    return found.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )
