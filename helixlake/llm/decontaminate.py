"""Benchmark decontamination over a distributed positional inverted index.

Tasks index their own documents: a shard holds the postings (word positions, numbered through the shard with gaps
between documents) of about a million words, and is stored once as one row. Postings of words that no test item has
are never asked for, so a filter of bounded size keeps them out. Test windows come in blocks of bounded size, and each
block is looked up in every shard: a window whose words are not all there is gone at once; for the others the lists are
shifted by their offsets in the window and intersected from the rarest word on. Hits are merged by document.

Besides exact phrases, near_items counts the items whose `near_terms` rarest words all lie within `near_span` words of
the rarest of them in the document. Rarest are the words that the fewest items have, counted over the whole test set.

Defined cases: null texts have no words; an item without words has no window; an item of fewer words than a window is
one window; a null item_id marks words as hit but is not listed, any other one is; a null doc_id and repeated rows are
rows like others; a text of any length is taken whole; no documents give no rows, and no items give documents without
hits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm.common import FILTER_BITS, bound_batches, filter_of, scratch, store
from helixlake.llm.shingles import U, WordHashes

WINDOW = 13
#: Words and documents of a shard, windows of a block: a row of the index, and a block, have bounded sizes.
SHARD_WORDS, SHARD_DOCS, BLOCK_WINDOWS = 250_000, 1 << 14, 200_000
#: Words are runs of 0-9, a-z and all that is not ASCII; A-Z count as a-z.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _words(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of(text.translate(_TO_WORDS).split() if text else [])


def test_windows(items: DataFrame) -> DataFrame:
    """item_id and the word hashes of each window of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist()):
                h = _words(text, hashes).view(np.int64)
                rows = [h[k : k + WINDOW] for k in range(max(1, len(h) - WINDOW + 1))] if len(h) else []
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.int64()), pa.array(part, pa.list_(pa.int64()))], ["item_id", "words"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, words array<long>")


def rarest_words(items: DataFrame, near_terms: int) -> DataFrame:
    """item_id and its `near_terms` words that the fewest items have, the rarest first, then by the words themselves."""
    letters = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(letters, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")
    own = items.where("item_id is not null").select(F.col("item_id").cast("long"), F.explode(words).alias("word")).distinct()
    common = own.groupBy("word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("n", "word"))  # an item's words: one text's
    top = own.join(common, "word").withColumn("k", rank).where(F.col("k") <= near_terms)
    return top.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("words"))


INDEX = "shard long, doc_ids array<long>, lengths array<int>, terms binary, starts binary, postings binary"


def build_index(docs: DataFrame, wanted: np.ndarray, gap: int) -> DataFrame:
    """One row for each shard; `wanted` filters the words by the low bits of their hashes; between documents `gap`
    positions stay free."""
    keep_bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 24
        words = WordHashes()
        ids: list[int | None] = []
        lengths: list[int] = []
        hashes: list[np.ndarray] = []
        places: list[np.ndarray] = []
        base = 0

        def flush() -> pa.RecordBatch:
            h, p = np.concatenate(hashes), np.concatenate(places)
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            columns = [[shard], [ids], [lengths], [h[first].tobytes()], [np.r_[first, len(h)].astype(np.uint32).tobytes()], [p[order].tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["shard", "doc_ids", "lengths", "terms", "starts", "postings"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()).to_pylist()):
                h = _words(text, words)
                at = np.flatnonzero(keep_bits.value[(h & U(FILTER_BITS - 1)).astype(np.int64)])
                ids.append(doc_id)
                lengths.append(len(h))
                hashes.append(h[at])
                places.append((at + base).astype(np.uint32))
                base += len(h) + gap
                if base >= SHARD_WORDS or len(ids) >= SHARD_DOCS:
                    yield flush()
                    shard, base = shard + 1, 0
                    ids, lengths, hashes, places = [], [], [], []
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(index, INDEX)


class TestBlock:
    """Windows of a block: distinct ones over a small vocabulary, with the items that have them; and the rarest words of
    some items."""

    def __init__(self, rows: pd.DataFrame, rarest: pd.DataFrame):
        pairs = [(np.asarray(w, np.int64).tobytes(), None if pd.isna(i) else int(i)) for w, i in zip(rows["words"], rows["item_id"].astype("Int64"))]
        names = sorted({w for w, _ in pairs})
        number = {w: k for k, w in enumerate(names)}
        self.lengths = np.array([len(w) // 8 for w in names], np.int64)
        flat = np.frombuffer(b"".join(names), U)
        hashes = WordHashes()
        near = [hashes.of([x.encode() for x in w]) for w in rarest["words"]]
        self.vocabulary, inverse = np.unique(np.concatenate([flat, *near]), return_inverse=True)
        self.words = np.full((len(names), WINDOW), -1, np.int64)
        self.words[np.arange(WINDOW)[None, :] < self.lengths[:, None]] = inverse[: len(flat)]
        owned = sorted({(number[w], i) for w, i in pairs if i is not None})
        self.owner_window = np.array([w for w, _ in owned], np.int64)
        self.owner_item = np.array([i for _, i in owned], np.int64)
        ends = len(flat) + np.cumsum([0, *map(len, near)])
        self.rarest = {int(i): inverse[a:b] for i, a, b in zip(rarest["item_id"], ends, ends[1:])}


def _at(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
    k = np.searchsorted(sorted_list, values)
    k[k == len(sorted_list)] = 0
    return sorted_list[k] == values


def look_up(lengths: np.ndarray, terms: np.ndarray, starts: np.ndarray, postings: np.ndarray, block: TestBlock, near_span: int, gap: int) -> list[tuple[int, list[int], list[int], list[int]]]:
    """Hits in one shard: document's number in it, hit words' positions, items, near items."""
    begins = np.cumsum(np.r_[0, lengths[:-1] + gap])
    if not len(terms) or not len(block.vocabulary):
        return []
    k = np.minimum(np.searchsorted(terms, block.vocabulary), len(terms) - 1)
    there = terms[k] == block.vocabulary
    low, high = np.where(there, starts[k], 0), np.where(there, starts[k + 1], 0)
    size = high - low

    def listed(word: int) -> np.ndarray:
        return postings[low[word] : high[word]].astype(np.int64)

    sizes = np.where(block.words >= 0, size[block.words], 1 << 60)
    hit_windows, hit_at = [], []
    for w in np.flatnonzero((sizes > 0).all(axis=1)):
        order = np.argsort(sizes[w], kind="stable")[: block.lengths[w]]
        at = listed(block.words[w, order[0]]) - order[0]
        for j in order[1:]:
            at = at[_at(listed(block.words[w, j]), at + j)]
            if not len(at):
                break
        if len(at):
            hit_windows.append(np.full(len(at), w))
            hit_at.append(at)
    hits: dict[int, set[int]] = {}
    items: dict[int, set[int]] = {}
    near: dict[int, set[int]] = {}
    if hit_at:
        w, at = np.concatenate(hit_windows), np.concatenate(hit_at)
        doc = np.searchsorted(begins, at, side="right") - 1
        for d, length, start in np.unique(np.stack([doc, block.lengths[w], at - begins[doc]], axis=1), axis=0).tolist():
            hits.setdefault(d, set()).update(range(start, start + length))
        pairs = np.unique(np.stack([w, doc], axis=1), axis=0)
        lo, hi = np.searchsorted(block.owner_window, pairs[:, 0]), np.searchsorted(block.owner_window, pairs[:, 0], side="right")
        for a, b, d in zip(lo.tolist(), hi.tolist(), pairs[:, 1].tolist()):
            items.setdefault(d, set()).update(block.owner_item[a:b].tolist())
    for item, own in block.rarest.items():
        if len(own) and (size[own] > 0).all():
            at = listed(own[0])
            for word in own[1:]:
                other = listed(word)
                n = np.searchsorted(other, at - near_span)
                at = at[(n < len(other)) & (other[np.minimum(n, len(other) - 1)] <= at + near_span)]
            doc = np.unique(np.searchsorted(begins, at, side="right") - 1)
            for d in doc.tolist():
                inside = [np.diff(np.searchsorted(listed(word), [begins[d], begins[d] + lengths[d]]))[0] for word in own]
                if min(inside) > 0:
                    near.setdefault(d, set()).add(item)
    return [(d, sorted(hits.get(d, ())), sorted(items.get(d, ())), sorted(near.get(d, ()))) for d in sorted({*hits, *items, *near})]


FOUND = "doc_key long, hit array<int>, items array<long>, near array<long>"


def search(index: DataFrame, block: TestBlock, near_span: int, gap: int) -> DataFrame:
    known = index.sparkSession.sparkContext.broadcast(block)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            for k in range(batch.num_rows):  # a shard at a time, its lists as they lie in the batch
                shard, lengths, *lists = (batch.column(j)[k] for j in range(5))
                terms, starts, postings = (np.frombuffer(x.as_buffer(), t) for x, t in zip(lists, (U, np.uint32, np.uint32)))
                found = look_up(lengths.values.to_numpy().astype(np.int64), terms, starts.astype(np.int64), postings, known.value, near_span, gap)
                if found:
                    columns = [[shard.as_py() * SHARD_DOCS + d for d, *_ in found], *([x[j] for x in found] for j in (1, 2, 3))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_key", "hit", "items", "near"])

    return index.select("shard", "lengths", "terms", "starts", "postings").mapInArrow(find, FOUND)


def decontaminate(docs: DataFrame, items: DataFrame, near_terms: int = 4, near_span: int = 26, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, near_items for every row of docs."""
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as kept:
        found = store(_decontaminated(docs, items, near_terms, near_span, percent), "contamination")
        kept.append(found.stored_at)
    return found


def _decontaminated(docs: DataFrame, items: DataFrame, near_terms: int, near_span: int, percent: int) -> DataFrame:
    gap = max(WINDOW, near_span) + 1  # so that no match reaches into the next document
    windows = store(test_windows(items), "windows")
    rarest = store(rarest_words(items, near_terms), "rarest")
    index = store(build_index(docs, filter_of(windows.select(F.explode("words").alias("word")), F.col("word")), gap), "index")
    blocks = -(-windows.count() // BLOCK_WINDOWS)
    part = lambda df, *names: df.where(F.pmod(F.xxhash64(*names), F.lit(blocks)) == k).toPandas()
    found = docs.sparkSession.createDataFrame([], FOUND)
    for k in range(blocks):
        block = TestBlock(part(windows, "item_id", F.array_join("words", " ")), part(rarest, "item_id"))
        found = found.union(search(index, block, near_span, gap))
    if blocks > 1:
        merged = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hit", "items", "near")]
        found = found.groupBy("doc_key").agg(*merged)
    listed = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "lengths")))
    rows = listed.select((F.col("shard") * SHARD_DOCS + F.col("pos")).alias("doc_key"), F.col("col.doc_ids").alias("doc_id"), F.col("col.lengths").cast("long").alias("n_words"))
    names = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<long>")), lambda x: x.cast("string")))
    n_hit = F.size(F.coalesce("hit", F.array().cast("array<int>"))).cast("long")
    n_near = F.size(F.coalesce("near", F.array().cast("array<long>"))).cast("long")
    return rows.join(found, "doc_key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * F.lit(100) >= F.col("n_words") * percent)).alias("contaminated"),
        names.alias("item_ids"), n_near.alias("near_items"),
    )
