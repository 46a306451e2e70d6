"""Near-duplicate documents: MinHash with banding, checks on signatures and on full sets, connected components.

1. One pass over the texts gives each document its shingle set's size, a 128-bit key of the set, and its band keys.
   Documents with equal sets form a class; its least doc_id stands for it from here on.
2. Each bucket proposes links between its members and one of them, drawn by hash anew in every bucket: as many as it
   has members, never all its pairs. Links are confirmed on full sets.
3. A bucket of three or more whose members then lie in more than one component is looked through once more: tasks
   compare its members from different components, in square blocks of bounded size, so that no task holds a whole
   bucket; each pair is confirmed there on full sets if its signatures agree far enough, in the first band that it
   shares. Only links that join components come out, fewer than a block has members.
4. Components over all confirmed links, by alternating large-star and small-star.

With r rows in b bands a pair of similarity s shares no bucket with probability (1 - s^r)^b: 1.2e-6 at s = 0.75 for the
defaults. A pair in a common bucket is dropped unread if its signatures agree in fewer than half of the minima: for
s = 0.75 and 144 minima that has probability 3e-11. Everything else is exact.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; a row without doc_id
is returned with a null component and kept; rows that share a doc_id count as one document; a text of any length is
taken whole; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.common import bound_batches, filter_bit, filter_of, scratch, slices, store
from helixlake.llm.components import connected_components
from helixlake.llm.shingles import Minima, U, WordHashes, band_keys, mixed, shingle_set, words

WIDTH, ROWS, BANDS = 5, 4, 36
#: Share of minima in which the signatures of a pair must agree to be compared on full sets.
AGREE = 0.5
#: A block of a bucket: so many members, and so many shingles of theirs, in expectation at most.
BLOCK, BLOCK_SHINGLES = 512, 500_000


def _sets(texts: pa.Array, hashes: WordHashes) -> list[np.ndarray]:
    return [shingle_set(hashes.of(words(t)), WIDTH) for t in pc.cast(texts, pa.binary()).to_pylist()]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), bands."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima, hashes = Minima(ROWS * BANDS), WordHashes()
        for batch in slices(batches, size=1 << 20):
            sets = _sets(batch.column(1), hashes)
            full = [s for s in sets if len(s)]
            bands = iter(band_keys(minima.of(full), ROWS).view(np.int64).tolist() if full else [])
            key = [s.sum(dtype=U).tobytes() + mixed(s ^ U(len(s))).sum(dtype=U).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def payloads(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, minima and full set of at least the documents in ids, from their texts."""
    spark: SparkSession = docs.sparkSession
    # A filter of bounded size spares most texts this second pass.
    wanted = spark.sparkContext.broadcast(filter_of(ids, F.xxhash64("rep")))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima, hashes = Minima(ROWS * BANDS), WordHashes()
        for batch in slices(batches, size=1 << 20):
            batch = batch.filter(pa.array(wanted.value[batch.column(2).to_numpy()] == 1))
            sets = _sets(batch.column(1), hashes)
            keep = [k for k, s in enumerate(sets) if len(s)]
            if keep:
                rows = minima.of([sets[k] for k in keep])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep)), pa.array([x.tobytes() for x in rows], pa.binary()), pa.array([sets[k].tobytes() for k in keep], pa.binary())], ["rep", "minima", "shingles"]
                )

    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text")
    hashed = hashed.withColumn("bit", filter_bit(F.xxhash64("rep")))
    return hashed.mapInArrow(load, "rep long, minima binary, shingles binary")


def confirmed(pairs: DataFrame, loaded: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    # Two texts under one doc_id (a data error) give two payloads; either may confirm.
    a = loaded.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    b = loaded.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    sized = pairs.join(b, "b").join(a, "a").where(f"100 * least(length(set_a), length(set_b)) >= {percent} * greatest(length(set_a), length(set_b))")
    return sized.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _across(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between different components in one block of a bucket, as many as it takes to join what they join. A pair
    is compared on full sets if its signatures agree far enough, and only in the first band in which they coincide."""
    side, rep, comp, size = (frame[c].to_numpy() for c in ("side", "rep", "component", "n"))
    comp = comp.copy()
    minima = np.stack([np.frombuffer(x, np.uint32) for x in frame["minima"]])
    sets = [np.frombuffer(x, U) for x in frame["shingles"]]
    same, bucket = frame["same"].iloc[0], frame["bucket"].iloc[0]
    left = np.arange(len(rep)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    keys = band_keys(minima, ROWS).view(np.int64)
    out: list[tuple[int, int]] = []
    for i in left:
        j = right[(comp[right] != comp[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
        if same:
            j = j[j > i]
        if len(j):
            j = j[(minima[j] == minima[i]).mean(axis=1) >= AGREE]
        if len(j):
            first = np.argmax(keys[j] == keys[i], axis=1)
            for k in j[keys[i][first] == bucket]:
                if comp[k] != comp[i] and _linked(sets[i], sets[k], percent):
                    out.append((min(rep[i], rep[k]), max(rep[i], rep[k])))
                    comp[comp == comp[k]] = comp[i]
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])


def cross_links(open_rows: DataFrame, loaded: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between components within the buckets of open_rows (bucket, rep, n, component). Members of a
    bucket's largest component needn't meet each other: each goes once to every block of the others, while these go to
    all blocks. Blocks are bounded by members and by shingles."""
    by_part = open_rows.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    parts = by_part.groupBy("bucket").agg(F.max(F.struct("c", "s", "component")).alias("major"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    major = F.col("major")
    parts = parts.select(  # stored, so that Spark can split a bucket of very many members in the join below
        "bucket", major["component"].alias("major"), blocks(F.col("c") - major["c"], F.col("s") - major["s"]).alias("few"), blocks(major["c"], major["s"]).alias("many")
    )
    dealt = open_rows.join(store(parts, "blocks"), "bucket").withColumn("in_major", F.col("component") == F.col("major"))
    spread = lambda n: F.pmod(F.xxhash64("rep", F.lit(3)), n).cast("int")
    dealt = dealt.withColumn("mine", F.when(F.col("in_major"), F.col("few") + spread(F.col("many"))).otherwise(spread(F.col("few"))))
    to = F.sequence(F.lit(0), F.when(F.col("in_major"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    dealt = dealt.withColumn("other", F.explode(to)).select(
        "bucket", "rep", "n", "component", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), (F.col("mine") == F.col("other")).alias("same"),
    )
    return dealt.join(loaded, "rep").groupBy("bucket", "low", "high").applyInPandas(lambda frame: _across(frame, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as kept:
        found = store(_near_duplicates(docs, percent), "near-duplicates")
        kept.append(found.stored_at)
    return found


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    sketch = store(sketches(docs), "sketches")
    # Equal keys have equal sets, and so equal bands: any of them will do.
    classes = store(
        sketch.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    rows = classes.select("rep", F.explode("bands").alias("bucket"))
    # One member of each bucket, drawn by a hash that differs from bucket to bucket.
    draw = F.xxhash64("rep", "bucket")
    heads = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min(draw).alias("drawn")).where("members > 1")
    shared = store(rows.join(heads, "bucket").select("bucket", "rep", "members", (draw == F.col("drawn")).alias("is_head")), "buckets")
    loaded = store(payloads(docs, shared.select("rep")), "payloads")

    head = shared.where("is_head").select("bucket", F.col("rep").alias("head"))
    star = shared.where("not is_head").join(head, "bucket").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
    first = store(confirmed(star, loaded, percent), "links")
    part = store(connected_components(first), "parts")

    # The one pair of a bucket of two has been looked at.
    labelled = shared.where("members > 2").join(part.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = store(labelled.select("bucket", "rep", "component"), "labelled")
    unsettled = store(labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket"), "unsettled")
    opened = labelled.join(unsettled, "bucket").join(classes.select("rep", "n"), "rep")
    more = cross_links(store(opened.select("bucket", "rep", "n", "component"), "opened"), loaded, percent)
    edges = part.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more)
    final = connected_components(edges)

    named = classes.select("set_key", "rep").join(final.withColumnRenamed("node", "rep"), "rep").select("set_key", "component")
    # Stored, so that the join below is one of two plain tables, in which Spark splits a class of very many documents.
    named = store(classes.select("set_key", "rep").join(named, "set_key", "left").select("set_key", F.coalesce("component", "rep").alias("component")), "named")
    out = sketch.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
