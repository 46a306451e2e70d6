"""Exact Jaccard join of documents on word shingles: size-banded tiles, bitmap bounds, sorted-array intersection.

1. Documents with equal shingle sets are a class; its least doc_id stands for it. Sizes fall into bands from 2^k to
   2^(k+1); a set that can be similar to one of the next band is dealt there too.
2. The shingle hashes of a band are cut into ranges, more of them than similar sets can differ in elements, so that of
   similar sets at least one range that isn't empty holds the same. A tile is a band, a range and what a set has in it:
   similar sets share one for certain, unlike a draw of minima, while a passage that many documents share makes a tile only
   of those that have nothing else in the range. Sets below SMALL take their least hashes as ranges of one (similar sets
   share one of these). Of a set only as many ranges are written as it takes; a set with too few filled ranges, which only
   chance could make, is dealt to tiles by every shingle, together with all sets that share one with it.
3. Each tile proposes links between its members and the least of them. Parity bitmaps, of more bits than the sets have
   elements, differ in no more bits than the sets in elements, so that the bits that differ bound the overlap from above;
   what they let pass is confirmed by intersecting sorted arrays.
4. Tiles whose members then lie in more than one component are looked through once more, in square blocks of bounded size;
   tiles of equal members count once. First with bitmaps alone; only members with a partner that the bitmaps let pass come back with their sets, for exact intersections.
5. Components over all confirmed links, by alternating large-star and small-star.

No pair at or above the threshold is lost, but for collisions of 64-bit hashes. Members of one component needn't be
compared with each other, so a group of very many alike costs what its members do, not its pairs.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; a row without doc_id is
returned with a null component; rows that share a doc_id count as one document; repeated rows are such rows; a pair just at the
threshold is linked; a text of any length is taken whole; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm.common import filter_bit, filter_of, release, scratch, slices, store
from helixlake.llm.components import connected_components
from helixlake.llm.near_dup import _linked, confirmed
from helixlake.llm.shingles import U, mixed, shingle_set

WIDTH, PERCENT = 5, 80
#: Sets below this many shingles take single hashes for ranges.
SMALL = 64
#: Ranges of a band, over the number that similar sets can differ in.
SLACK = 1.25
#: So many standard deviations of filled ranges a set writes more than it needs.
SPARE = 6.0
#: A block of a tile: members with bitmaps, and members and shingles of them with sets, in expectation at most.
BLOCK, SET_BLOCK, SET_SHINGLES = 4096, 512, 500_000

_odd = mixed(np.arange(1, 257, dtype=U)) | U(1)
#: A value for each byte, the same for A-Z and a-z.
LETTER = _odd[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
BASE = U(0x9E3779B97F4A7C15)
CHUNK = 1 << 19


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^k and its inverse modulo 2^64, for k below n."""
    rise = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, x, U)]))
    return rise(BASE), rise(U(pow(int(BASE), -1, 1 << 64)))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z in lower case: differences of prefix polynomials over bytes,
    without an object for each word. Long texts are cut at a space near every CHUNK bytes."""
    found = []
    x = np.frombuffer(raw, np.uint8)
    start = 0
    while start < len(x):
        stop = min(len(x), start + CHUNK)
        while stop < len(x) and not SPACE[x[stop]]:
            stop += 1
        own = x[start:stop]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[own], [True]])))
        power, inverse = _powers(max(2 * CHUNK, 1 << (len(own) - 1).bit_length()))
        prefix = np.concatenate([np.zeros(1, U), np.cumsum(LETTER[own] * power[: len(own)], dtype=U)])
        a, b = edge[0::2], edge[1::2]
        found.append(mixed((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(U)))
        start = stop
    return np.concatenate(found) if found else np.zeros(0, U)


def ranges(band: int, percent: int) -> int:
    """Into how many ranges a band is cut."""
    return math.ceil(max(SLACK, 1.5 if band < 8 else 0) * ((100 - percent) * (2 << band) / percent + 1))


def written(n: int, band: int, percent: int = PERCENT, spare: float = SPARE) -> int:
    """How many ranges a set of n writes, the first ones of the band: so many that enough of them are filled, by `spare`
    standard deviations. It never falls with n, so that of two sets the larger one writes all that the smaller one needs."""
    count = ranges(band, percent)
    if band < 8:
        return count
    filled = 1 - math.exp(-n / count)
    need = (100 - percent) * n / percent + 1
    return min(count, math.ceil((need + spare * math.sqrt(need * (1 - filled)) + spare * spare / 2 * (1 - filled)) / filled))


def tile_keys(own: np.ndarray, percent: int = PERCENT, spare: float = SPARE) -> tuple[np.ndarray, bool]:
    """Tiles of a sorted set, and whether its filled ranges are enough."""
    n = len(own)
    if not n:
        return own, True
    band, keys, enough = n.bit_length() - 1, [], True
    if n < SMALL:
        keys.append(mixed(own[: n - -(-percent * n // 100) + 1]))
    need = (100 - percent) * n // percent + 1
    for b in (band, band + 1):
        if (1 << b) < SMALL or (b > band and 100 * n < percent << b):
            continue
        count = ranges(b, percent)
        upto = written(n, b, percent, spare)
        at = ((own >> U(32)) * U(count)) >> U(32)
        at = at[: np.searchsorted(at, upto)]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at.astype(np.int64)
        enough &= len(first) >= need
        if len(first):
            held = np.add.reduceat(mixed(own[: len(at)] ^ U(0x5851F42D4C957F2D)), first)
            keys.append(mixed(held + mixed(at[first] * U(128) + U(b))))
    return np.concatenate(keys), enough


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parities of the set's elements by their lower bits: a power of two of them, at least twice the size of the set."""
    words = max(2, 1 << (2 * len(own) - 1).bit_length() >> 6)
    flips = np.bincount((own & U(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(U)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of fewer words: parities of what falls together there."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [shingle_set(word_hashes(t or b""), WIDTH) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]


def _over(docs: DataFrame, make: Callable[[np.ndarray, list[np.ndarray]], list], schema: str, filtered: np.ndarray | None = None, name: str = "rep") -> DataFrame:
    """Columns that make gives for ids and shingle sets; of ids that pass the filter, if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(filtered)
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            if shared.value is not None:
                batch = batch.filter(pa.array(shared.value[batch.column(2).to_numpy()] == 1))
            yield pa.RecordBatch.from_arrays(make(batch.column(0), _sets(batch)), names)

    taken = docs.select(F.col("doc_id").cast("long").alias(name), "text")
    if filtered is not None:
        taken = taken.where(F.col(name).isNotNull()).withColumn("bit", filter_bit(F.xxhash64(name)))
    return taken.mapInArrow(rows, schema)


def _key(own: np.ndarray) -> bytes | None:
    return own.sum(dtype=U).tobytes() + mixed(own ^ U(len(own))).sum(dtype=U).tobytes() if len(own) else None


def sketches(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key and bits (null for an empty set), enough (see tile_keys)."""

    def make(ids: pa.Array, sets: list[np.ndarray]) -> list:
        bits = [bitmap(s).tobytes() if len(s) else None for s in sets]
        enough = [bool(tile_keys(s, percent)[1]) for s in sets]
        return [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), pa.array(bits, pa.binary()), pa.array(enough, pa.bool_())]

    return _over(docs, make, "doc_id long, n_shingles long, set_key binary, bits binary, enough boolean", name="doc_id")


def tiles(docs: DataFrame, reps: DataFrame, scarce: DataFrame, percent: int) -> DataFrame:
    """tile, rep: the tiles of at least the documents in reps; for sets that share a shingle with one of scarce, also by
    every such shingle."""
    wanted = filter_of(reps, F.xxhash64("rep"))
    repeat = lambda ids, keys: pa.array(np.repeat(np.array(ids.to_pylist(), np.int64), [len(k) for k in keys]))

    def deal(ids: pa.Array, sets: list[np.ndarray]) -> list:
        keys = [tile_keys(s, percent)[0] for s in sets]
        return [pa.array(np.concatenate([*keys, np.zeros(0, U)]).view(np.int64)), repeat(ids, keys)]

    found = _over(docs, deal, "tile long, rep long", wanted)
    if scarce.isEmpty():
        return found

    def every(ids: pa.Array, sets: list[np.ndarray]) -> list:
        keys = [mixed(s ^ U(0xD1B54A32D192ED03)) for s in sets]
        return [pa.array(np.concatenate([*keys, np.zeros(0, U)]).view(np.int64)), repeat(ids, keys)]

    by_all = _over(docs, every, "tile long, rep long", wanted)
    theirs = _over(docs, every, "tile long, rep long", filter_of(scarce, F.xxhash64("rep"))).join(scarce, "rep", "left_semi").select("tile").distinct()
    return found.unionByName(by_all.join(store(theirs, "scarce-tiles"), "tile", "left_semi"))


def payloads(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, shingles (sorted), of at least the documents in ids, from their texts."""

    def load(batch_ids: pa.Array, sets: list[np.ndarray]) -> list:
        keep = [k for k, s in enumerate(sets) if len(s)]
        return [batch_ids.take(pa.array(keep, pa.int64())), pa.array([sets[k].tobytes() for k in keep], pa.binary())]

    return _over(docs, load, "rep long, shingles binary", filter_of(ids, F.xxhash64("rep")))


def _dealt(members: DataFrame, most: int, shingles: int) -> DataFrame:
    """Members (tile, rep, n, component) of tiles dealt to blocks low and high: every two of different components meet in one.
    Those of the largest component, who needn't meet each other, go to the blocks of the others only."""
    parts = members.groupBy("tile", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    whole = parts.groupBy("tile").agg(F.max(F.struct("c", "s", "component")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    number = lambda c, s: F.greatest(F.lit(1), F.ceil(F.greatest(c / most, s / shingles))).cast("int")
    top = F.col("top")
    sizes = store(whole.where(F.col("c") > top["c"]).select("tile", top["component"].alias("top"), number(F.col("c") - top["c"], F.col("s") - top["s"]).alias("few"), number(top["c"], top["s"]).alias("many")), "tile-blocks")
    placed = members.join(sizes, "tile").withColumn("in_top", F.col("component") == F.col("top"))
    draw = F.xxhash64("rep", F.lit(5))
    own = F.when(F.col("in_top"), F.col("few") + F.pmod(draw, F.col("many"))).otherwise(F.pmod(draw, F.col("few"))).cast("int")
    last = F.when(F.col("in_top"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    met = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return met.select("tile", "rep", "n", "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def _by_block(dealt: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What kernel gives for the rows of each block. A task takes its blocks one after the other from sorted rows, so that a
    block costs no more than it holds."""

    def starts(rows: pa.RecordBatch) -> np.ndarray:
        keys = [rows.column(c).to_numpy() for c in ("tile", "low", "high")]
        return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in keys])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            at = starts(rows).tolist()
            for a, b in zip(at, at[1:]):
                if (out := kernel(rows.slice(a, b - a))) is not None:
                    yield out
            rest = rows.slice(at[-1])
        if rest is not None and (out := kernel(rest)) is not None:
            yield out

    block = ["tile", "low", "high"]
    return dealt.repartition(*block).sortWithinPartitions(*block, "side", "rep").mapInArrow(run, schema)


def _meeting(block: pa.RecordBatch, percent: int, bits: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a block, in pairs, that lie in different components and may be similar by their sizes, and by bitmaps if there
    are some. Bounded numbers of pairs are looked at at once."""
    side, n, comp = (block.column(c).to_numpy() for c in ("side", "n", "component"))
    same = block.column("low")[0] == block.column("high")[0]
    left, right = np.flatnonzero(side == 0), np.arange(len(side)) if same else np.flatnonzero(side == 1)
    step = max(1, (1 << 21) // max(1, len(right) * (1 if bits is None else bits.shape[1])))
    for k in range(0, len(left), step):
        own = left[k : k + step]
        x, y = n[own][:, None], n[right][None, :]
        good = (comp[own][:, None] != comp[right][None, :]) & _let_pass(x, y, np.abs(x - y), percent)
        if same:
            good &= own[:, None] < right[None, :]
        if bits is not None and good.any():
            good &= _let_pass(x, y, np.bitwise_count(bits[own][:, None, :] ^ bits[right][None, :, :]).sum(axis=2, dtype=np.int64), percent)
        i, j = np.nonzero(good)
        if len(i):
            yield own[i], right[j]


def _let_pass(a: int, b: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar if they differ in at least `apart` elements."""
    return 100 * (a + b - apart) >= percent * (a + b + apart)


def close(pairs: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps let pass. sized: rep, n, bits."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            apart = np.zeros(batch.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                words = min(len(x), len(y))
                apart[k] = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()
            yield batch.select([0, 1]).filter(pa.array(_let_pass(n, m, apart, percent)))

    of = lambda c, n, bits: sized.select(F.col("rep").alias(c), F.col("n").alias(n), F.col("bits").alias(bits))
    joined = pairs.join(of("b", "m", "bits_b"), "b").join(of("a", "n", "bits_a"), "a").where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    return joined.select("a", "b", "n", "m", "bits_a", "bits_b").mapInArrow(check, "a long, b long")


def _bounded(block: pa.RecordBatch, percent: int) -> pa.RecordBatch | None:
    """tile, rep: members of a block that have a partner in another component which the bitmaps let pass."""
    raw = block.column("bits").to_pylist()
    sizes = {len(x) for x in raw}
    if len(sizes) == 1:
        bits = np.frombuffer(b"".join(raw), U).reshape(len(raw), -1)
    else:
        bits = np.stack([_folded(np.frombuffer(x, U), min(sizes) // 8) for x in raw])
    good = np.zeros(len(raw), bool)
    for i, j in _meeting(block, percent, bits):
        good[i] = good[j] = True
    return block.select(["tile", "rep"]).filter(pa.array(good)) if good.any() else None


def _joined(block: pa.RecordBatch, percent: int) -> pa.RecordBatch | None:
    """Links between components in a block, as many as it takes to join what they join."""
    rep, comp = block.column("rep").to_numpy(), block.column("component").to_numpy().copy()
    sets = [np.frombuffer(x.as_buffer(), U) for x in block.column("shingles")]
    out: list[tuple[int, int]] = []
    for left, right in _meeting(block, percent):
        for i, k in zip(left.tolist(), right.tolist()):
            if comp[k] != comp[i] and _linked(sets[i], sets[k], percent):
                out.append((min(rep[i], rep[k]), max(rep[i], rep[k])))
                comp[comp == comp[k]] = comp[i]
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"]) if out else None


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; the threshold lies above 50 percent."""
    with scratch(docs.sparkSession) as kept:
        found = store(_similar(docs, percent), "similar")
        kept.append(found.stored_at)
    return found


def _similar(docs: DataFrame, percent: int) -> DataFrame:
    sketch = store(sketches(docs, percent), "set-keys")
    classes = sketch.where("set_key is not null and doc_id is not null").groupBy("set_key")
    classes = classes.agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(as_c) for c, as_c in (("n_shingles", "n"), ("enough", "enough"), ("bits", "bits"))])
    classes = store(classes, "set-classes")
    dealt = tiles(docs, classes, classes.where("not enough").select("rep"), percent)
    by_tile = Window.partitionBy("tile").orderBy("rep")
    shared = dealt.withColumn("head", F.first("rep").over(by_tile)).where("rep <> head")
    shared = store(shared.select("tile", "head", "rep").distinct(), "shared-tiles")
    star = store(shared.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    star = store(close(star, classes, percent), "close-star")
    sets = payloads(docs, star.select(F.explode(F.array("a", "b")).alias("rep")))
    first = store(confirmed(star, store(sets, "star-sets"), percent), "star-links")
    part = store(connected_components(first, "star-components"), "star-parts")
    edges = part.select(F.col("component").alias("a"), F.col("node").alias("b")).union(_across_tiles(docs, shared, part, classes, percent))
    final = connected_components(edges, "similar-components")

    named = classes.select("set_key", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    named = store(named.select("set_key", F.coalesce("component", "rep").alias("component")), "named-classes")
    out = sketch.join(named, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _across_tiles(docs: DataFrame, shared: DataFrame, part: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between components within tiles."""
    # Tiles with the same members are one; of two members the links are known.
    member = F.xxhash64("rep")
    alike = shared.groupBy("tile").agg(F.count("*").alias("c"), F.first("head").alias("head"), F.bit_xor(member).alias("x"), F.sum(F.shiftright(member, 32)).alias("y")).where("c > 1")
    once = store(alike.groupBy("c", "head", "x", "y").agg(F.min("tile").alias("tile")).select("tile"), "distinct-tiles")
    rows = shared.join(once, "tile", "left_semi")
    rows = rows.select("tile", "rep").unionByName(rows.select("tile", F.col("head").alias("rep")).distinct())
    rows = rows.join(part.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rows = store(rows.join(classes.select("rep", "n"), "rep").select("tile", "rep", "n", "component"), "tile-members")
    split = rows.groupBy("tile").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("tile")
    rows = store(rows.join(store(split, "open-tiles"), "tile"), "open-members")
    bits = classes.select("rep", "bits")
    survivors = _by_block(_dealt(rows, BLOCK, 1 << 40).join(bits, "rep"), lambda block: _bounded(block, percent), "tile long, rep long")
    near = store(rows.join(store(survivors.distinct(), "let-pass"), ["tile", "rep"], "left_semi"), "near-members")
    sets = store(payloads(docs, near.select("rep")), "near-sets")
    return _by_block(_dealt(near, SET_BLOCK, SET_SHINGLES).join(sets, "rep"), lambda block: _joined(block, percent), "a long, b long")
