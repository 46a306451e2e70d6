"""Clusters of evidence: maximal sets of rows that agree on both breakpoints.

Every kind of variant is one shape of row: it is active for left breakpoints in [start, stop), and at a left breakpoint b
allows right breakpoints from low(b) to high(b), both linear in b and clipped. Equal shapes are one before they come together,
so the work follows the distinct coordinates, not the depth of coverage. Inside a tile of left breakpoints a sweep over arrivals,
for inversions over all left breakpoints, finds the sets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.constants import CLUSTER_SPAN_CAPS, READ_CLUSTERS
from helixlake.stored import store

SHAPE = ["start", "stop", "low", "high", "slope", "least", "most", "side"]
#: Shapes or places that one step of the sweep looks at together.
BLOCK = 64
#: Width of a tile of left breakpoints, in reaches of the longest shape; members of sets that a task gives at once.
TILE_REACHES, BATCH_MEMBERS = 16, 1 << 20


def _shape(df: DataFrame, start: Column, stop: Column, low: Column, high: Column, slope: int, least: Column, most: Column, side: str) -> DataFrame:
    made = dict(zip(SHAPE[:-1], (start, stop, low, high, F.lit(slope), least, most)))
    return df.select("ev_id", "chrom", "sv_type", *[c.cast("long").alias(n) for n, c in made.items()], F.lit(side).alias("side"))


def shapes(evidence: DataFrame) -> DataFrame:
    """Shapes of evidence (ev_id, chrom, sv_type, l_start, l_end, l_or, r_start, r_end, r_or, min_delta, max_delta)."""
    le, ls, rs, re = (F.col(c) for c in ("l_end", "l_start", "r_start", "r_end"))
    lo, hi = F.col("min_delta"), F.col("max_delta")
    of = lambda *kinds: evidence.where(F.col("sv_type").isin(*kinds))
    # Right breakpoints move right with b until the read's own place caps them.
    ahead = _shape(of("DEL", "TDUP"), le, le + hi, rs - le - hi, rs - le - lo, 1, le, rs, "A")
    insertion = _shape(of("INS"), le, rs, lo - (rs - le), hi - (rs - le), 0, F.lit(-(1 << 40)), F.lit(1 << 40), "A")
    inv = of("INV")
    forward = _shape(inv.where("l_or = 'F'"), le, F.least(le + hi, re), re + lo + le, re + hi + le, -1, re, re + hi, "F")
    back = _shape(inv.where("l_or = 'R'"), F.greatest(ls - hi, F.lit(0)), ls, rs - hi + ls, rs - lo + ls, -1, rs - hi, rs, "R")
    return ahead.unionByName(insertion).unionByName(forward).unionByName(back)


def duplications(evidence: DataFrame) -> DataFrame:
    """Clusters of interspersed and inverted duplications: maximal sets of rows of either strand of the left end, of which
    those of one strand agree on a right breakpoint. Types end in _LEFT or _RIGHT, where the copy lies."""
    found = cluster(duplication_shapes(evidence), between=True, paired=True)
    place = F.when(F.col("sv_type").endswith("_RIGHT"), -F.col("left_brk")).otherwise(F.col("left_brk"))
    return found.withColumn("left_brk", place)


def region_shapes(reads: DataFrame) -> DataFrame:
    """Shapes of one-ended evidence (ev_id, chrom, sv_type, pos, pos_end, or, max_delta, conc_max): forward reads reach on to
    the right, reverse reads to the left; any right breakpoint will do."""
    wide = (F.lit(0), F.lit(0), 0, F.lit(0), F.lit(0))
    forward = _shape(reads.where("or = 'F'"), F.col("pos_end"), F.col("pos") + F.col("max_delta"), *wide, "F")
    back = _shape(reads.where("or = 'R'"), F.greatest(F.lit(0), F.col("pos") - F.col("conc_max")), F.col("pos"), *wide, "R")
    return forward.unionByName(back)


def duplication_shapes(evidence: DataFrame) -> DataFrame:
    """Shapes of interspersed (INTERDUP) and inverted duplications (INVDUP); evidence as for shapes. Each row has two: the
    copy inserted to the left, and to the right of its source, which is the first mirrored about 0, strands turned."""
    start = F.when(F.col("l_or") == "F", F.col("l_end")).otherwise(F.col("l_start")).cast("long")
    end = F.when(F.col("r_or") == "F", F.col("r_end")).otherwise(F.col("r_start")).cast("long")
    columns = ["ev_id", "chrom", F.col("min_delta").alias("_lo"), F.col("max_delta").alias("_hi")]
    named = lambda to: F.concat("sv_type", F.lit(f"_{to}")).alias("sv_type")
    far = F.lit(1 << 40)
    left = evidence.select(*columns, named("LEFT"), start.alias("_s"), end.alias("_e"), F.col("l_or").alias("_side"), F.lit(1).alias("_first"), F.lit(0).alias("_floor"))
    turned = F.when(F.col("l_or") == "F", "R").otherwise("F")
    right = evidence.select(*columns, named("RIGHT"), (-end).alias("_s"), (-start).alias("_e"), turned.alias("_side"), (-far).alias("_first"), (-far).alias("_floor"))
    rows = left.unionByName(right)
    s, e, lo, hi, first, floor = (F.col(c) for c in ("_s", "_e", "_lo", "_hi", "_first", "_floor"))
    found = []
    for side in "FR":
        own = rows.where(F.col("_side") == side)
        # Of an interspersed copy both strands look on to the right, with the other end before their mates.
        found.append(_shape(own.where("sv_type like 'INTERDUP%'"), s + 1, s + hi + 1, e - hi - s, e - lo - s, 1, floor, e, side))
    inverted = rows.where("sv_type like 'INVDUP%'")
    found.append(_shape(inverted.where("_side = 'F'"), s + 1, s + hi + 1, e + lo + s, e + hi + s, -1, e, far, "F"))
    found.append(_shape(inverted.where("_side = 'R'"), F.greatest(first, s - hi), s + 1, e - hi + s, e - lo + s, -1, floor, e, "R"))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def _table(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Shapes in order of arrival as a table, and which of them are of side F."""
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    return np.array([r[:8] for r in ordered], np.int64).reshape(-1, 8), np.array([r[8] == "F" for r in ordered], bool)


def beginnings(table: np.ndarray) -> np.ndarray:
    """Left breakpoints, besides arrivals, at which two active shapes begin to overlap: where the upper bound of one rises
    to the lower bound of the other. Bounds are linear or held by a clip, so they meet where two of such pieces do. table:
    shapes by their start."""
    found = [np.zeros(0, np.int64)]
    upto = np.maximum.accumulate(table[:, 2]) if len(table) else table[:, 2]
    for at in range(0, len(table), BLOCK):
        own = table[at : at + BLOCK]
        since = int(np.searchsorted(upto, own[0, 1], "right"))  # all before have stopped
        other = table[since : at + len(own)]
        i, j = np.nonzero((other[:, 2] > own[:, 1, None]) & (np.arange(since, at + len(own)) < np.arange(at, at + len(own))[:, None]))
        for low, high in ((own[i], other[j]), (other[j], own[i])):
            found.append(_meetings(low, high))
    return np.unique(np.concatenate(found))


def _meetings(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the upper bounds of `high` rise to the lower bounds of `low`, row by row, while both are active."""
    found = [np.zeros(0, np.int64)]
    clip = lambda x, k, b: np.minimum(np.maximum(x[:, k] + x[:, 5] * b, x[:, 6]), x[:, 7])
    for lk, ls in ((3, low[:, 5]), (6, 0), (7, 0)):
        for hk, hs in ((4, high[:, 5]), (6, 0), (7, 0)):
            closing = np.broadcast_to(np.subtract(hs, ls), len(low))
            if not (closing > 0).any():
                continue
            b = -((high[:, hk] - low[:, lk]) // np.maximum(closing, 1))  # rounded up
            k = np.nonzero((closing > 0) & (np.maximum(low[:, 1], high[:, 1]) < b) & (b < np.minimum(low[:, 2], high[:, 2])))[0]
            lo, hi, b = low[k], high[k], b[k]
            met = (clip(hi, 4, b) >= clip(lo, 3, b)) & (clip(hi, 4, b - 1) < clip(lo, 3, b - 1))
            found.append(np.unique(b[met]))
    return np.concatenate(found)


def cliques(table: np.ndarray, names: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Of each place, the maximal sets of shapes active there that share a right breakpoint while the left one is the place: as
    the bits of their names, with the places from which and up to which all of them are active. table: shapes by their start."""
    far = np.int64(1) << 60
    upto = np.maximum.accumulate(table[:, 2]) if len(table) else table[:, 2]
    for at in range(0, len(places), BLOCK):
        b = places[at : at + BLOCK, None]
        first, last = int(np.searchsorted(upto, b[0, 0], "right")), int(np.searchsorted(table[:, 1], b[-1, 0], "right"))
        near = np.arange(first, last)[table[first:last, 2] > b[0, 0]]
        rows, name = table[near], names[near]
        sets: list[list[tuple[int, int, int]]] = [[] for _ in b]
        if len(rows):
            start, stop, low, high, slope, least, most = rows.T[1:]
            active = (start <= b) & (b < stop)
            lo = np.where(active, np.minimum(np.maximum(low + slope * b, least), most), far)
            hi = np.where(active, np.minimum(np.maximum(high + slope * b, least), most), far)
            # In the order of ends, openings first where they are equal, a set is full where a closing follows an opening.
            ends = np.sort(np.concatenate([2 * lo, 2 * hi + 1], axis=1), axis=1)
            full = np.zeros(ends.shape, bool)
            full[:, 1:] = (ends[:, 1:] & 1 == 1) & (ends[:, :-1] & 1 == 0) & (ends[:, 1:] < 2 * far)
            k, e = np.nonzero(full)
            right = (ends[k, e] >> 1)[:, None]
            inside = (lo[k] <= right) & (right <= hi[k]) & active[k]
            base = int(name[0])
            spread = np.zeros((len(k), int(name[-1]) - base + 1), np.uint8)
            spread[:, name - base] = inside
            packed = np.packbits(spread, axis=1, bitorder="little")
            _, once, which = np.unique(packed.view(f"V{packed.shape[1]}")[:, 0], return_index=True, return_inverse=True)
            since, until = np.where(inside[once], start, -far).max(axis=1), np.where(inside[once], stop, far).min(axis=1)
            own = [(int.from_bytes(x.tobytes(), "little") << base, s, u) for x, s, u in zip(packed[once], since.tolist(), until.tolist())]
            for i, x in zip(k.tolist(), which.tolist()):
                sets[i].append(own[x])
        yield from zip(b[:, 0].tolist(), sets)


def sweep(rows: list[tuple], both_sides: bool, between: bool = False, paired: bool = False) -> list[tuple[int, list[int]]]:
    """Maximal sets of shapes (id, start, stop, low, high, slope, least, most, side) that share a left and a right
    breakpoint, with the left breakpoint where each was first complete. Looked for where shapes arrive, or with between at
    all left breakpoints: a set that is new at one without an arrival has two shapes that begin to overlap there. With
    paired, a set of either side at one left breakpoint make one together, whatever their right breakpoints, and between is
    implied; the left breakpoint is the last one looked at."""
    table, forward = _table(rows)
    return [(b, sorted(table[own, 0].tolist())) for b, own in swept(table, forward, both_sides, between, paired)]


def swept(table: np.ndarray, forward: np.ndarray, both_sides: bool, between: bool = False, paired: bool = False, window: tuple[int, int] | None = None) -> list[tuple[int, np.ndarray]]:
    """What sweep gives, with members as rows of the table (shapes by start and id; forward: which are of side F), by place and
    members' ids. Left breakpoints outside the window aren't looked at."""
    names = np.arange(len(table))
    parts = [forward, ~forward] if paired else [names >= 0]
    places = np.unique(np.concatenate([table[:, 1], *[beginnings(table[p]) for p in parts if between or paired]]))
    if window:
        places = places[(window[0] <= places) & (places < window[1])]
    if paired:
        found = pairs(places, *[[sets for _, sets in cliques(table[p], names[p], places)] for p in parts])
    else:
        first: dict[int, tuple[int, int, int]] = {}
        for b, sets in cliques(table, names, places):
            for own, since, until in sets:
                first.setdefault(own, (b, since, until))
        if both_sides:
            sides = [sum(1 << k for k in np.nonzero(p)[0].tolist()) for p in (forward, ~forward)]
            first = {own: x for own, x in first.items() if own & sides[0] and own & sides[1]}
        found = maximal(first)
    kept = [(b, np.nonzero(np.unpackbits(np.frombuffer(own.to_bytes(own.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little"))[0]) for b, own in found]
    return sorted(kept, key=lambda x: (x[0], sorted(table[x[1], 0].tolist())))


def maximal(found: dict[int, tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of sets (bits of members: place, and from and up to where all members are active), those that lie in no other, with their
    places. A set that holds another stands at a place where all of the other's members are active."""
    ordered = sorted((b, since, until, own) for own, (b, since, until) in found.items())
    places, sets = [x[0] for x in ordered], [x[3] for x in ordered]
    kept = []
    for k, (b, since, until, own) in enumerate(ordered):
        after = sets[k + 1 : bisect_left(places, until)]
        if not any(own & x == own for x in after) and not any(own & x == own for x in reversed(sets[bisect_left(places, since) : k])):
            kept.append((b, own))
    return kept


def pairs(places: np.ndarray, *sides: list[list[tuple[int, int, int]]]) -> list[tuple[int, int]]:
    """(place, bits of both): maximal pairs of a set of either side that stand at one left breakpoint, with the end of the first
    run of places where they do. sides: at each place, what cliques gives of either side. A pair lies in another one if at some
    place each of its two lies in a set there and one of them in a larger one, so two sets of places for each set tell."""
    held: list[dict[int, tuple[int, int]]] = []  # the places where a set lies in some set, and those where it lies in a larger one, as bits
    for at in sides:
        stands: dict[int, int] = {}
        ends = {}
        for k, sets in enumerate(at):
            for x, since, until in sets:
                stands[x] = stands.get(x, 0) | 1 << k
                ends[x] = since, until
        # All members of a set that holds another are active only where all of the other's are.
        ordered = sorted((since, x) for x, (since, _) in ends.items())
        starts, own = [since for since, _ in ordered], {}
        for since, x in ordered:
            larger = 0
            for _, y in ordered[bisect_left(starts, since) : bisect_left(starts, ends[x][1])]:
                if x & y == x and x != y:
                    larger |= stands[y]
            own[x] = stands[x] | larger, larger
        held.append(own)
    found: dict[int, int] = {}
    before: list[set[int]] = [set(), set()]
    for sets in zip(*sides):
        now = [{x for x, _, _ in own} for own in sets]
        for x in now[0]:
            inside, larger = held[0][x]
            for y in now[1] if x not in before[0] else now[1] - before[1]:
                other_inside, other_larger = held[1][y]
                if not larger & other_inside and not inside & other_larger and x | y not in found:
                    both = inside & other_inside
                    run = both + (both & -both)  # a carry through the first run
                    found[x | y] = int(places[(run & ~both).bit_length() - 2])
        before = now
    return [(b, own) for own, b in found.items()]


def cluster(shaped: DataFrame, both_sides: bool = False, least: int = 2, between: bool = False, paired: bool = False, of_each: int = -1) -> DataFrame:
    """cluster_id, chrom, sv_type, left_brk, size, ev_id: members of the maximal sets with at least `least` rows, and more than
    `of_each` of either side, with how many they are. both_sides, between and paired: see sweep.

    What is active at one left breakpoint decides on the sets there, and what is active as far from it as a shape reaches, or twice
    as far for pairs, on whether they are maximal. So tiles of left breakpoints, each with the shapes of its surroundings, are
    swept apart, and each gives the sets that stand in itself."""
    keys = ["chrom", "sv_type"]
    groups = shaped.where("start < stop").groupBy(*keys, *SHAPE)
    distinct = store(groups.agg(F.min("ev_id").alias("shape"), F.collect_list("ev_id").alias("ids")), "distinct-shapes")
    reach = distinct.groupBy(*keys).agg(F.max(F.col("stop") - F.col("start")).alias("reach"))  # a row for each chromosome and type
    wide = distinct.join(F.broadcast(reach.withColumns({"width": TILE_REACHES * F.col("reach"), "around": F.col("reach") * (2 if paired else 1)})), keys)
    tiles = F.sequence(F.floor((F.col("start") - F.col("around")) / F.col("width")), F.floor((F.col("stop") + F.col("around")) / F.col("width")))
    # So many partitions whatever their bytes: the work is in the sets, which are far larger than the shapes.
    parts = int(shaped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiled = wide.withColumn("tile", F.explode(tiles)).repartition(parts, *keys, "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = pa.Table.from_batches(list(batches))
        chrom, kind, tile, width, around = (frame[c][0].as_py() for c in (*keys, "tile", "width", "around"))
        column = {c: frame[c].to_numpy() for c in ("shape", *SHAPE[:-1])}
        order = np.lexsort((column["shape"], column["start"]))
        table = np.column_stack([*column.values()])[order]
        forward = (frame["side"].to_numpy() == "F")[order]
        lists = frame["ids"].combine_chunks().take(pa.array(order))
        ids, many = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        upto = np.cumsum(many)
        first = tile * width
        found: list[tuple] = []
        held = k = 0
        last = None
        for b, own in swept(table, forward, both_sides, between, paired, (first - around, first + width + around)):
            k = k + 1 if b == last else 0
            last = b
            size = int(many[own].sum())
            if not first <= b < first + width or size < least or of_each >= 0 and not of_each < many[own][forward[own]].sum() < size - of_each:
                continue
            ends = np.cumsum(many[own])
            members = ids[np.arange(size) + np.repeat(upto[own] - ends, many[own])]
            found.append((f"{chrom}:{kind}:{b}:{k}", b, size, members))
            held += size
            if held > BATCH_MEMBERS:
                yield _batch(chrom, kind, found)
                found, held = [], 0
        yield _batch(chrom, kind, found)

    sets = tiled.groupBy(*keys, "tile").applyInArrow(run, "cluster_id string, chrom string, sv_type string, left_brk long, size long, ids array<long>")
    return sets.select("cluster_id", "chrom", "sv_type", "left_brk", "size", F.explode("ids").alias("ev_id"))


def _batch(chrom: str, kind: str, found: list[tuple]) -> pa.RecordBatch:
    """Sets (cluster_id, left_brk, size, members) as rows."""
    names, places, sizes, members = zip(*found) if found else ((), (), (), (np.zeros(0, np.int64),))
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(members), pa.int64()))
    n = len(found)
    columns = [pa.array(names, pa.string()), pa.array([chrom] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), lists]
    return pa.RecordBatch.from_arrays(columns, ["cluster_id", "chrom", "sv_type", "left_brk", "size", "ids"])


def regions(rows: DataFrame, least: int) -> DataFrame:
    """Clusters of insertion regions: maximal sets of reads whose reaches share a place, with more than `least` of either
    strand. rows: see region_shapes; sv_type is the one of the forward reads, so that reverse reads of the complementary
    type meet them."""
    return cluster(region_shapes(rows), of_each=least)


def clonal_dedup(members: DataFrame) -> DataFrame:
    """One mapping for each read name in a cluster, and one row for each (l_end, r_start, edit): PCR copies count once."""
    by_name = Window.partitionBy("cluster_id", "read_name").orderBy("edit", "l_end", "r_start", "ev_id")
    once = members.withColumn("_k", F.row_number().over(by_name)).where("_k = 1").drop("_k")
    # Split reads of one breakpoint have their inner ends in common: their outer ones tell copies (bp_l is theirs alone).
    outer = [F.when(F.col("bp_l").isNotNull(), F.col(c)) for c in ("l_start", "r_end")] if "bp_l" in members.columns else []
    by_place = Window.partitionBy("cluster_id", "l_end", "r_start", "edit", *outer).orderBy("read_name", "ev_id")
    return once.withColumn("_k", F.row_number().over(by_place)).where("_k = 1").drop("_k")


def read_cluster_cap(members: DataFrame, most: int = READ_CLUSTERS) -> DataFrame:
    """A row of evidence stays in its first `most` clusters, by left breakpoint and cluster."""
    order = Window.partitionBy("ev_id").orderBy("left_brk", "cluster_id")
    return members.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def maximal_sets(members: DataFrame) -> DataFrame:
    """Clusters whose members are not all in a larger cluster, nor in an equal one of lower id. Pairs of clusters meet
    by the members that they share, so clusters without a common member never do."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    sized = members.join(sizes, "cluster_id")
    other = sized.select("ev_id", F.col("cluster_id").alias("other"), F.col("n").alias("other_n"))
    common = sized.join(other, "ev_id").where("other <> cluster_id and other_n >= n").groupBy("cluster_id", "n", "other", "other_n").agg(F.count("*").alias("common"))
    covered = common.where("common = n and (other_n > n or other < cluster_id)").select("cluster_id").distinct()
    return sizes.join(covered, "cluster_id", "left_anti")


def cluster_prune(summaries: DataFrame) -> DataFrame:
    cap = F.create_map(*[F.lit(x) for kv in CLUSTER_SPAN_CAPS.items() for x in kv])[F.col("sv_type")]
    return summaries.where(F.coalesce(F.col("outer_end") - F.col("outer_start") <= cap, F.lit(True)))


def pairing(sides: DataFrame, first: str, second: str) -> DataFrame:
    """Clusters of the two orientations on one chromosome with one left breakpoint."""
    a = sides.where(F.col("orient") == first).select("chrom", "left_brk", F.col("cluster_id").alias("first_id"), F.col("n").alias("first_n"))
    b = sides.where(F.col("orient") == second).select("chrom", "left_brk", F.col("cluster_id").alias("second_id"), F.col("n").alias("second_n"))
    return a.join(b, ["chrom", "left_brk"])


def region_pairing(regions: DataFrame, least: int) -> DataFrame:
    """Support by strand of places with reads of complementary types t and t xor 1. regions: chrom, place, type, or."""
    kind = F.col("type").bitwiseXOR(F.when(F.col("or") == "R", 1).otherwise(0))
    counts = regions.groupBy("chrom", "place", kind.alias("type")).agg(F.count_if(F.col("or") == "F").alias("forward"), F.count_if(F.col("or") == "R").alias("back"))
    return counts.where((F.col("forward") > least) & (F.col("back") > least))
