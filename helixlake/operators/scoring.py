"""Cluster summaries, support, likelihoods, conflicts, selection and refinement."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.constants import GC_WINDOW, INFINITE_SCORE, ZERO_RATE_DEPTH, ZERO_RATE_PAIRS, Params
from helixlake.functions.likelihood import erf, log_poisson
from helixlake.operators import composition
from helixlake.operators.depth import expected_depth, observed_depth
from helixlake.operators.ranges import islands, overlap_join

P = Params()


DUPLICATIONS = ["INVDUP_LEFT", "INVDUP_RIGHT", "INTERDUP_LEFT", "INTERDUP_RIGHT"]
REGIONS = ["MEI_F", "MEI_R", "NUMT_F", "NUMT_R"]


def cluster_bounds(members: DataFrame) -> DataFrame:
    """Inner and outer ends of each cluster. Members of insertion regions bound the side that their strand points from;
    those of duplications reach a hundred bases further on one side."""
    forward = F.col("l_or") == "F"
    start, end = F.col("l_end"), F.col("r_start")
    dup, region = F.col("sv_type").isin(*DUPLICATIONS), F.col("sv_type").isin(*REGIONS)
    floor = lambda c: F.greatest(F.lit(0), c)
    places = {
        "inner_start": (F.max, F.when(region, F.when(forward, start)).when(dup & ~forward, start + 100).otherwise(start)),
        "outer_start": (F.min, F.when(region, F.when(forward, start)).when(dup & forward, floor(start - 100)).otherwise(start)),
        "inner_end": (F.min, F.when(region, F.when(~forward, start)).when(dup & forward, floor(end - 100)).otherwise(end)),
        "outer_end": (F.max, F.when(region, F.when(~forward, start)).when(dup & ~forward, end + 100).otherwise(end)),
    }
    return members.groupBy("cluster_id", "chrom", "sv_type").agg(*[take(place).alias(name) for name, (take, place) in places.items()])


def cluster_support(members: DataFrame) -> DataFrame:
    """Reads of each sample: all of them, and the split ones among them."""
    return members.groupBy("cluster_id", "sample").agg(F.count("*").alias("rp"), F.count_if(F.col("library") == "SplitRead").alias("sr"))


def cluster_edit_avg(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id", "sample").agg(F.round(F.avg("edit"), 6).alias("avg_edit"))


def barcode_homogeneity(members: DataFrame) -> DataFrame:
    """Sum of squared barcode counts over the squared sum, without missing barcodes; 1 where all are missing."""
    counts = members.groupBy("cluster_id", "barcode").agg(F.count(F.col("barcode")).alias("n"))
    total = F.sum("n")
    score = F.when(total == 0, 1.0).otherwise(F.sum(F.col("n") * F.col("n")) / (total * total))
    return counts.groupBy("cluster_id").agg(F.round(score, 6).alias("homogeneity"))


def deletion_length_bounds(members: DataFrame) -> DataFrame:
    span = F.col("r_start") - F.col("l_end")
    return members.where("sv_type = 'DEL'").groupBy("cluster_id").agg(F.min(span - F.col("max_delta")).alias("min_len"), F.min(span - F.col("min_delta")).alias("max_len"))


def score_region(bounds: DataFrame) -> DataFrame:
    """Where the depth of a call is taken, [start_pos, end_pos), and the breakpoint of its expected pairs."""
    kind, i_s, o_s, i_e, o_e = (F.col(c) for c in ("sv_type", "inner_start", "outer_start", "inner_end", "outer_end"))
    left, right = kind.endswith("_LEFT"), kind.endswith("_RIGHT")
    start = F.when(kind.isin("DEL", "TDUP"), i_s).when((kind == "INV") | right, o_s).when(left, i_e).otherwise(0)
    end = F.when(kind.isin("DEL", "TDUP"), i_e).when((kind == "INV") | right, i_s).when(left, o_e).otherwise(0)
    place = F.when((kind == "TDUP") | right | kind.isin("MEI_R", "NUMT_R"), o_e).otherwise(o_s)
    return bounds.select("cluster_id", "chrom", "sv_type", start.alias("start_pos"), end.alias("end_pos"), place.alias("breakpoint"))


def call_spans(bounds: DataFrame) -> DataFrame:
    """What calls take up when they are held against each other: their inner ends."""
    return bounds.select("cluster_id", "chrom", "sv_type", F.col("inner_start").alias("start_pos"), F.col("inner_end").alias("end_pos"))


def long_inserts(band: DataFrame, read_length: int = P.read_length) -> DataFrame:
    """For each library, how many pairs a base's depth of one gives that span a breakpoint: the chances of fragments
    longer than each length from a read to the upper end of the band, added up."""
    lengths = band.select("library", "mean", "std", F.explode(F.sequence(F.lit(read_length), F.greatest(F.lit(read_length), F.col("conc_max")))).alias("i"), "conc_max").where("i <= conc_max")
    tail = 1 - 0.5 * (1 + erf((F.col("i") - F.col("mean")) / (F.col("std") * math.sqrt(2))))
    return lengths.groupBy("library").agg(F.sum(tail).alias("spanning"))


def score_inputs(
    bounds: DataFrame, members: DataFrame, depth: DataFrame, profile: DataFrame, windows: DataFrame | None, band: DataFrame, libraries: DataFrame, track: DataFrame | None = None, width: int = 1000
) -> DataFrame:
    """For every call and sample: observed and expected depth (od, ed), pairs of all samples together (op), and expected
    pairs (ep) by the sample's first library. libraries: sample, library. With a track (`composition.base_gc`, over pages of
    `width` bases) a base goes by its own window's GC, else by that of its grid window."""
    region = score_region(bounds)
    spans = region.select(F.col("cluster_id").alias("span_id"), "chrom", "start_pos", "end_pos").where("start_pos < end_pos")
    od = observed_depth(spans, depth).withColumnsRenamed({"span_id": "cluster_id", "observed_rd": "od"})
    ed = expected_depth(spans, profile, windows) if track is None else composition.expected_depth(spans, profile, track, width)
    ed = ed.withColumnsRenamed({"span_id": "cluster_id", "expected_rd": "ed"})
    first = libraries.groupBy("sample").agg(F.min("library").alias("library")).join(long_inserts(band), "library").select("sample", "spanning")  # a row for each sample
    if track is None:
        at = region.select("cluster_id", "chrom", (F.floor(F.col("breakpoint") / GC_WINDOW) * GC_WINDOW).alias("start_pos"))
        rates = at.join(windows, ["chrom", "start_pos"]).join(profile, ["chrom", "gc"])
    else:
        rates = composition.rate_at(region.select("cluster_id", "chrom", "breakpoint"), profile, track, width)
    rates = rates.select("cluster_id", "sample", "mean_rd")
    op = members.groupBy("cluster_id").agg(F.count("*").alias("op"))
    rows = region.select("cluster_id", "sv_type").join(op, "cluster_id").crossJoin(F.broadcast(first))
    keys = ["cluster_id", "sample"]
    rows = rows.join(od, keys, "left").join(ed, keys, "left").join(rates, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(*keys, "sv_type", "op", zero(F.col("spanning") * F.col("mean_rd")).cast("double").alias("ep"), zero(F.col("od")).cast("long").alias("od"), zero(F.col("ed")).cast("double").alias("ed"))


def genotype_likelihood(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Score and genotype from observed and expected depth (od, ed) and pairs (op, ep). With `whole` the likelihoods are
    cut to whole numbers before they are compared."""
    depth = lambda factor: log_poisson(F.col("od"), F.col("ed") * factor, ZERO_RATE_DEPTH)
    pairs = lambda factor: log_poisson(F.col("op"), F.col("ep") * factor, ZERO_RATE_PAIRS)
    loss, gain = F.col("sv_type") == "DEL", F.col("sv_type").isin("TDUP", *DUPLICATIONS)
    if "element" in rows.columns:  # deletions of a mobile element go by their pairs alone
        loss = loss & F.col("element").isNull()

    def total(of_loss: float, of_gain: float, of_pairs: float) -> Column:
        return F.when(loss, depth(of_loss)).when(gain, depth(of_gain)).otherwise(0.0) + pairs(of_pairs)

    homo, hete, none = total(0.0, 2.0, 1.0), total(0.5, 1.5, 0.5), total(1.0, 1.0, 0.0)
    if whole:
        homo, hete = homo.cast("int"), hete.cast("int")
    rows = rows.withColumn("_homo", homo).withColumn("_hete", hete).withColumn("_none", none)
    ratio = F.greatest("_homo", "_hete") / F.col("_none") / F.col("op")
    return rows.select(
        "cluster_id", "sample", "sv_type", F.when(F.col("op") == 0, INFINITE_SCORE).otherwise(ratio).alias("score"),
        F.when(F.col("op") == 0, 0).when(F.col("_homo") > F.col("_hete"), 3).otherwise(1).alias("zygosity"),
    )


def mei_deletions(calls: DataFrame, elements: DataFrame) -> DataFrame:
    """Deletions of about the length of a mobile element that they overlap."""
    spans = calls.where("sv_type = 'DEL'").select("cluster_id", "chrom", "start_pos", "end_pos", (F.col("start_pos") - 20).alias("_s"), (F.col("end_pos") + 20).alias("_e"))
    found = overlap_join(spans, elements, ("_s", "_e"), ("start_pos", "end_pos"))
    length, own = F.col("r_end_pos") - F.col("r_start_pos"), F.col("end_pos") - F.col("start_pos")
    return found.where((F.abs(own + 1) > 0.8 * length) & (F.abs(own + 1) < 1.2 * length)).groupBy("cluster_id").agg(F.min("r_repeat_class").alias("element"))


def cluster_weight(support: DataFrame, scores: DataFrame, least: int = P.support) -> DataFrame:
    """The score in the first of all samples for clusters with enough reads in some sample, else the infinite one."""
    enough = support.groupBy("cluster_id").agg((F.max("rp") >= least).alias("enough"))
    first = scores.groupBy("cluster_id").agg(F.min_by("score", "sample").alias("score"))
    return enough.join(first, "cluster_id").select("cluster_id", F.when(F.col("enough"), F.col("score")).otherwise(INFINITE_SCORE).alias("weight"))


def top_scores(weights: DataFrame, n: int = 100) -> DataFrame:
    return weights.orderBy("weight", "cluster_id").limit(n)


def conflicts(calls: DataFrame, width: int = 20_000) -> DataFrame:
    """Pairs of calls that can't both be on one chromosome copy: they overlap, neither is a mobile element, not one
    inversion within another, nor a deletion strictly within an inversion."""
    found = overlap_join(calls, calls, ("start_pos", "end_pos"), ("start_pos", "end_pos"), width).where("cluster_id < r_cluster_id")
    nested = "((start_pos > r_start_pos and end_pos < r_end_pos) or (r_start_pos > start_pos and r_end_pos < end_pos))"
    within = "((sv_type = 'DEL' and r_sv_type = 'INV' and start_pos > r_start_pos and end_pos < r_end_pos) or (r_sv_type = 'DEL' and sv_type = 'INV' and r_start_pos > start_pos and r_end_pos < end_pos))"
    allowed = f"sv_type like 'MEI%' or r_sv_type like 'MEI%' or (sv_type = 'INV' and r_sv_type = 'INV' and {nested}) or {within}"
    return found.where(f"not ({allowed})").select(F.col("cluster_id").alias("a"), F.col("r_cluster_id").alias("b"))


def conflict_triples(pairs: DataFrame) -> DataFrame:
    """Triangles: three calls that conflict with each other, lowest id first."""
    ab, bc, ac = pairs.toDF("a", "b"), pairs.toDF("b", "c"), pairs.toDF("a", "c")
    return ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c")


def breakpoint_votes(members: DataFrame) -> DataFrame:
    """For each split read of a cluster, how many of its other split reads have a breakpoint in common with it, and how
    many have none. Reads are counted by breakpoint first, so a cluster's reads never meet pairwise."""
    split = members.where("library = 'SplitRead'").select("cluster_id", "ev_id", "l_end", "r_start")
    places = split.groupBy("cluster_id", "l_end", "r_start").agg(F.count("*").alias("n"))
    left = split.groupBy("cluster_id", "l_end").agg(F.count("*").alias("same_left"))
    right = split.groupBy("cluster_id", "r_start").agg(F.count("*").alias("same_right"))
    total = split.groupBy("cluster_id").agg(F.count("*").alias("total"))
    joined = split.join(places, ["cluster_id", "l_end", "r_start"]).join(left, ["cluster_id", "l_end"]).join(right, ["cluster_id", "r_start"]).join(total, "cluster_id")
    same = F.col("same_left") + F.col("same_right") - F.col("n") - 1
    return joined.select("cluster_id", "ev_id", "l_end", "r_start", same.alias("same"), (F.col("total") - 1 - same).alias("different"))


def refine(votes: DataFrame, support: DataFrame, kinds: DataFrame, least: int = P.support) -> DataFrame:
    """The coordinates of the last split read with which no fewer agree than disagree, in clusters above the least number
    of reads with more than three split ones, of a type that is refined. kinds: cluster_id, sv_type."""
    enough = support.groupBy("cluster_id").agg(F.sum("rp").alias("rp"), F.sum("sr").alias("sr")).where((F.col("rp") > least) & (F.col("sr") > 3)).select("cluster_id")
    refined = kinds.where(F.col("sv_type").isin("DEL", "TDUP", "INV", "MEI_F", "MEI_R")).select("cluster_id")
    kept = votes.where("same >= different").join(enough, "cluster_id").join(refined, "cluster_id")
    return kept.groupBy("cluster_id").agg(F.max_by(F.struct("l_end", "r_start"), "ev_id").alias("p")).select("cluster_id", "p.l_end", "p.r_start")


def mei_call_filter(calls: DataFrame, elements: DataFrame, satellites: DataFrame) -> DataFrame:
    """Adds filter: mfilt for insertion calls of mobile elements (MEI_F, MEI_R) that lie on one of their own class on their strand,
    or on one of their own name at the start, the middle or the end on their strand (in the middle of a forward call: on
    the other one), or on a satellite at any of these. calls: cluster_id, chrom, sv_type, outer_start, outer_end, element (class),
    element_name. Each call asks for four places; elements without repeat_type go by their class."""
    s, e = F.col("outer_start"), F.col("outer_end")
    middle = F.floor((s + e) / 2).cast("int")
    place = lambda name, a, b: F.struct(F.lit(name).alias("place"), a.cast("int").alias("s"), b.cast("int").alias("e"))
    places = F.array(place("all", s - 1, e), place("start", s, s + 1), place("middle", middle, middle + 1), place("end", e - 1, e))
    asked = calls.select("cluster_id", "chrom", "sv_type", "element", "element_name", F.explode(places).alias("_p")).select("cluster_id", "chrom", "sv_type", "element", "element_name", "_p.place", "_p.s", "_p.e")
    kind = F.col("repeat_type") if "repeat_type" in elements.columns else F.col("repeat_class")
    spans = elements.select("chrom", "start_pos", "end_pos", "strand", "repeat_class", kind.alias("repeat_type"), F.lit(False).alias("satellite"))
    spans = spans.unionByName(satellites.select("chrom", "start_pos", "end_pos", F.lit("").alias("strand"), F.lit("").alias("repeat_class"), F.lit("").alias("repeat_type"), F.lit(True).alias("satellite")))
    found = overlap_join(asked, spans, ("s", "e"), ("start_pos", "end_pos"))
    strand = F.when(F.col("sv_type") == "MEI_F", "+").otherwise("-")
    turned = (F.col("place") == "middle") & (F.col("sv_type") == "MEI_F")
    own = F.when(F.col("place") == "all", F.col("r_repeat_class") == F.col("element")).otherwise(F.col("r_repeat_type") == F.col("element_name"))
    hit = F.col("r_satellite") | (own & F.when(turned, F.col("r_strand") != strand).otherwise(F.col("r_strand") == strand))
    bad = found.where(hit).select("cluster_id").distinct().withColumn("filter", F.lit("mfilt"))
    return calls.join(bad, "cluster_id", "left").withColumn("filter", F.coalesce("filter", F.lit("PASS")))


def report_filter(support: DataFrame, least: int = P.support) -> DataFrame:
    sums = support.groupBy("cluster_id").agg(F.sum("rp").alias("rp"), F.sum("sr").alias("sr"))
    return sums.where(F.col("rp") > least).withColumn("refined", F.col("sr") > 3)


def clash(a: tuple, b: tuple) -> bool:
    """Whether two calls (sv_type, start, end) can't both be on one chromosome copy: see conflicts."""
    if a[1] > b[2] or a[2] < b[1] or "MEI" in (a[0][:3], b[0][:3]):
        return False
    kinds, inside, around = (a[0], b[0]), a[1] > b[1] and a[2] < b[2], a[1] < b[1] and a[2] > b[2]
    if kinds == ("INV", "INV"):
        return not (inside or around)
    return not (kinds == ("INV", "DEL") and around or kinds == ("DEL", "INV") and inside)


def pair_score(kind: str, element: bool, op: int, ep: float, od: float, ed: float) -> float:
    """The score of genotype_likelihood, for one call."""
    if not op:
        return INFINITE_SCORE

    def poisson(n: float, rate: float, penalty: float) -> float:
        rate = rate if rate > 0 else penalty
        return n * math.log(rate) - rate - math.lgamma(n + 1)

    factors = {"DEL": (0.0, 0.5)}.get(kind, (2.0, 1.5)) if kind == "TDUP" or kind in DUPLICATIONS or kind == "DEL" and not element else None
    by_depth = [poisson(od, f * ed, ZERO_RATE_DEPTH) for f in (*factors, 1.0)] if factors else [0.0] * 3
    homo, hete, none = (d + poisson(op, f * ep, ZERO_RATE_PAIRS) for d, f in zip(by_depth, (1.0, 0.5, 0.0)))
    return max(homo, hete) / none / op


@dataclass
class Candidate:
    """A call that may be picked: its type and inner ends, its reads by sample, and its score for so many reads."""

    kind: str
    start: int
    end: int
    reads: dict[str, set[str]]
    score: Callable[[int], float]


def greedy_cover(calls: dict[str, Candidate], least: int = P.support) -> list[tuple[str, float, dict[str, int]]]:
    """Greedy weighted set cover. A call's weight is its score for its reads that aren't covered yet, infinite unless some
    sample has `least` of them. The least weight is picked (ties by call), and covers its reads in the samples that have
    enough. A picked call clashes with another one if a sample supports both; a third call that clashes with both is
    barred from the samples that support the two, whose reads no longer count for it. Gives calls, weights and covered
    reads by sample, in the order of picks."""
    covered: set[str] = set()
    barred: dict[str, set[str]] = defaultdict(set)
    owners: dict[str, set[str]] = defaultdict(set)
    for c, call in calls.items():
        for own in call.reads.values():
            for x in own:
                owners[x].add(c)
    spans = {c: (call.kind, call.start, call.end) for c, call in calls.items()}
    picked: dict[str, dict[str, int]] = {}
    out = []

    def weight(c: str) -> tuple[float, dict[str, set[str]]]:
        left = {s: own - covered for s, own in calls[c].reads.items()}
        enough = {s: own for s, own in left.items() if s not in barred[c] and len(own) >= least}
        return (calls[c].score(sum(map(len, left.values()))) if enough else INFINITE_SCORE), enough

    now = {c: weight(c)[0] for c in calls}
    heap = [(w, c) for c, w in now.items() if w < INFINITE_SCORE]
    heapq.heapify(heap)
    while heap:
        w, c = heapq.heappop(heap)
        if w != now[c] or c in picked:
            continue
        enough = weight(c)[1]
        picked[c] = {s: len(own) for s, own in enough.items()}
        out.append((c, w, picked[c]))
        touched = set()
        for own in enough.values():
            covered |= own
            for x in own:
                touched |= owners[x]
        for other, support in picked.items():
            both = support.keys() & picked[c].keys()
            if other != c and both and clash(spans[c], spans[other]):
                for k in calls:
                    if k not in picked and clash(spans[k], spans[c]) and clash(spans[k], spans[other]):
                        barred[k] |= both
                        touched.add(k)
        for k in touched - picked.keys():
            if (again := weight(k)[0]) != now[k]:
                now[k] = again
                if again < INFINITE_SCORE:
                    heapq.heappush(heap, (again, k))
    return out


def set_cover(bounds: DataFrame, members: DataFrame, inputs: DataFrame, elements: DataFrame, least: int = P.support) -> DataFrame:
    """Greedy cover, apart in each island of overlapping calls: calls that share reads or clash overlap, so islands don't
    depend on each other. Gives cluster_id, chrom, pick (within its island), weight, op (its reads when picked), and
    sample, rp, sr of what it covers.
    inputs: see score_inputs; the first sample's count."""
    ends = [F.col(c) for c in ("inner_start", "outer_start", "inner_end", "outer_end")]
    spans = bounds.withColumn("_start", F.least(*ends).cast("long")).withColumn("_stop", F.greatest(*ends).cast("long") + 1)
    spans = islands(spans, ["chrom"], "_start", "_stop")
    reads = members.groupBy("cluster_id", "sample").agg(F.collect_set("read_name").alias("reads"), F.collect_set(F.when(F.col("library") == "SplitRead", F.col("read_name"))).alias("split"))
    reads = reads.groupBy("cluster_id").agg(F.collect_list(F.struct("sample", "reads", "split")).alias("by_sample"))
    first = inputs.join(F.broadcast(inputs.agg(F.min("sample").alias("sample"))), "sample").select("cluster_id", "ep", "od", "ed")
    found = mei_deletions(call_spans(bounds), elements)
    rows = spans.join(reads, "cluster_id").join(first, "cluster_id").join(found, "cluster_id", "left")
    rows = rows.select("chrom", "island", "cluster_id", "sv_type", "inner_start", "inner_end", "by_sample", "ep", "od", "ed", F.col("element").isNotNull().alias("element"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        calls, split = {}, {}
        for r in frame.itertuples():
            score = lambda op, r=r: pair_score(r.sv_type, r.element, op, r.ep, r.od, r.ed)
            calls[r.cluster_id] = Candidate(r.sv_type, r.inner_start, r.inner_end, {x["sample"]: set(x["reads"]) for x in r.by_sample}, score)
            split[r.cluster_id] = {x["sample"]: set(x["split"]) for x in r.by_sample}
        out, covered = [], set()
        for k, (c, w, support) in enumerate(greedy_cover(calls, least)):
            op = sum(len(own - covered) for own in calls[c].reads.values())
            for s, n in sorted(support.items()):
                own = calls[c].reads[s] - covered
                out.append((frame["chrom"].iloc[0], c, k, w, op, s, n, len(own & split[c][s])))
                covered |= own
        return pd.DataFrame(out, columns=["chrom", "cluster_id", "pick", "weight", "op", "sample", "rp", "sr"])

    return rows.groupBy("chrom", "island").applyInPandas(run, "chrom string, cluster_id string, pick int, weight double, op long, sample string, rp long, sr long")
