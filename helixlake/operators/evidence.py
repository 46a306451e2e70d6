"""Alternative mappings, soft clips, split reads and the evidence table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.constants import CLIP_WINDOW, KMER, KMER_CAP, MAX_CIGAR_OPS, MAX_HITS, MIN_SOFT_CLIP, MISMATCH_SHARE, SEED_BAND, SPAN_CAPS, SPLIT_MAX_DELTA, Params
from helixlake.functions.sequence import cigar_ops, hamming, kmer_valid, kmers, reverse_complement
from helixlake.operators.ranges import free_name, overlap_filter
from helixlake.operators.reads import with_length
from helixlake.stored import store

P = Params()


def xa_entries(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Entries chr,(+/-)pos,cigar,nm; of the xa column. Positions become 0-based."""
    one = rows.select(*keep, F.explode(F.filter(F.split("xa", ";"), lambda x: x != "")).alias("entry"))
    part = F.split("entry", ",")
    return one.select(
        *keep, part[0].alias("alt_chrom"), (F.abs(part[1].cast("int")) - 1).alias("alt_pos"), F.when(F.substring(part[1], 1, 1) == "-", "R").otherwise("F").alias("alt_or"),
        part[2].alias("alt_cigar"), part[3].cast("int").alias("alt_nm"),
    )


def alternatives(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left and right mappings of a name on one chromosome, the left one first. Each side: read_name, chrom, pos, or, nm."""
    r = right.select("read_name", "chrom", F.col("pos").alias("r_pos"), F.col("or").alias("r_or"), F.col("nm").alias("r_nm"))
    both = left.select("read_name", "chrom", F.col("pos").alias("l_pos"), F.col("or").alias("l_or"), F.col("nm").alias("l_nm")).join(r, ["read_name", "chrom"])
    return both.where("l_pos < r_pos").select("read_name", "chrom", "l_pos", "l_or", "r_pos", "r_or", (F.col("l_nm") + F.col("r_nm")).alias("edit"))


def classify_alternatives(rows: DataFrame, band: DataFrame) -> DataFrame:
    """Adds class by strands and by the library's band of insert sizes; libraries without a band go. Needs l_or, r_or, library
    and insert_size."""
    sized = rows.join(F.broadcast(band.select("library", "conc_min", "conc_max")), "library")  # a row for each library
    found = "case when l_or = r_or then 'INV' when l_or = 'R' then 'TDUP' when insert_size < conc_min then 'INS' when insert_size > conc_max then 'DEL' else 'CONC' end"
    return sized.withColumn("class", F.expr(found)).drop("conc_min", "conc_max")


def softclip_candidates(reads: DataFrame) -> DataFrame:
    """At most two CIGAR operations, the first or last a soft clip above the least length. Adds the clip's side and length."""
    ops = reads.withColumn("_ops", cigar_ops(F.col("cigar")))
    clip = lambda at: (F.element_at("_ops", at)["op"] == "S") & (F.element_at("_ops", at)["len"] > MIN_SOFT_CLIP)
    kept = ops.where((F.size("_ops") > 0) & (F.size("_ops") < MAX_CIGAR_OPS)).withColumn("_head", clip(1)).withColumn("_tail", clip(-1)).where("_head or _tail")
    length = F.when(F.col("_head"), F.element_at("_ops", 1)["len"]).otherwise(F.element_at("_ops", -1)["len"])
    return kept.withColumn("clip_side", F.when(F.col("_head"), "HEAD").otherwise("TAIL")).withColumn("clip_len", length).drop("_ops", "_head", "_tail")


def clip_quality() -> Column:
    """Mean base quality of the clipped part, rounded down. Needs quals, clip_side and clip_len."""
    part = F.when(F.col("clip_side") == "HEAD", F.slice("quals", F.lit(1), F.col("clip_len"))).otherwise(F.slice("quals", -F.col("clip_len"), F.col("clip_len")))
    return F.floor(F.aggregate(part, F.lit(0), lambda s, q: s + q) / F.col("clip_len")).cast("int")


def softclip_quality(clips: DataFrame) -> DataFrame:
    return clips.select(F.concat("read_name", F.lit("_Split")).alias("read_name"), "clip_side", "clip_len", clip_quality().alias("avg_phred"))


def softclip_histogram(clips: DataFrame, least_quality: int = P.mapq, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    return clips.where(F.col("mapq") > least_quality).groupBy(*by, "brk").agg(F.count("*").alias("n"))


def softclip_neighbours(histogram: DataFrame, tile: int = 10_000, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Clips in [brk - 10, brk + 10) of each breakpoint. Positions near a tile's edge are counted in both tiles, so a
    window holds a tile, not a chromosome."""
    half = CLIP_WINDOW // 2
    own = F.floor(F.col("brk") / tile)
    tiles = F.array_distinct(F.array(own, F.floor((F.col("brk") - half) / tile), F.floor((F.col("brk") + half) / tile)))
    dealt = histogram.withColumn("_own", own).withColumn("_tile", F.explode(tiles))
    near = F.sum("n").over(Window.partitionBy(*by, "_tile").orderBy("brk").rangeBetween(-half, half - 1))
    return dealt.withColumn("neighbours", near).where("_own = _tile").select(*by, "brk", "n", "neighbours")


def kmer_counts(sequences: DataFrame) -> DataFrame:
    """Counts of the valid k-mers; those at the cap or above go, which also bounds each seed's matches."""
    found = sequences.select(F.explode(kmers(F.col("seq"))).alias("k")).select("k.kmer").where(kmer_valid(F.col("kmer")))
    return found.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") < KMER_CAP)


def seed_join(clips: DataFrame, reference: DataFrame) -> DataFrame:
    """Places of each clip's first k-mer, and of its reverse complement's, in its chromosome within the band. K-mers at the
    cap or above have no places. clips: clip_id, chrom, pos, seq; reference: chrom, kmer, at. Adds hit_or and probe, the
    sequence that lies at the place."""
    counts = reference.groupBy("chrom", "kmer").agg(F.count("*").alias("_n")).where(F.col("_n") >= KMER_CAP).select("chrom", "kmer")
    ways = F.array(F.struct(F.lit("F").alias("hit_or"), F.col("seq").alias("probe")), F.struct(F.lit("R").alias("hit_or"), reverse_complement(F.col("seq")).alias("probe")))
    seeds = clips.withColumn("_w", F.explode(ways)).select(*clips.columns, "_w.hit_or", "_w.probe").withColumn("kmer", F.substring("probe", 1, KMER)).where(kmer_valid(F.col("kmer")))
    # At most a row for each KMER_CAP k-mers of the reference.
    rare = reference.join(F.broadcast(counts), ["chrom", "kmer"], "left_anti").withColumn("_bin", F.floor(F.col("at") / SEED_BAND))
    # What lies within the band lies in the clip's own bin of that width or in one beside it.
    home = F.floor(F.col("pos") / SEED_BAND)
    seeds = seeds.withColumn("_bin", F.explode(F.array(home - 1, home, home + 1)))
    # K-mers are far more bytes than the texts they come from, by which Spark would plan to broadcast them.
    return seeds.hint("merge").join(rare.hint("merge"), ["chrom", "kmer", "_bin"]).where(F.abs(F.col("at") - F.col("pos")) < SEED_BAND).drop("_bin")


def extended_pages(pages: DataFrame, more: int, width: int = 1000) -> DataFrame:
    """Pages (chrom, start_pos, seq) with the first `more` bases of the page after each, at most `width`."""
    after = pages.select("chrom", (F.col("start_pos") - width).alias("start_pos"), F.substring("seq", 1, more).alias("_more"))
    return pages.join(after, ["chrom", "start_pos"], "left").select("chrom", "start_pos", "seq", F.concat("seq", F.coalesce("_more", F.lit(""))).alias("long_seq"))


def reference_kmers(pages: DataFrame, width: int = 1000) -> DataFrame:
    """chrom, kmer, at: every k-mer of the reference, those over page ends too."""
    found = extended_pages(pages, KMER - 1, width).select("chrom", "start_pos", F.explode(kmers(F.col("long_seq"))).alias("k"))
    return found.where(kmer_valid(F.col("k.kmer"))).select("chrom", "k.kmer", (F.col("start_pos") + F.col("k.at")).alias("at"))


def with_reference(seeded: DataFrame, pages: DataFrame, longest: int, width: int = 1000) -> DataFrame:
    """Adds ref_seq, the bases at each place; clips have `longest` bases at most."""
    own = extended_pages(pages, longest, width).select("chrom", F.col("start_pos").alias("_page"), "long_seq")
    paged = seeded.withColumn("_page", F.floor(F.col("at") / width) * width).join(own, ["chrom", "_page"])
    return paged.withColumn("ref_seq", F.expr("substring(long_seq, cast(at - _page + 1 as int), length(seq))")).drop("long_seq", "_page")


def verify(seeded: DataFrame) -> DataFrame:
    """Seeds whose whole clip differs from the reference in at most five in a hundred bases."""
    distance = hamming(F.col("probe"), F.col("ref_seq"))
    kept = seeded.where(F.length("seq") == F.length("ref_seq")).withColumn("mismatches", distance)
    return kept.where(F.col("mismatches") <= F.floor(F.length("seq") * MISMATCH_SHARE))


def hit_cap(hits: DataFrame) -> DataFrame:
    """Clips with fewer than MAX_HITS hits on both strands together keep them, with a mapping quality of sixty shared among them."""
    counts = hits.groupBy("clip_id").agg(F.count("*").alias("hits")).where(F.col("hits") < MAX_HITS)
    return hits.hint("merge").join(counts, "clip_id").withColumn("hit_mapq", F.floor(60 / F.col("hits")).cast("int"))


SPLIT_CLASS = """case
  when hit_or = 'F' and (clip_side = 'TAIL' and pos < hit_pos or clip_side = 'HEAD' and hit_pos < pos) then 'FFAB'
  when hit_or = 'F' and (clip_side = 'TAIL' and hit_pos < pos or clip_side = 'HEAD' and pos < hit_pos) then 'FFBA'
  when hit_or = 'R' and clip_side = 'TAIL' and pos < hit_pos then 'FRAB' when hit_or = 'R' and clip_side = 'HEAD' and hit_pos < pos then 'RFAB'
  when hit_or = 'R' and clip_side = 'TAIL' and hit_pos < pos then 'RFBA' when hit_or = 'R' and clip_side = 'HEAD' and pos < hit_pos then 'FRBA' end"""


def split_accept(hits: DataFrame, satellites: DataFrame, p: Params = P, lengths: DataFrame | None = None) -> DataFrame:
    """Hits of split reads with both qualities, both places inside the chromosome, no satellite at either, and one part
    wholly before the other. Adds l_start, l_end, r_start, r_end. Needs qual, hit_mapq, pos, hit_pos, clip_len."""
    rows = with_length(hits.where((F.col("qual") > p.mapq) & (F.col("hit_mapq") > 0) & (F.least("pos", "hit_pos") > 0)), lengths, p)
    rows = rows.where(F.greatest("pos", "hit_pos") < F.col("_length")).drop("_length")
    first = F.col("pos") < F.col("hit_pos")
    kept, clipped = p.read_length - F.col("clip_len"), F.col("clip_len")
    rows = rows.withColumn("l_start", F.least("pos", "hit_pos")).withColumn("r_start", F.greatest("pos", "hit_pos"))
    rows = rows.withColumn("l_end", F.col("l_start") + F.when(first, kept).otherwise(clipped)).withColumn("r_end", F.col("r_start") + F.when(first, clipped).otherwise(kept))
    rows = rows.where("l_end < r_start and pos <> hit_pos")
    for at in ("pos", "hit_pos"):
        end = free_name(rows.columns, f"{at}_end")
        rows = overlap_filter(rows.withColumn(end, F.col(at) + 1), satellites, (at, end), ("start_pos", "end_pos"), anti=True).drop(end)
    return rows


def split_orientation(hits: DataFrame) -> DataFrame:
    """Class from the clip's side, the hit's strand and which comes first; hits at the read's own place have none."""
    return hits.withColumn("split_class", F.expr(SPLIT_CLASS)).where("split_class is not null")


def split_fanout(hits: DataFrame) -> DataFrame:
    """Evidence rows of a split read: two inversions and two inverted duplications for strand changes, else a deletion or
    a tandem duplication and an interspersed one."""
    row = lambda kind, orient, shift: F.struct(F.lit(kind).alias("sv_type"), F.lit(orient).alias("orient"), F.lit(shift).alias("shift"))
    turned = F.array(row("INV", "FF", -20), row("INV", "RR", 20), row("INVDUP", "FF", 20), row("INVDUP", "RR", 20))
    ahead, back = F.array(row("DEL", "FR", -20), row("INTERDUP", "FR", -20)), F.array(row("TDUP", "RF", 20), row("INTERDUP", "RF", 20))
    rows = F.when(F.col("split_class") == "FFAB", ahead).when(F.col("split_class") == "FFBA", back).otherwise(turned)
    return hits.withColumn("e", F.explode(rows)).select("clip_id", "split_class", "e.sv_type", "e.orient", (F.col("pos") + F.col("e.shift")).alias("start_pos"))


def split_evidence(hits: DataFrame, max_delta: int = SPLIT_MAX_DELTA) -> DataFrame:
    """Evidence rows of accepted hits with their class, in a window of their own: two inversions and two inverted
    duplications for strand changes, else a deletion or a tandem duplication and an interspersed one. Both parts are shifted
    together or apart, as their type wants, by what a clip's place may be wrong; bp_l and bp_r are the breakpoints unshifted.
    Needs clip_id and split_class besides what split_accept needs and adds; any other columns stay."""
    row = lambda kind, ends, left, right: F.struct(F.lit(kind).alias("sv_type"), F.lit(ends[0]).alias("l_or"), F.lit(ends[1]).alias("r_or"), F.lit(left).alias("left"), F.lit(right).alias("right"))
    w = CLIP_WINDOW
    turned = F.array(row("INV", "FF", -w, -w), row("INV", "RR", w, w), row("INVDUP", "FF", w, w), row("INVDUP", "RR", w, w))
    ahead, back = F.array(row("DEL", "FR", -w, w), row("INTERDUP", "FR", -w, w)), F.array(row("TDUP", "RF", -w, w), row("INTERDUP", "RF", -w, w))
    kind = F.col("split_class")
    rows = hits.withColumn("_e", F.explode(F.when(kind == "FFAB", ahead).when(kind == "FFBA", back).otherwise(turned)))
    # Without a strand change the inner ends or, of a duplication, the outer ones; else the sides on which the read was clipped.
    tail = F.col("clip_side") == "TAIL"
    bp_l = F.when((kind == "FFAB") | ((kind != "FFBA") & tail), F.col("l_end")).otherwise(F.col("l_start"))
    bp_r = F.when((kind == "FFBA") | ((kind != "FFAB") & tail), F.col("r_end")).otherwise(F.col("r_start"))
    rows = rows.withColumns({"bp_l": bp_l, "bp_r": bp_r, "sv_type": F.col("_e.sv_type"), "l_or": F.col("_e.l_or"), "r_or": F.col("_e.r_or")})
    rows = rows.withColumns({**{c: F.col(c) + F.col("_e.left") for c in ("l_start", "l_end")}, **{c: F.col(c) + F.col("_e.right") for c in ("r_start", "r_end")}})
    return rows.withColumns({"min_delta": F.lit(0), "max_delta": F.lit(max_delta), "library": F.lit("SplitRead")}).drop("_e")


def evidence_filter(pairs: DataFrame, satellites: DataFrame, gaps: DataFrame, p: Params = P, lengths: DataFrame | None = None) -> DataFrame:
    """Both mapping qualities above the threshold, strictly inside the chromosome, no satellite at an end, no gap between."""
    rows = with_length(pairs.where((F.col("mq1") > p.mapq) & (F.col("mq2") > p.mapq) & (F.col("l_start") > 0)), lengths, p)
    rows = rows.where(F.col("r_end") < F.col("_length")).drop("_length")
    rows = overlap_filter(rows, satellites, ("l_start", "l_end"), ("start_pos", "end_pos"), anti=True)
    rows = overlap_filter(rows, satellites, ("r_start", "r_end"), ("start_pos", "end_pos"), anti=True)
    return overlap_filter(rows, gaps, ("l_end", "r_start"), ("start_pos", "end_pos"), anti=True)


def evidence_union(pairs: DataFrame, alternative: DataFrame, split: DataFrame) -> DataFrame:
    """Evidence of all kinds, with its library: read pairs keep theirs."""
    columns = ["read_name", "chrom", "l_start", "r_start", "sv_type", "library"]
    named = lambda df, name: df.withColumn("library", F.lit(name)).select(*columns)
    return pairs.select(*columns).unionByName(named(alternative, "Alternative")).unionByName(named(split, "SplitRead"))


def evidence_fanout(evidence: DataFrame) -> DataFrame:
    """Inversions also stand for inverted duplications, the other pairs also for interspersed ones."""
    more = F.when(F.col("sv_type") == "INV", "INVDUP").when(F.col("sv_type").isin("DEL", "TDUP", "INS"), "INTERDUP")
    return evidence.withColumn("sv_type", F.explode(F.filter(F.array("sv_type", more), lambda x: x.isNotNull())))


def span_caps(evidence: DataFrame) -> DataFrame:
    cap = F.create_map(*[F.lit(x) for kv in SPAN_CAPS.items() for x in kv])[F.col("sv_type")]
    span = F.col("r_start") - F.col("l_start")
    return evidence.where(F.coalesce(span < cap, F.lit(True)) & ((F.col("sv_type") != "INS") | (F.col("r_start") > F.col("l_end"))))


def unique_reads(parts: list[DataFrame]) -> DataFrame:
    names = parts[0].select("read_name")
    for p in parts[1:]:
        names = names.unionByName(p.select("read_name"))
    return names.distinct()


def read_ids(names: DataFrame, ranges: int = 256) -> DataFrame:
    """Dense numbers from 0 in the order of names. Names are dealt to ranges of about equal size, whatever beginnings they
    share, and numbered within a range on top of the counts of the ranges before."""
    dealt = store(names.repartitionByRange(ranges, "read_name").withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("read_name")) - 1
    return dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_range").select("read_name", (F.col("_start") + F.col("_inside")).alias("read_id"))


def usable_clips(clips: DataFrame, least_quality: int = P.mapq) -> DataFrame:
    """Soft clips of good mean quality near whose breakpoint there are some others, but not very many. Needs avg_phred and
    neighbours."""
    return clips.where((F.col("avg_phred") > least_quality) & (F.col("neighbours") > 1) & (F.col("neighbours") < 100))


def read_name_stats(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("read_name").agg(F.count("*").alias("occurrences"), F.min("edit").alias("min_edit"), F.sum("phred").alias("sum_phred"))


def prune_normalise(evidence: DataFrame, least: float = 0.4, most: int = 100) -> DataFrame:
    """Each row's share of its read's phred; rows below the least share and reads with too many rows go."""
    totals = evidence.groupBy("library", "read_name").agg(F.sum("phred").alias("_total"), F.count("*").alias("_rows"))
    share = F.when(F.col("_total") == 0, 0.0).otherwise(F.col("phred") / F.col("_total"))
    return evidence.join(totals, ["library", "read_name"]).withColumn("share", share).where((F.col("share") >= least) & (F.col("_rows") <= most)).drop("_total", "_rows")


def normalise_ends(rows: DataFrame) -> DataFrame:
    """The end further left first."""
    swap: Column = F.col("l_start") > F.col("r_start")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    ends = [pick(a, b).alias(a) for a, b in (("l_start", "r_start"), ("l_end", "r_end"), ("l_or", "r_or"), ("r_start", "l_start"), ("r_end", "l_end"), ("r_or", "l_or"))]
    return rows.select(*[c for c in rows.columns if c not in ("l_start", "l_end", "l_or", "r_start", "r_end", "r_or")], *ends)
