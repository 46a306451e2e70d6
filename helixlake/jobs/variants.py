"""Queries of the variant operators over the fixture's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.constants import MAX_CALLS, MEI_DISTANCE, Params
from helixlake.functions import sequence as s
from helixlake.functions.likelihood import log_poisson
from helixlake.jobs.tables import Tables
from helixlake.operators import calling, clusters, composition, depth, evidence, reads, resolve, scoring, vcf
from helixlake.operators.ranges import overlap_filter, overlap_join
from helixlake.sources import annotation, bam, files, fixtures, text
from helixlake.stored import scratch_dir, store

P = Params()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    return make


@query
def scan_alignments(t: Tables) -> DataFrame:
    return t.alignments.where("chrom = 'chr1'").select("read_name", "sample", "library", "pos", "flag", "mapq")


@query
def proper_filter(t: Tables) -> DataFrame:
    odd = t.alignments.withColumn("flag", F.expr("cast(flag + case rid % 5 when 0 then 256 when 1 then 1024 when 2 then 2048 else 0 end as int)"))
    return reads.proper_filter(odd).select("read_name", "pos", "flag")


@query
def accept_filter(t: Tables) -> DataFrame:
    return reads.accept(t.alignments, t.band, t.satellites).select("read_name", "chrom", "pos")


@query
def classify_pairs(t: Tables) -> DataFrame:
    return t.classified.select("read_name", "pos", "class")


@query
def classify_pairs_interchr(t: Tables) -> DataFrame:
    return reads.classify(t.mates, t.band, interchromosomal=True).groupBy("chrom", "class").agg(F.count("*").alias("n"))


@query
def numt_classify(t: Tables) -> DataFrame:
    return reads.numt(t.mates).select("read_name", "chrom", "pos", "numt_type")


@query
def mei_classify(t: Tables) -> DataFrame:
    return reads.mei(t.alignments, t.elements).select("read_name", "pos", "mei_code", "mei_type", "element_start")


@query
def route_evidence(t: Tables) -> DataFrame:
    rows = reads.classify(t.mates, t.band)
    # Only rows far from their mates ask whether these lie in an element. Of the others the route takes no places, so they are
    # counted as one before they meet anything, and each place of a mate is looked up once.
    far = F.expr(f"chrom <> mate_chrom or abs(pos - mate_pos) > {MEI_DISTANCE}")
    places = {c: F.when(far, F.col(c)).otherwise(F.lit(0)) for c in ("pos", "mate_pos")}
    rows = store(rows.withColumn("_far", far).withColumns(places).groupBy("chrom", "mate_chrom", "pos", "mate_pos", "class", "_far").agg(F.count("*").alias("rows")), "route-counts")
    ends = rows.where("_far").select("chrom", "mate_pos").distinct().withColumn("_e", F.col("mate_pos") + P.read_length)
    inside = overlap_filter(ends, t.elements, ("mate_pos", "_e"), ("start_pos", "end_pos"), anti=False).select("chrom", "mate_pos", F.lit(True).alias("_in"))
    marked = rows.join(inside, ["chrom", "mate_pos"], "left").withColumn("in_element", F.coalesce("_in", F.lit(False)))
    return reads.route(marked).groupBy("route", "class").agg(F.sum("rows").alias("n"))


@query
def class_counts(t: Tables) -> DataFrame:
    return t.classified.where("mapq > 5").groupBy("class").agg(F.count("*").alias("n"))


@query
def chrom_semi(t: Tables) -> DataFrame:
    return t.alignments.select("chrom").distinct().join(t.repeats.select("chrom"), "chrom", "left_semi")


@query
def normalize_ends(t: Tables) -> DataFrame:
    rows = t.alignments.selectExpr("read_name", "flag", "pos as l_start", "pos + 99 as l_end", "if(flag & 16 = 0, 'F', 'R') as l_or", "mate_pos as r_start", "mate_pos + 99 as r_end", "if(flag & 32 = 0, 'F', 'R') as r_or")
    return evidence.normalise_ends(rows)


@query
def insert_size(t: Tables) -> DataFrame:
    return t.pairs.selectExpr("rid", "pos1 as l_pos", "pos2 as r_pos", "or1 as l_or", "or2 as r_or", "100 as read_length").select("rid", reads.insert_size().alias("insert_size"))


@query
def flag_ops(t: Tables) -> DataFrame:
    return t.alignments.select("read_name", "pos", s.alternative_flag(F.col("flag"), F.col("mapq") % 2 == 0, F.col("nm") % 2 == 0).alias("alt_flag"))


@query
def fragment_sample(t: Tables) -> DataFrame:
    return t.sample.select("library", "rid", "isize", "rank")


@query
def lower_median(t: Tables) -> DataFrame:
    return reads.lower_median(t.sample).select("library", "median", "n")


@query
def trimmed_stats(t: Tables) -> DataFrame:
    return reads.trimmed_stats(t.sample).select("library", "median", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query
def concordance_band(t: Tables) -> DataFrame:
    return t.band.select("library", "conc_min", "conc_max", "min_delta", "max_delta")


@query
def fragment_histogram(t: Tables) -> DataFrame:
    return reads.fragment_histogram(t.sample)


@query
def library_lookup(t: Tables) -> DataFrame:
    return t.pairs.select("rid", "library").join(F.broadcast(t.band.select("library", "max_delta")), "library", "left").select("rid", F.coalesce(F.nullif("max_delta", F.lit(0)), F.lit(100)).alias("max_delta"))


@query
def mate_join(t: Tables) -> DataFrame:
    return reads.mate_join(t.alignments).select("read_name", "chrom", "pos1", "pos2", "or1", "or2", "edit", "mq2")


@query
def pair_geometry(t: Tables) -> DataFrame:
    rows = reads.mate_join(t.alignments).selectExpr("*", "if(mq1 % 5 = 0, 12, 0) as lead1", "if(mq1 % 5 = 1, 15, 0) as trail1", "if(edit % 3 = 0, 11, 0) as lead2", "if(edit % 3 = 1, 14, 0) as trail2")
    return reads.pair_geometry(rows)


@query
def evidence_filter(t: Tables) -> DataFrame:
    return evidence.evidence_filter(t.evidence, t.satellites, t.gaps).select("ev_id", "chrom", "sv_type")


def _split(t: Tables) -> DataFrame:
    return evidence.split_fanout(evidence.split_orientation(t.split_hits))


@query
def evidence_union(t: Tables) -> DataFrame:
    split = _split(t).join(t.pairs.selectExpr("rid as clip_id", "chrom", "pos2"), "clip_id").selectExpr("concat('r', clip_id, '_Split') as read_name", "chrom", "start_pos as l_start", "pos2 as r_start", "sv_type")
    other = _alternatives(t).selectExpr("read_name", "chrom", "l_pos as l_start", "r_pos as r_start", "'DEL' as sv_type")
    return evidence.evidence_union(t.evidence, other, split).groupBy("library", "sv_type").agg(F.count("*").alias("n"), F.sum("l_start").alias("l_sum"), F.sum("r_start").alias("r_sum"))


@query
def evidence_fanout(t: Tables) -> DataFrame:
    return evidence.evidence_fanout(t.evidence).select("ev_id", "sv_type")


@query
def split_fanout(t: Tables) -> DataFrame:
    return _split(t)


@query
def split_evidence(t: Tables) -> DataFrame:
    """Evidence rows of accepted hits, with both ends and the breakpoints."""
    # Stored before and after the rules, or the plan holds each expression many times over.
    hits = store(evidence.split_accept(store(t.split_hits, "split-hits"), t.satellites), "accepted-hits")
    return evidence.split_evidence(evidence.split_orientation(hits)).select("clip_id", "split_class", "sv_type", "l_or", "r_or", "l_start", "l_end", "r_start", "r_end", "bp_l", "bp_r", "min_delta", "max_delta")


@query
def span_caps(t: Tables) -> DataFrame:
    wide = evidence.evidence_fanout(t.evidence).withColumn("r_start", F.col("r_start") + F.col("ev_id") % 3 * 60000)
    return evidence.span_caps(wide).select("ev_id", "sv_type", "r_start")


@query
def unique_reads(t: Tables) -> DataFrame:
    return evidence.unique_reads([t.evidence, t.xa, reads.numt(t.mates)])


@query
def read_ids(t: Tables) -> DataFrame:
    return evidence.read_ids(t.evidence.select("read_name").distinct())


@query
def readname_stats(t: Tables) -> DataFrame:
    return evidence.read_name_stats(evidence.evidence_fanout(t.evidence))


@query
def prune_normalize(t: Tables) -> DataFrame:
    return evidence.prune_normalise(evidence.evidence_fanout(t.evidence)).select("ev_id", "sv_type", F.round("share", 6).alias("share"))


def _read_ends(t: Tables) -> DataFrame:
    return t.alignments.selectExpr("read_name", "chrom", "pos", "pos + 100 as pos_end")


@query
def satellite_anti(t: Tables) -> DataFrame:
    return overlap_filter(_read_ends(t), t.satellites, ("pos", "pos_end"), ("start_pos", "end_pos"), anti=True).select("read_name", "pos")


@query
def gap_anti(t: Tables) -> DataFrame:
    rows = t.evidence.select("ev_id", "chrom", "l_end", "r_start")
    return overlap_filter(rows, t.gaps, ("l_end", "r_start"), ("start_pos", "end_pos"), anti=True).select("ev_id")


@query
def mei_range_join(t: Tables) -> DataFrame:
    # A place is looked up once, however many rows of evidence have their right ends there.
    found = overlap_join(t.evidence.select("chrom", "r_start", "r_end").distinct(), t.elements, ("r_start", "r_end"), ("start_pos", "end_pos"), width=500, right_columns=["start_pos", "end_pos", "repeat_class"])
    first = found.groupBy("chrom", "r_start", "r_end").agg(F.min(F.struct("r_start_pos", "r_end_pos", "r_repeat_class")).alias("e"))
    return t.evidence.select("ev_id", "chrom", "r_start", "r_end").join(first, ["chrom", "r_start", "r_end"]).select("ev_id", F.col("e.r_start_pos").alias("start_pos"), F.col("e.r_repeat_class").alias("repeat_class"))


@query
def first_repeat(t: Tables) -> DataFrame:
    return t.repeats.groupBy("chrom", "repeat_class").agg(F.min(F.struct("start_pos", "end_pos")).alias("f")).select("chrom", "repeat_class", "f.start_pos", "f.end_pos")


@query
def repeats_project(t: Tables) -> DataFrame:
    return t.repeats.where(F.col("repeat_class").isin(*P.mobile_elements)).select("chrom", "start_pos", "end_pos", "strand", "mei_code")


@query
def read_depth(t: Tables) -> DataFrame:
    return t.depth


@query
def mean_depth(t: Tables) -> DataFrame:
    return depth.mean_depth(t.depth).select("sample", "chrom", F.round("mean_depth", 9).alias("mean_depth"))


@query
def gc_depth(t: Tables) -> DataFrame:
    return depth.gc_depth(t.depth, t.windows).select("sample", "chrom", "gc", F.round("mean_rd", 9).alias("mean_rd"))


@query
def observed_rd(t: Tables) -> DataFrame:
    return depth.observed_depth(t.spans, t.depth)


@query
def expected_rd(t: Tables) -> DataFrame:
    return depth.expected_depth(t.spans, depth.gc_depth(t.depth, t.windows), t.windows)


@query
def gc_by_base(t: Tables) -> DataFrame:
    """How many bases' own windows have each GC percent."""
    found = composition.base_gc(t.reference, t.page).select("chrom", F.explode("gc").alias("gc"))
    return found.groupBy("chrom", F.col("gc").cast("int").alias("gc")).agg(F.count("*").alias("bases"))


@query
def gc_profile(t: Tables) -> DataFrame:
    return t.base_profile.select("sample", "chrom", "gc", F.round("mean_rd", 9).alias("mean_rd"))


@query
def expected_rd_by_base(t: Tables) -> DataFrame:
    return composition.expected_depth(t.spans, t.base_profile, t.track, t.page)


@query
def base_decode(t: Tables) -> DataFrame:
    return t.pairs.select("rid", s.base_decode(F.expr("case edit % 6 when 0 then 1 when 1 then 2 when 2 then 4 when 3 then 8 when 4 then 15 else 3 end")).alias("base"))


@query
def revcomp(t: Tables) -> DataFrame:
    return t.dna.select("seq_id", s.reverse_complement(F.expr("if(seq_id % 7 = 0, concat(seq, 'nX'), seq)")).alias("rc"))


@query
def kmer_valid(t: Tables) -> DataFrame:
    return t.dna.select("seq_id", s.kmer_valid(F.expr("if(seq_id % 3 = 0, concat(substring(seq, 1, 9), 'N'), substring(seq, 1, 10))")).alias("valid"))


@query
def kmer_hash(t: Tables) -> DataFrame:
    return t.dna.select("seq_id", s.kmer_hash(F.substring("seq", 11, 10)).alias("hash"))


@query
def kmer_counts(t: Tables) -> DataFrame:
    return evidence.kmer_counts(t.dna)


@query
def hamming(t: Tables) -> DataFrame:
    return t.dna.select("seq_id", s.hamming(F.substring("seq", 1, 32), F.substring("seq", 33, 32)).alias("distance"))


@query
def barcode_encode(t: Tables) -> DataFrame:
    return t.dna.select("seq_id", s.barcode_encode(F.expr("if(seq_id % 9 = 0, null, substring(seq, 3, 16))")).alias("barcode"))


@query
def ref_upper(t: Tables) -> DataFrame:
    return t.dna.select("seq_id", F.upper(F.lower("seq")).alias("seq"))


@query
def ref_subsequence(t: Tables) -> DataFrame:
    """Bases [start, end) over pages of 64."""
    spans = t.dna.selectExpr("seq_id as span_id", "'all' as chrom", "seq_id * 64 + 30 as start_pos", "seq_id * 64 + 120 as end_pos")
    return files.subsequences(spans, t.dna.selectExpr("'all' as chrom", "seq_id * 64 as start_pos", "seq"), 64)


@query
def kmer_seed_join(t: Tables) -> DataFrame:
    return evidence.seed_join(t.dna_clips, t.reference_kmers).select("clip_id", "pos", "hit_or", "at")


@query
def seed_verify(t: Tables) -> DataFrame:
    return t.hits.select("clip_id", "hit_or", "at", "mismatches")


@query
def hit_cap(t: Tables) -> DataFrame:
    return evidence.hit_cap(t.hits).select("clip_id", "hit_or", "at", "hits", "hit_mapq")


@query
def header_read_groups(t: Tables) -> DataFrame:
    line = "case when rid % 3 = 0 then concat('@RG\\tID:', library, '\\tSM:', sample) when rid % 3 = 1 then concat('@RG\\tSM:', sample) else concat('@SQ\\tSN:', chrom) end"
    return text.read_groups(t.pairs.selectExpr("rid as file", f"{line} as line"))


@query
def cigar_parse(t: Tables) -> DataFrame:
    ops = s.cigar_ops(F.col("cigar"))
    return t.reads.select("read_name", "pos", F.size(ops).alias("n_ops"), F.element_at(ops, 1)["op"].alias("first_op"), F.element_at(ops, 1)["len"].alias("first_len"), s.soft_clipped(F.col("cigar")).alias("clipped"))


@query
def xa_parse(t: Tables) -> DataFrame:
    return evidence.xa_entries(t.xa, ["read_name", "chrom"])


@query
def divet_parse(t: Tables) -> DataFrame:
    made = "concat_ws(if(ev_id % 2 = 0, ' ', '\\t'), read_name, chrom, l_start, l_end, l_or, '=', r_start, r_end, r_or, sv_type, edit, mq1, mq2)"
    lines = t.evidence.selectExpr(f"if(ev_id % 17 = 0, ' ', {made}) as line")
    return text.divet(lines).select("read_name", "l_start", "r_end", "sv_type", "edit", "phred")


def _fastq(t: Tables, mate: int) -> DataFrame:
    return t.dna.selectExpr("cast(floor(seq_id / 100) as bigint) as file", f"explode(array(struct(seq_id % 100 * 4 as line_no, concat('@r', seq_id, '/{mate}') as line), struct(seq_id % 100 * 4 + 1 as line_no, substring(seq, {mate}, 30) as line), struct(seq_id % 100 * 4 + 2 as line_no, '+' as line), struct(seq_id % 100 * 4 + 3 as line_no, repeat('I', 30) as line))) as e").select("file", "e.line_no", "e.line")


@query
def discordant_fastq(t: Tables) -> DataFrame:
    """Records of discordant reads, reverse strands turned back."""
    seq = t.evidence.join(t.dna, F.expr("seq_id = ev_id % 2000")).select("read_name", "l_or", "seq")
    return seq.select(F.concat(F.lit("@"), "read_name").alias("name"), F.when(F.col("l_or") == "R", s.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


@query
def fastq_pair_join(t: Tables) -> DataFrame:
    return text.fastq_pairs(text.fastq(_fastq(t, 1)), text.fastq(_fastq(t, 2)))


def _calls(t: Tables) -> DataFrame:
    """The stand-in clusters, refined by their split reads, with genotypes by the profile; every seventh's deletion is of a
    mobile element, and insertions of one and duplications stand beside them."""
    support = scoring.cluster_support(t.sided)
    ends = calling.refined_ends(scoring.cluster_bounds(t.sided), t.sided, support)
    ends = ends.where("coalesce(inner_start + outer_start + inner_end + outer_end, -1) >= 0")  # regions with reads of both strands
    genotypes = scoring.genotype_likelihood(t.scored).select("cluster_id", "sample", "zygosity", "score")
    again = t.sided.select("cluster_id", F.expr("regexp_replace(cluster_id, '^[A-Z]+_[A-Z]+:', '')").alias("plain")).distinct()
    genotypes = again.join(genotypes.withColumnRenamed("cluster_id", "plain"), "plain").drop("plain")
    element = F.expr("case when sv_type = 'MEI_F' or sv_type = 'DEL' and outer_start % 7 = 0 then 'SINE/Alu' end")
    length = F.expr("case when sv_type = 'MEI_F' and outer_start % 2 = 0 then 300 end")
    calls = calling.with_samples(ends, support, genotypes).withColumns({"element": element, "element_length": length, "filtered": F.col("outer_start") % 5 == 0})
    return calls.withColumn("ref", F.lit(None).cast("string"))


def _records(t: Tables) -> DataFrame:
    return vcf.records(_calls(t))


@query
def resolved_records(t: Tables) -> DataFrame:
    """Sequences of the stand-in calls: of precise ones, and of a third of all; some insert an element of a known place."""
    known = F.col("sv_type").startswith("MEI") & (F.col("outer_start") % 2 == 0)
    start = F.when(known, F.col("outer_start") - F.col("outer_start") % 1000)
    calls = store(_calls(t).withColumns({"element_chrom": F.when(known, F.col("chrom")), "element_start": start, "element_end": start + 150}), "stand-in-calls")
    records = vcf.records(resolve.with_sequences(calls, t.reference, F.col("outer_start") % 3 == 0, t.page))
    return records.select("chrom", "pos", "id", "ref", "alt")


@query
def vcf_records(t: Tables) -> DataFrame:
    return _records(t)


@query
def vcf_to_bed(t: Tables) -> DataFrame:
    return text.vcf_to_bed(_records(t))


@query
def sv_stats(t: Tables) -> DataFrame:
    return vcf.stats(_records(t))


def _entries(t: Tables) -> DataFrame:
    return evidence.xa_entries(t.xa, ["read_name", "chrom"]).where("alt_chrom = chrom").selectExpr("read_name", "chrom", "alt_pos as pos", "alt_or as or", "alt_nm as nm")


def _primary(t: Tables, side: str) -> DataFrame:
    return t.alignments.where(f"isize {side} 0").selectExpr("read_name", "chrom", "pos", "if(flag & 16 = 0, 'F', 'R') as or", "nm")


def _alternatives(t: Tables) -> DataFrame:
    return evidence.alternatives(_entries(t), _primary(t, "<"))


@query
def alt_left_prim_right(t: Tables) -> DataFrame:
    return _alternatives(t)


@query
def alt_left_alt_right(t: Tables) -> DataFrame:
    return evidence.alternatives(_entries(t), _entries(t))


@query
def prim_left_alt_right(t: Tables) -> DataFrame:
    return evidence.alternatives(_primary(t, ">"), _entries(t))


@query
def alt_classify(t: Tables) -> DataFrame:
    libraries = t.alignments.where("isize < 0").select("read_name", "library")
    rows = _alternatives(t).join(libraries, "read_name").withColumn("read_length", F.lit(100)).withColumn("insert_size", reads.insert_size())
    return evidence.classify_alternatives(rows, t.band).select("read_name", "l_pos", "r_pos", "insert_size", "class")


@query
def softclip_candidates(t: Tables) -> DataFrame:
    return evidence.softclip_candidates(t.reads).select("read_name", "pos", "clip_side", "clip_len")


@query
def softclip_quality(t: Tables) -> DataFrame:
    clips = evidence.softclip_candidates(t.reads).withColumn("quals", F.expr("transform(sequence(1, 100), i -> cast((i * 7 + rid) % 41 as int))"))
    return evidence.softclip_quality(clips)


def _histogram(t: Tables) -> DataFrame:
    clips = evidence.softclip_candidates(t.reads)
    return evidence.softclip_histogram(clips.withColumn("brk", F.expr("if(clip_side = 'HEAD', pos, pos + 100 - clip_len)")))


@query
def softclip_hist(t: Tables) -> DataFrame:
    return _histogram(t)


@query
def softclip_neighbors(t: Tables) -> DataFrame:
    return evidence.softclip_neighbours(_histogram(t))


@query
def split_orientation(t: Tables) -> DataFrame:
    return evidence.split_orientation(t.split_hits).select("clip_id", "split_class")


@query
def split_accept(t: Tables) -> DataFrame:
    return evidence.split_accept(t.split_hits, t.satellites).select("clip_id", "l_start", "l_end", "r_start", "r_end")


@query
def usable_clips(t: Tables) -> DataFrame:
    clips = evidence.softclip_candidates(t.reads).selectExpr("*", "if(clip_side = 'HEAD', pos, pos + 100 - clip_len) as brk", "mapq as avg_phred")
    near = evidence.softclip_neighbours(_histogram(t)).select("chrom", "brk", "neighbours")
    return evidence.usable_clips(clips.join(near, ["chrom", "brk"])).select("read_name", "pos", "brk", "neighbours")


@query
def chromosome_range(t: Tables) -> DataFrame:
    named = t.alignments.selectExpr("read_name", "pos", "if(rid % 9 = 0, concat(chrom, '_GL000220'), chrom) as chrom")
    return reads.chromosome_range(named, ["chr1", "chr2", "chr3", "chr4"], "chr2", "chr3")


@query
def library_validity(t: Tables) -> DataFrame:
    odd = t.band.withColumn("conc_min", F.expr("if(library = 'lib1', -1, conc_min)"))
    return reads.valid_libraries(odd).select("library", "conc_max")


@query
def chromosome_names(t: Tables) -> DataFrame:
    other = t.repeats.selectExpr("if(mei_code = 0, concat('chr', substring(chrom, 4)), substring(chrom, 4)) as name").distinct()
    return reads.named_alike(t.alignments.select("chrom").distinct(), other)


@query
def mei_ends(t: Tables) -> DataFrame:
    return t.reads.select("read_name", "pos", (F.col("pos") + s.soft_clipped(F.col("cigar"))).alias("pos_end"))


@query
def numt_ends(t: Tables) -> DataFrame:
    start, end = reads.clipped_ends(F.col("pos"), F.col("cigar"))
    return t.reads.select("read_name", "pos", start.alias("start_pos"), end.alias("end_pos"))


def _clustered(t: Tables, kind: str, both: bool = False) -> DataFrame:
    found = clusters.cluster(clusters.shapes(t.evidence.where(F.col("sv_type") == kind)), both, between=both)
    return found.select("chrom", "sv_type", "left_brk", "ev_id", "size")


@query
def cluster_del(t: Tables) -> DataFrame:
    return _clustered(t, "DEL")


@query
def cluster_ins(t: Tables) -> DataFrame:
    return _clustered(t, "INS")


@query
def cluster_tdup(t: Tables) -> DataFrame:
    return _clustered(t, "TDUP")


@query
def cluster_inv(t: Tables) -> DataFrame:
    return _clustered(t, "INV", both=True)


def _region(rows: DataFrame, t: Tables, least: int, length: int, further: int) -> DataFrame:
    """rows: ev_id, chrom, sv_type (the type of the forward reads), pos, or, library. A forward read reaches from `length`
    bases after its start to its library's window and `further` bases more."""
    wide = rows.join(F.broadcast(t.band.select("library", (F.col("max_delta") + further).alias("max_delta"), "conc_max")), "library").withColumn("pos_end", F.col("pos") + length)
    found = clusters.regions(wide, least)
    return found.select("chrom", "sv_type", "left_brk", "ev_id", "size")


@query
def cluster_mei(t: Tables) -> DataFrame:
    """Of discordant reads whose mate lies in a mobile element of another chromosome."""
    rows = reads.mei(t.apart.where("mapq > 5"), t.elements)
    own = "if(flag & 16 = 0, 'F', 'R')"
    return _region(rows.selectExpr("rid * 2 + if(isize > 0, 0, 1) as ev_id", "chrom", f"concat('MEI', mei_type ^ if({own} = 'R', 1, 0)) as sv_type", "pos", f"{own} as or", "library"), t, 2, 0, 0)


@query
def cluster_numt(t: Tables) -> DataFrame:
    rows = reads.numt(t.apart.where("mapq > 5").withColumn("mate_chrom", F.expr("if(nm % 2 = 0, 'chrM', mate_chrom)")))
    own = "if(flag & 16 = 0, 'F', 'R')"
    return _region(rows.selectExpr("rid * 2 + if(isize > 0, 0, 1) as ev_id", "chrom", f"concat('NUMT', if(numt_type = 'R', 1, 0) ^ if({own} = 'R', 1, 0)) as sv_type", "pos", f"{own} as or", "library"), t, 0, 100, 200)


def _duplications(t: Tables, kind: str) -> DataFrame:
    found = clusters.duplications(evidence.evidence_fanout(t.evidence).where(F.col("sv_type") == kind))
    return found.select("chrom", "sv_type", "left_brk", "ev_id", "size")


@query
def cluster_interdup(t: Tables) -> DataFrame:
    return _duplications(t, "INTERDUP")


@query
def cluster_invdup(t: Tables) -> DataFrame:
    return _duplications(t, "INVDUP")


@query
def dup_pairing(t: Tables) -> DataFrame:
    sides = t.members.where("sv_type = 'INV'").withColumn("orient", F.concat("l_or", "r_or")).withColumn("left_brk", F.floor(F.col("l_start") / 3700))
    sides = sides.groupBy("chrom", "left_brk", "orient").agg(F.count("*").alias("n")).withColumn("cluster_id", F.concat_ws(":", "chrom", "orient", F.col("left_brk").cast("string")))
    return clusters.pairing(sides, "FF", "RR")


def _places(t: Tables, width: int) -> DataFrame:
    return t.alignments.where("mapq > 5").selectExpr("chrom", f"cast(floor(pos / {width}) as bigint) as place", "cast(nm % 6 as int) as type", "if(flag & 16 = 0, 'F', 'R') as or")


@query
def mei_pairing(t: Tables) -> DataFrame:
    return clusters.region_pairing(_places(t, 500), 2)


@query
def numt_pairing(t: Tables) -> DataFrame:
    return clusters.region_pairing(_places(t, 300).where("type < 2"), 0)


@query
def maximal_sets(t: Tables) -> DataFrame:
    narrow = t.evidence.selectExpr("ev_id", "concat('a', chrom, ':', sv_type, ':', floor(l_start / 1000)) as cluster_id")
    wide = t.evidence.selectExpr("ev_id", "concat('b', chrom, ':', sv_type, ':', floor(l_start / 1850)) as cluster_id")
    return clusters.maximal_sets(narrow.unionByName(wide))


@query
def clonal_dedup(t: Tables) -> DataFrame:
    return clusters.clonal_dedup(t.members).select("cluster_id", "ev_id")


@query
def read_cluster_cap(t: Tables) -> DataFrame:
    many = t.members.where("sv_type = 'DEL'").select("ev_id", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("k"), "cluster_id", "l_start")
    named = many.selectExpr("ev_id", "concat(cluster_id, ':', k) as cluster_id", "cast((l_start * 7 + k * 13) % 101 as bigint) as left_brk")
    return clusters.read_cluster_cap(named)


@query
def cluster_prune(t: Tables) -> DataFrame:
    wide = t.bounds.selectExpr("cluster_id", "sv_type", "outer_start", "outer_end + inner_start % 2 * 600000 as outer_end")
    return clusters.cluster_prune(wide)


@query
def read_cluster_edges(t: Tables) -> DataFrame:
    return t.members.select("read_name", "cluster_id").distinct()


@query
def cluster_bounds(t: Tables) -> DataFrame:
    return scoring.cluster_bounds(t.sided)


@query
def cluster_support(t: Tables) -> DataFrame:
    return t.support


@query
def cluster_edit_avg(t: Tables) -> DataFrame:
    return scoring.cluster_edit_avg(t.members)


@query
def barcode_homogeneity(t: Tables) -> DataFrame:
    return scoring.barcode_homogeneity(t.barcoded)


@query
def del_length_bounds(t: Tables) -> DataFrame:
    return scoring.deletion_length_bounds(t.members)


@query
def score_region(t: Tables) -> DataFrame:
    return scoring.score_region(scoring.cluster_bounds(t.sided))


@query
def log_poisson_score(t: Tables) -> DataFrame:
    value = log_poisson(F.col("edit") * 40 + F.col("mapq"), F.col("edit") * 31.5, 0.01)
    return t.pairs.select("rid", F.round(value, 5).alias("log_p"))


QUERIES["log_poisson"] = QUERIES.pop("log_poisson_score")


@query
def score_inputs(t: Tables) -> DataFrame:
    return t.scored.select("cluster_id", "sample", "sv_type", "op", "od", F.round("ep", 5).alias("ep"), "ed")


@query
def expected_pairs(t: Tables) -> DataFrame:
    return scoring.long_inserts(t.band).select("library", F.round("spanning", 6).alias("spanning"))


@query
def genome_depth(t: Tables) -> DataFrame:
    """Mean depth and GC profile over all chromosomes together."""
    whole = t.profile.join(t.windows.groupBy("chrom", "gc").agg(F.count("*").alias("windows")), ["chrom", "gc"])
    return whole.groupBy("sample", "gc").agg(F.round(F.sum(F.col("mean_rd") * F.col("windows")) / F.sum("windows"), 9).alias("mean_rd"))


@query
def widest_delta(t: Tables) -> DataFrame:
    return t.band.agg(F.max("max_delta").alias("max_delta"))


@query
def genotype_likelihood(t: Tables) -> DataFrame:
    return scoring.genotype_likelihood(t.scored).withColumn("score", F.round("score", 5))


@query
def mei_deletion(t: Tables) -> DataFrame:
    short = t.bounds.where("sv_type = 'DEL'").selectExpr("cluster_id", "chrom", "sv_type", "inner_start as start_pos", "inner_start + 150 as end_pos")
    return scoring.mei_deletions(short, t.elements)


@query
def cluster_weight(t: Tables) -> DataFrame:
    return t.weights.withColumn("weight", F.round("weight", 5))


@query
def topk_scores(t: Tables) -> DataFrame:
    return scoring.top_scores(t.weights.withColumn("weight", F.round("weight", 4)))


@query
def genotype_code(t: Tables) -> DataFrame:
    return t.pairs.select("rid", s.genotype(F.col("edit") % 4).alias("gt"))


@query
def sv_conflicts(t: Tables) -> DataFrame:
    return scoring.conflicts(t.calls)


@query
def conflict_triples(t: Tables) -> DataFrame:
    return scoring.conflict_triples(scoring.conflicts(t.calls))


@query
def breakpoint_votes(t: Tables) -> DataFrame:
    return scoring.breakpoint_votes(t.members)


@query
def refine_breakpoints(t: Tables) -> DataFrame:
    rough = t.members.withColumn("l_end", F.col("l_end") - F.col("l_end") % 1000).withColumn("r_start", F.col("r_start") - F.col("r_start") % 1000)
    return scoring.refine(scoring.breakpoint_votes(rough), t.support, t.bounds.select("cluster_id", "sv_type"))


@query
def mei_call_filter(t: Tables) -> DataFrame:
    """Calls of either strand, some of a class and some of a name that lie there."""
    calls = t.calls.selectExpr(
        "cluster_id", "chrom", "if(start_pos % 3 = 0, 'MEI_R', 'MEI_F') as sv_type", "start_pos as outer_start", "start_pos + 40 + start_pos % 300 as outer_end",
        "if(start_pos % 2 = 0, 'SINE/Alu', 'LINE/L1') as element", "if(start_pos % 5 < 2, 'SINE/Alu', 'Other/SVA') as element_name",
    )
    return scoring.mei_call_filter(calls, t.elements, t.satellites).select("cluster_id", "filter")


@query
def report_filter(t: Tables) -> DataFrame:
    return scoring.report_filter(t.support)


@query
def call_limit(t: Tables) -> DataFrame:
    """The reporting limit: the best calls of a run."""
    return scoring.top_scores(t.weights.withColumn("weight", F.round("weight", 4)), MAX_CALLS)


@query
def set_cover(t: Tables) -> DataFrame:
    return scoring.set_cover(t.bounds, t.members, t.scored, t.elements)


@query
def call_variants(t: Tables) -> DataFrame:
    """From alignments to records: the whole run."""
    calls = calling.call_variants(t.alignments, t.satellites, t.gaps, t.elements, t.windows)
    return vcf.records(calls).withColumn("size", F.regexp_extract("info", "SVLEN=(-?[0-9]+)", 1).cast("int"))


def _kept(t: Tables, df: DataFrame, name: str, **options: str) -> str:
    """Writes lines as a text file in the shared folder, for a reader."""
    path = f"{scratch_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).text(path)
    return path


def _sam_rows(t: Tables) -> DataFrame:
    seq = F.translate(F.md5(F.col("read_name").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return t.mates.withColumns({"cigar": F.lit("32M"), "seq": seq, "quals": F.translate(seq, "ACGT", "I5#!")})


@query
def sam_reader(t: Tables) -> DataFrame:
    header = t.libraries.groupBy("library").agg(F.min("sample").alias("sample")).select(F.concat(F.lit("@RG\tID:"), "library", F.lit("\tSM:"), "sample").alias("value"))
    path = _kept(t, header.unionByName(files.sam_lines(_sam_rows(t))).coalesce(1), "sam")
    return files.sam(t.spark, path).select("read_name", "flag", "chrom", "pos", "mapq", "mate_chrom", "mate_pos", "isize", "library", "sample", "nm", "seq", F.element_at("base_quals", 1).alias("first_quality"))


@query
def bam_reader(t: Tables) -> DataFrame:
    """Alignments as compressed files in order of place, and those of two chromosomes read back in small splits."""
    rows = _sam_rows(t)
    ends = rows.selectExpr("explode(array(struct(chrom, pos), struct(mate_chrom as chrom, mate_pos as pos))) as e").groupBy("e.chrom").agg((F.max("e.pos") + 1000).alias("length"))
    contigs = [(r.chrom, r.length) for r in ends.orderBy("chrom").collect()]  # a row for each chromosome
    samples = {r.library: r.sample for r in t.libraries.groupBy("library").agg(F.min("sample").alias("sample")).collect()}  # a row for each library
    path = f"{scratch_dir(t.spark)}/bam-{uuid.uuid4().hex}"
    bam.write_bam(rows, path, contigs, samples)
    found = bam.bam(t.spark, path, chroms=["chr2", "chr4"], split=4 << 20)
    return found.select("read_name", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "isize", "library", "sample", "nm", "seq", F.element_at("base_quals", 1).alias("first_quality"))


@query
def fasta_reader(t: Tables) -> DataFrame:
    rows = t.dna.selectExpr("seq_id", "explode(array(struct(0 as k, concat('>s', seq_id, ' of the fixture') as value), struct(1 as k, lower(substring(seq, 1, 40)) as value), struct(2 as k, substring(seq, 41, 24) as value))) as l")
    path = _kept(t, rows.select("seq_id", "l.k", "l.value").repartitionByRange(4, "seq_id").sortWithinPartitions("seq_id", "k").select("value"), "fasta")
    return files.fasta(t.spark, path, width=25)


@query
def fastq_reader(t: Tables) -> DataFrame:
    rows = _fastq(t, 1).repartitionByRange(4, "file").sortWithinPartitions("file", "line_no").select(F.col("line").alias("value"))
    return files.fastq_files(t.spark, _kept(t, rows, "fastq", compression="gzip")).select("qname", "seq", "qual")


@query
def bed_reader(t: Tables) -> DataFrame:
    rows = t.gaps.select(F.concat_ws("\t", "chrom", "start_pos", "end_pos", F.lit("gap")).alias("value"))
    head = t.spark.createDataFrame([("track name=gaps",), ("# gaps",)], "value string")
    return files.bed(t.spark, _kept(t, head.unionByName(rows), "bed"))


@query
def repeat_masker_reader(t: Tables) -> DataFrame:
    """repeats as the table of a masker, and read back."""
    f = ["463", "1.3", "0.6", "1.7", "chrom", "start_pos + 1", "end_pos", "'(0)'", "if(strand = '-', 'C', '+')", "concat(substring_index(repeat_class, '/', -1), 'x')", "repeat_class", "1", "9", "'(0)'", "7"]
    rows = t.repeats.selectExpr(f"concat('  ', concat_ws('  ', {', '.join(f)})) as value")
    head = t.spark.createDataFrame([("   SW  perc perc",), ("score  div. del.",), ("",)], "value string")
    return files.repeat_masker(t.spark, _kept(t, head.unionByName(rows), "masker"))


@query
def annotation_tables(t: Tables) -> DataFrame:
    """Lengths and GC of chromosomes, and intervals cut to them: gaps once moved over an end, once as they are, and repeats."""
    gaps = t.gaps.unionByName(t.gaps.selectExpr("if(start_pos % 2 = 0, chrom, 'chr9') as chrom", "start_pos + 1900 as start_pos", "end_pos + 1900 as end_pos"))
    made = annotation.annotate(t.reference, gaps, t.gaps, t.repeats, t.page)
    kinds = {"gap": made.gaps, "duplication": made.duplications, "satellite": made.satellites, "element": made.elements}
    rows = made.lengths.selectExpr("'chromosome' as kind", "chrom", "0 as start_pos", "length as end_pos", "gc")
    for kind, found in kinds.items():
        rows = rows.unionByName(found.select(F.lit(kind).alias("kind"), "chrom", "start_pos", "end_pos", F.lit(None).cast("double").alias("gc")))
    return rows


@query
def input_list(t: Tables) -> DataFrame:
    rows = fixtures.table(t.spark, t.sf_dir, "nation").selectExpr("concat(n_name, '.bam, ', n_regionkey, '.bam,') as value")
    return files.input_paths(t.spark.read.text(_kept(t, rows, "inputs")))


@query
def cluster_dump(t: Tables) -> DataFrame:
    """Lines of the debugging dump of clusters."""
    order = F.array_sort(F.collect_list(F.struct("edit", "ev_id", "read_name")))
    rows = t.members.groupBy("cluster_id", "chrom", "sv_type").agg(order.alias("m"))
    return rows.select(F.concat_ws(" ", "chrom", "sv_type", "cluster_id", F.size("m"), F.array_join(F.transform("m", lambda x: x["read_name"]), " ")).alias("line"))


@query
def read_name_dump(t: Tables) -> DataFrame:
    return evidence.unique_reads([t.evidence, reads.numt(t.mates)]).agg(F.count("*").alias("n"), F.min("read_name").alias("first_name"), F.max("read_name").alias("last_name"))
