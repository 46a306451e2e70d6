"""From alignments to variant calls: evidence, clusters, scores, cover, refinement, records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.constants import MAX_INVERSION, MEI_DISTANCE, REVERSE, SPLIT_MAX_DELTA, Params
from helixlake.functions.sequence import genotype, soft_clipped
from helixlake.operators import clusters, composition, depth, evidence, reads, resolve, scoring
from helixlake.stored import scratch, store

P = Params()
ENDS = ["inner_start", "outer_start", "inner_end", "outer_end"]
#: What names a record.
KEY = ["sample", "library", "read_name", "flag"]


def discordant_pairs(alignments: DataFrame, band: DataFrame, p: Params = P) -> DataFrame:
    """Discordant pairs of proper records above the mapping quality, with their library's window."""
    return pair_evidence(reads.classify(alignments.where(reads.proper() & (F.col("mapq") > p.mapq)), band).where("class not in ('CONC', 'UNMAPPED')").drop("conc_min", "conc_max"), band, p)


def pair_evidence(classified: DataFrame, band: DataFrame, p: Params = P) -> DataFrame:
    """Evidence of discordant records (with class) whose mates are among them, on one chromosome: the left mate's class, starts
    after leading clips and ends before trailing ones, if there is a column cigar."""
    lead, trail = reads.clips(F.col("cigar")) if "cigar" in classified.columns else (F.lit(0), F.lit(0))
    classified = store(classified, "discordant-records")  # both mates come from it, a small part of all records
    joined = reads.mate_join(classified.withColumns({"lead": lead, "trail": trail}), ("lead", "trail", "class"))
    rows = joined.join(F.broadcast(band.select("library", "conc_max", "min_delta", "max_delta")), "library")
    last = p.read_length - 1
    return rows.selectExpr(
        "rid as ev_id", "read_name", "chrom", "sample", "library", "pos1 + lead1 as l_start", f"pos1 + {last} - trail1 as l_end", "or1 as l_or", "pos2 + lead2 as r_start", f"pos2 + {last} - trail2 as r_end", "or2 as r_or",
        "class1 as sv_type", "mq1", "mq2", "edit", "cast(least(mq1, 40) as double) as phred", "min_delta", "max_delta", "conc_max",
    )


def routed(alignments: DataFrame, band: DataFrame, satellites: DataFrame, elements: DataFrame, p: Params = P, lengths: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted discordant records by what they tell of, in one pass of rules, the first that holds: mitochondrial insertions
    (mate there, itself not), insertions of a mobile element (mate inside one, on another chromosome or far away), pairs."""
    columns = ["read_name", "rid", "chrom", "mate_chrom", "sample", "library", "pos", "mate_pos", "flag", "isize", "mapq", "nm", "cigar"]
    rows = reads.classify(reads.accept(alignments.select(*columns), band, satellites, p, lengths), band).drop("conc_min", "conc_max")
    rows = store(rows.where("class not in ('CONC', 'UNMAPPED')"), "discordant")
    mitochondrial = reads.numt(rows)
    mobile = store(reads.mei(rows.where(f"chrom <> mate_chrom or abs(pos - mate_pos) > {MEI_DISTANCE}"), elements, p).join(mitochondrial.select(*KEY), KEY, "left_anti"), "mobile")
    near = rows.where(f"chrom = mate_chrom and (class <> 'INV' or abs(pos - mate_pos) < {MAX_INVERSION})")
    return mitochondrial, mobile, near.join(mobile.select(*KEY), KEY, "left_anti")


def region_evidence(mobile: DataFrame, mitochondrial: DataFrame, band: DataFrame, p: Params = P) -> DataFrame:
    """One-ended evidence of insertions, as evidence rows at the read's place, with the reach that regions takes (pos, pos_end,
    or). The type is the forward read's; a reverse read's complementary type stands under the same name."""
    own, reverse = F.when(reads.bit(REVERSE), "R").otherwise("F"), reads.bit(REVERSE).cast("int")
    _, before_clip = reads.clipped_ends(F.col("pos"), F.col("cigar"), p.read_length)
    of_element = mobile.select("*", F.concat(F.lit("MEI"), F.col("mei_type").bitwiseXOR(reverse)).alias("sv_type"), (F.col("pos") + F.coalesce(soft_clipped(F.col("cigar")), F.lit(0))).alias("pos_end"), F.lit(0).alias("_more"))
    of_mito = mitochondrial.select("*", F.concat(F.lit("NUMT"), (F.col("numt_type") == "R").cast("int").bitwiseXOR(reverse)).alias("sv_type"), F.coalesce(before_clip, F.col("pos") + p.read_length).alias("pos_end"), F.lit(2 * p.read_length).alias("_more"))
    rows = of_element.unionByName(of_mito, allowMissingColumns=True)
    rows = rows.join(F.broadcast(band.select("library", F.expr("coalesce(nullif(max_delta, 0), 100)").alias("max_delta"), "conc_max")), "library")
    place = [F.col("pos").alias(c) for c in ("l_start", "l_end", "r_start", "r_end")]
    return rows.select(
        F.xxhash64(*KEY, "pos").alias("ev_id"), "read_name", "chrom", "sample", "library", *place, own.alias("l_or"), own.alias("r_or"), own.alias("or"), "sv_type", F.col("mapq").alias("mq1"), F.col("mapq").alias("mq2"),
        F.col("nm").alias("edit"), F.least("mapq", F.lit(40)).cast("double").alias("phred"), F.lit(0).alias("min_delta"), (F.col("max_delta") + F.col("_more")).alias("max_delta"), "conc_max", "pos", "pos_end", "element", "element_name",
    )


def split_reads(alignments: DataFrame, pages: DataFrame, band: DataFrame, satellites: DataFrame, p: Params = P, lengths: DataFrame | None = None, width: int = 1000) -> DataFrame:
    """Evidence rows of clipped parts that lie elsewhere on their chromosome: clips of good quality near some others, sought by
    their first bases in the reference and held against it whole. pages: chrom, start_pos, seq of `width` bases. A clip's
    breakpoint is where its read's mapped part ends, whatever the clip's length. Needs cigar, seq and base_quals."""
    columns = ["read_name", "chrom", "mate_chrom", "sample", "library", "pos", "mate_pos", "flag", "isize", "mapq", "cigar", "seq", "base_quals"]
    rows = evidence.softclip_candidates(alignments.select(*columns).where("seq is not null and cigar is not null")).withColumnRenamed("base_quals", "quals")
    rows = reads.accept(rows, band, satellites, p, lengths)
    head = F.col("clip_side") == "HEAD"
    clipped = F.when(head, F.expr("substring(seq, 1, clip_len)")).otherwise(F.expr("substring(seq, -clip_len, clip_len)"))
    rows = rows.withColumns({"avg_phred": evidence.clip_quality(), "brk": F.when(head, F.col("pos")).otherwise(F.col("pos") + p.read_length - F.col("clip_len")), "part": clipped})
    rows = store(rows.select(F.xxhash64(*KEY, "pos").alias("clip_id"), F.concat("read_name", F.lit("_Split")).alias("read_name"), "chrom", "sample", "pos", "mapq", "clip_side", "clip_len", "avg_phred", "brk", F.col("part").alias("seq")), "clips")
    by = ("sample", "chrom")
    near = evidence.softclip_neighbours(evidence.softclip_histogram(rows.where(F.col("avg_phred") > p.mapq), p.mapq, by), by=by)
    usable = evidence.usable_clips(rows.join(near.drop("n"), [*by, "brk"]), p.mapq)
    seeded = evidence.seed_join(store(usable, "usable-clips"), evidence.reference_kmers(pages, width))
    hits = evidence.hit_cap(store(evidence.verify(evidence.with_reference(seeded, pages, p.read_length, width)), "hits"))
    hits = hits.withColumnRenamed("at", "hit_pos").withColumn("qual", F.col("mapq"))
    hits = store(evidence.split_accept(hits, satellites, p, lengths), "accepted-hits")  # Spark plans what follows without these rules
    rows = evidence.split_evidence(evidence.split_orientation(hits))
    return rows.select(
        F.xxhash64("clip_id", "hit_pos", "hit_or", "sv_type", "l_or").alias("ev_id"), "read_name", "chrom", "sample", "library", "l_start", "l_end", "l_or", "r_start", "r_end", "r_or", "sv_type", F.col("mapq").alias("mq1"),
        F.col("hit_mapq").alias("mq2"), F.lit(0).alias("edit"), F.lit(0.0).alias("phred"), "min_delta", "max_delta", F.lit(SPLIT_MAX_DELTA).alias("conc_max"), "bp_l", "bp_r",
    )


def clustered(rows: DataFrame) -> DataFrame:
    """Members of the maximal sets of deletions, insertions, all duplications, inversions and insertion regions, with their
    evidence: one mapping for each read name and place, and each row in its first clusters only; two members at least. Split
    reads come with rows for duplications of their own; pairs stand for these as well. Members of interspersed and inverted
    duplications stand with the ends that their strands point from, and with turned strands where the copy lies to the right."""
    straight = clusters.cluster(clusters.shapes(rows.where("sv_type in ('DEL', 'INS', 'TDUP')")))
    turned = clusters.cluster(clusters.shapes(rows.where("sv_type = 'INV'")), both_sides=True, between=True)
    split = F.col("library") == "SplitRead"
    fanned = evidence.evidence_fanout(rows.where(~split & F.col("sv_type").isin("DEL", "INS", "TDUP", "INV"))).unionByName(rows.where(split))
    copied = evidence.span_caps(fanned.where("sv_type in ('INVDUP', 'INTERDUP')"))
    found = straight.unionByName(turned).unionByName(clusters.duplications(copied))
    if "pos_end" in rows.columns:
        for kind, least in (("MEI", 2), ("NUMT", 0)):
            part = clusters.regions(rows.where(F.col("sv_type").startswith(kind)), least)
            strand = F.when(F.substring("sv_type", -1, 1).cast("int") % 2 == 0, f"{kind}_F").otherwise(f"{kind}_R")
            found = found.unionByName(part.withColumns({"cluster_id": F.col("cluster_id"), "sv_type": strand}))
    members = found.join(rows.drop("chrom", "sv_type"), "ev_id")
    copy = F.col("sv_type").isin(*scoring.DUPLICATIONS)
    start, end = F.when(F.col("l_or") == "F", F.col("l_end")).otherwise(F.col("l_start")), F.when(F.col("r_or") == "F", F.col("r_end")).otherwise(F.col("r_start"))
    strand = F.when(copy & F.col("sv_type").endswith("_RIGHT"), F.when(F.col("l_or") == "F", "R").otherwise("F")).otherwise(F.col("l_or"))
    members = members.withColumns({"l_end": F.when(copy, start).otherwise(F.col("l_end")), "r_start": F.when(copy, end).otherwise(F.col("r_start")), "l_or": strand})
    members = store(clusters.read_cluster_cap(clusters.clonal_dedup(members)), "cluster-members")
    enough = members.groupBy("cluster_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("cluster_id")
    return members.join(enough, "cluster_id")


def refined_ends(bounds: DataFrame, members: DataFrame, support: DataFrame) -> DataFrame:
    """Bounds with the coordinates of agreeing split reads where there are some; adds precise."""
    kinds = bounds.select("cluster_id", "sv_type")
    better = scoring.refine(scoring.breakpoint_votes(members), support, kinds).select("cluster_id", F.col("l_end").alias("_l"), F.col("r_start").alias("_r"))
    joined = bounds.join(better, "cluster_id", "left")
    ends = [F.coalesce("_l" if c.endswith("start") else "_r", c).alias(c) for c in ENDS]
    return joined.select("cluster_id", "chrom", "sv_type", *ends, F.col("_l").isNotNull().alias("precise"))


def with_samples(bounds: DataFrame, support: DataFrame, genotypes: DataFrame) -> DataFrame:
    """What records need: bounds with rp and sr of all samples, and each sample's genotype, score, rp and sr. A sample without a
    read of the call is 0/0."""
    rows = genotypes.select("cluster_id", "sample", genotype(F.col("zygosity")).alias("gt"), "score").join(support, ["cluster_id", "sample"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    own = F.when(F.coalesce("rp", F.lit(0)) > 0, F.col("gt")).otherwise("0/0").alias("gt")
    rows = rows.select("cluster_id", F.struct("sample", own, "score", zero("rp"), zero("sr")).alias("s"))
    gathered = rows.groupBy("cluster_id").agg(F.collect_list("s").alias("samples"), F.sum("s.rp").alias("rp"), F.sum("s.sr").alias("sr"))  # a sample each
    return bounds.join(gathered, "cluster_id")


def prepared(alignments: DataFrame) -> DataFrame:
    """Alignments with the columns that the job takes, null where there are none: a mate without a chromosome of its own
    lies on its record's."""
    for c, kind in (("mate_chrom", "string"), ("cigar", "string"), ("seq", "string"), ("base_quals", "array<int>")):
        if c not in alignments.columns:
            alignments = alignments.withColumn(c, F.lit(None).cast(kind))
    return alignments.withColumn("mate_chrom", F.coalesce("mate_chrom", "chrom"))


def inserted_elements(bounds: DataFrame, members: DataFrame, elements: DataFrame) -> DataFrame:
    """cluster_id, element, element_name, element_length and where it stands of calls of mobile elements: those of most of their
    reads, and the first such element of the reference."""
    kind = F.col("repeat_type") if "repeat_type" in elements.columns else F.col("repeat_class")
    lengths = elements.select(kind.alias("element_name"), "chrom", "start_pos", "end_pos").groupBy("element_name").agg(F.min(F.struct("chrom", "start_pos", "end_pos")).alias("f"))
    lengths = lengths.select("element_name", (F.col("f.end_pos") - F.col("f.start_pos")).alias("element_length"), *[F.col(f"f.{c}").alias(to) for c, to in zip(("chrom", "start_pos", "end_pos"), resolve.ELEMENT)])
    counts = members.where("element_name is not null").groupBy("cluster_id", "element", "element_name").agg(F.count("*").alias("_n"))
    named = counts.groupBy("cluster_id").agg(F.max_by(F.struct("element", "element_name"), F.struct("_n", "element_name", "element")).alias("e")).select("cluster_id", "e.element", "e.element_name")
    return named.join(bounds.where("sv_type like 'MEI%'").select("cluster_id"), "cluster_id").join(lengths, "element_name", "left")


def call_variants(
    alignments: DataFrame, satellites: DataFrame, gaps: DataFrame, elements: DataFrame, windows: DataFrame | None, split: DataFrame | None = None, p: Params = P,
    lengths: DataFrame | None = None, pages: DataFrame | None = None, width: int = 1000,
    resolved: bool = False,
) -> DataFrame:
    """Calls with what `vcf.records` needs. alignments: see the fixture; with mate_chrom, cigar, seq and base_quals they may lie
    on several chromosomes and be clipped. windows: GC of grid windows, not looked at where pages are given; lengths: chrom, length (else all chromosomes are as long
    as the parameters say); pages: the reference, by which each base's GC goes, in which clipped parts are sought, and
    which gives records their sequences (those of imprecise calls too if `resolved`); split: evidence rows of split reads found
    elsewhere, if there are any."""
    with scratch(alignments.sparkSession) as kept:
        found = store(_call_variants(prepared(alignments), satellites, gaps, elements, windows, split, p, lengths, pages, width, resolved), "calls")
        kept.append(found.stored_at)
    return found


def _call_variants(
    alignments: DataFrame, satellites: DataFrame, gaps: DataFrame, elements: DataFrame, windows: DataFrame | None, split: DataFrame | None, p: Params, lengths: DataFrame | None, pages: DataFrame | None, width: int,
    resolved: bool,
) -> DataFrame:
    band = store(reads.valid_libraries(reads.concordance_band(reads.fragment_sample(alignments.where(reads.proper())), p.read_length)), "band")  # a row for each library
    mitochondrial, mobile, near = routed(alignments, band, satellites, elements, p, lengths)
    rows = store(evidence.evidence_filter(pair_evidence(near, band, p), satellites, gaps, p, lengths), "pair-rows")
    for more in [split] if pages is None else [split, split_reads(alignments, pages, band, satellites, p, lengths, width)]:
        if more is not None:
            rows = rows.unionByName(store(more, "split-rows"), allowMissingColumns=True)
    rows = evidence.span_caps(rows).unionByName(store(region_evidence(mobile, mitochondrial, band, p), "region-rows"), allowMissingColumns=True)
    for c in ("bp_l", "bp_r"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("int"))
    rows = store(rows, "evidence")
    members = store(clustered(rows), "members")
    bounds = store(clusters.cluster_prune(scoring.cluster_bounds(members)), "bounds")
    counted = store(depth.read_depth(alignments.where(reads.proper() & (F.col("mapq") > p.mapq))), "depth")
    libraries = alignments.select("sample", "library").distinct().join(F.broadcast(band.select("library")), "library")
    if pages is None:
        track, profile = None, depth.gc_depth(counted, windows)
    else:
        track = store(composition.base_gc(pages, width), "base-gc")
        profile = store(composition.gc_profile(counted, track, width), "profile")
    inputs = store(scoring.score_inputs(bounds, members, counted, profile, windows, band, libraries, track, width), "score-inputs")
    picked = store(scoring.set_cover(bounds, members, inputs, elements, p.support), "picked")
    support = picked.select("cluster_id", "sample", "rp", "sr")
    kept = scoring.report_filter(support, p.support).select("cluster_id")
    # The shift by which split reads meet pairs is taken back where they give the breakpoint.
    unshifted = members.withColumns({"l_end": F.coalesce("bp_l", "l_end"), "r_start": F.coalesce("bp_r", "r_start")})
    ends = refined_ends(bounds.join(kept, "cluster_id"), unshifted, support)
    found = scoring.mei_deletions(scoring.call_spans(bounds), elements)
    scored = inputs.drop("op").join(picked.select("cluster_id", "op").distinct(), "cluster_id").join(found, "cluster_id", "left")
    calls = with_samples(ends, support, scoring.genotype_likelihood(scored))
    inserted = inserted_elements(bounds, members, elements)
    calls = calls.join(found.withColumnRenamed("element", "_deleted"), "cluster_id", "left").join(inserted, "cluster_id", "left")
    calls = store(calls.withColumn("element", F.coalesce("element", "_deleted")).drop("_deleted"), "named-calls")
    barred = scoring.mei_call_filter(calls.where("sv_type like 'MEI%'"), elements, satellites).where("filter = 'mfilt'").select("cluster_id", F.lit(True).alias("filtered"))
    calls = calls.join(barred, "cluster_id", "left")
    if pages is None:
        return calls.withColumn("ref", F.lit(None).cast("string"))
    return resolve.with_sequences(calls, pages, resolved, width)
