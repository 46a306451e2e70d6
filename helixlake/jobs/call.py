"""The calling job over files: `python -m helixlake.jobs.call build ...`, then `python -m helixlake.jobs.call call ...`."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.constants import Params
from helixlake.operators import reads, vcf
from helixlake.operators.calling import call_variants
from helixlake.sources import annotation, bam, files

P = Params()


def alignment_files(spark: SparkSession, *paths: str, chroms: Sequence[str] = ()) -> DataFrame:
    """Records of SAM and BAM files (what ends in .bam) as the calling job takes them, of `chroms` only where given: a read's
    name in its library numbers its pair."""
    packed = [path for path in paths if path.endswith(".bam")]
    plain = [path for path in paths if path not in packed]
    found = [bam.bam(spark, *packed, chroms=list(chroms) or None)] if packed else []
    found += [files.sam(spark, *plain)] if plain else []
    rows = reduce(DataFrame.unionByName, found)
    if chroms:
        rows = rows.where(F.col("chrom").isin(*chroms))
    known = lambda c: F.nullif(c, F.lit("*")).alias(c)
    rid = F.xxhash64("sample", "library", "read_name").alias("rid")
    return rows.select("read_name", rid, "chrom", known("mate_chrom"), "sample", "library", "pos", "mate_pos", "flag", "isize", "mapq", F.coalesce("nm", F.lit(0)).alias("nm"), known("cigar"), known("seq"), "base_quals")


def fragment_histogram(alignments: DataFrame) -> DataFrame:
    """How many fragments of each size the libraries' samples have."""
    return reads.fragment_sample(alignments.where(reads.proper())).groupBy("library", "isize").agg(F.count("*").alias("n"))


def call_files(
    spark: SparkSession, paths: Sequence[str], annotated: str, out: str, p: Params = P, chroms: Sequence[str] = (), resolved: bool = False, mobile: bool = True, clipped: bool = True, histogram_only: bool = False
) -> None:
    """Calls the variants of alignment files by a stored annotation and writes under `out`: `histogram` (fragment sizes),
    `calls` (lines of a VCF file, in order over its parts) and `totals` (calls and bases by type)."""
    alignments = alignment_files(spark, *paths, chroms=chroms)
    fragment_histogram(alignments).orderBy("library", "isize").write.option("header", True).csv(f"{out}/histogram")
    if histogram_only:
        return
    known = annotation.load(spark, annotated)
    elements = known.elements if mobile else known.elements.limit(0)
    if not clipped:
        alignments = alignments.withColumn("seq", F.lit(None).cast("string"))
    # Mates may lie in elements of chromosomes that aren't called.
    pages = known.pages.where(F.col("chrom").isin(*chroms)) if chroms else known.pages
    calls = call_variants(alignments, known.satellites, known.gaps, elements, None, None, p, known.lengths.select("chrom", "length"), pages, known.width, resolved)
    records = vcf.records(calls)
    contigs = {r.chrom: r.length for r in known.lengths.orderBy("chrom").collect()}  # a row for each chromosome
    samples = [r.sample for r in calls.select(F.explode("samples.sample").alias("sample")).distinct().orderBy("sample").collect()]
    vcf.write(records, contigs, samples, f"{out}/calls")
    vcf.stats(records).coalesce(1).write.option("header", True).csv(f"{out}/totals")


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    make = jobs.add_parser("build", help="store the annotation of a reference")
    make.add_argument("--ref", nargs="+", required=True, help="FASTA files")
    for name in ("gaps", "dups", "reps"):
        make.add_argument(f"--{name}", nargs="*", default=[])
    call = jobs.add_parser("call", help="call the variants of alignment files")
    call.add_argument("--input", nargs="+", required=True, help="SAM files, and BAM files, whose names end in .bam")
    call.add_argument("--annotation", required=True, help="where build has stored it")
    call.add_argument("--mq", type=int, default=P.mapq)
    call.add_argument("--rp", type=int, default=P.support)
    call.add_argument("--read-length", type=int, default=P.read_length)
    call.add_argument("--chroms", nargs="*", default=[])
    for name in ("resolved", "no-mei", "no-soft-clip", "hist-only"):
        call.add_argument(f"--{name}", action="store_true")
    for job in (make, call):
        job.add_argument("--out", required=True)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"variants-{a.job}").getOrCreate()
    if a.job == "build":
        annotation.build(spark, a.out, a.ref, a.gaps, a.dups, a.reps)
    else:
        p = replace(P, mapq=a.mq, support=a.rp, read_length=a.read_length)
        call_files(spark, a.input, a.annotation, a.out, p, a.chroms, a.resolved, not a.no_mei, not a.no_soft_clip, a.hist_only)


if __name__ == "__main__":
    main()
