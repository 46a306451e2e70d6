"""Scalar functions on sequences, CIGARs, flags and barcodes, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixlake.constants import KMER


def base_decode(code: Column) -> Column:
    """Letter of a 4-bit base code; what is none of the five is N."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in {1: "A", 2: "C", 4: "G", 8: "T", 15: "N"}.items() for x in kv])[code.cast("int")], F.lit("N"))


def complement(seq: Column) -> Column:
    return F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def kmer_valid(kmer: Column) -> Column:
    return kmer.rlike(f"^[ACGT]{{{KMER}}}$")


def kmer_hash(kmer: Column) -> Column:
    """Two bits a base, A C T G as 0 1 2 3."""
    return F.conv(F.translate(kmer, "ACTG", "0123"), 4, 10).cast("long")


def kmers(seq: Column) -> Column:
    """Array of (offset, kmer) of all windows of KMER bases, offsets from 0."""
    last = F.length(seq) - KMER
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.substring(seq, i + 1, F.lit(KMER)).alias("kmer"))))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two sequences of one length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(1)))


def barcode_encode(barcode: Column) -> Column:
    """Two bits a base, A C G T as 0 1 2 3; null for a missing tag or other letters."""
    return F.when(barcode.rlike("^[ACGT]+$"), F.conv(F.translate(barcode, "ACGT", "0123"), 4, 10).cast("long"))


def cigar_ops(cigar: Column) -> Column:
    """Array of (len, op)."""
    return F.zip_with(F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), 1), F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), 2), lambda n, op: F.struct(n.cast("int").alias("len"), op.alias("op")))


def soft_clipped(cigar: Column) -> Column:
    """Sum of the lengths of soft clips."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"] == "S"), F.lit(0), lambda s, x: s + x["len"])


def genotype(zygosity: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in ("0/0", "0/1", "1/0", "1/1")]), zygosity.cast("int") + 1)


def alternative_flag(flag: Column, reverse: Column, mate_reverse: Column) -> Column:
    """The flag with the strands of an alternative mapping."""
    cleared = flag.bitwiseAND(F.lit(0xFFDF)).bitwiseAND(F.lit(0xFFEF))
    return cleared.bitwiseOR(F.when(mate_reverse, 0x20).otherwise(0)).bitwiseOR(F.when(reverse, 0x10).otherwise(0))


def phred_text(quals: Column) -> Column:
    return F.array_join(F.transform(quals, lambda q: F.char(q + 33)), "")
