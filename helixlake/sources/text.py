"""Readers of the text formats around alignments: headers, DIVET rows, FASTQ, VCF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIVET = ["read_name", "chrom", "l_start", "l_end", "l_or", "chrom2", "r_start", "r_end", "r_or", "sv_type", "edit", "avg_qual", "phred"]
NUMBERS = {"l_start": "int", "l_end": "int", "r_start": "int", "r_end": "int", "edit": "double", "avg_qual": "double", "phred": "double"}


def read_groups(lines: DataFrame) -> DataFrame:
    """Library and sample of the @RG lines of a header (file, line); Lib1 where there is no ID."""
    part = lambda tag: F.nullif(F.regexp_extract("line", f"\\t{tag}:([^\\t]+)", 1), F.lit(""))
    return lines.where(F.col("line").startswith("@RG")).select("file", F.coalesce(part("ID"), F.lit("Lib1")).alias("library"), part("SM").alias("sample"))


def divet(lines: DataFrame) -> DataFrame:
    """Thirteen fields between blanks or tabs; blank lines are skipped. A line with other fields is no row of the format:
    that is an error, not a row less."""
    fields = F.split(F.trim(F.regexp_replace("line", "[ \\t\\r\\n]+", " ")), " ")
    odd = F.raise_error(F.concat(F.lit("not a row of thirteen fields: "), "line"))
    rows = lines.where(F.trim("line") != "").select(F.when(F.size(fields) == len(DIVET), fields).otherwise(odd.cast("array<string>")).alias("f"))
    return rows.select(*[F.col("f")[k].cast(NUMBERS.get(name, "string")).alias(name) for k, name in enumerate(DIVET)])


def fastq(rows: DataFrame) -> DataFrame:
    """Records of four lines (file, line_no from 0, line)."""
    at = (F.col("line_no") % 4).cast("int")
    pick = lambda k: F.max(F.when(at == k, F.col("line")))
    return rows.groupBy("file", F.floor(F.col("line_no") / 4).alias("record")).agg(F.expr("substring(max(case when line_no % 4 = 0 then line end), 2)").alias("qname"), pick(1).alias("seq"), pick(3).alias("qual"))


def fastq_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of two files by name without its /1 or /2."""
    name = F.regexp_replace("qname", "/[12]$", "")
    a = first.select(name.alias("name"), F.col("seq").alias("seq1"))
    return a.join(second.select(name.alias("name"), F.col("seq").alias("seq2")), "name")


def vcf_to_bed(records: DataFrame) -> DataFrame:
    return records.select("chrom", (F.col("pos") - 1).alias("start_pos"), F.regexp_extract("info", "(?:^|;)END=([0-9]+)", 1).cast("int").alias("end_pos"), F.regexp_extract("info", "SVTYPE=([^;]+)", 1).alias("sv_type"))
