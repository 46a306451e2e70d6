"""Variant records with their samples, totals, and files of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.operators.scoring import DUPLICATIONS, REGIONS

#: Symbolic alleles, types and keys of the format.
ALLELES = {"DEL": "<DEL>", "INS": "<INS>", "INV": "<INV>", "TDUP": "<DUP:TANDEM>", "NUMT_F": "<INS:MT>", "NUMT_R": "<INS:MT>", **dict.fromkeys(DUPLICATIONS, "<DUP:ISP>")}
TYPES = {"DEL": "DEL", "INS": "INS", "INV": "INV", "TDUP": "DUP:TANDEM", "NUMT_F": "INS:MT", "NUMT_R": "INS:MT", "INVDUP_LEFT": "DUP:ISP;ISINV", "INVDUP_RIGHT": "DUP:ISP;ISINV", "INTERDUP_LEFT": "DUP:ISP", "INTERDUP_RIGHT": "DUP:ISP"}
HEADER = [
    "##fileformat=VCFv4.3",
    *[f'##INFO=<ID={key},Number={n},Type={kind},Description="{text}">' for key, n, kind, text in (
        ("END", 1, "Integer", "End position"), ("SVLEN", 1, "Integer", "Length"), ("SVTYPE", 1, "String", "Type"), ("MEINFO", 1, "String", "Class of the mobile element"),
        ("POS2", 1, "Integer", "Place of the source of an interspersed duplication"), ("ISINV", 0, "Flag", "The copy is inverted"), ("RPSUP", 1, "Integer", "Read pairs of all samples"),
        ("SRSUP", 1, "Integer", "Split reads of all samples"), ("CIPOS", 2, "Integer", "Confidence interval around POS"), ("CIEND", 2, "Integer", "Confidence interval around END"),
        ("IMPRECISE", 0, "Flag", "Without a precise breakpoint"), ("PRECISE", 0, "Flag", "With a precise breakpoint"),
    )],
    '##FILTER=<ID=LowQual,Description="No support by read pairs">', '##FILTER=<ID=mfilt,Description="An insertion on an element of its own class">',
    *[f'##FORMAT=<ID={key},Number=1,Type={kind},Description="{text}">' for key, kind, text in (("GT", "String", "Genotype"), ("CNVL", "Float", "Score"), ("RP", "Integer", "Read pairs"), ("SR", "Integer", "Split reads"))],
    *[f'##ALT=<ID={a.strip("<>")},Description="{a.strip("<>")}">' for a in sorted(set(ALLELES.values()))],
]
FORMAT = "GT:CNVL:RP:SR"


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("sv_type")]


def records(calls: DataFrame) -> DataFrame:
    """Columns of a variant record. calls: cluster_id, chrom, sv_type, inner_start, outer_start, inner_end, outer_end; rp,
    sr (of all samples); precise; element and element_length (class and length of the mobile element that is inserted or
    deleted, or null); filtered (null: no); ref (the base at the position, or null); alt, if there is such a column (a sequence, or
    null for a symbolic allele: see `resolve.with_sequences`); samples (array of sample, gt, score,
    rp, sr)."""
    kind, i_s, o_s, i_e, o_e = (F.col(c) for c in ("sv_type", "inner_start", "outer_start", "inner_end", "outer_end"))
    left, right, mobile, region = kind.endswith("_LEFT"), kind.endswith("_RIGHT"), kind.startswith("MEI"), kind.isin(*REGIONS)
    start = F.when(kind.isin("DEL", "INS"), i_s).when(left, i_e).otherwise(o_s)
    inner = F.abs(i_e - i_s + 1)
    size = F.when(kind == "TDUP", F.abs(o_e - o_s + 1)).when(right, F.abs(i_s - o_s + 1)).when(left, F.abs(i_e - o_e + 1)).when(mobile, F.coalesce("element_length", F.abs(i_e - i_s)) + F.abs(i_s - o_s))
    size = size.when(region, F.abs(o_e - i_e + 1)).otherwise(inner)
    end = F.when(mobile, o_s + size).when(right, i_s).when(kind.isin("INV", "TDUP") | left, o_e).otherwise(i_e)
    of_element = lambda prefix, plain: F.when(mobile, F.concat(F.lit(f"{prefix}INS:ME:"), F.coalesce("element", F.lit(".")))).when((kind == "DEL") & F.col("element").isNotNull(), F.concat(F.lit(f"{prefix}DEL:ME:"), "element")).otherwise(plain)
    alt = of_element("<", _lookup(ALLELES))
    alt = F.when(alt.endswith(">"), alt).otherwise(F.concat(alt, F.lit(">")))
    if "alt" in calls.columns:
        alt = F.coalesce("alt", alt)
    interval = lambda to, back: F.concat(F.lit("CIEND=0,"), to, F.lit(";CIPOS=-"), back, F.lit(",0;IMPRECISE"))
    info = F.concat_ws(
        ";", F.concat(F.lit("END="), end + 1), F.concat(F.lit("SVLEN="), F.when(kind == "DEL", -size).otherwise(size)), F.when(mobile, F.concat(F.lit("MEINFO="), F.col("element"))),
        F.when(left, F.concat(F.lit("POS2="), o_s)).when(right, F.concat(F.lit("POS2="), o_e)), F.concat(F.lit("RPSUP="), "rp"), F.concat(F.lit("SRSUP="), "sr"),
        F.when(F.col("precise"), "CIEND=0,0;CIPOS=0,0;PRECISE").otherwise(interval(o_e - i_e, i_s - o_s)), F.concat(F.lit("SVTYPE="), of_element("", _lookup(TYPES))),
    )
    bad = (F.col("rp") <= 0) | F.coalesce("filtered", F.lit(False))
    own = F.transform(F.array_sort("samples"), lambda s: F.format_string("%s:%.6f:%d:%d", s["gt"], s["score"], s["rp"], s["sr"]))
    prefix = F.when(region, F.lower(F.substring_index("sv_type", "_", 1))).when(kind.contains("DUP"), "dup").otherwise(F.lower("sv_type"))
    return calls.select(
        "chrom", (start + 1).cast("int").alias("pos"), F.concat(F.lit("sv_"), prefix, F.lit("_"), "cluster_id").alias("id"), F.coalesce("ref", F.lit(".")).alias("ref"), alt.alias("alt"),
        F.lit(255).alias("qual"), F.when(bad & region, "mfilt").when(bad, "LowQual").otherwise("PASS").alias("filter"), info.alias("info"), F.lit(FORMAT).alias("format"), F.array_join(own, "\t").alias("samples"),
    )


def stats(records: DataFrame) -> DataFrame:
    kind, length = F.regexp_extract("info", "SVTYPE=([^;]+)", 1), F.regexp_extract("info", "SVLEN=(-?[0-9]+)", 1).cast("long")
    return records.groupBy(kind.alias("sv_type")).agg(F.count("*").alias("n"), F.sum(F.abs(length)).alias("total_length"))


def lines(records: DataFrame, contigs: dict[str, int], samples: list[str]) -> DataFrame:
    """The file's lines in order: part files one after the other are one valid file."""
    spark = records.sparkSession
    head = [*HEADER, *[f"##contig=<ID={c},length={n}>" for c, n in contigs.items()], "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    first = spark.createDataFrame([(k, "", 0, line) for k, line in enumerate(head)], "rank int, chrom string, pos int, value string")
    line = F.concat_ws("\t", "chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "samples")
    body = records.select(F.lit(len(head)).alias("rank"), "chrom", "pos", line.alias("value"))
    return first.unionByName(body).orderBy("rank", "chrom", "pos", "value").select("value")


def write(records: DataFrame, contigs: dict[str, int], samples: list[str], path: str) -> None:
    lines(records, contigs, samples).write.text(path)
