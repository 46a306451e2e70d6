"""Annotation of a reference: one job from its files to stored tables, and these tables back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.constants import Params
from helixlake.operators.composition import base_gc
from helixlake.sources import files
from helixlake.stored import scratch, store

P = Params()
INTERVALS = "chrom string, start_pos int, end_pos int"
REPEATS = INTERVALS + ", strand string, repeat_type string, repeat_class string, mei_code int"


@dataclass(frozen=True)
class Annotation:
    """pages: chrom, start_pos, seq of `width` bases; track: see `composition.base_gc`; lengths: chrom, length and gc (percent of
    all bases); gaps, duplications: chrom, start_pos, end_pos; repeats: see `files.repeat_masker`."""

    width: int
    pages: DataFrame
    track: DataFrame
    lengths: DataFrame
    gaps: DataFrame
    duplications: DataFrame
    repeats: DataFrame

    @property
    def satellites(self) -> DataFrame:
        return self.repeats.where("repeat_class like '%Satellite%'")

    @property
    def elements(self) -> DataFrame:
        """Mobile elements, by the names that the parameters give them."""
        named = F.create_map(*[x for k, name in enumerate(P.mobile_elements) for x in (F.lit(k), F.lit(name))])
        return self.repeats.where("mei_code is not null and repeat_class not like '%Satellite%'").withColumn("repeat_class", named[F.col("mei_code")])


def chromosome_lengths(pages: DataFrame) -> DataFrame:
    """chrom, length and gc, the percent of G and C among all bases."""
    strong = F.length("seq") - F.length(F.translate("seq", "GC", ""))
    return pages.groupBy("chrom").agg(F.max(F.col("start_pos") + F.length("seq")).cast("int").alias("length"), F.round(100 * F.sum(strong) / F.sum(F.length("seq")), 6).alias("gc"))


def annotate(pages: DataFrame, gaps: DataFrame, duplications: DataFrame, repeats: DataFrame, width: int = 1000) -> Annotation:
    """Intervals of chromosomes that the reference doesn't have go, and so do those without a base; repeated ones are one; an
    interval over its chromosome's end ends there."""
    pages = pages.where("seq <> ''")
    lengths = chromosome_lengths(pages)

    def own(rows: DataFrame) -> DataFrame:
        cut = rows.join(lengths.select("chrom", "length"), "chrom").withColumns({"start_pos": F.greatest("start_pos", F.lit(0)), "end_pos": F.least("end_pos", "length")})
        return cut.where("start_pos < end_pos").select(*rows.columns).distinct()

    return Annotation(width, pages, base_gc(pages, width), lengths, own(gaps), own(duplications), own(repeats))


def build(spark: SparkSession, path: str, fasta: Sequence[str], gaps: Sequence[str] = (), duplications: Sequence[str] = (), repeats: Sequence[str] = (), width: int = 1000) -> Annotation:
    """Reads FASTA, BED and RepeatMasker files and writes their tables under `path`, each in ranges of chromosome and place, so
    that a scan of some chromosomes skips the files and row groups of the others."""
    none = lambda schema: spark.createDataFrame([], schema)
    with scratch(spark):
        pages = store(files.fasta(spark, *fasta, width=width).select("chrom", F.col("start_pos").cast("int").alias("start_pos"), "seq"), "pages")
        made = annotate(
            pages, files.bed(spark, *gaps) if gaps else none(INTERVALS), files.bed(spark, *duplications) if duplications else none(INTERVALS),
            files.repeat_masker(spark, *repeats) if repeats else none(REPEATS), width,
        )
        for name, place in (("pages", "start_pos"), ("track", "page"), ("gaps", "start_pos"), ("duplications", "start_pos"), ("repeats", "start_pos")):
            getattr(made, name).repartitionByRange("chrom", place).sortWithinPartitions("chrom", place).write.parquet(f"{path}/{name}")
        made.lengths.withColumn("width", F.lit(width)).coalesce(1).write.parquet(f"{path}/lengths")  # a row for each chromosome
    return load(spark, path)


def load(spark: SparkSession, path: str, chroms: Sequence[str] = ()) -> Annotation:
    """The tables that `build` wrote, of the named chromosomes (of all, if none are named)."""
    keep = F.col("chrom").isin(*chroms) if chroms else F.lit(True)
    read = {name: spark.read.parquet(f"{path}/{name}").where(keep) for name in ("pages", "track", "lengths", "gaps", "duplications", "repeats")}
    first = read["lengths"].select("width").first()
    return Annotation(width=first.width if first else 1000, **{**read, "lengths": read["lengths"].drop("width")})
