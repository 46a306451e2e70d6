"""Library statistics, record filters, classification, mate assembly and geometry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.constants import BAND_SIGMAS, FRAGMENT_SAMPLE, MAX_INVERSION, MEI_DISTANCE, MIN_INSERT, PROPER_MASK, Params
from helixlake.functions.sequence import cigar_ops
from helixlake.operators.ranges import free_name, overlap_filter, overlap_join

P = Params()


def proper() -> Column:
    return F.col("flag").bitwiseAND(F.lit(PROPER_MASK)) == 1


def bit(value: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(value)) != 0


def proper_filter(alignments: DataFrame) -> DataFrame:
    return alignments.where(proper())


def first_of_library(rows: DataFrame, limit: int, width: int = 10_000) -> DataFrame:
    """The first `limit` rows of each library by rid. Counts of rid ranges tell which ranges can hold them, so that only
    those are ranked."""
    rows = rows.withColumn("_range", F.floor(F.col("rid") / width))
    counts = rows.groupBy("library", "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("library").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < limit).select("library", "_range")
    rank = F.row_number().over(Window.partitionBy("library").orderBy("rid"))
    return rows.join(ranges, ["library", "_range"]).withColumn("rank", rank).where(F.col("rank") <= limit).drop("_range")


def fragment_sample(alignments: DataFrame, limit: int = FRAGMENT_SAMPLE) -> DataFrame:
    inward = alignments.where((F.col("isize") > 0) & ~bit(0x10) & bit(0x20))
    return first_of_library(inward.select("library", "rid", "isize"), limit)


def lower_median(sample: DataFrame) -> DataFrame:
    """The element below the middle: number n div 2 of the sorted values, from 1 (the only one where there is one)."""
    sizes = sample.groupBy("library", "isize").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("library").orderBy("isize")
    ranked = sizes.select("library", "isize", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy("library")).alias("total"))
    return ranked.where("upto >= greatest(1, total div 2)").groupBy("library").agg(F.min("isize").alias("median"), F.max("total").alias("n"))


def trimmed_stats(sample: DataFrame) -> DataFrame:
    """Mean of the sizes up to twice the median, and their deviation from deviations cut to whole numbers."""
    kept = sample.join(F.broadcast(lower_median(sample)), "library").where("isize <= 2 * median")  # a row for each library
    mean = kept.groupBy("library").agg(F.avg("isize").alias("mean"), F.max("median").alias("median"))
    cut = F.pow((F.col("isize") - F.col("mean")).cast("int"), F.lit(2))
    return kept.drop("median").join(F.broadcast(mean), "library").groupBy("library", "median", "mean").agg(F.sqrt(F.avg(cut)).alias("std"))


def concordance_band(sample: DataFrame, read_length: int = P.read_length) -> DataFrame:
    low = F.greatest(F.lit(0), (F.col("mean") - BAND_SIGMAS * F.col("std")).cast("int"))
    high = (F.col("mean") + BAND_SIGMAS * F.col("std")).cast("int")
    band = trimmed_stats(sample).withColumn("conc_min", low).withColumn("conc_max", high)
    delta = F.col("conc_max") - 2 * read_length
    return band.withColumn("min_delta", F.greatest(F.lit(0), F.col("conc_min") - 2 * read_length)).withColumn("max_delta", F.when(delta < 0, 20).otherwise(delta))


def fragment_histogram(sample: DataFrame) -> DataFrame:
    return sample.groupBy("library", "isize").agg(F.count("*").alias("n"))


PAIR_CLASS = """case when flag & 1 = 0 then 'CONC' when flag & 12 != 0 then 'UNMAPPED'
  when flag & 48 in (0, 48) then 'INV'
  when pos <= mate_pos and flag & 48 = 16 then 'TDUP' when pos > mate_pos and flag & 48 = 32 then 'TDUP'
  when abs(isize) < conc_min then 'INS' when abs(isize) > conc_max then 'DEL' else 'CONC' end"""
PAIR_CLASS_INTERCHROMOSOMAL = PAIR_CLASS.replace("when pos <= mate_pos", "when chrom != mate_chrom then 'INTERCHR' when pos <= mate_pos", 1)


def classify(alignments: DataFrame, band: DataFrame, interchromosomal: bool = False) -> DataFrame:
    """Adds `class`; the order of the tests is part of its meaning."""
    rule = PAIR_CLASS_INTERCHROMOSOMAL if interchromosomal else PAIR_CLASS
    return alignments.join(F.broadcast(band.select("library", "conc_min", "conc_max")), "library").withColumn("class", F.expr(rule))


def with_length(rows: DataFrame, lengths: DataFrame | None, p: Params = P) -> DataFrame:
    """Adds _length, that of the row's chromosome. lengths: chrom, length; chromosomes that it doesn't have go."""
    if lengths is None:
        return rows.withColumn("_length", F.lit(p.chrom_length))
    return rows.join(F.broadcast(lengths.select("chrom", F.col("length").alias("_length"))), "chrom")  # a row for each chromosome


def same_chromosome(rows: DataFrame) -> Column:
    """Whether the mate lies on the record's own chromosome: so without a column mate_chrom."""
    return F.col("mate_chrom") == F.col("chrom") if "mate_chrom" in rows.columns else F.lit(True)


def _at_mate(rows: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What found makes of the rows while chrom is the mate's chromosome."""
    if "mate_chrom" not in rows.columns:
        return found(rows)
    own = free_name(rows.columns, "_own_chrom")
    return found(rows.withColumn(own, F.col("chrom")).withColumn("chrom", F.col("mate_chrom"))).withColumn("chrom", F.col(own)).drop(own)


def accept(alignments: DataFrame, band: DataFrame, satellites: DataFrame, p: Params = P, lengths: DataFrame | None = None) -> DataFrame:
    """Proper records above the mapping quality, not too far apart nor too close (on one chromosome), with neither end on a
    satellite."""
    rows = with_length(alignments.join(F.broadcast(band.select("library", "conc_max")), "library"), lengths, p)
    near = same_chromosome(rows) & (F.abs("isize") < MIN_INSERT)
    rows = rows.where(proper() & (F.col("mapq") > p.mapq) & (F.abs(F.col("pos") - F.col("mate_pos")) < F.col("_length") - 2 * F.col("conc_max")) & ~near).drop("conc_max", "_length")
    rows = rows.withColumn("_end", F.col("pos") + p.read_length).withColumn("_mate_end", F.col("mate_pos") + p.read_length)
    rows = overlap_filter(rows, satellites, ("pos", "_end"), ("start_pos", "end_pos"), anti=True)
    return _at_mate(rows, lambda df: overlap_filter(df, satellites, ("mate_pos", "_mate_end"), ("start_pos", "end_pos"), anti=True)).drop("_end", "_mate_end")


def numt(alignments: DataFrame) -> DataFrame:
    """Reads whose mate, but not they themselves, lies on the mitochondrion."""
    mito = lambda c: F.col(c).contains("MT") | F.col(c).contains("chrM")
    return alignments.where(mito("mate_chrom") & ~mito("chrom")).withColumn("numt_type", F.when(bit(0x20), "R").otherwise("F"))


def mei(alignments: DataFrame, elements: DataFrame, p: Params = P) -> DataFrame:
    """Reads whose mate lies inside a mobile element (the first by start, end and code), with the type of their pairing. Each
    place of a mate asks for its element once, however many reads have their mates there."""
    place = F.col("mate_chrom") if "mate_chrom" in alignments.columns else F.col("chrom")
    places = alignments.select(place.alias("chrom"), "mate_pos").distinct().withColumn("_mate_end", F.col("mate_pos") + p.read_length)
    found = overlap_join(places, elements, ("mate_pos", "_mate_end"), ("start_pos", "end_pos"), width=500).where("r_start_pos <= mate_pos and _mate_end <= r_end_pos")
    kind = F.col("r_repeat_type") if "repeat_type" in elements.columns else F.col("r_repeat_class")
    key = F.struct("r_start_pos", "r_end_pos", "r_mei_code", "r_strand", F.col("r_repeat_class").alias("element"), kind.alias("element_name"))
    columns = [c for c in alignments.columns]
    first = found.groupBy(F.col("chrom").alias("_mate_chrom"), F.col("mate_pos").alias("_mate_pos")).agg(F.min(key).alias("e"))
    one = alignments.withColumn("_place", place).join(first, (F.col("_place") == F.col("_mate_chrom")) & (F.col("mate_pos") == F.col("_mate_pos")))
    opposite = (~bit(0x20) & (F.col("e.r_strand") == "-")) | (bit(0x20) & (F.col("e.r_strand") == "+"))
    return one.select(*columns, F.col("e.r_mei_code").alias("mei_code"), (2 * F.col("e.r_mei_code") + F.when(opposite, 0).otherwise(1)).alias("mei_type"), F.col("e.r_start_pos").alias("element_start"), "e.element", "e.element_name")


ROUTE = f"""case when mate_chrom like '%MT%' or mate_chrom like '%chrM%' then 'NUMT'
  when in_element and (chrom != mate_chrom or abs(pos - mate_pos) > {MEI_DISTANCE}) then 'MEI'
  when chrom = mate_chrom and class not in ('INV', 'CONC', 'UNMAPPED') then 'PAIR'
  when chrom = mate_chrom and class = 'INV' and abs(pos - mate_pos) < {MAX_INVERSION} then 'INVERSION' else 'NONE' end"""


def route(classified: DataFrame) -> DataFrame:
    """Where a record's evidence goes: NUMT before MEI before pairs. Needs class, in_element and mate_chrom."""
    return classified.withColumn("route", F.expr(ROUTE))


def insert_size() -> Column:
    """From positions and strands of l_pos, r_pos, l_or, r_or and read_length."""
    return F.expr("case concat(l_or, r_or) when 'FR' then r_pos + read_length - l_pos when 'RF' then r_pos - l_pos - read_length else r_pos - l_pos end")


def mate_join(alignments: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each pair of a left and a right mate of a name in a library, on one chromosome; equal positions and single
    mates go. more: columns of either mate, which get 1 and 2 behind their names."""
    keys = ["sample", "library", "read_name", "chrom"]
    alignments = alignments.where(same_chromosome(alignments))
    own = lambda k: [F.col(c).alias(f"{c}{k}") for c in more]
    left = alignments.where("pos < mate_pos").select(*keys, "rid", F.col("pos").alias("pos1"), F.col("flag"), "isize", F.col("mapq").alias("mq1"), F.col("nm").alias("nm1"), *own(1))
    right = alignments.where("pos > mate_pos").select(*keys, F.col("pos").alias("pos2"), F.col("mapq").alias("mq2"), F.col("nm").alias("nm2"), *own(2))
    strand = lambda b: F.when(bit(b), "R").otherwise("F")
    return left.join(right, keys).select(*keys, "rid", "pos1", "pos2", strand(0x10).alias("or1"), strand(0x20).alias("or2"), "flag", "isize", "mq1", "mq2", (F.col("nm1") + F.col("nm2")).alias("edit"), *[f"{c}{k}" for c in more for k in (1, 2)])


def clips(cigar: Column) -> tuple[Column, Column]:
    """Lengths of a leading and a trailing soft clip."""
    ops = cigar_ops(cigar)
    return tuple(F.coalesce(F.when(F.try_element_at(ops, F.lit(at))["op"] == "S", F.try_element_at(ops, F.lit(at))["len"]), F.lit(0)) for at in (1, -1))


def clipped_ends(pos: Column, cigar: Column, read_length: int = P.read_length) -> tuple[Column, Column]:
    """Start after a leading soft clip, and end before a trailing one."""
    ops = cigar_ops(cigar)
    clip = lambda at: F.when(F.element_at(ops, at)["op"] == "S", F.element_at(ops, at)["len"]).otherwise(0)
    return pos + clip(1), pos + read_length - clip(-1)


def chromosome_range(rows: DataFrame, order: list[str], first: str, last: str, barred: str = "GL000220") -> DataFrame:
    """Rows of the chromosomes from first to last in the given order, without those that have `barred` in their name."""
    wanted = order[order.index(first) : order.index(last) + 1]
    return rows.where(F.col("chrom").isin(*wanted) & ~F.col("chrom").contains(barred))


def valid_libraries(band: DataFrame) -> DataFrame:
    """Libraries none of whose statistics is missing or below zero."""
    return band.where(" and ".join(f"coalesce({c} >= 0, false)" for c in ("median", "mean", "std", "conc_min", "conc_max")))


def named_alike(chromosomes: DataFrame, annotation: DataFrame) -> DataFrame:
    """chrom of the alignments, and the name of the same chromosome in the annotation. chromosomes: chrom; annotation: name.
    Both have a row for each chromosome."""
    return chromosomes.join(F.broadcast(annotation), F.col("chrom") == F.col("name")).select("chrom", "name")


def pair_geometry(pairs: DataFrame, read_length: int = P.read_length) -> DataFrame:
    """Ends less trailing clips, starts after leading ones; the end is fixed before the start moves. Needs lead1, trail1,
    lead2, trail2."""
    return pairs.select(
        "read_name", "chrom", (F.col("pos1") + F.col("lead1")).alias("l_start"), (F.col("pos1") + read_length - F.col("trail1") - 1).alias("l_end"),
        (F.col("pos2") + F.col("lead2")).alias("r_start"), (F.col("pos2") + read_length - F.col("trail2") - 1).alias("r_end"), "edit",
    )
