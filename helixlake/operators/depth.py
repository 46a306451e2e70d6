"""Read depth, GC profile and sums over spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.constants import GC_WINDOW, Params

P = Params()


def read_depth(alignments: DataFrame) -> DataFrame:
    """Read starts at each position: sparse, so only positions that have some."""
    return alignments.groupBy("sample", "chrom", "pos").agg(F.count("*").alias("n"))


def mean_depth(depth: DataFrame, chrom_length: int = P.chrom_length) -> DataFrame:
    return depth.groupBy("sample", "chrom").agg((F.sum("n") / F.lit(chrom_length)).alias("mean_depth"))


def gc_windows(dna: DataFrame, chroms: int = 4) -> DataFrame:
    """GC percent of the grid windows of the fixture: window k of a chromosome takes sequence k."""
    gc = F.round(100 * (F.length("seq") - F.length(F.translate("seq", "GC", ""))) / F.length("seq")).cast("int")
    rows = dna.select((F.col("seq_id") * GC_WINDOW).alias("start_pos"), gc.alias("gc"))
    return rows.withColumn("chrom", F.explode(F.array(*[F.lit(f"chr{k}") for k in range(1, chroms + 1)]))).select("chrom", "start_pos", "gc")


def gc_depth(depth: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean depth of a base by GC percent of its window, for each sample and chromosome; zero in bin 0. Depth is summed
    by window before it meets the grid."""
    by_window = depth.groupBy("sample", "chrom", (F.floor(F.col("pos") / GC_WINDOW) * GC_WINDOW).alias("start_pos")).agg(F.sum("n").alias("n"))
    samples = depth.select("sample", "chrom").distinct()
    grid = windows.groupBy("chrom", "gc").agg(F.count("*").alias("windows"))
    # Windows are far more bytes than what Spark plans by; the profile has a row for each sample, chromosome and percent.
    seen = by_window.join(windows.hint("merge"), ["chrom", "start_pos"]).groupBy("sample", "chrom", "gc").agg(F.sum("n").alias("n"))
    per_base = F.coalesce("n", F.lit(0)) / (F.col("windows") * GC_WINDOW)
    return samples.join(grid, "chrom").join(seen, ["sample", "chrom", "gc"], "left").select("sample", "chrom", "gc", F.when(F.col("gc") == 0, 0.0).otherwise(per_base).alias("mean_rd"))


def observed_depth(spans: DataFrame, depth: DataFrame, tile: int = 10_000) -> DataFrame:
    """Depth in [start_pos, end_pos) of every span and sample, by prefix sums: within tiles, on top of the tiles before, so
    no chromosome is summed up in one task and no span meets each of its positions."""
    kind = depth.schema["n"].dataType
    tiled = depth.withColumn("tile", F.floor(F.col("pos") / tile))
    totals = tiled.groupBy("sample", "chrom", "tile").agg(F.sum("n").alias("t"))
    before = Window.partitionBy("sample", "chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sample", "chrom", "tile", "t", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("before"))
    samples = depth.select("sample").distinct()
    ends = spans.select("span_id", "chrom", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("start_pos").alias("at")), F.struct(F.lit(1).alias("sign"), F.col("end_pos").alias("at")))).alias("e"))
    ends = ends.crossJoin(F.broadcast(samples)).select("span_id", "chrom", "sample", "e.sign", "e.at")  # a row for each sample
    # A position event: 0 for depth, 1 for the end of a span; depth at the end itself doesn't count.
    events = tiled.select("sample", "chrom", "tile", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.col("n").cast(kind).alias("n"), F.lit(None).cast(spans.schema["span_id"].dataType).alias("span_id"), F.lit(0).alias("sign"))
    events = events.unionByName(ends.select("sample", "chrom", F.floor(F.col("at") / tile).alias("tile"), "at", F.lit(0).alias("kind"), F.lit(0).cast(kind).alias("n"), "span_id", "sign"))
    upto = Window.partitionBy("sample", "chrom", "tile").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("inside", F.sum("n").over(upto)).where("kind = 0")
    # Of tiles without depth the last before them knows the sum.
    known = totals.select("sample", "chrom", "tile", "before").unionByName(totals.groupBy("sample", "chrom").agg((F.max("tile") + 1).alias("tile"), F.sum("t").alias("before")))
    gaps = Window.partitionBy("sample", "chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, 0)
    wanted = summed.select("sample", "chrom", "tile").distinct().join(known, ["sample", "chrom", "tile"], "full")
    after = totals.select("sample", "chrom", "tile", (F.col("before") + F.col("t")).alias("upto"))
    filled = wanted.join(after, ["sample", "chrom", "tile"], "left").withColumn("before", F.coalesce("before", F.last("upto", ignorenulls=True).over(gaps), F.lit(0))).select("sample", "chrom", "tile", "before")
    found = summed.join(filled, ["sample", "chrom", "tile"])
    return found.groupBy("span_id", "sample").agg(F.sum(F.col("sign") * (F.col("before") + F.col("inside"))).alias("observed_rd"))


def expected_depth(spans: DataFrame, profile: DataFrame, windows: DataFrame) -> DataFrame:
    """Sum over the bases in [start_pos, end_pos) of the profile at the GC of their grid window: whole windows by prefix
    sums, and at both ends the bases of the window that the end lies in."""
    rates = windows.join(F.broadcast(profile), ["chrom", "gc"]).select("sample", "chrom", "start_pos", "mean_rd")
    down = lambda c: F.floor(F.col(c) / GC_WINDOW) * GC_WINDOW
    whole = spans.select("span_id", "chrom", down("start_pos").alias("start_pos"), down("end_pos").alias("end_pos"))
    sums = observed_depth(whole, rates.select("sample", "chrom", F.col("start_pos").alias("pos"), (F.col("mean_rd") * GC_WINDOW).alias("n")))
    ends = F.array(*[F.struct(F.lit(sign).alias("sign"), F.col(c).alias("at")) for sign, c in ((-1, "start_pos"), (1, "end_pos"))])
    ends = spans.select("span_id", "chrom", F.explode(ends).alias("e")).select("span_id", "chrom", (F.floor(F.col("e.at") / GC_WINDOW) * GC_WINDOW).alias("start_pos"), (F.col("e.sign") * F.pmod("e.at", F.lit(GC_WINDOW))).alias("bases"))
    parts = ends.join(rates.hint("merge"), ["chrom", "start_pos"]).select("span_id", "sample", (F.col("bases") * F.col("mean_rd")).alias("e"))
    both = sums.select("span_id", "sample", F.col("observed_rd").alias("e")).unionByName(parts)
    return both.groupBy("span_id", "sample").agg(F.round(F.sum("e"), 6).alias("expected_rd"))
