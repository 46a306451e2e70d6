"""GC of each base's own window, and what the depth of a span should be by it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.constants import GC_WINDOW
from helixlake.operators.depth import observed_depth


WINDOWS = T.StructType([T.StructField("gc", T.ArrayType(T.ByteType())), T.StructField("classes", T.ArrayType(T.ByteType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(WINDOWS)
def _windows(bases: pd.Series, own: pd.Series) -> pd.DataFrame:
    """Of each page: the percent of its bases' windows, and how many bases have each percent. bases: the page and what follows
    it, as far as its last window reaches; own: how many of these are the page's."""
    found = []
    for text, n in zip(bases, own):
        codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        upto = np.concatenate([[0], np.cumsum((codes == ord("G")) | (codes == ord("C")))])
        first = np.arange(n)
        last = np.minimum(first + GC_WINDOW, len(codes))
        gc = (200 * (upto[last] - upto[first]) + last - first) // (2 * (last - first))  # halves go up
        classes, counts = np.unique(gc, return_counts=True)
        found.append((gc.astype(np.int8), classes.astype(np.int8), counts.astype(np.int32)))
    return pd.DataFrame(found, columns=["gc", "classes", "counts"])


def base_gc(pages: DataFrame, width: int = 1000) -> DataFrame:
    """chrom, page, gc (the GC percent of the window that begins at each base of the page), and classes and counts (how many of
    these bases have each percent). pages: chrom, start_pos, seq of `width` bases, upper case. A window that a chromosome's end
    cuts takes the bases that are there. A page gets the bases after it from the pages that follow, a few rows each."""
    reach = -(-(GC_WINDOW - 1) // width)
    page = F.floor(F.col("start_pos") / width)
    # Back to the k-th page before this one go the bases that its windows still reach.
    parts = [F.struct(page.alias("page"), F.lit(0).alias("k"), F.col("seq").alias("s"))]
    parts += [F.struct((page - k).alias("page"), F.lit(k).alias("k"), F.substring("seq", 1, GC_WINDOW - 1 - (k - 1) * width).alias("s")) for k in range(1, reach + 1)]
    dealt = pages.where("seq <> ''").select("chrom", F.explode(F.array(*parts)).alias("p")).where("p.page >= 0")
    joined = dealt.groupBy("chrom", "p.page").agg(F.array_sort(F.collect_list(F.struct("p.k", "p.s"))).alias("parts")).where("parts[0].k = 0")
    text = joined.select("chrom", "page", F.array_join(F.transform("parts", lambda x: x["s"]), "").alias("bases"), F.length(F.col("parts")[0]["s"]).alias("own"))
    return text.withColumn("w", _windows("bases", "own")).select("chrom", "page", "w.gc", "w.classes", "w.counts")


def _by_class(track: DataFrame) -> DataFrame:
    """chrom, page, gc and bases: of each page, a row for each percent that it has."""
    return track.select("chrom", "page", F.explode(F.arrays_zip("classes", "counts")).alias("c")).select("chrom", "page", F.col("c.classes").cast("int").alias("gc"), F.col("c.counts").alias("bases"))


def _at(track: DataFrame, rows: DataFrame, place: str, width: int) -> DataFrame:
    """rows (with chrom), with the percent at their place; without those that lie outside the reference."""
    paged = rows.withColumns({"page": F.floor(F.col(place) / width), "_off": F.pmod(F.col(place), F.lit(width)).cast("int")})
    joined = paged.join(track.select("chrom", "page", F.col("gc").alias("_gc")), ["chrom", "page"])
    return joined.withColumn("gc", F.get("_gc", F.col("_off")).cast("int")).where("gc is not null").drop("page", "_off", "_gc")


def gc_profile(depth: DataFrame, track: DataFrame, width: int = 1000) -> DataFrame:
    """Mean depth of a base by the GC percent of its window, for each sample and chromosome; zero for percent 0."""
    bases = _by_class(track).groupBy("chrom", "gc").agg(F.sum("bases").alias("bases"))
    reads = _at(track, depth, "pos", width).groupBy("sample", "chrom", "gc").agg(F.sum("n").alias("n"))
    all_of = depth.select("sample", "chrom").distinct().join(bases, "chrom").join(reads, ["sample", "chrom", "gc"], "left")
    return all_of.select("sample", "chrom", "gc", F.when(F.col("gc") == 0, 0.0).otherwise(F.coalesce("n", F.lit(0)) / F.col("bases")).alias("mean_rd"))


def expected_depth(spans: DataFrame, profile: DataFrame, track: DataFrame, width: int = 1000) -> DataFrame:
    """Sum over the bases in [start_pos, end_pos) of the profile at the GC of their own windows. Whole pages come from prefix
    sums over pages; at both ends the bases of a page before the end are counted by class. Bases outside the reference and spans
    of samples without a profile there give nothing."""
    rates = _by_class(track).join(profile, ["chrom", "gc"]).groupBy("sample", "chrom", (F.col("page") * width).alias("pos")).agg(F.sum(F.col("bases") * F.col("mean_rd")).alias("n"))
    down = lambda c: (F.floor(F.col(c) / width) * width).alias(c)
    whole = observed_depth(spans.select("span_id", "chrom", down("start_pos"), down("end_pos")), rates, 100 * width)
    ends = F.array(*[F.struct(F.lit(sign).alias("sign"), F.col(c).alias("at")) for sign, c in ((-1, "start_pos"), (1, "end_pos"))])
    ends = spans.select("span_id", "chrom", F.explode(ends).alias("e")).select("span_id", "chrom", "e.sign", F.floor(F.col("e.at") / width).alias("page"), F.pmod("e.at", F.lit(width)).cast("int").alias("off"))
    before = ends.where("off > 0").join(track.select("chrom", "page", "gc"), ["chrom", "page"])
    counted = before.select("span_id", "chrom", "sign", F.explode(F.slice("gc", 1, F.col("off"))).alias("gc")).groupBy("span_id", "chrom", F.col("gc").cast("int").alias("gc")).agg(F.sum("sign").alias("bases"))
    parts = counted.join(profile, ["chrom", "gc"]).select("span_id", "sample", (F.col("bases") * F.col("mean_rd")).alias("e"))
    both = whole.select("span_id", "sample", F.col("observed_rd").alias("e")).unionByName(parts)
    return both.groupBy("span_id", "sample").agg(F.round(F.sum("e"), 6).alias("expected_rd"))


def rate_at(places: DataFrame, profile: DataFrame, track: DataFrame, width: int = 1000) -> DataFrame:
    """places (with chrom and breakpoint), for each sample, with the profile's mean_rd at the breakpoint."""
    return _at(track, places, "breakpoint", width).join(profile, ["chrom", "gc"])
