"""Interval joins as equi-joins on bins, and islands of overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.stored import store


def free_name(taken: list[str], name: str) -> str:
    """A column name like `name` that none of `taken` is, whatever the case of its letters."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], width: int = 5_000, right_columns: list[str] | None = None) -> DataFrame:
    """All pairs of rows on one chrom whose closed intervals overlap. Both sides are dealt to the bins that they touch; a
    pair counts in the bin where its later start lies, so once. The right side's columns get the prefix `r_`."""
    names = right_columns or [c for c in right.columns if c != "chrom"]
    if clash := {f"r_{c}".lower() for c in {*names, *right_ends}} & {c.lower() for c in left.columns}:
        raise ValueError(f"left has columns of the names that right's get: {sorted(clash)}")
    ls, le = (F.col(c) for c in left_ends)
    rs, re = (F.col(f"r_{c}") for c in right_ends)
    r = right.select("chrom", *[F.col(c).alias(f"r_{c}") for c in {*names, *right_ends}]).withColumn("_bin", _bins(rs, re, width))
    dealt = left.withColumn("_bin", _bins(ls, le, width))
    home = F.floor(F.greatest(ls, rs) / width)
    joined = dealt.join(r, ["chrom", "_bin"]).where((ls <= re) & (rs <= le) & (F.col("_bin") == home))
    return joined.select(*left.columns, *[f"r_{c}" for c in names])


def overlap_filter(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], anti: bool, width: int = 5_000) -> DataFrame:
    """Rows of left that overlap some row of right, or with anti none, whatever their length. Each row asks three tables and
    is never multiplied: the spans in the bins of its two ends, and whether right fills some bin between those. Positions
    are of 32 bits."""
    # Left's own columns travel in one struct, so that none of them can clash.
    columns = left.columns
    left = left.select("chrom", F.col(left_ends[0]).alias("_ls"), F.col(left_ends[1]).alias("_le"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_left"))
    ls, le = F.col("_ls"), F.col("_le")
    spans = right.select("chrom", F.col(right_ends[0]).alias("_rs"), F.col(right_ends[1]).alias("_re")).distinct()
    spans = spans.withColumn("_bin", _bins(F.col("_rs"), F.col("_re"), width)).groupBy("chrom", "_bin").agg(F.collect_set(F.struct("_rs", "_re")).alias("_spans"))
    first = spans.select("chrom", F.col("_bin").alias("_b1"), F.col("_spans").alias("_s1"))
    second = spans.select("chrom", F.col("_bin").alias("_b2"), F.col("_spans").alias("_s2"))
    keyed = left.withColumn("_b1", F.floor(ls / width)).withColumn("_b2", F.floor(le / width))
    # The bins between lie inside the row, so one that is filled is a hit. The first and last of them part in the halves of
    # one node of the binary tree over all bins: what is filled from `_from` on in its left half, or up to `_to` in its right.
    height = ((1 << 32) // width).bit_length()
    shifted = lambda c: c + F.lit(1 << (height - 1))
    level = F.explode(F.sequence(F.lit(0), F.lit(height)))
    nodes = spans.select("chrom", shifted(F.col("_bin")).alias("_at"), level.alias("_level")).withColumn("_node", F.expr("shiftright(_at, _level)"))
    in_left = F.expr("_level = 0 or shiftright(_at, _level - 1) % 2 = 0")
    in_right = F.expr("_level = 0 or shiftright(_at, _level - 1) % 2 = 1")
    nodes = nodes.groupBy("chrom", "_level", "_node").agg(F.max(F.when(in_left, F.col("_at"))).alias("_last"), F.min(F.when(in_right, F.col("_at"))).alias("_next"))
    keyed = keyed.withColumn("_from", shifted(F.col("_b1") + 1)).withColumn("_to", shifted(F.col("_b2") - 1))
    parted = F.expr("case when _from > _to then -1 when _from = _to then 0 else length(bin(_from ^ _to)) end")
    keyed = keyed.withColumn("_level", F.coalesce(parted, F.lit(-1))).withColumn("_node", F.expr("if(_level < 0, _from, shiftright(_from, _level))"))
    joined = keyed.join(first, ["chrom", "_b1"], "left").join(second, ["chrom", "_b2"], "left").join(nodes, ["chrom", "_level", "_node"], "left")
    hit = F.coalesce((F.col("_last") >= F.col("_from")) | (F.col("_next") <= F.col("_to")), F.lit(False))
    for c in ("_s1", "_s2"):
        hit = hit | F.coalesce(F.exists(c, lambda s: (ls <= s["_re"]) & (s["_rs"] <= le)), F.lit(False))
    return joined.where(~hit if anti else hit).select(*[F.col(f"_left.`{c}`") for c in columns])


def islands(df: DataFrame, keys: list[str], start: str, stop: str, tile: int = 100_000) -> DataFrame:
    """Adds `island`: the least start of the run of overlapping intervals [start, stop) in which each lies. Tiles keep a
    chromosome out of one task: what reaches into a tile, and the island open at its start, come from a table with a row
    for each tile."""
    at = Window.partitionBy(*keys)
    points = store(df.groupBy(*keys, start).agg(F.max(stop).alias("_stop")).withColumn("_tile", F.floor(F.col(start) / tile)), "points")
    reach = points.groupBy(*keys, "_tile").agg(F.max("_stop").alias("_reach"))
    before = at.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    points = points.join(reach.select(*keys, "_tile", F.max("_reach").over(before).alias("_before")), [*keys, "_tile"])
    inside = Window.partitionBy(*keys, "_tile").orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.greatest(F.max("_stop").over(inside), F.col("_before"))
    points = store(points.withColumn("_head", F.when(F.coalesce(F.col(start) >= so_far, F.lit(True)), F.col(start))).drop("_before"), "heads")
    heads = points.groupBy(*keys, "_tile").agg(F.max("_head").alias("_last"))
    points = points.join(heads.select(*keys, "_tile", F.max("_last").over(before).alias("_open")), [*keys, "_tile"])
    upto = Window.partitionBy(*keys, "_tile").orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    points = points.select(*keys, start, F.coalesce(F.max("_head").over(upto), F.col("_open")).alias("island"))
    return df.join(points, [*keys, start])
