"""Alignment, annotation and sequence tables derived from the driver's star schema (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, lead: str, order: list[str], name: str, width: int = 1000) -> DataFrame:
    """row_number() over (order by order), from 1, without sorting all rows in one task: rows are numbered within
    ranges of `width` values of the leading order column, on top of the counts of the ranges before."""
    df = df.withColumn("_range", F.floor(F.col(lead) / width))
    counts = df.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row for each range.
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return df.withColumn("_inside", inside).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")


def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "lineitem"), "l_orderkey", ORDER, "rid")
    return rows.selectExpr(
        "rid", "l_orderkey", "concat('chr', l_suppkey % 4 + 1) as chrom", "concat('s', l_orderkey % 3) as sample", "concat('lib', l_linenumber % 2) as library",
        "cast((l_partkey * 37) % 1000000 + 1 as int) as pos1",
        """cast((l_partkey * 37) % 1000000 + 1 + l_orderkey % 7 + case
             when l_partkey % 100 < 10 and l_quantity >= 26 then 2000 when l_partkey % 100 between 20 and 29 and l_quantity >= 46 then 110
             when l_partkey % 100 between 40 and 49 and l_quantity >= 26 then 1500 when l_partkey % 100 between 60 and 69 and l_quantity >= 26 then 3000
             else 300 + cast(l_quantity as int) end as int) as pos2""",
        """case when l_partkey % 100 between 40 and 49 and l_quantity >= 26 then 'R'
             when l_partkey % 100 between 60 and 69 and l_quantity >= 26 and l_linestatus = 'F' then 'R' else 'F' end as or1""",
        """case when l_partkey % 100 between 40 and 49 and l_quantity >= 26 then 'F'
             when l_partkey % 100 between 60 and 69 and l_quantity >= 26 and l_linestatus = 'O' then 'F' else 'R' end as or2""",
        "cast(round(l_tax * 500) as int) as mapq", "cast(round(l_discount * 100) as int) as edit",
    )


def alignments(pairs: DataFrame) -> DataFrame:
    """Two records for each pair: one pass over the pairs, not a union of two."""
    first = F.struct(
        F.col("pos1").alias("pos"), F.col("pos2").alias("mate_pos"), F.expr("65 + if(or1 = 'R', 16, 0) + if(or2 = 'R', 32, 0)").alias("flag"), F.expr("pos2 + 100 - pos1").alias("isize"))
    second = F.struct(
        F.col("pos2").alias("pos"), F.col("pos1").alias("mate_pos"), F.expr("129 + if(or2 = 'R', 16, 0) + if(or1 = 'R', 32, 0)").alias("flag"), F.expr("-(pos2 + 100 - pos1)").alias("isize"))
    both = pairs.withColumn("m", F.explode(F.array(first, second)))
    return both.select(F.concat(F.lit("r"), "rid").alias("read_name"), "rid", "chrom", "sample", "library", "m.pos", "m.mate_pos", "m.flag", "m.isize", "mapq", F.col("edit").alias("nm"))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('chr', p_partkey % 4 + 1) as chrom", "cast((p_partkey * 53) % 1000000 as int) as start_pos", "cast((p_partkey * 53) % 1000000 + 50 + p_size * 4 as int) as end_pos",
        "if(p_size % 2 = 0, '+', '-') as strand",
        "case when p_partkey % 10 = 9 then 'Satellite' when p_partkey % 3 = 0 then 'SINE/Alu' when p_partkey % 3 = 1 then 'LINE/L1' else 'Other/SVA' end as repeat_class",
        "cast(p_partkey % 3 as int) as mei_code",
    )


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('chr', s_suppkey % 4 + 1) as chrom", "cast((s_suppkey * 977) % 1000000 as int) as start_pos", "cast((s_suppkey * 977) % 1000000 + 200 as int) as end_pos"
    )


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = "concat(md5(cast(cast(p_partkey as string) as binary)), md5(cast(cast(p_partkey + 1 as string) as binary)))"
    return table(spark, sf_dir, "part").selectExpr("p_partkey as seq_id", f"translate({hashed}, '0123456789abcdef', 'ACGTACGTACGTACGT') as seq")


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and the barcode of its reads; none where the tag is missing."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as l_orderkey", "if(o_orderpriority like '5%', null, o_custkey) as barcode").groupBy("l_orderkey").agg(F.max("barcode").alias("barcode"))
