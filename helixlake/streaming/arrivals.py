"""Depth by bin and counts by class from a stream of alignment records.

The model has no event time: a record is final when it arrives. State is bounded by the genome (bins times samples) and by
the classes, so it needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from helixlake.operators.reads import classify, proper


def alignment_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def depth_by_bin(records: DataFrame, width: int = 1000) -> DataFrame:
    return records.where(proper()).groupBy("sample", "chrom", (F.floor(F.col("pos") / width) * width).alias("start_pos")).agg(F.count("*").alias("n"))


def class_counts(records: DataFrame, band: DataFrame) -> DataFrame:
    """Against a library band of earlier data: a static side, a row for each library."""
    return classify(records, band).groupBy("library", "class").agg(F.count("*").alias("n"))


def keep_current(counts: DataFrame, table_path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Writes each batch's changed counts as a table of its own under table_path/batch=<id>, so that a batch that is
    repeated after a failure replaces itself; the latest batch of a key holds its count."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.select(*keys, "n").write.mode("overwrite").parquet(f"{table_path}/batch={batch}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table_path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(table_path).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
