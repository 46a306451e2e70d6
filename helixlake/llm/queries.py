"""Queries opN_<name>: each applies one corpus operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import language, toxicity
from helixlake.llm.alignment import token_alignment
from helixlake.llm.collocations import collocations
from helixlake.llm.common import crc_mod, table
from helixlake.llm.decontaminate import decontaminate
from helixlake.llm.html_text import main_texts
from helixlake.llm.licences import scan
from helixlake.llm.near_dup import near_duplicates
from helixlake.llm.ngram_join import similar_documents
from helixlake.llm.oracle import ORACLE_SQL
from helixlake.llm.packing import pack_documents
from helixlake.llm.pseudonyms import pseudonym_report
from helixlake.llm.quality import quality
from helixlake.llm.sharding import assign_shards

__all__ = ["ORACLE_SQL", "QUERIES"]

SEQUENCE_LENGTH = 2048
#: A deployment passes its own secret to the operator.
PSEUDONYM_KEY = b"documented key for tests"


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = crc_mod(F.col("doc_id"), 3)
    model = language.fit(docs, remainder != 1)
    named = language.identify(docs, model)
    return named.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = crc_mod(F.col("doc_id"), 4)
    labels = table(spark, sf_dir, "labels").where(remainder != 2)
    found = toxicity.toxicity(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "score", "predicted", "spans")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


#: Documents as files: a tree of directories under each source.
PATH = "concat_ws('/', coalesce(source, 'unknown'), cast(floor(doc_id / 1000) as bigint), cast(floor(doc_id / 50) as bigint), doc_id)"


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.expr(PATH).alias("path"), "text")
    return scan(files).withColumnRenamed("file", "doc_id")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer(), SEQUENCE_LENGTH)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym_report(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment(table(spark, sf_dir, "documents"), a, b)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_main_text": op4_main_text,
    "op5_licences": op5_licences,
    "op6_shards": op6_shards,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_pack": op8_pack,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_decontaminate": op10_decontaminate,
    "op11_ngram_join": op11_ngram_join,
    "op12_collocations": op12_collocations,
    "op13_token_alignment": op13_token_alignment,
}

