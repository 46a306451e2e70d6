"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, pseudonyms, packing.

Each stage takes the documents that the one before kept. All but the last return the columns of documents:

* language: documents that the classifier rejects go: no letter in the text, or the likeliest language is less likely
  than LEAST_SCORE. It is fitted on the documents' own labels.
* near_duplicates: of each group one document stays, the one with the least doc_id (one row of it, if rows repeat).
* decontaminate: documents with benchmark passages in a twentieth of their words or more go.
* pseudonyms: personal data in texts gives way to pseudonyms; n_chars is the new text's.
* pack: sequences of at most 2048 tokens, one row for each piece.

A row without doc_id passes the filters that go by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import language
from helixlake.llm.common import scratch, store, table
from helixlake.llm.decontaminate import decontaminate
from helixlake.llm.near_dup import near_duplicates
from helixlake.llm.packing import pack_documents
from helixlake.llm.pseudonyms import pseudonymise
from helixlake.llm.queries import PSEUDONYM_KEY, SEQUENCE_LENGTH, word_tokenizer
from helixlake.stored import discard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = language.identify(docs, language.fit(docs, F.lit(True)), *COLUMNS[1:])
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose ids gone hasn't. Its ids are stored first: Spark plans the join by what they measure, and
    shuffles whole texts to them only where they are too many to broadcast."""
    return docs.join(store(gone.select("doc_id").distinct(), "gone"), "doc_id", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs)
    kept = _without(docs, found.where("not kept"))
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    # Rows that share a doc_id are one document; only these are gathered by it.
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def pseudonymise_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = pseudonymise(docs.select(*COLUMNS), PSEUDONYM_KEY)
    return made.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, word_tokenizer(), SEQUENCE_LENGTH)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pseudonyms", pseudonymise_texts),
    ("pack", pack),
]

#: The classifier and the tokenizer are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again; what a stage stored on its way, and its predecessor's result, go."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            before, docs = docs, store(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs.stored_at)
        if hasattr(before, "stored_at"):
            discard(spark, before.stored_at)
    return docs
