"""Training-corpus pipeline: language ID, near-duplicate removal, decontamination, PII removal, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import bpe, decontamination, language_id, near_dedup, pii
from ebbtide.llm.queries import vocabulary_path
from ebbtide.llm.texts import read_table
from ebbtide.session import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which the word-first model finds a language: all that hold a letter; their `lang` stays as it is."""
    model = language_id.learn(docs)
    found = language_id.identify(docs, model, "text")
    judged = docs.select(F.struct("*").alias("doc"), found.alias("found"))
    return judged.where(F.col("found.lang_pred") != language_id.UNDETERMINED).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at similarity 0.8 the document with the smallest id stays."""
    judged = near_dedup.near_duplicates(docs, words=5, similarity=80)
    return docs.join(judged.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, also one with other numbers, names or units."""
    return decontamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalise personal data to its kind and remove the terms that reveal it; no document goes."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them: `round_trip` says whether the text came back."""
    path = vocabulary_path()
    encoded = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), bpe.encode("text", path).alias("packed"))
    decoded = encoded.withColumn("decoded", bpe.decode("packed", path))
    return decoded.select(
        "doc_id",
        "source",
        (F.length("packed") / 4).cast("long").alias("n_tokens"),
        "packed",
        F.sha2("packed", 256).alias("ids_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", remove_personal_data),
    ("bpe", encode_bpe),
]

#: No SQL can express the learned and the byte-level stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`, each written to the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
