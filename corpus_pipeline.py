"""A corpus pipeline in five stages, each one of the corpus operators at work on what its predecessor kept.

Toxic documents go, of exact copies the one with the largest id stays, likewise of near duplicates, found
secrets are replaced by their kind in brackets, and the rest is packed into training sequences. A stage's
result is written as Parquet to the shared scratch folder and read again, so a lost executor costs no
more than the stage that was running.

Edge cases: null texts count as empty; null ids are carried and rank smallest; ties and repeated rows are
settled as each operator's module says, so exactly one row of each group stays; texts of any length are
treated whole; an empty table runs through; all but the last stage return the columns they were given,
whatever their names and number (n_chars, if there is one, is counted anew where a secret was replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotlens.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from lotlens.llm.base import documents, written

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled rows of the whole table that are not held out."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]

#: The model's training and the hash-based candidate search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
