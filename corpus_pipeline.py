"""The corpus pipeline: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.exact_dedup import drop_exact_duplicates
from docgraph.llm.near_dedup import drop_similar
from docgraph.llm.packing import pack_documents
from docgraph.llm.shared import discard, documents, save
from docgraph.llm.suffix_dedup import remove_repeated
from docgraph.llm.toxicity import drop_toxic, fit

#: Differing bits at which fingerprints make two documents a candidate pair, found by the Golay keys.  Pairs further
#: apart are found by MinHash bands, and only pairs of similarity 0.8 are linked.
NEAR_BITS = 2


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; null and empty texts stay."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space; null counts as empty."""
    return drop_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents whose five-word shingles are 0.8 similar: the smallest doc_id."""
    return drop_similar(docs, max_bits=NEAR_BITS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the 200-byte strings that start elsewhere too; ``n_chars``, where there is one, follows."""
    kept = remove_repeated(docs)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table is deleted once the next one is stored, all but the last."""
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES[:-1]):
        kept = save(stage(spark, docs, sf_dir), f"stage-{name}")
        if number:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
