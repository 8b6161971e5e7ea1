"""Training corpus pipeline: five stages, each one operator over all that the stage before kept.

run(spark, sf_dir) reads documents, applies the stages in order, and writes each result as
Parquet in the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm._common import stored
from inkveil.llm.decontaminate import drop_contaminated
from inkveil.llm.ngram_join import keep_one
from inkveil.llm.packing import pack_documents
from inkveil.llm.suffix_dedup import remove_repeats
from inkveil.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes and more that an earlier document has are cut out; a text cut whole drops out."""
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a phrase of ten words of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents with their place in windows of 4096."""
    from public_tokenizers import path

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pack_documents(docs, path("word_bpe_49k.json")).select(*columns)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None  # a trained classifier and a tokenizer: not for SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs.select([F.col(c) for c in docs.columns])
