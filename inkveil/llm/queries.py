"""The registered queries of this subpackage: thin calls with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, merkle, spelling

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edit_report

    return edit_report(_documents(spark, sf_dir))


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op2_decontamination"] = decontaminate.ORACLE


@_query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removed_digest

    return removed_digest(_documents(spark, sf_dir))


@_query
def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import score_documents

    return score_documents(_documents(spark, sf_dir))


@_query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import perspectives

    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op5_chat"] = chat.ORACLE


@_query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), path("word_bpe_49k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query
def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .records import write_and_read

    return write_and_read(_documents(spark, sf_dir), path("byte_bpe_50k.json"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_documents(spark, sf_dir))


@_query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


@_query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_documents(spark, sf_dir))


ORACLES["op12_spelling"] = spelling.ORACLE


@_query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import verified

    return verified(_documents(spark, sf_dir))


ORACLES["op13_merkle"] = merkle.ORACLE
