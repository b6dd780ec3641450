"""Corpus pipeline: quality rules, SimHash near-dedup, benchmark decontamination, secret scans, byte-level BPE.

Each stage reads what the one before has written, works on all of it, and its decisions take effect: rejected
documents go, frequent lines are cut, one document of each near-duplicate group stays, documents that hold a
benchmark item go, found secrets are replaced by their kind, and the rest is encoded.

Defined cases, for every stage: an empty table gives an empty one; extra columns are kept (but for the last stage); a null
id is an id of its own rows; n_chars follows the text where a stage changes it. What a stage does with null, empty and
very long texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, ledger, quality, simhash
from gridloom.llm.common import scratch, table, written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their frequent lines. Null, empty and very short texts fail; repeated rows stay or go
    together."""
    return _counted(quality.apply(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (a null id last). Texts without words are
    copies of each other; of rows repeated whole one stays."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows stay or go together."""
    # the id with the text: rows without an id, or that share one, are judged each
    named = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    hit = decontaminate.matches(named, table(spark, sf_dir, "benchmark"), key="__row")
    return named.join(hit.select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti").drop("__row")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each found secret replaced by its kind. A null text stays null; copies are changed alike."""
    blobs = ledger.BlobLedger(spark, scratch(spark, "ledger"))
    blobs.scan(docs, path="doc_id")
    return _counted(ledger.redact(docs, blobs.findings()))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each row, with the id, language and source. A null text has no tokens."""
    import public_tokenizers

    keep = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep, digests=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]

#: SQL has no byte-pair merges; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
