"""A corpus pipeline of five stages, each calling one operator of tallyforge.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents, with extra columns as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe, decontaminate, pii, quality, simhash
from tallyforge.llm.common import checkpointed, table
from tallyforge.llm.queries import TOKENIZER


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ledger bits fail the current policy of quality rules go.

    Null, empty and wordless texts go, very long ones are measured whole, repeated rows stay or
    go together, ids and other columns aren't looked at.
    """
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays.

    Null and wordless texts are one group, very long ones are compared whole, of repeated rows
    one stays, rows that share a doc_id are told apart by text, rows without a doc_id stay.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Null and empty texts hold none and stay, very long ones are read whole, rows are judged each
    by itself, with or without a doc_id; an empty benchmark leaves every row.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows where there is such a column.

    Null and empty texts stay as they are, very long ones are read whole, repeated rows are each
    changed; no row goes.
    """
    found = pii.redact(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", pii.length(found["text"]).cast(docs.schema["n_chars"].dataType))
    return found


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document that is left.

    A null text is encoded as an empty one, very long ones whole, repeated rows each.
    """
    return bpe.encode(docs, TOKENIZER)


STAGES = [
    ("quality_rules", rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii_redaction", personal_data),
    ("bpe_encoding", encode),
]

#: The stages' hashing and tokenizer aren't expressible in SQL; tests/llm hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
