"""Queries of this subpackage by name, each over whole tables, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clusters, decontaminate, html, language, minhash, passages, pii, quality, ranked, secrets, simhash, urls
from .common import checkpointed, table

try:  # the tokenizer files' folder is a parameter of the operators; this is the default of the queries
    import public_tokenizers

    TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
except ImportError:
    TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def rules_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of the rules keeps, from a ledger written once."""
    return quality.versions(checkpointed(quality.ledger(table(spark, sf_dir, "documents"))))


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does, from a ledger written once."""
    return quality.ablation(checkpointed(quality.ledger(table(spark, sf_dir, "documents"))))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.named(pages))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER, digest=True)


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_passages": op1_passages,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_rules": op4_rules,
    "rules_versions": rules_versions,
    "rules_ablation": rules_ablation,
    "op5_urls": op5_urls,
    "op6_html": op6_html,
    "op7_secrets": op7_secrets,
    "op8_language": op8_language,
    "op9_simhash": op9_simhash,
    "op10_bpe": op10_bpe,
    "op11_clusters": op11_clusters,
    "op12_ranked": op12_ranked,
    "op13_minhash": op13_minhash,
}

ORACLE: dict[str, str] = {
    "op4_rules": quality.oracle(),
    "rules_versions": quality.versions_oracle(),
    "rules_ablation": quality.ablation_oracle(),
    "op5_urls": urls.oracle(),
    "op7_secrets": secrets.oracle(),
    "op11_clusters": clusters.oracle(),
    "op12_ranked": ranked.oracle(),
    "op13_minhash": minhash.oracle(),
}
