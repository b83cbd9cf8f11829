"""The registered queries of this subpackage: one per operator over its whole table, the pipeline, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .alignment import alignment_counts
from .chat_format import chat_format
from .decontamination import matches
from .exact_dedup import EXACT_SQL, exact_dedup
from .jaccard_join import JACCARD_SQL, jaccard_groups
from .language_id import language_id
from .license_scan import license_scan
from .mixing import MIXING_SQL, mixed_sample
from .periodic_runs import periodic_runs, planted, run_digests
from .suffix_dedup import SUFFIX_SQL, suffix_dedup
from .token_counts import edited_counts, private_edits
from .toxicity import toxicity
from .url_filter import PAGE_RULES, URL_SQL, url_rules, url_verdicts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in documents."""
    return license_scan(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with how much of it."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies that each document belongs to."""
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taken words of every document in a mix whose sources weigh 3, 1, 2 in turn."""
    return mixed_sample(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after private data has been replaced."""
    return edited_counts(table(spark, sf_dir, "documents"), private_edits)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document, and how many are equal."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and canonical form of every conversation, read off its raw transcript."""
    return chat_format(table(spark, sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of those that are not held out."""
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that repeat four times and more in every document, some of them planted, and the documents without them."""
    return run_digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of byte-level and piece tokens of every document, and how often their linked ids meet in the corpus."""
    return alignment_counts(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every page may stay, by its URL."""
    return url_verdicts(table(spark, sf_dir, "pages"), url_rules(spark, PAGE_RULES))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_mix_sources": op4_mix_sources,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_alignment": op12_token_alignment,
    "op13_url_filter": op13_url_filter,
}

SQL = {
    "op3_jaccard_join": JACCARD_SQL,
    "op4_mix_sources": MIXING_SQL,
    "op6_suffix_dedup": SUFFIX_SQL,
    "op8_exact_dedup": EXACT_SQL,
    "op13_url_filter": URL_SQL,
}
