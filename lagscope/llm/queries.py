"""The registered queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.llm import warc
from lagscope.llm.decontamination import contaminated
from lagscope.llm.filter_audit import filter_audit
from lagscope.llm.katz import katz_scores
from lagscope.llm.oracle import ORACLE  # noqa: F401
from lagscope.llm.quality_classifier import quality_scores
from lagscope.llm.quality_rules import quality_rules
from lagscope.llm.sentencepiece_fst import encode_documents
from lagscope.llm.simhash_dedup import simhash_classes
from lagscope.llm.source_divergence import source_divergence
from lagscope.llm.suffix_dedup import repeated_passages
from lagscope.llm.token_store import token_store
from lagscope.llm.toxicity import toxicity
from lagscope.llm.winnowing import fingerprints


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizers have a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_arrow_batches(spark: SparkSession, size: str = "16m") -> None:
    """Hand texts to Python tasks in batches of this size: texts can be long, and tasks small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), model or tokenizer_file("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tie")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_store(documents(spark, sf_dir), tokenizer or tokenizer_file("byte_bpe_50k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(warc.captures(spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False))


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _hex(hashes: str) -> F.Column:
    return F.concat_ws("", F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", _hex("hashes").alias("fingerprint"), _hex("edited_hashes").alias("edited_fingerprint"), "near_edited", "near_next"
    )


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_token_store": op5_token_store,
    "op6_warc": op6_warc,
    "op7_katz_scores": op7_katz_scores,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_filter_audit": op12_filter_audit,
    "op13_winnowing": op13_winnowing,
}
