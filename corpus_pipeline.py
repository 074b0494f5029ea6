"""A corpus pipeline of the operators in ``lagscope.llm``.

Each stage takes the documents that the one before it kept, and returns the columns of ``documents``; the last
returns token ids. The classifier drops what it rejects; of each class of SimHash near-duplicates (operator 8) the row with the smallest doc_id stays (a
null id only if there is no other; of rows with one doc_id, the one whose text hashes least); repeated
passages are taken out of texts and ``n_chars`` is counted anew; documents that hold a benchmark item are dropped; the
rest is encoded, and read back.

Null texts are empty texts in every stage (they have no words, no repeated passage and no benchmark item);
an empty table gives empty stages; columns of ``documents`` beyond doc_id and text pass through untouched,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.llm.decontamination import clean
from lagscope.llm.quality_classifier import good
from lagscope.llm.queries import small_arrow_batches, tokenizer_file
from lagscope.llm.sentencepiece_fst import encode_documents
from lagscope.llm.simhash_dedup import one_of_each
from lagscope.llm.suffix_dedup import deduplicated
from lagscope.session import store


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: keep what the co-trained classifier takes for good."""
    small_arrow_batches(spark)
    return good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each class of SimHash fingerprints of 3-word shingles linked at two
    bits or fewer, the contract's parameters; no word-similarity check beside the bit distance."""
    small_arrow_batches(spark)
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: take out passages that an earlier document, or the text before, has."""
    small_arrow_batches(spark)
    out = deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: drop documents that hold a benchmark item."""
    small_arrow_batches(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: doc_id, ids, n_tokens, round_trip."""
    small_arrow_batches(spark)
    return encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: The stages train models and follow links of any length, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
