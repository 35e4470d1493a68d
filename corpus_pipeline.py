"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Language identification drops texts without a known language, quality rules drop texts that fail a
threshold, the Jaccard join leaves one document of each group of near duplicates, the secret scan
masks values that look live, and packing cuts the rest into windows of tokens.

Null and empty texts, and texts without a letter, leave at the first stage; null ids, labels and
sources take part. Texts of any length stay whole. Of repeated rows, which are near duplicates of each
other, one stays. Columns beyond those of ``documents`` are carried to the last stage but one, whatever
their names. Empty tables pass all stages and give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptframe.llm import language, quality
from promptframe.llm.jaccard import drop_near_duplicates
from promptframe.llm.packing import pack
from promptframe.llm.registry import prepared, table, written
from promptframe.llm.secrets import mask


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows; it learns from the documents themselves, and rows
    without a label get the language it finds."""
    prepared(spark)
    return language.keep_known(docs, language.learn(docs), lang_col="lang")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; stop words count only in languages that have a list."""
    prepared(spark)
    return quality.keep_good(docs, lang_col="lang")


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    prepared(spark)
    return drop_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked and ``n_chars`` counted anew."""
    prepared(spark)
    masked = mask(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2,048 tokens."""
    import public_tokenizers

    prepared(spark)
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_stage), ("quality_rules", quality_stage),
          ("ngram_jaccard_join", duplicate_stage), ("secret_scan", secret_stage), ("packing", packing_stage)]
#: The network and the token windows have no SQL; tests/llm/test_pipeline.py checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back before the next."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
