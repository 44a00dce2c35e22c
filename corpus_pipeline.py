"""Training-corpus pipeline: each stage works on all that the one before it kept.

Stages: language ID (documents without an identifiable language go), n-gram Jaccard join (the document of smallest
id of each group of near copies stays), benchmark decontamination (documents with a leak go), surrogates for
personal data (texts are rewritten, ``n_chars`` follows), best-fit packing (the remaining texts become sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoquery.llm.decontaminate import find_leaks
from annoquery.llm.jaccard import similarity_classes
from annoquery.llm.langid import document_items, identify
from annoquery.llm.packing import pack
from annoquery.llm.pii import replace_entities
from annoquery.llm.queries import word_tokenizer
from annoquery.llm.shared import staged, without


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null, empty and wordless texts, and those below the least probability. Repeated rows are judged each; extra columns stay."""
    rejected = identify(document_items(docs)).where("not kept").select(F.col("id").alias("doc_id"))
    return without(docs, rejected)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest ``doc_id`` of each group stays. Null and empty texts are groups of their own; rows that repeat a ``doc_id`` stay or go together."""
    return without(docs, similarity_classes(docs).where("class_id <> doc_id").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leak go. Null and empty texts and an empty benchmark match nothing; rows that repeat a ``doc_id`` go together."""
    return without(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are rewritten, null and empty ones stay as they are; ``n_chars`` follows where it is there."""
    out = replace_entities(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence; a null or empty text is the end id alone."""
    return pack(docs, word_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("packing", packing),
]

#: SQL can express neither the shingle join on whole tables in reasonable time nor tokenization; tests/llm/test_pipeline.py holds each stage against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
