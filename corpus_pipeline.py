"""The corpus pipeline: documents in, packed sequences out. Each stage is written as Parquet and read again by the next.

Stages look at doc_id, text, lang and n_chars alone; all other columns of docs, whatever their names, pass through the first
four unchanged. An empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograin.llm import ngram_jaccard_join, packing, pii, quality_classifier, substring_dedup
from cartograin.llm.common import table, written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score under the model of trusted text is within their language's threshold.

    Null and empty texts go. Rows without an id stay. Of rows of one id all stay if one is within the threshold. A null
    language is one of its own. Long texts are scored whole.
    """
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by a similarity of 0.8 or more on shingles of five words.

    Texts that are null or without words are linked with nothing and stay, as do rows without an id. Rows of one id are one
    document and stay or go together.
    """
    return ngram_jaccard_join.one_of_each(docs, width=5, num=80, den=100)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of 20 words that also start earlier.

    All rows stay, with empty texts where all words went; null texts stay null. Rows without an id come after all others and,
    like rows of one id, take nothing from each other. n_chars is counted anew.
    """
    return _counted(substring_dedup.without_repeats(docs, window=20))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that give it away replaced.

    All rows stay; null texts stay null, rows of equal texts get equal ones, ids are not looked at. n_chars is counted anew.
    """
    return _counted(pii.sanitised(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences.

    Null and empty texts have the closing id alone. Rows are not told apart by their ids: each row's tokens are packed.
    """
    return packing.packed(docs, packing.default_tokenizer())


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substrings), ("PII", private), ("packing", sequences)]

#: SQL cannot express the trained model, the corpus statistics or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
