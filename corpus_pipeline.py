"""The corpus pipeline: five stages, each over all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever other columns there are.

Defined cases, in every stage: an empty table gives no rows; texts are taken whole, however long; repeated rows are rows of
their own until exact dedup, which keeps one of them; null text is a text without letters (so language ID drops it) and
counts as empty after that; rows with null doc_id go on like the others. Each stage's own cases are stated with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardframe.llm import exact_dedup, langid, mixing, ngram_join, packing
from shardframe.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the model does not reject. Null or empty texts and those without a letter go; so
    do all documents if none has a language to learn from. Null and repeated ids are predicted like others, and not learned
    from (null), or once (repeated)."""
    return langid.accepted(docs, langid.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the one with the largest doc_id; of ties and of a group of null ids
    one row."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles link at a similarity of 0.75: the rows with the smallest
    doc_id (null comes last) and one text, of null ids one row. Documents without words all stay."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the documents of the mix; one that is taken k times has k rows. A null source is a source, the last one;
    documents without words are not taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's pieces in sequences of 4096 tokens. Each row is packed, whatever its id; an empty text is the
    end id alone."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mix), ("packing", pack)]

#: Language ID and the mix cannot be expressed in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
