"""A corpus pipeline over documents: each stage works on all that its predecessor kept.

Quality classifier, n-gram Jaccard join, benchmark decontamination, personal data, mixing to target weights. Each stage
takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. An empty table gives
an empty result at every stage; columns beside doc_id, text and source may have any names and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotsage.llm import decontaminate, mixing, near, pii, quality
from plotsage.llm.common import cut, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts have the score of a text without words; copies stay or go together; very long texts are read whole."""
    return quality.accepted(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of least doc_id stays (of equal ids the first row; null ids come last). Null and empty texts are near to nothing and stay."""
    return near.representatives(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go. Null and empty texts overlap with nothing and stay; repeated rows stay or go together."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind. All rows stay; null texts stay null, empty ones empty."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, so that sources come near their target weights. Null and empty texts have size 0 and are taken 0 times; a null source is a source."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", keep_uncontaminated),
    ("personal data", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
]

#: SQL cannot express a fitted classifier, MinHash classes or random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{at}")
    return docs
