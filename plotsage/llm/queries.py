"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotsage.llm import decontaminate, hamming, infill, licenses, lm, mixing, near, pii, quality, quantise, secrets, spotsigs, substring
from plotsage.llm.common import read


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.repeats(read(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(read(spark, sf_dir, "documents")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return hamming.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_copies(read(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.digest(*quantise.compress(read(spark, sf_dir, "embeddings")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(read(spark, sf_dir, "documents")))


def op13_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest(spotsigs.edits(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_nearest_neighbours, op4_benchmark_decontamination, op5_license_scan, op6_ngram_jaccard, op7_source_mixing, op8_quality_classifier, op9_personal_data, op10_language_model, op11_vector_codes, op12_fill_in_middle, op13_spot_signatures)}
ORACLE_SQL: dict[str, str] = {"op5_license_scan": licenses.scan_sql(), "op11_vector_codes": quantise.digest_sql(), "op12_fill_in_middle": infill.digest_sql(), "op13_spot_signatures": spotsigs.digest_sql()}
