"""Agreement of our labels with external ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotsage.functions.text import LABELS


def _labels(df: DataFrame, *names: str) -> DataFrame:
    rows = [(x,) for x in LABELS] if len(names) == 1 else [(x, y) for x in LABELS for y in LABELS]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def confusion(pairs: DataFrame) -> DataFrame:
    """ours, theirs, n for all nine pairs of labels; pairs that do not occur have 0."""
    counted = pairs.groupBy("ours", "theirs").agg(F.count("*").alias("n"))
    return _labels(pairs, "ours", "theirs").join(counted, ["ours", "theirs"], "left").na.fill(0, ["n"])


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: n and agreement_rate, 0 for no pairs."""
    return pairs.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("ours") == F.col("theirs")).cast("double")), F.lit(0.0)).alias("agreement_rate"))


def disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.filter("ours <> theirs")


def distribution(labels: DataFrame, column: str = "label") -> DataFrame:
    """label and n for all three labels."""
    counted = labels.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return _labels(labels, "label").join(counted, "label", "left").na.fill(0, ["n"])
