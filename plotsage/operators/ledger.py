"""The evidence ledger: replay, numbering, latest results, and differences between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotsage.sources.shared import cut


def replay(ledger: DataFrame, run_id) -> DataFrame:
    """A run's rows in order of id; an unknown run has none. The filter prunes partitions of run_id."""
    return ledger.filter(F.col("run_id") == run_id).orderBy("id")


def numbered(evidence: DataFrame, order: str = "pos") -> DataFrame:
    """evidence with row_id, from 1 in each run, by source order and then layer.

    Rows are sorted into ranges over all runs, so that a run of any size is many tasks: each range numbers its own rows,
    behind as many as the ranges before it hold of the same run."""
    keys = ["run_id", order, "layer_order"]
    ranged = cut(evidence.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ledger-ranges")
    before = Window.partitionBy("run_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("run_id", "_range").agg(F.count("*").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    within = F.row_number().over(Window.partitionBy("run_id", "_range").orderBy(order, "layer_order"))
    return ranged.withColumn("_nth", within).join(offsets, ["run_id", "_range"]).withColumn("row_id", F.col("_before") + F.col("_nth")).select(*evidence.columns, "row_id")


def latest(results: DataFrame) -> DataFrame:
    """Each plot's newest result: by created_at, then id. An aggregate rather than a window: one row is kept in memory."""
    best = F.max(F.struct("created_at", "id", *[c for c in results.columns if c not in ("created_at", "id", "plot_id")])).alias("r")
    return results.groupBy("plot_id").agg(best).select("plot_id", "r.*")


def with_latest(plots: DataFrame, results: DataFrame) -> DataFrame:
    """plots with the newest result of each, null where there is none, and assessed."""
    return plots.join(latest(results), "plot_id", "left").withColumn("assessed", F.col("id").isNotNull())


def diff(ledger: DataFrame, before, after) -> DataFrame:
    """Rows of two runs side by side by plot and layer: what was added, dropped, or changed, and in what.

    A flipped tier is laid to the layers whose value or version changed.
    """
    fields = ("dataset_version", "pixel_value", "covered_fraction", "verdict")
    side = lambda run, tag: ledger.filter(F.col("run_id") == run).select("plot_id", "dataset_name", *[F.col(c).alias(f"{c}_{tag}") for c in fields], F.lit(True).alias(f"in_{tag}"))
    both = side(before, "a").join(side(after, "b"), ["plot_id", "dataset_name"], "full_outer")
    changed = lambda c: ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    tier = lambda tag: F.split(f"verdict_{tag}", r"\|")[0]
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "dropped").otherwise("both")
    return both.select("plot_id", "dataset_name", status.alias("status"), changed("dataset_version").alias("version_changed"), changed("pixel_value").alias("value_changed"), changed("covered_fraction").alias("fraction_changed"), (~tier("a").eqNullSafe(tier("b"))).alias("tier_flipped"))


def unlike(ledger: DataFrame, before, after) -> DataFrame:
    """Rows (without run and verdict) that one run has and the other has not."""
    rows = lambda run: ledger.filter(F.col("run_id") == run).select("plot_id", "dataset_name", "dataset_version", "pixel_value", "covered_fraction")
    a, b = rows(before), rows(after)
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))
