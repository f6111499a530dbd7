"""Tables at rest: append-only Parquet, kept unique by anti-joins. One writer for each table at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plotsage.operators.validation import first_of_each_hash
from plotsage.sources.shared import cut


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table, or no rows of the same columns if nothing is at the path yet. Other errors are the caller's."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table does not hold. Writing the same rows twice adds nothing.

    Of the table only those keys are brought together that the batch asks for: a semi-join with the batch's keys comes
    first, which Spark broadcasts where they are few and turns into a Bloom filter of the scan where they are many."""
    rows = cut(rows, "appended")
    asked = rows.select(key).distinct()
    there = read_or_empty(rows.sparkSession, path, rows).select(key).join(asked, key, "left_semi").distinct()
    rows.join(there, key, "left_anti").select(*rows.columns).write.mode("append").parquet(path)


def append_whole_runs(rows: DataFrame, path: str) -> None:
    """Append the runs (by run_id, null being one of them) that are not recorded yet, each as a partition of its own.

    Nothing of the table is read. The runs that were written whole stand in a list beside the table, to which they are added
    last. A write that was killed leaves its runs out of the list; they are written again then, over what is there.
    """
    spark = rows.sparkSession
    runs = rows.select("run_id").distinct()
    recorded = read_or_empty(spark, f"{path}_runs", runs).withColumnRenamed("run_id", "_recorded").distinct()
    fresh = cut(runs.join(recorded, F.col("run_id").eqNullSafe(F.col("_recorded")), "left_anti"), "fresh-runs")
    wanted = fresh.select(F.col("run_id").alias("_wanted"))
    added = rows.join(wanted, F.col("run_id").eqNullSafe(F.col("_wanted")), "left_semi")
    # few files for each run, and many tasks for one that is large
    added.hint("rebalance", "run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    fresh.write.mode("append").parquet(f"{path}_runs")


def append_plots(features: DataFrame, path: str) -> None:
    """Plots by geom_hash: the first of a batch, and only if no earlier batch had it. Texts without geometry stay out."""
    shaped = first_of_each_hash(features.filter("parts is not null"))
    append_new(shaped.withColumn("plot_id", F.substring("geom_hash", 1, 16)), path, "geom_hash")


def ingestion_runs(features: DataFrame) -> DataFrame:
    """One row for each submission: its hash and run_id, counts, and ids that occur more than once."""
    text = F.array_join(F.array_sort(F.collect_list("geom_hash")), "\n")
    ids = features.groupBy("submission", "external_id").agg(F.count("*").alias("n")).filter("n > 1").groupBy("submission").agg(F.array_sort(F.collect_list("external_id")).alias("duplicate_ids"))
    runs = features.groupBy("submission").agg(F.first("source_format").alias("source_format"), F.sha2(text, 256).alias("submission_hash"), F.count("*").alias("n_features"), F.count_distinct("geom_hash").alias("n_hashes"), F.count_if(F.col("raw").isNotNull()).alias("n_raw"))
    return runs.join(ids, "submission", "left").withColumn("run_id", F.substring("submission_hash", 1, 16))


def append_runs(features: DataFrame, path: str) -> None:
    append_new(ingestion_runs(features), path, "submission_hash")


def append_results(results: DataFrame, path: str) -> None:
    """Results, partitioned by run: a recorded run is skipped as a whole. Nested columns are stored as JSON."""
    nested = [f.name for f in results.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
    append_whole_runs(results.withColumns({c: F.to_json(c) for c in nested}), path)


def append_ledger(evidence: DataFrame, path: str) -> None:
    """Evidence rows, partitioned by run; a recorded run is skipped."""
    append_whole_runs(evidence, path)


def plots_of_run(plots: DataFrame, run_id: str) -> DataFrame:
    """Plots of one ingestion run, in the order of their ids."""
    return plots.filter(F.col("run_id") == run_id).orderBy("plot_id")


def plots_of_consignment(plots: DataFrame, consignment: str) -> DataFrame:
    """Plots of one consignment, in the order of their ids."""
    return plots.filter(F.col("consignment") == consignment).orderBy("plot_id")


def append_consignments(fresh: DataFrame, path: str) -> None:
    """Consignments (consignment, operator) that the table does not hold, the first by name of equal ids; others stay as they are."""
    append_new(fresh.filter("consignment is not null").groupBy("consignment").agg(F.min("operator").alias("operator")), path, "consignment")


def results_from_json(results: DataFrame, like: DataFrame) -> DataFrame:
    """Stored results with the columns of like, nested ones read back from their JSON."""
    nested = {f.name: f.dataType for f in like.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
    return results.withColumns({c: F.from_json(c, kind) for c, kind in nested.items() if c in results.columns}).select(*[c for c in like.columns if c in results.columns])


def with_consignments(plots: DataFrame, fresh: DataFrame) -> DataFrame:
    """plots with the consignment of fresh (plot_id, consignment) where it names one, else their own."""
    new = fresh.select("plot_id", F.col("consignment").alias("_new"))
    return plots.join(new, "plot_id", "left").withColumn("consignment", F.coalesce("_new", "consignment")).drop("_new")


def dataset_version(datasets: DataFrame, needles: DataFrame) -> DataFrame:
    """For each needle the first dataset (by pos) whose name contains it in any case; else the needle and 'unknown'.

    datasets (pos, name, version) is a policy table of a few rows and is broadcast for the containment test.
    """
    hit = needles.join(F.broadcast(datasets), F.contains(F.lower("name"), F.lower("needle")), "left")
    best = hit.groupBy("needle").agg(F.min_by(F.struct("name", "version"), "pos").alias("d"))
    return best.select("needle", F.coalesce("d.name", "needle").alias("dataset_name"), F.when(F.col("d.name").isNull(), "unknown").otherwise(F.col("d.version")).alias("dataset_version"))
