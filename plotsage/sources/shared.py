"""Tables in the folder that all executors share: what cuts lineage, and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the setting is missing, which can only be made before Spark starts: the folder of each application on one machine.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. On one machine without the setting, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = "file://" + tempfile.mkdtemp(prefix="plotsage-")
    return _own_folders[application]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: ends its lineage.

    The folder keeps the tables that results read, until its owner clears it."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def by_shape(plots: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f of the different shapes among plots (plot_id, gtype, parts), each looked at once, for every plot that has the shape.

    f takes a table of the same three columns and returns rows with its plot_id. The shapes are written to the shared folder;
    both joins are shuffles, so a shape that many plots have is split by adaptive execution."""
    keyed = plots.select("plot_id", "gtype", "parts", F.xxhash64("gtype", "parts").alias("hash"))
    shapes = cut(keyed.select("hash", "gtype", "parts").distinct().withColumn("shape", F.monotonically_increasing_id()), "shapes")
    told = f(shapes.select(F.col("shape").alias("plot_id"), "gtype", "parts")).withColumnRenamed("plot_id", "shape")
    of = shapes.hint("merge")
    same = (keyed["hash"] == of["hash"]) & keyed["gtype"].eqNullSafe(of["gtype"]) & keyed["parts"].eqNullSafe(of["parts"])
    return keyed.join(of, same).select("plot_id", "shape").join(told.hint("merge"), "shape").drop("shape")
