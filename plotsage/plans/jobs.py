"""Whole jobs: from plots to findings, areas, samples, tiers and statements, one lineage of DataFrames each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotsage.functions import geodesy as geo
from plotsage.functions import geometry as g
from plotsage.operators import crossings, risk, statements, validation, zonal
from plotsage.sources.shared import by_shape, cut


def with_hash(plots: DataFrame) -> DataFrame:
    return plots.withColumn("geom_hash", g.geometry_hash(F.col("gtype"), F.col("parts")))


def submission_hashes(hashed: DataFrame, by: str) -> DataFrame:
    """Order-free hash of a submission's member hashes, repeats kept, and counts. One row of hashes is a submission."""
    text = F.array_join(F.array_sort(F.collect_list("geom_hash")), "\n")
    return hashed.groupBy(by).agg(F.sha2(text, 256).alias("submission_hash"), F.count("*").alias("n_features"), F.count_distinct("geom_hash").alias("n_hashes"))


def new_rows(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet: what an insert would add."""
    return rows.join(existing.select(key).distinct(), key, "left_anti").select(*rows.columns)


def with_raw(plots: DataFrame) -> DataFrame:
    """Plots with open rings as they were typed, in raw; parts are closed."""
    first, last = F.col("parts")[0][0][0], F.element_at(F.col("parts")[0][0], -1)
    opened = (F.col("gtype") == "Polygon") & (first != last)
    return closed(plots.withColumn("raw", F.when(opened, g.wkt(F.col("gtype"), F.col("parts")))))


def closed(plots: DataFrame) -> DataFrame:
    areal = F.col("gtype").isin("Polygon", "MultiPolygon")
    return plots.withColumn("parts", F.when(areal, g.each_ring(F.col("parts"), g.closed)).otherwise(F.col("parts")))


def validate(plots: DataFrame) -> DataFrame:
    return validation.findings(plots, crossings.repairs(plots))


def measure(plots: DataFrame) -> DataFrame:
    return geo.deviations(plots.withColumns(geo.areas(F.col("gtype"), F.col("parts"), F.col("parts")[0][0][0]["x"])))


def as_rings(boxes: DataFrame) -> DataFrame:
    corner = lambda x, y: g.point(F.col(x), F.col(y))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    return boxes.select("plot_id", F.lit("Polygon").alias("gtype"), F.array(F.array(ring)).alias("parts"))


def feature_issues(plots: DataFrame) -> DataFrame:
    """plots with issues: why a plot may not go into a statement, rings that cross themselves among it."""
    meeting = lambda shapes: crossings.meetings(shapes).filter("part = o_part and ring = o_ring").select("plot_id").distinct()
    crossing = by_shape(closed(plots), meeting).distinct().withColumn("crossing", F.lit(True))
    return plots.join(crossing, "plot_id", "left").withColumn("issues", statements.issues(F.col("gtype"), F.col("parts"), F.col("crossing")))


def footprints(plots: DataFrame) -> DataFrame:
    """plot_id, parts and plot_ha of what is sampled of each plot: its rings, or the footprint of 50 m around a point."""
    at = F.col("parts")[0][0][0]
    around = F.transform(geo.footprint(at["x"], at["y"]), lambda p: g.point(F.rint(p["x"]), F.rint(p["y"])))
    shape = F.when(F.col("gtype") == "Point", F.array(F.array(around))).otherwise(F.col("parts"))
    # a generator's column is made once for all that names it
    shaped = plots.select("plot_id", F.explode(F.array(shape)).alias("parts"))
    return shaped.withColumn("plot_ha", geo.total(F.col("parts"), geo.geodesic_ring))


def sampled(plots: DataFrame, layers: DataFrame, runs: DataFrame) -> DataFrame:
    """Samples (see zonal.samples) of plots that may be sampled, one for each shape among them; runs are those of the rasters."""

    def of_shapes(shapes: DataFrame) -> DataFrame:
        sized = footprints(shapes)
        return zonal.samples(zonal.overlay(sized.select("plot_id", "parts"), layers, runs), layers, sized)

    return by_shape(plots, of_shapes)


def process(spark: SparkSession, plots: DataFrame, layers: DataFrame, cells: DataFrame, provider=None) -> DataFrame:
    """Findings for all plots; area, samples and risk for those that can be sampled and have a geometry.

    provider: takes the sampled plots (plot_id, parts, plot_ha) and returns rows like zonal.samples; the default overlays
    rings and, for points, their footprints of 50 m.
    """
    # rules are many columns, and four of the tables below ask for them
    checked = cut(validate(plots), "checked")
    able = checked.filter(validation.sampleable(F.col("findings")) & F.col("parts").isNotNull())
    measured = measure(able)
    sample = provider(footprints(measured)) if provider else sampled(measured, layers, zonal.raster_runs(cells))
    tiers = risk.assess(sample).select("plot_id", "risk", "rule_id", "boundary_uncertain", "rationale", "loss_fraction", "forest_fraction", "cropland_fraction", "covered_cells")
    areas = measured.select("plot_id", "geodesic_ha", "epsg6933_ha", "epsg3857_ha", "utm_ha", "required_format", "borderline")
    return checked.join(areas, "plot_id", "left").join(tiers, "plot_id", "left").withColumn("assessed", F.col("risk").isNotNull())
