"""Validation rules of single plots, one select; and findings over collections of plots.

Input: plot_id, gtype, parts and, where known, raw (WKT as submitted), crs and asserted_area_ha. Each rule gives at most
one finding, a struct of rule_id, severity, disposition, x and y (of a failing point, or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotsage.functions import geodesy as geo
from plotsage.functions import geometry as g

#: Bounds of the region in micro-degrees, padded by half a degree, both ends in.
WEST, EAST, SOUTH, NORTH = 107_000_000, 109_100_000, 11_900_000, 14_500_000
LEAST_COMPACT, SPIKE_RATIO, SLIVER_HA, LEAST_DECIMALS, REPAIR_SHARE = 0.05, 25.0, 0.02, 2, 0.01
VALID, FIXED, REVIEW = "AUTO_VALID", "AUTO_FIXED", "NEEDS_REVIEW"
DISPOSITIONS = (VALID, FIXED, REVIEW)
#: A plot with one of these is neither measured nor overlaid.
BLOCKING = ("coordinate_out_of_range", "lat_lon_swap", "null_island", "out_of_aoi", "unknown_mixed_crs")
FINDING = "struct<rule_id:string,severity:string,disposition:string,x:bigint,y:bigint>"


def finding(rule: str, severity: str, disposition: str, at: Column | None = None) -> Column:
    x, y = (at["x"], at["y"]) if at is not None else (F.lit(None), F.lit(None))
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(disposition).alias("disposition"), x.cast("long").alias("x"), y.cast("long").alias("y"))


def first_where(points: Column, test) -> Column:
    return F.get(F.filter(points, test), F.lit(0))


def in_region(x: Column, y: Column) -> Column:
    return x.between(WEST, EAST) & y.between(SOUTH, NORTH)


def out_of_range(p: Column) -> Column:
    return (F.abs(p["y"]) > 90_000_000) | (F.abs(p["x"]) > 180_000_000)


def swapped(p: Column) -> Column:
    far = (F.abs(p["y"]) > 90_000_000) & (F.abs(p["x"]) <= 90_000_000)
    return far | (~out_of_range(p) & in_region(p["y"], p["x"]) & ~in_region(p["x"], p["y"]))


def place_finding(points: Column) -> Column:
    """Null island, swapped, out of range, out of the region: the first that holds."""
    zero = first_where(points, lambda p: (p["x"] == 0) | (p["y"] == 0))
    turned, far = first_where(points, swapped), first_where(points, out_of_range)
    outside = first_where(points, lambda p: ~in_region(p["x"], p["y"]))
    return (
        F.when(zero.isNotNull(), finding("null_island", "ERROR", REVIEW, zero))
        .when(turned.isNotNull(), finding("lat_lon_swap", "ERROR", REVIEW, turned))
        .when(far.isNotNull(), finding("coordinate_out_of_range", "ERROR", REVIEW, far))
        .when(outside.isNotNull(), finding("out_of_aoi", "ERROR", REVIEW, outside))
    )


def is_open(raw: Column) -> Column:
    """A POLYGON text of three points or more whose first and last differ as text."""
    ring = F.split(F.split(F.regexp_replace(F.regexp_extract(raw, r"(?s)\((.*)\)", 1), r"^\s*\(", ""), r"\)")[0], ",")
    ends = g.let(ring, lambda r: (F.size(r) >= 3) & (F.trim(r[0]) != F.trim(F.element_at(r, -1))))
    return raw.isNotNull() & F.upper(F.ltrim(raw)).startswith("POLYGON") & ends


def median(values: Column) -> Column:
    mid = lambda s: (s[F.floor((F.size(s) - 1) / 2).cast("int")] + s[F.floor(F.size(s) / 2).cast("int")]) / 2
    return g.let(F.array_sort(values), mid)


def has_spike(ring: Column) -> Column:
    """The farthest point from the middle is more than 25 times as far as the median, and the shape is not compact."""

    def far(points: Column, middle: Column) -> Column:
        reach = F.transform(points, lambda p: F.hypot(p["x"] - middle["x"], p["y"] - middle["y"]))
        return g.let(reach, lambda r: g.let(median(r), lambda m: (m > 0) & (F.array_max(r) / m > SPIKE_RATIO)))

    def test(points: Column) -> Column:
        middle = F.struct(median(F.transform(points, lambda p: p["x"].cast("double"))).alias("x"), median(F.transform(points, lambda p: p["y"].cast("double"))).alias("y"))
        return (F.size(points) >= 4) & g.let(middle, lambda m: far(points, m))

    return F.coalesce(g.let(F.slice(ring, F.lit(1), F.size(ring) - 1), test) & (geo.compactness(ring) < LEAST_COMPACT), F.lit(False))


def findings(plots: DataFrame, repairs: DataFrame | None = None) -> DataFrame:
    """plots with findings (in the order of the rules), disposition and needs_review.

    repairs: plot_id and repair (a disposition) of plots whose geometry is invalid, see crossings.repairs(). Missing
    columns raw, crs and asserted_area_ha count as null. A plot without a geometry has the findings of its text alone.
    """
    for name, kind in (("raw", "string"), ("crs", "string"), ("asserted_area_ha", "double")):
        if name not in plots.columns:
            plots = plots.withColumn(name, F.lit(None).cast(kind))
    plots = plots.join(repairs.select("plot_id", "repair"), "plot_id", "left") if repairs is not None else plots.withColumn("repair", F.lit(None).cast("string"))
    # the columns that several rules need are made once
    ring = g.exterior(F.col("gtype"), F.col("parts"))
    made = plots.withColumn("_points", g.coordinates(F.col("parts"))).withColumn("_ring", ring).withColumn("_place", place_finding(F.col("_points")))
    made = made.withColumn("_compact", F.when(F.col("_ring").isNotNull(), geo.compactness(F.col("_ring"))).otherwise(1.0))
    made = made.withColumn("_ha", F.when(F.col("gtype").isin("Polygon", "MultiPolygon"), geo.total(F.col("parts"), geo.geodesic_ring)).otherwise(0.0))
    made = made.withColumn("_spike", F.col("_ring").isNotNull() & F.col("repair").isNull() & has_spike(F.col("_ring")))
    rule = F.coalesce(F.col("_place.rule_id"), F.lit(""))
    least = F.array_min(F.transform("_points", lambda p: F.greatest(g.decimals(p["x"]), g.decimals(p["y"]))))
    pairs = F.exists(F.sequence(F.lit(1), F.greatest(F.size("_ring") - 1, F.lit(1))), lambda i: F.get(F.col("_ring"), i) == F.get(F.col("_ring"), i - 1))
    every = F.array(
        F.col("_place"),
        F.when(foreign(F.col("crs")) & ~rule.isin("lat_lon_swap", "coordinate_out_of_range"), finding("unknown_mixed_crs", "ERROR", REVIEW)),
        F.when((F.col("gtype") == "Point") & (F.col("asserted_area_ha") >= geo.THRESHOLD_HA), finding("geometry_type_vs_asserted_area", "ERROR", REVIEW)),
        F.when(is_open(F.col("raw")), finding("unclosed_ring", "WARNING", FIXED)),
        F.when(F.col("repair") == FIXED, finding("invalid_geometry", "ERROR", FIXED, g.repeated_vertex(F.col("_ring")))).when(F.col("repair").isNotNull(), finding("invalid_geometry", "ERROR", REVIEW, g.repeated_vertex(F.col("_ring")))),
        F.when(F.col("repair").isNull() & F.coalesce(pairs, F.lit(False)), finding("duplicate_vertices", "WARNING", FIXED)),
        F.when(F.col("_spike"), finding("spike_vertex", "ERROR", REVIEW)),
        F.when(F.col("repair").isNull() & ~F.col("_spike") & (F.col("_ha") > 0) & (F.col("_ha") < SLIVER_HA) & (F.col("_compact") < LEAST_COMPACT), finding("sliver", "ERROR", REVIEW)),
        F.when((F.col("gtype") == "Polygon") & (F.size(F.get(F.col("parts"), F.lit(0))) > 1), finding("holes", "WARNING", REVIEW)),
        F.when((least < LEAST_DECIMALS) & ~rule.isin("null_island", "lat_lon_swap", "coordinate_out_of_range"), finding("grid_snapped_low_precision", "WARNING", VALID)),
    )
    told = made.withColumn("findings", F.array_compact(every)).drop("_points", "_ring", "_place", "_compact", "_ha", "_spike", "repair")
    return told.withColumn("disposition", worst(F.col("findings"))).withColumn("needs_review", F.col("disposition") == REVIEW)


def worst(found: Column) -> Column:
    """The worst disposition among findings; valid if there is none."""
    rank = F.create_map(*[F.lit(x) for i, d in enumerate(DISPOSITIONS) for x in (d, i)])
    at = F.coalesce(F.array_max(F.transform(found, lambda f: rank[f["disposition"]])), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DISPOSITIONS)), at + 1)


def dominating(found: Column) -> Column:
    """The first finding of the worst disposition."""
    return F.get(F.filter(found, lambda f: f["disposition"] == worst(found)), F.lit(0))


def sampleable(found: Column) -> Column:
    return ~F.arrays_overlap(F.transform(found, lambda f: f["rule_id"]), F.array(*map(F.lit, BLOCKING)))


def foreign(crs: Column) -> Column:
    """Whether a reference system is named that is not the expected one."""
    named = F.upper(crs)
    return crs.isNotNull() & ~F.contains(named, F.lit("4326")) & ~F.contains(named, F.lit("CRS84"))


def blocked(parts: Column, crs: Column) -> Column:
    """Whether one of the blocking rules holds, without the other rules: the same as not sampleable(findings)."""
    return place_finding(g.coordinates(parts)).isNotNull() | foreign(crs)


def long_findings(validated: DataFrame) -> DataFrame:
    """One row for each finding: plot_id, nth, and its fields."""
    return validated.select("plot_id", F.posexplode("findings").alias("nth", "f")).select("plot_id", "nth", "f.*")


def duplicate_ids(features: DataFrame, column: str = "external_id") -> DataFrame:
    """Ids that more than one feature has: id, n and a finding's fields. Null ids are no ids."""
    return features.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id", "n", F.lit("duplicate_feature_id").alias("rule_id"), F.lit("ERROR").alias("severity"), F.lit(REVIEW).alias("disposition"))


def first_of_each_hash(features: DataFrame, order: str = "pos") -> DataFrame:
    """The first feature in source order of each geom_hash."""
    return features.withColumn("_n", F.row_number().over(Window.partitionBy("geom_hash").orderBy(order))).filter("_n = 1").drop("_n")
