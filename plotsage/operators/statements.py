"""Due-diligence statements: features, conformance, and one row for each consignment.

A statement never claims full compliance: legality is not assessed, and the determination is the highest tier alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotsage.functions import geometry as g
from plotsage.functions.text import reference_number, verification_number
from plotsage.operators.risk import highest
from plotsage.sources.shared import cut

MAX_BYTES, LEAST_PAIRS = 25 * 1024 * 1024, 4
OPEN, SHUT = '{"type":"FeatureCollection","features":[', "]}"
#: Salt of verification numbers; deployments set their own.
SALT = "plotsage.reference-verification.v1"
VALID_DAYS, POLICY_VERSION, CUTOFF, APPLIES_FROM = 365, "2026-06-17", "2020-12-31", "2026-12-30"
# The eight legal areas that a statement names and does not assess.
LEGAL_AREAS = ("land_use_rights", "environmental_protection", "forest_related", "third_parties_rights", "labour_rights", "human_rights", "fpic", "tax_anticorruption_trade_customs")


def coordinates_json(gtype: Column, parts: Column) -> Column:
    """Coordinates as GeoJSON text in degrees, six decimals at most, rings closed."""
    pair = lambda p: F.concat(F.lit("["), g.number_text(p["x"]), F.lit(","), g.number_text(p["y"]), F.lit("]"))
    many = lambda ring: F.concat(F.lit("["), F.array_join(F.transform(ring, pair), ","), F.lit("]"))
    polygon = lambda part: F.concat(F.lit("["), F.array_join(F.transform(part, lambda r: many(g.closed(r))), ","), F.lit("]"))
    return (
        F.when(gtype == "Point", pair(parts[0][0][0]))
        .when(gtype == "Polygon", polygon(parts[0]))
        .when(gtype == "MultiPolygon", F.concat(F.lit("["), F.array_join(F.transform(parts, polygon), ","), F.lit("]")))
        .otherwise(many(parts[0][0]))
    )


def feature_json(plot_id: Column, gtype: Column, parts: Column) -> Column:
    """One feature, keys in fixed order, without blanks."""
    properties = F.to_json(F.struct(F.lit("").alias("ProducerName"), plot_id.cast("string").alias("ProductionPlace"), F.lit(None).cast("double").alias("Area")), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"'), gtype, F.lit('","coordinates":'), coordinates_json(gtype, parts), F.lit("}}"))


def issues(gtype: Column, parts: Column, crossing: Column | None = None) -> Column:
    """Why a feature does not conform: unsupported type, no rings, holes, too few pairs, open rings, self-crossing.

    crossing: whether a ring of the plot meets itself, in a crossing, a touch or a spur (see crossings). Six decimals hold by construction.
    """
    areal = gtype.isin("Polygon", "MultiPolygon")
    rings = F.flatten(parts)
    short = F.exists(rings, lambda r: F.size(r) < LEAST_PAIRS)
    unclosed = F.exists(rings, lambda r: (F.size(r) >= LEAST_PAIRS) & (r[0] != F.element_at(r, -1)))
    return F.array_compact(F.array(
        F.when(~F.coalesce(gtype.isin("Point", "MultiPoint", "LineString", "Polygon", "MultiPolygon"), F.lit(False)), "unsupported geometry type"),
        F.when(areal & F.exists(parts, lambda p: F.size(p) == 0), "no rings"),
        F.when(areal & F.exists(parts, lambda p: F.size(p) > 1), "interior rings"),
        F.when(areal & short, "fewer than 4 pairs"),
        F.when(areal & unclosed, "not closed"),
        F.when(areal & ~short & F.coalesce(crossing if crossing is not None else F.lit(False), F.lit(False)), "self-crossing ring"),
    ))


def eligible(plots: DataFrame) -> DataFrame:
    """Plots (with risk, and issues as jobs.feature_issues makes them) that a statement may hold: assessed, without issues."""
    return plots.filter(F.col("risk").isNotNull() & (F.size("issues") == 0))


def payload_bytes(plots: DataFrame) -> DataFrame:
    """consignment, n_plots, bytes of the collection and conformant, without building it."""
    size = F.octet_length(feature_json(F.col("plot_id"), F.col("gtype"), F.col("parts")))
    total = F.sum(size) + F.count("*") - 1 + len(OPEN) + len(SHUT)
    return plots.groupBy("consignment").agg(F.count("*").alias("n_plots"), total.alias("bytes")).withColumn("conformant", F.col("bytes") < MAX_BYTES)


def collections(plots: DataFrame) -> DataFrame:
    """consignment, plot_ids and geojson, in order of plot_id, where the payload is under the cap; others have null geojson.

    The sizes come first: no consignment over the cap is ever gathered into one row.
    """
    sizes = payload_bytes(plots)
    feature = feature_json(F.col("plot_id"), F.col("gtype"), F.col("parts"))
    small = plots.join(sizes.filter("conformant").select("consignment"), "consignment", "left_semi")
    rows = F.array_sort(F.collect_list(F.struct("plot_id", feature.alias("feature"))))
    built = small.groupBy("consignment").agg(rows.alias("rows")).select("consignment", F.transform("rows", lambda r: r["plot_id"]).alias("plot_ids"), F.concat(F.lit(OPEN), F.array_join(F.transform("rows", lambda r: r["feature"]), ","), F.lit(SHUT)).alias("geojson"))
    return sizes.join(built, "consignment", "left")


def legality() -> Column:
    """Every legal area, not assessed."""
    return F.create_map(*[F.lit(x) for area in LEGAL_AREAS for x in (area, "NOT_ASSESSED")])


def statements(plots: DataFrame, countries: DataFrame, day: Column, run_id: Column, salt: str = SALT) -> DataFrame:
    """One row for each consignment of the eligible among plots (plot_id, consignment, operator, country, risk, gtype, parts,
    issues): header, plot_ids, geojson, legality (a map of areas, none assessed) and numbers.

    countries: country, risk_class, due_diligence_path. day and run_id fix dates and reference numbers; nothing reads the
    clock. A consignment over the size cap has conformant false and no numbers. Eligible plots are written to the shared
    folder, as heads, sizes and collections ask for them.
    """
    plots = cut(eligible(plots).select("plot_id", "consignment", "operator", "country", "risk", "gtype", "parts"), "eligible")
    head = plots.groupBy("consignment").agg(F.min("operator").alias("operator"), F.min("country").alias("country"), highest(F.col("risk")).alias("determination"))
    full = head.join(collections(plots), "consignment").join(F.broadcast(countries), "country", "left")
    reference = F.when(F.col("conformant"), reference_number(F.col("consignment").cast("string"), day, run_id))
    full = full.withColumn("operator", F.coalesce("operator", F.lit(""))).withColumn("reference_number", reference)
    return full.withColumns({
        "verification_number": verification_number(F.col("reference_number"), salt), "valid_from": day, "valid_until": F.date_add(day, VALID_DAYS), "annual_review_required": F.lit(True),
        "legality": legality(), "legality_status": F.lit("NOT_ASSESSED"), "compliance_complete": F.lit(False), "policy_version": F.lit(POLICY_VERSION), "cutoff_date": F.to_date(F.lit(CUTOFF)), "application_date": F.to_date(F.lit(APPLIES_FROM)),
    })
