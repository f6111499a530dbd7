"""Areas on WGS 84 as column expressions: geodesic, equal-area, Web Mercator, and UTM by the Krueger series.

The geodesic area is the spherical excess on authalic latitudes. It differs from that of true geodesic edges at second
order in the length of the edges, which is nothing for plots; it is not meant for polygons of the size of a country.
Hectares throughout; rings are in micro-degrees, closed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotsage.functions.geometry import let, twice_area

A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
N = FLATTENING / (2 - FLATTENING)
Q_POLE = (1 - E2) * (1 / (1 - E2) - math.log((1 - E) / (1 + E)) / (2 * E))
R2 = A * A * Q_POLE / 2
K0, EASTING = 0.9996, 500000.0
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
THRESHOLD_HA, BORDER_HA = 4.0, 0.10
FOOTPRINT_M, FOOTPRINT_SIDES = 50.0, 64


def authalic_q(lat: Column) -> Column:
    return let(F.sin(lat), lambda s: (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E * s) / (1 + E * s)) / (2 * E)))


def half_tangent(lat: Column) -> Column:
    """tan of half the authalic latitude."""
    return F.tan(F.asin(authalic_q(lat) / Q_POLE) / 2)


def radians(micro: Column) -> Column:
    return F.radians(micro / 1e6)


def edges(points: Column, term) -> Column:
    """Sum of term(points, i) over the edges, from point i - 1 to i, of a ring of points."""
    total = lambda ps: F.when(F.size(ps) > 1, F.aggregate(F.sequence(F.lit(1), F.size(ps) - 1), F.lit(0.0), lambda acc, i: acc + term(ps, i))).otherwise(F.lit(0.0))
    return let(points, total)


def geodesic_ring(ring: Column) -> Column:
    points = F.transform(ring, lambda p: F.struct(radians(p["x"]).alias("l"), half_tangent(radians(p["y"])).alias("t")))
    excess = lambda p, i: 2 * F.atan2(F.tan((p[i]["l"] - p[i - 1]["l"]) / 2) * (p[i - 1]["t"] + p[i]["t"]), 1 + p[i - 1]["t"] * p[i]["t"])
    return F.abs(edges(points, excess)) * R2 / 1e4


def shoelace(points: Column) -> Column:
    """Area of projected points u, v; about the first of them, as large coordinates would cancel."""
    cross = lambda p, i: (p[i - 1]["u"] - p[0]["u"]) * (p[i]["v"] - p[0]["v"]) - (p[i]["u"] - p[0]["u"]) * (p[i - 1]["v"] - p[0]["v"])
    return F.abs(edges(points, cross)) / 2 / 1e4


def projected_ring(ring: Column, project) -> Column:
    return shoelace(F.transform(ring, lambda p: project(radians(p["x"]), radians(p["y"]))))


def equal_area(lon: Column, lat: Column) -> Column:
    return F.struct((A * lon).alias("u"), (A * authalic_q(lat) / 2).alias("v"))


def mercator(lon: Column, lat: Column) -> Column:
    return F.struct((A * lon).alias("u"), (A * F.log(F.tan(math.pi / 4 + lat / 2))).alias("v"))


def utm(zone: Column):
    """Projection into the zone of that EPSG code."""
    middle = F.radians(F.when(zone == 32649, 111.0).otherwise(105.0))

    def project(lon: Column, lat: Column) -> Column:
        conformal = let(F.sin(lat), lambda s: F.sinh(F.atanh(s) - E * F.atanh(E * s)))
        plane = let(conformal, lambda t: F.struct(F.atan2(t, F.cos(lon - middle)).alias("xi"), F.atanh(F.sin(lon - middle) / F.sqrt(1 + t * t)).alias("eta")))
        return let(plane, lambda p: series(p["xi"], p["eta"]))

    def series(xi: Column, eta: Column) -> Column:
        north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
        east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), F.lit(0.0))
        return F.struct((EASTING + K0 * RECTIFYING * east).alias("u"), (K0 * RECTIFYING * north).alias("v"))

    return project


def utm_inverse(zone: Column, east: Column, north: Column) -> Column:
    """Micro-degrees (not rounded) of a point in the zone: the series back, then five Newton steps for the latitude."""
    middle = F.when(zone == 32649, 111.0).otherwise(105.0)

    def conformal(tau: Column) -> Column:
        """The tangent of the conformal latitude, of the tangent of the latitude."""
        root = F.sqrt(1 + tau * tau)
        return let(F.sinh(E * F.atanh(E * tau / root)), lambda sigma: tau * F.sqrt(1 + sigma * sigma) - sigma * root)

    def latitude(goal: Column) -> Column:
        gain = lambda tau: (1 + (1 - E2) * tau * tau) / ((1 - E2) * F.sqrt(1 + tau * tau))
        step = lambda tau, _: tau + let(conformal(tau), lambda now: (goal - now) / F.sqrt(1 + now * now)) * gain(tau)
        return F.aggregate(F.sequence(F.lit(1), F.lit(5)), goal / (1 - E2), step)

    def place(xi: Column, eta: Column) -> Column:
        tau = let(F.sin(xi) / F.sqrt(F.pow(F.sinh(eta), 2) + F.pow(F.cos(xi), 2)), latitude)
        return F.struct(((middle + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))) * 1e6).alias("x"), (F.degrees(F.atan(tau)) * 1e6).alias("y"))

    def series(xi: Column, eta: Column) -> Column:
        back_xi = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
        back_eta = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
        return let(F.struct(back_xi.alias("xi"), back_eta.alias("eta")), lambda p: place(p["xi"], p["eta"]))

    scaled = F.struct((north / (K0 * RECTIFYING)).alias("xi"), ((east - EASTING) / (K0 * RECTIFYING)).alias("eta"))
    return let(scaled, lambda p: series(p["xi"], p["eta"]))


def utm_zone(lon_micro: Column) -> Column:
    return F.when(lon_micro >= 108_000_000, 32649).otherwise(32648)


def total(parts: Column, ring_area) -> Column:
    """Exteriors less holes, over all parts; 0 for what has no area."""
    part = lambda p: ring_area(p[0]) - F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.lit(0.0), lambda acc, r: acc + ring_area(r))
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + part(p))


def areas(gtype: Column, parts: Column, lon_micro: Column) -> dict[str, Column]:
    """All bases and their deviations, by column name. lon_micro: a longitude within, which picks the zone."""
    areal = gtype.isin("Polygon", "MultiPolygon")
    basis = lambda f: F.when(areal, total(parts, f)).otherwise(0.0)
    geo = basis(geodesic_ring)
    other = {
        "epsg6933_ha": basis(lambda r: projected_ring(r, equal_area)),
        "epsg3857_ha": basis(lambda r: projected_ring(r, mercator)),
        "utm_ha": basis(lambda r: projected_ring(r, utm(utm_zone(lon_micro)))),
    }
    return {"geodesic_ha": geo, **other}


def deviations(df):
    """Percent of 6933 and 3857 from the geodesic area (0 and null where that is 0), format and borderline flag."""
    some = F.col("geodesic_ha") > 0
    away = lambda c: 100 * (F.col(c) - F.col("geodesic_ha")) / F.col("geodesic_ha")
    return df.withColumns({
        "delta_6933_pct": F.when(some, away("epsg6933_ha")).otherwise(0.0),
        "delta_3857_pct": F.when(some, away("epsg3857_ha")),
        "required_format": required_format(F.col("geodesic_ha")),
        "borderline": F.abs(F.col("geodesic_ha") - THRESHOLD_HA) <= BORDER_HA,
    })


def required_format(hectares: Column) -> Column:
    return F.when(hectares < THRESHOLD_HA, "point").otherwise("polygon")


def mercator_inflation(lat_degrees: Column) -> Column:
    return 1 / F.pow(F.cos(F.radians(lat_degrees)), 2)


def cell_ground_ha(south: Column, north: Column, width: Column) -> Column:
    """Geodesic area of a cell between two latitudes, all in micro-degrees. It depends on the row of the grid alone."""
    tangent = lambda y: half_tangent(radians(y))
    side = lambda y: let(tangent(y), lambda t: 2 * F.atan2(F.tan(radians(width) / 2) * 2 * t, 1 + t * t))
    return F.abs(side(north) - side(south)) * R2 / 1e4


def footprint(x: Column, y: Column) -> Column:
    """The 64-gon of 50 m around a point, as a closed ring of micro-degrees."""
    zone = utm_zone(x)
    angle = lambda i: i % FOOTPRINT_SIDES * (2 * math.pi / FOOTPRINT_SIDES)
    corner = lambda c, i: utm_inverse(zone, c["u"] + FOOTPRINT_M * F.cos(angle(i)), c["v"] + FOOTPRINT_M * F.sin(angle(i)))
    return let(utm(zone)(radians(x), radians(y)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(FOOTPRINT_SIDES)), lambda i: corner(c, i)))


def compactness(ring: Column) -> Column:
    """4 pi area / perimeter squared, planar in degrees; 1 for a ring without length."""
    side = lambda p, i: F.hypot((p[i]["x"] - p[i - 1]["x"]).cast("double"), (p[i]["y"] - p[i - 1]["y"]).cast("double"))
    return let(edges(ring, side), lambda length: F.when(length > 0, 4 * math.pi * F.abs(twice_area(ring)) / 2 / (length * length)).otherwise(1.0))
