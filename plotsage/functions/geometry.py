"""Geometry as columns: parts of rings of points in whole micro-degrees.

A geometry is gtype (its name) and parts, an array of polygons, each an array of rings (exterior first), each an array of
struct<x, y>. Points and lines have one part with one ring. Whole numbers make rounding, orientation, equality and hashes
exact, and the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SRID = "SRID=4326;"
PARTS = "array<array<array<struct<x:bigint,y:bigint>>>>"
TYPES = ("Point", "MultiPoint", "LineString", "Polygon", "MultiPolygon", "GeometryCollection")


def micro(degrees: Column) -> Column:
    """Degrees to micro-degrees, half to even; what is rounded once stays as it is."""
    return F.rint(degrees * 1e6).cast("long")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))


def let(value: Column, f) -> Column:
    """f of the value, which is computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def each_ring(parts: Column, f) -> Column:
    return F.transform(parts, lambda part: F.transform(part, f))


def coordinates(parts: Column) -> Column:
    """All points."""
    return F.flatten(F.flatten(parts))


def exterior(gtype: Column, parts: Column) -> Column:
    """The exterior ring of a polygon, else null."""
    return F.when((gtype == "Polygon") & (F.size(parts) > 0), parts[0][0])


def closed(ring: Column) -> Column:
    return let(ring, lambda r: F.when((F.size(r) > 0) & (r[0] != F.element_at(r, -1)), F.concat(r, F.array(r[0]))).otherwise(r))


def twice_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring, exact; positive if counter-clockwise. Relative to the first point."""

    def total(r: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            a, b, o = r[i - 1], r[i], r[0]
            return acc + (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])

        return F.when(F.size(r) > 2, F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0).cast("long"), step)).otherwise(F.lit(0).cast("long"))

    return let(ring, total)


def oriented(ring: Column, hole: bool) -> Column:
    """Exteriors counter-clockwise, holes clockwise."""
    return let(ring, lambda r: F.when(twice_area(r) > 0 if hole else twice_area(r) < 0, F.reverse(r)).otherwise(r))


def rotated(ring: Column) -> Column:
    """A closed ring from its smallest point on, closed again."""
    def turned(points: Column) -> Column:
        return let(points, from_least)

    def from_least(open_: Column) -> Column:
        at = lambda k: F.concat(F.slice(open_, k, F.size(open_)), F.slice(open_, F.lit(1), k - 1), F.array(open_[k - 1]))
        return let(F.array_position(open_, F.array_min(open_)).cast("int"), at)

    return let(ring, lambda r: F.when(F.size(r) > 1, turned(F.slice(r, F.lit(1), F.size(r) - 1))).otherwise(r))


def canonical(gtype: Column, parts: Column) -> Column:
    """The same geometry always as the same parts: closed, oriented, rotated, holes and parts in order."""
    ring = lambda r, hole: rotated(oriented(closed(r), hole))
    part = lambda p: F.concat(F.array(ring(p[0], False)), F.array_sort(F.transform(F.slice(p, F.lit(2), F.size(p)), lambda r: ring(r, True))))
    keyed = lambda ps: F.array_sort(F.transform(F.transform(ps, part), lambda p: F.struct(polygon_text(p).alias("text"), p.alias("part"))))
    return let(parts, lambda ps: F.when(gtype.isin("Polygon", "MultiPolygon"), F.transform(keyed(ps), lambda x: x["part"])).otherwise(ps))


def number_text(value: Column) -> Column:
    """Micro-degrees as degrees, without trailing zeros."""
    size = F.abs(value)
    text = F.format_string("%d.%06d", F.floor(size / 1_000_000), size % 1_000_000)
    return F.concat(F.when(value < 0, "-").otherwise(""), F.regexp_replace(text, r"\.?0+$", ""))


def points_text(ring: Column) -> Column:
    return F.array_join(F.transform(ring, lambda p: F.concat(number_text(p["x"]), F.lit(" "), number_text(p["y"]))), ", ")


def polygon_text(part: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(part, lambda r: F.concat(F.lit("("), points_text(r), F.lit(")"))), ", "), F.lit(")"))


def wkt(gtype: Column, parts: Column) -> Column:
    return let(parts, lambda ps: _wkt(gtype, ps))


def _wkt(gtype: Column, parts: Column) -> Column:
    polygons = F.array_join(F.transform(parts, polygon_text), ", ")
    return (
        F.when(gtype == "Polygon", F.concat(F.lit("POLYGON "), polygons))
        .when(gtype == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON ("), polygons, F.lit(")")))
        .when(gtype == "MultiPoint", F.concat(F.lit("MULTIPOINT ("), F.array_join(F.transform(parts[0][0], lambda p: F.concat(F.lit("("), points_text(F.array(p)), F.lit(")"))), ", "), F.lit(")")))
        .otherwise(F.concat(F.upper(gtype), F.lit(" ("), points_text(parts[0][0]), F.lit(")")))
    )


def canonical_wkt(gtype: Column, parts: Column) -> Column:
    return F.concat(F.lit(SRID), wkt(gtype, canonical(gtype, parts)))


def geometry_hash(gtype: Column, parts: Column) -> Column:
    return F.sha2(canonical_wkt(gtype, parts), 256)


def raw_hash(raw: Column) -> Column:
    """Hash of a text that was not parsed: blanks collapsed, keyed by its type."""
    return F.sha2(F.concat(F.lit(f"{SRID}RAW;"), raw_type(raw), F.lit(";"), F.trim(F.regexp_replace(raw, r"\s+", " "))), 256)


def raw_type(raw: Column) -> Column:
    """Type of a WKT text by its head alone."""
    head = F.upper(F.split(F.trim(F.split(raw, r"\(")[0]), " ")[0])
    names = F.create_map(*[F.lit(x) for t in TYPES for x in (t.upper(), t)])
    return F.coalesce(names[head], F.initcap(head))


def parse_wkt(raw: Column) -> Column:
    """parts of a WKT text; rings of polygons are closed; null where it cannot be read."""
    return let(F.struct(raw_type(raw).alias("kind"), F.regexp_extract(raw, r"(?s)\((.*)\)", 1).alias("body")), lambda x: _parts(x["kind"], x["body"]))


def _parts(kind: Column, body: Column) -> Column:
    pair = r"^[-+0-9.eE]+\s+[-+0-9.eE]+"
    read = lambda text: F.transform(F.split(F.regexp_replace(text, r"[()]", ""), ","), lambda p: F.when(F.trim(p).rlike(pair), point(micro(F.split(F.trim(p), r"\s+")[0].try_cast("double")), micro(F.split(F.trim(p), r"\s+")[1].try_cast("double")))))
    rings = lambda text: F.transform(F.split(text, r"\)\s*,\s*\("), read)
    parts = (
        F.when(kind == "Polygon", F.array(F.transform(rings(body), closed)))
        .when(kind == "MultiPolygon", F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), lambda part: F.transform(rings(part), closed)))
        .when(kind.isin("Point", "MultiPoint", "LineString"), F.array(F.array(read(body))))
    )
    return let(parts, lambda ps: F.when(~F.exists(coordinates(ps), lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull()), ps))


def decimals(value: Column) -> Column:
    """Significant decimals of a micro-degree value."""
    return F.length(F.regexp_replace(F.format_string("%06d", F.abs(value) % 1_000_000), "0+$", ""))


def repeated_vertex(ring: Column) -> Column:
    """The first point that stands in an open ring before already, not as its neighbour."""
    again = lambda open_: F.filter(open_, lambda p, i: (F.array_position(open_, p) < i) & (i > 0))
    return F.when(F.size(ring) > 1, F.get(let(F.slice(ring, F.lit(1), F.size(ring) - 1), again), F.lit(0)))
