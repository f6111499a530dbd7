"""Validity of polygons, and what repairs them.

Segments of a plot that meet are found by a join on the cells of a grid of its own. Meetings alone tell crossings and
touches; how rings are nested is told by winding numbers, and whether touching rings part the interior by the cycles of a
graph of rings and points. A repair is made from the planar arrangement of all segments: they are cut where they meet,
what falls together is one edge, and of each edge both sides have a winding number for each ring. Edges with the inside on
one side only are the outline of the repaired shape. Meetings, cuts and winding numbers are joins and sums; only the
outlines of invalid plots are linked to rings one plot at a time.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotsage.functions import geodesy as geo
from plotsage.functions import geometry as g
from plotsage.operators.validation import FIXED, REPAIR_SHARE, REVIEW
from plotsage.sources.shared import by_shape, cut

#: Segments for each cell of a plot's grid: a short ring is one cell, a long one has cells along both sides.
PER_CELL = 16
#: Edges for each band of a plot that a ray is sent through.
PER_BAND = 8


def segments(plots: DataFrame, *more: str) -> DataFrame:
    """plot_id, part, ring, nth, n (segments of the ring), ax, ay, bx, by of every segment that has a length; and more columns.

    Repeated neighbours make no segment: they are no fault of the ring here.
    """
    rings = plots.filter(F.col("gtype").isin("Polygon", "MultiPolygon")).select("plot_id", *more, F.posexplode("parts").alias("part", "p")).select("plot_id", *more, "part", F.posexplode("p").alias("ring", "r"))
    tidy = F.filter("r", lambda v, i: (i == 0) | (v != F.get(F.col("r"), F.greatest(i - 1, F.lit(0)))))
    tidy = rings.withColumn("r", tidy).withColumn("n", F.size("r") - 1).filter("n > 0")
    segment = lambda i: F.struct(i.alias("nth"), F.col("r")[i]["x"].alias("ax"), F.col("r")[i]["y"].alias("ay"), F.col("r")[i + 1]["x"].alias("bx"), F.col("r")[i + 1]["y"].alias("by"))
    each = tidy.select("plot_id", *more, "part", "ring", "n", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), segment)).alias("s"))
    return each.select("plot_id", *more, "part", "ring", "n", "s.*")


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum(((F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax))).cast("double"))


def _within(ax, ay, bx, by, cx, cy) -> Column:
    """c lies in the box of a and b."""
    return F.col(cx).between(F.least(ax, bx), F.greatest(ax, bx)) & F.col(cy).between(F.least(ay, by), F.greatest(ay, by))


def meetings(plots: DataFrame) -> DataFrame:
    """plot_id, kind, x, y and both segments (part, ring, nth, ax to by; o_part and so on) of each pair that meets, neighbours of a ring left out.

    kind: cross (interiors cross), touch (a point of one on the other), overlap (along a stretch). x, y: where they touch
    or cross, to the nearest whole number. Neighbours in a ring meet in one point by right and count only if they overlap, as a spur does. Long segments fall into several cells, and a
    pair that shares several is counted once, in the cell of its boxes' common lower corner.
    """
    # the box and the number of points are read off the geometry, before it is taken apart
    points = g.coordinates(F.col("parts"))
    bound = lambda f, c: f(F.transform("_points", lambda p: p[c]))
    boxed = plots.withColumn("_points", points).withColumns({"x0": bound(F.array_min, "x"), "y0": bound(F.array_min, "y"), "x1": bound(F.array_max, "x"), "y1": bound(F.array_max, "y"), "side": F.ceil(F.sqrt(F.size("_points") / PER_CELL))})
    seg = segments(boxed, "x0", "y0", "x1", "y1", "side")
    cell = lambda v, lo, hi: F.expr(f"({v} - {lo}) * side div greatest({hi} - {lo} + 1, 1)")
    for name, v, lo, hi in (("c0", "least(ax, bx)", "x0", "x1"), ("c1", "greatest(ax, bx)", "x0", "x1"), ("r0", "least(ay, by)", "y0", "y1"), ("r1", "greatest(ay, by)", "y0", "y1")):
        seg = seg.withColumn(name, cell(v, lo, hi))
    seg = seg.withColumn("c", F.explode(F.sequence("c0", "c1"))).withColumn("r", F.explode(F.sequence("r0", "r1")))
    names = ("part", "ring", "nth", "n", "ax", "ay", "bx", "by", "c0", "r0")
    seg = seg.select("plot_id", "c", "r", *names)
    # the same columns on both sides: Spark makes and shuffles them once
    other = seg.toDF("plot_id", "c", "r", *[f"o_{x}" for x in names])
    pairs = seg.join(other, ["plot_id", "c", "r"]).filter("struct(part, ring, nth) < struct(o_part, o_ring, o_nth)")
    pairs = pairs.filter("c = greatest(c0, o_c0) and r = greatest(r0, o_r0)")
    d1, d2 = _turn("ax", "ay", "bx", "by", "o_ax", "o_ay"), _turn("ax", "ay", "bx", "by", "o_bx", "o_by")
    d3, d4 = _turn("o_ax", "o_ay", "o_bx", "o_by", "ax", "ay"), _turn("o_ax", "o_ay", "o_bx", "o_by", "bx", "by")
    on = ((d1 == 0) & _within("ax", "ay", "bx", "by", "o_ax", "o_ay")) | ((d2 == 0) & _within("ax", "ay", "bx", "by", "o_bx", "o_by")) | ((d3 == 0) & _within("o_ax", "o_ay", "o_bx", "o_by", "ax", "ay")) | ((d4 == 0) & _within("o_ax", "o_ay", "o_bx", "o_by", "bx", "by"))
    line = (d1 == 0) & (d2 == 0)
    shared = lambda lo_a, hi_a, lo_b, hi_b: F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b)
    along = F.greatest(
        shared(F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("o_ax", "o_bx"), F.greatest("o_ax", "o_bx")),
        shared(F.least("ay", "by"), F.greatest("ay", "by"), F.least("o_ay", "o_by"), F.greatest("o_ay", "o_by")),
    )
    near = F.expr("part = o_part and ring = o_ring and (o_nth - nth = 1 or o_nth - nth = n - 1)")
    kind = F.when((d1 * d2 < 0) & (d3 * d4 < 0), "cross").when(line & on & (along > 0), "overlap").when(on & ~near, "touch")
    pairs = pairs.withColumn("kind", kind).filter("kind is not null")
    at = F.expr("((o_ax - ax) * (o_by - o_ay) - (o_ay - ay) * (o_bx - o_ax)) / ((bx - ax) * (o_by - o_ay) - (by - ay) * (o_bx - o_ax))")
    touched = lambda v: F.when((d1 == 0) & _within("ax", "ay", "bx", "by", "o_ax", "o_ay"), F.col(f"o_a{v}")).when((d2 == 0) & _within("ax", "ay", "bx", "by", "o_bx", "o_by"), F.col(f"o_b{v}")).when((d3 == 0) & _within("o_ax", "o_ay", "o_bx", "o_by", "ax", "ay"), F.col(f"a{v}")).otherwise(F.col(f"b{v}"))
    place = lambda v: F.when(F.col("kind") == "cross", F.col(f"a{v}") + F.rint(at * (F.col(f"b{v}") - F.col(f"a{v}"))).cast("long")).otherwise(touched(v)).alias(v)
    told = ("part", "ring", "nth", "n", "ax", "ay", "bx", "by")
    return pairs.select("plot_id", "kind", place("x"), place("y"), *told, *[f"o_{c}" for c in told])


def arrangement(plots: DataFrame, met: DataFrame) -> DataFrame:
    """plot_id, lx, ly, hx, hy, part, ring and m of each edge of the arrangement and ring on it: m counts how often the ring runs
    from the lower end (by y, then x) to the higher, less how often the other way.

    met: meetings(plots). Segments are cut at all points where others meet them; crossings stand on whole numbers. Edges
    meet in ends only, unless rounding moved them by half a unit over another."""
    own = ["plot_id", "part", "ring", "nth"]
    both = met.select(*own, "kind", "x", "y", *[f"{o}{e}{v}" for o in ("", "o_") for e in "ab" for v in "xy"])
    turned = met.select("plot_id", *[F.col(f"o_{c}").alias(c) for c in own[1:]], "kind", "x", "y", *[F.col(f"{o}{e}{v}").alias(f"{n}{e}{v}") for o, n in (("o_", ""), ("", "o_")) for e in "ab" for v in "xy"])
    pair = both.unionByName(turned)
    flat = lambda e: _turn("ax", "ay", "bx", "by", f"o_{e}x", f"o_{e}y") == 0
    end = lambda e: F.when((F.col("kind") != "cross") & flat(e) & _within("ax", "ay", "bx", "by", f"o_{e}x", f"o_{e}y"), g.point(F.col(f"o_{e}x"), F.col(f"o_{e}y")))
    cuts = pair.withColumn("cut", F.explode(F.array_compact(F.array(F.when(F.col("kind") == "cross", g.point(F.col("x"), F.col("y"))), end("a"), end("b"))))).groupBy(*own).agg(F.collect_set("cut").alias("cuts"))
    seg = segments(plots).join(cuts, own, "left")
    a, b = g.point(F.col("ax"), F.col("ay")), g.point(F.col("bx"), F.col("by"))
    along = lambda p: (p["x"] - F.col("ax")) * (F.col("bx") - F.col("ax")) + (p["y"] - F.col("ay")) * (F.col("by") - F.col("ay"))
    inner = F.transform(F.array_sort(F.transform(F.filter("cuts", lambda p: (p != a) & (p != b)), lambda p: F.struct(along(p).alias("t"), p.alias("p")))), lambda x: x["p"])
    points = F.when(F.col("cuts").isNull(), F.array(a, b)).otherwise(F.concat(F.array(a), inner, F.array(b)))
    step = lambda i: F.struct(F.get("points", i).alias("f"), F.get("points", i + 1).alias("t"))
    sub = seg.select("plot_id", "part", "ring", points.alias("points")).select("plot_id", "part", "ring", F.explode(F.transform(F.sequence(F.lit(0), F.size("points") - 2), step)).alias("e")).select("plot_id", "part", "ring", "e.f", "e.t").filter("f <> t")
    up = F.expr("t.y > f.y OR (t.y = f.y AND t.x > f.x)")
    side = lambda v, low: F.when(up, F.col(f"{'f' if low else 't'}.{v}")).otherwise(F.col(f"{'t' if low else 'f'}.{v}"))
    keyed = sub.select("plot_id", "part", "ring", side("x", True).alias("lx"), side("y", True).alias("ly"), side("x", False).alias("hx"), side("y", False).alias("hy"), F.when(up, 1).otherwise(-1).alias("m"))
    return keyed.groupBy("plot_id", *ENDS, "part", "ring").agg(F.sum("m").alias("m"))


ENDS = ("lx", "ly", "hx", "hy")


def sides(edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """plot_id, the ends of an edge, part, ring, left and right: the winding numbers of each ring on both sides of each edge,
    looking from its lower end; rings that wind around neither side and do not lie on it have no row.

    edges: arrangement(); asked: those edges (plot_id and ends) that are asked about, all by default. From the middle of an edge a ray goes right, from
    that of a level edge upwards; each edge that it meets adds what its rings wind. Rays and edges meet by an equi-join on
    bands of the plot."""
    least = edges.groupBy("plot_id").agg(F.min(F.least("lx", "hx")).alias("x0"), F.max(F.greatest("lx", "hx")).alias("x1"), F.min("ly").alias("y0"), F.max("hy").alias("y1"), F.ceil(F.count("*") / PER_BAND).alias("bands"))
    level = F.col("ly") == F.col("hy")
    # twice the coordinates: middles are whole numbers
    band = lambda twice, lo, hi: F.expr(f"(({twice}) - 2 * {lo}) * bands div (2 * ({hi} - {lo} + 1))")
    rays = (asked if asked is not None else edges.select("plot_id", *ENDS).distinct()).join(least, "plot_id")
    rays = rays.withColumns({"axis": F.when(level, 1).otherwise(0), "mx": F.expr("lx + hx"), "my": F.expr("ly + hy")})
    rays = rays.withColumn("band", F.when(level, band("mx", "x0", "x1")).otherwise(band("my", "y0", "y1"))).select("plot_id", *ENDS, "axis", "band", "mx", "my")
    held = edges.filter("m <> 0").join(least, "plot_id")
    reach = lambda axis, a, b, lo, hi: F.struct(F.lit(axis).alias("axis"), band(f"2 * least({a}, {b})", lo, hi).alias("b0"), band(f"2 * greatest({a}, {b})", lo, hi).alias("b1"))
    held = held.withColumn("of", F.explode(F.array(reach(0, "ly", "hy", "y0", "y1"), reach(1, "lx", "hx", "x0", "x1")))).withColumn("band", F.explode(F.sequence("of.b0", "of.b1")))
    held = held.select("plot_id", F.col("of.axis").alias("axis"), "band", "part", "ring", "m", *[F.col(c).alias(f"o_{c}") for c in ENDS])
    met = rays.join(held, ["plot_id", "axis", "band"])
    beside = "(mx - 2 * o_lx) * (o_hy - o_ly)"
    above = "(my - 2 * o_ly) * (o_hx - o_lx)"
    hit = F.expr(f"""CASE WHEN axis = 0 AND 2 * o_ly <= my AND my < 2 * o_hy AND {above} > {beside} THEN m
        WHEN axis = 1 AND 2 * o_lx <= mx AND mx < 2 * o_hx AND {beside} > {above} THEN -m
        WHEN axis = 1 AND 2 * o_hx <= mx AND mx < 2 * o_lx AND {beside} < {above} THEN m END""")
    wound = met.withColumn("w", hit).filter("w is not null").select("plot_id", *ENDS, "part", "ring", "w", F.lit(0).cast("long").alias("m"))
    lying = edges.select("plot_id", *ENDS, "part", "ring", F.lit(0).cast("long").alias("w"), "m")
    lying = lying.join(asked.select("plot_id", *ENDS), ["plot_id", *ENDS], "left_semi") if asked is not None else lying
    both = wound.unionByName(lying).groupBy("plot_id", *ENDS, "part", "ring").agg(F.sum("w").alias("w"), F.sum("m").alias("m"))
    return both.select("plot_id", *ENDS, "part", "ring", F.when(level, F.col("w")).otherwise(F.col("w") + F.col("m")).alias("left"), F.when(level, F.col("w") - F.col("m")).otherwise(F.col("w")).alias("right"))


def outline(edges: DataFrame, met: DataFrame) -> DataFrame:
    """plot_id, fx, fy, tx, ty of the edges of the repaired shape, its inside to their left.

    Inside is what an exterior ring winds around, whichever way and however often, but no hole of the same part does; holes
    that have nothing to do with their exterior ring count as parts."""
    told = sides(edges)
    of_part = told.groupBy("plot_id", *ENDS, "part").agg(F.max(F.when(F.col("ring") == 0, F.struct("left", "right"))).alias("shell"), F.collect_list(F.when(F.col("ring") > 0, F.struct("ring", "left", "right"))).alias("holes"))
    shared = lambda h: ((h["left"] != 0) & (F.col("shell.left") != 0)) | ((h["right"] != 0) & (F.col("shell.right") != 0))
    within = of_part.filter("shell is not null").select("plot_id", "part", F.explode(F.filter("holes", shared)).alias("h")).select("plot_id", "part", "h.ring")
    meets = met.filter("part = o_part and ring = 0 and o_ring > 0").select("plot_id", "part", F.col("o_ring").alias("ring"))
    true_holes = within.unionByName(meets).groupBy("plot_id", "part").agg(F.collect_set("ring").alias("true_holes"))
    full = of_part.join(true_holes, ["plot_id", "part"], "left")
    is_hole = lambda h: F.coalesce(F.array_contains("true_holes", h["ring"]), F.lit(False))

    def inside(side: str) -> Column:
        shell = F.coalesce(F.col(f"shell.{side}") != 0, F.lit(False)) & ~F.exists("holes", lambda h: is_hole(h) & (h[side] != 0))
        return F.bool_or(shell | F.exists("holes", lambda h: ~is_hole(h) & (h[side] != 0))).alias(side)

    bounds = full.groupBy("plot_id", *ENDS).agg(inside("left"), inside("right")).filter("left <> right")
    pick = lambda up, down: F.when(F.col("left"), F.col(up)).otherwise(F.col(down))
    return bounds.select("plot_id", pick("lx", "hx").alias("fx"), pick("ly", "hy").alias("fy"), pick("hx", "lx").alias("tx"), pick("hy", "ly").alias("ty"))


def _linked(edges: list[tuple]) -> list[list[tuple]]:
    """Closed rings of edges (from, to) with the inside to their left; no ring comes twice to one point."""
    leaving: dict[tuple, list] = {}
    for f, t in sorted(edges):
        leaving.setdefault(f, []).append(t)
    rings = []
    while leaving:
        at = min(leaving)
        path, seen = [at], {at: 0}
        while path:
            f = path[-1]
            if f not in leaving:
                break  # an edge that rounding left without a successor
            back = math.atan2(path[-2][1] - f[1], path[-2][0] - f[0]) if len(path) > 1 else math.pi
            # leftmost: the first edge clockwise from the one that led here
            t = min(leaving[f], key=lambda t: (back - math.atan2(t[1] - f[1], t[0] - f[0])) % (2 * math.pi) or 2 * math.pi)
            leaving[f].remove(t)
            if not leaving[f]:
                del leaving[f]
            if t in seen:  # a ring is closed; what led to it goes on
                rings.append([*path[seen[t] :], t])
                for p in path[seen[t] + 1 :]:
                    del seen[p]
                path = path[: seen[t] + 1]
                if len(path) == 1 and path[0] not in leaving:
                    break
            else:
                seen[t] = len(path)
                path.append(t)
    return rings


def _twice_area(ring: list[tuple]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def _holds(ring: list[tuple], x2: int, y2: int) -> bool:
    """Whether a point (twice its coordinates) lies within a ring."""
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (2 * ay <= y2) != (2 * by <= y2):
            away = (y2 - 2 * ay) * (bx - ax) - (x2 - 2 * ax) * (by - ay)
            inside ^= (away > 0) == (by > ay)
    return inside


def _polygons(edges: list[tuple]) -> list[list[list[tuple]]]:
    """Parts of rings: holes go to the smallest exterior ring around them."""
    rings = _linked(edges)
    parts = [[r] for r in sorted(rings, key=_twice_area) if _twice_area(r) > 0]
    for hole in (r for r in rings if _twice_area(r) < 0):
        (ax, ay), (bx, by) = hole[:2]
        around = next((p for p in parts if _holds(p[0], ax + bx, ay + by)), None)
        if around:
            around.append(hole)
    return parts


def rebuilt(plots: DataFrame, met: DataFrame) -> DataFrame:
    """plot_id and rebuilt (parts) of each of plots: its repaired shape; plots of which no area is left have no row.

    Exterior rings keep all they wind around, so a ring that crosses itself falls into lobes; holes are taken off, parts
    are united. Points where segments met stay in the rings."""
    found = outline(cut(arrangement(plots, met), "repair-edges"), met)
    kind = dict(plots.dtypes)["plot_id"]

    def link(table: pa.Table) -> pa.Table:
        fx, fy, tx, ty = (table.column(c).to_pylist() for c in ("fx", "fy", "tx", "ty"))
        parts = _polygons([((a, b), (c, d)) for a, b, c, d in zip(fx, fy, tx, ty, strict=True)])
        made = [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]
        point = pa.struct([("x", pa.int64()), ("y", pa.int64())])
        return pa.table({"plot_id": table.column("plot_id").slice(0, 1), "rebuilt": pa.array([made], pa.list_(pa.list_(pa.list_(point))))})

    return found.groupBy("plot_id").applyInArrow(link, f"plot_id {kind}, rebuilt {g.PARTS}").filter("size(rebuilt) > 0")


def without_spurs(ring: Column) -> Column:
    """A ring without its spurs: points between two equal ones, and points that go back along their own segment, go."""

    def step(acc: Column, p: Column) -> Column:
        last, before = F.element_at(acc, -1), F.element_at(acc, -2)
        back = ((last["x"] - before["x"]) * (p["y"] - last["y"]) == (last["y"] - before["y"]) * (p["x"] - last["x"])) & ((last["x"] - before["x"]) * (p["x"] - last["x"]) + (last["y"] - before["y"]) * (p["y"] - last["y"]) < 0)
        kept = F.when((F.size(acc) > 1) & back, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return g.let(kept, lambda k: F.when((F.size(k) > 0) & (F.element_at(k, -1) == p), k).otherwise(F.concat(k, F.array(p))))

    return F.aggregate(F.slice(ring, F.lit(2), F.size(ring)), F.array(ring[0]), step)


def nesting(plots: DataFrame, met: DataFrame) -> DataFrame:
    """plot_id, n_outside, n_nested_holes and n_nested_parts of plots whose rings are nested wrongly: holes outside their exterior
    ring, holes in holes, parts in parts. plots have several rings, of which none may cross or overlap; met: meetings(plots).

    One edge of each ring asks where it lies."""
    edges = cut(arrangement(plots, met.join(plots.select("plot_id"), "plot_id", "left_semi")), "nested-edges")
    one = edges.groupBy("plot_id", F.col("part").alias("of_part"), F.col("ring").alias("of_ring")).agg(F.min(F.struct(*ENDS)).alias("e")).select("plot_id", "of_part", "of_ring", "e.*")
    told = sides(edges, one.select("plot_id", *ENDS).distinct()).filter("left <> 0 and right <> 0")
    at = one.join(told, ["plot_id", *ENDS], "left").groupBy("plot_id", "of_part", "of_ring", "part").agg(F.max(F.col("ring") == 0).alias("in_shell"), F.count_if(F.col("ring") > 0).alias("in_holes"))
    of = at.groupBy("plot_id", "of_part", "of_ring").agg(
        F.coalesce(F.max(F.expr("part = of_part and in_shell")), F.lit(False)).alias("at_home"), F.coalesce(F.max(F.expr("part = of_part and in_holes > 0")), F.lit(False)).alias("in_hole"),
        F.coalesce(F.max(F.expr("part <> of_part and in_shell and in_holes = 0")), F.lit(False)).alias("in_part"),
    )
    counted = of.groupBy("plot_id").agg(F.count_if(F.expr("of_ring > 0 and not at_home")).alias("n_outside"), F.count_if(F.expr("of_ring > 0 and in_hole")).alias("n_nested_holes"), F.count_if(F.expr("of_ring = 0 and in_part")).alias("n_nested_parts"))
    return counted.filter("n_outside + n_nested_holes + n_nested_parts > 0")


def parted(met: DataFrame) -> DataFrame:
    """plot_id of plots whose interior falls apart because rings of a part touch each other in a circle.

    Rings and points where they touch are a graph; its edges are followed one by one, and one whose ends are connected
    already closes a circle."""
    touch = met.filter("kind = 'touch' and part = o_part and ring <> o_ring")
    name = lambda ring: F.concat(F.lit("ring "), F.col(ring).cast("string"))
    at = F.concat_ws(" ", "x", "y")
    ends = touch.select("plot_id", "part", F.explode(F.array(F.struct(name("ring").alias("ring"), at.alias("at")), F.struct(name("o_ring").alias("ring"), at.alias("at")))).alias("e"))
    each = ends.groupBy("plot_id", "part").agg(F.array_sort(F.collect_set("e")).alias("edges"))

    def follow(acc: Column, e: Column) -> Column:
        holds = lambda group: F.array_contains(group, e["ring"]) | F.array_contains(group, e["at"])
        closes = F.exists(acc["groups"], lambda group: F.array_contains(group, e["ring"]) & F.array_contains(group, e["at"]))
        joined = F.array_distinct(F.concat(F.flatten(F.filter(acc["groups"], holds)), F.array(e["ring"], e["at"])))
        return F.struct((acc["closed"] | closes).alias("closed"), F.concat(F.filter(acc["groups"], lambda group: ~holds(group)), F.array(joined)).alias("groups"))

    start = F.struct(F.lit(False).alias("closed"), F.array().cast("array<array<string>>").alias("groups"))
    return each.filter(F.aggregate("edges", start, follow)["closed"]).select("plot_id").distinct()


COUNTS = ("n_cross", "n_overlap", "n_touch", "n_outside", "n_nested_holes", "n_nested_parts", "n_parted", "n_flat")
# What is said of a plot, by the first of COUNTS that is not 0.
REASONS = ("Self-intersection", "Ring overlaps itself", "Ring Self-intersection", "Hole lies outside shell", "Holes are nested", "Nested shells", "Interior is disconnected", "Too few points in geometry component")


def faults(plots: DataFrame, met: DataFrame) -> DataFrame:
    """plot_id and COUNTS of each plot that is not valid: pairs of segments that cross or overlap (of one ring or several),
    touches of a ring with itself, rings nested wrongly, an interior that touching rings part, exterior rings without area.

    Rings of one part may touch in single points, as may parts. Nesting is looked at where nothing crosses or overlaps."""
    told = met.groupBy("plot_id").agg(F.count_if(F.expr("kind = 'cross'")).alias("n_cross"), F.count_if(F.expr("kind = 'overlap'")).alias("n_overlap"), F.count_if(F.expr("kind = 'touch' and part = o_part and ring = o_ring")).alias("n_touch"))
    rough = told.filter("n_cross + n_overlap > 0").select("plot_id")
    several = (F.size("parts") > 1) | F.exists("parts", lambda p: F.size(p) > 1)
    n_flat = F.size(F.filter("parts", lambda p: (F.size(p) > 0) & (g.twice_area(p[0]) == 0)))
    # one look at all plots; most have one ring, and an area
    seen = plots.filter(F.col("gtype").isin("Polygon", "MultiPolygon")).select("plot_id", "gtype", F.when(several, F.col("parts")).alias("parts"), n_flat.alias("n_flat"))
    seen = cut(seen.filter("n_flat > 0 or parts is not null"), "rings")
    many = seen.filter("n_flat = 0 and parts is not null").join(rough, "plot_id", "left_anti")
    full = told.join(parted(met).withColumn("n_parted", F.lit(1)), "plot_id", "left").join(seen.filter("n_flat > 0").select("plot_id", "n_flat"), "plot_id", "full_outer")
    if not many.isEmpty():
        full = full.join(nesting(many, met), "plot_id", "full_outer")
    full = full.withColumns({c: F.lit(0).cast("long") for c in COUNTS if c not in full.columns}).na.fill(0, list(COUNTS))
    return full.filter(" + ".join(COUNTS) + " > 0").select("plot_id", *COUNTS)


def repairs(plots: DataFrame) -> DataFrame:
    """plot_id, COUNTS, repair (the disposition of a repair), area_before, area_after (hectares) and rebuilt (see there) of each
    plot that is not valid.

    Nothing left, a polygon that falls into parts, or an area that changes by more than one percent: review. A multipolygon
    whose parts unite into one is fixed, as the area that it counted twice is meant to go; so is what keeps its area. Plots
    of one shape are looked at once."""
    return by_shape(plots, _repairs)


def _repairs(plots: DataFrame) -> DataFrame:
    # what meets is little beside the plots, and most of what follows asks for it
    met = cut(meetings(plots), "meetings")
    bad = cut(faults(plots, met), "faults")
    shapes = plots.join(bad, "plot_id").select("plot_id", "gtype", "parts", *COUNTS)
    made = rebuilt(shapes, met.join(bad.select("plot_id"), "plot_id", "left_semi"))
    full = shapes.join(made, "plot_id", "left").withColumn("area_before", geo.total(F.col("parts"), geo.geodesic_ring)).withColumn("area_after", F.coalesce(geo.total(F.col("rebuilt"), geo.geodesic_ring), F.lit(0.0)))
    repair = (
        F.when(F.col("area_after") <= 0, REVIEW)
        .when((F.col("gtype") == "MultiPolygon") & (F.size("rebuilt") == 1), FIXED)
        .when((F.col("gtype") == "Polygon") & (F.size("rebuilt") > 1), REVIEW)
        .when(F.col("area_before") <= 0, REVIEW)
        .when(F.abs(F.col("area_after") - F.col("area_before")) > REPAIR_SHARE * F.col("area_before"), REVIEW)
        .otherwise(FIXED)
    )
    return full.select("plot_id", *COUNTS, repair.alias("repair"), "area_before", "area_after", "rebuilt")


def repaired(plots: DataFrame, found: DataFrame) -> DataFrame:
    """plots with repaired_wkt: canonical text of the plot, rings closed, or of its repaired shape; null if no area is left.

    found: repairs(plots)."""
    areal = F.col("gtype").isin("Polygon", "MultiPolygon")
    own = F.when(areal, g.each_ring(F.col("parts"), g.closed)).otherwise(F.col("parts"))
    gtype = F.when(F.col("repair").isNull(), F.col("gtype")).when(F.size("rebuilt") == 1, "Polygon").otherwise("MultiPolygon")
    shape = F.when(F.col("repair").isNull(), own).otherwise(F.col("rebuilt"))
    told = plots.join(found.select("plot_id", "repair", "rebuilt"), "plot_id", "left").withColumn("_gtype", gtype).withColumn("_shape", shape)
    return told.withColumn("repaired_wkt", F.when(F.col("_shape").isNotNull(), g.canonical_wkt(F.col("_gtype"), F.col("_shape")))).drop("repair", "rebuilt", "_gtype", "_shape")


def validity(plots: DataFrame) -> DataFrame:
    """plot_id, is_valid, reason and repaired_wkt of all plots; those of one shape are looked at once."""
    return by_shape(plots, _validity)


def _validity(plots: DataFrame) -> DataFrame:
    found = _repairs(plots)
    reason = F.lit("Valid Geometry")
    for count, text in reversed(list(zip(COUNTS, REASONS, strict=True))):
        reason = F.when(F.col(count) > 0, text).otherwise(reason)
    counted = repaired(plots, found).join(found.select("plot_id", *COUNTS), "plot_id", "left")
    return counted.select("plot_id", F.col("n_cross").isNull().alias("is_valid"), reason.alias("reason"), "repaired_wkt")
