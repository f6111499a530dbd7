"""Rules, crossings, overlaps, overlay, tiers, ledger, statements."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plotsage.functions import geometry as g
from plotsage.operators import crossings, ledger, overlap, risk, statements, validation, zonal
from plotsage.plans import derive, jobs
from test_geometry import parsed, square

PATHOLOGIES = {
    "POLYGON((108.0294 12.6694, 108.0306 12.6706, 108.0306 12.6694, 108.0294 12.6706, 108.0294 12.6694))": ("NEEDS_REVIEW", "invalid_geometry"),
    "POLYGON((108.03 12.67, 108.0308 12.67, 108.0308 12.6708, 108.03 12.6708))": ("AUTO_FIXED", "unclosed_ring"),
    "POINT(12.646123 108.046123)": ("NEEDS_REVIEW", "lat_lon_swap"),
    "POINT(12027500 1419000)": ("NEEDS_REVIEW", "coordinate_out_of_range"),
    "POINT(0 12.646123)": ("NEEDS_REVIEW", "null_island"),
    "POINT(-108.031234 12.671234)": ("NEEDS_REVIEW", "out_of_aoi"),
    "POINT(108.1 12.7)": ("AUTO_VALID", "grid_snapped_low_precision"),
    "POLYGON((108.03 12.67, 108.0308 12.67, 108.0308 12.67, 108.0308 12.6708, 108.03 12.6708, 108.03 12.67))": ("AUTO_FIXED", "duplicate_vertices"),
    "POLYGON((108.03 12.67, 108.0308 12.67, 108.5 12.670003, 108.0308 12.6708, 108.03 12.6708, 108.03 12.67))": ("NEEDS_REVIEW", "spike_vertex"),
    "POLYGON((108.03 12.67, 108.031 12.671, 108.032 12.672, 108.03 12.67))": ("NEEDS_REVIEW", "invalid_geometry"),
    "POLYGON((108.03 12.67, 108.0317 12.67, 108.0317 12.670004, 108.03 12.670004, 108.03 12.67))": ("NEEDS_REVIEW", "sliver"),
    "POLYGON((108.03 12.67, 108.04 12.67, 108.04 12.68, 108.03 12.68, 108.03 12.67), (108.033 12.673, 108.033 12.676, 108.036 12.676, 108.033 12.673))": ("NEEDS_REVIEW", "holes"),
    "POLYGON((108.03 12.67, 108.0304 12.67, 108.0304 12.669999, 108.0304 12.67, 108.0308 12.67, 108.0308 12.6708, 108.03 12.6708, 108.03 12.67))": ("AUTO_FIXED", "invalid_geometry"),
    "MULTIPOLYGON(((108.03 12.67, 108.031 12.67, 108.031 12.671, 108.03 12.671, 108.03 12.67)), ((108.0305 12.6705, 108.0315 12.6705, 108.0315 12.6715, 108.0305 12.6715, 108.0305 12.6705)))": ("AUTO_FIXED", "invalid_geometry"),
}


def test_each_pathology_has_its_rule_and_disposition(spark):
    rows = {r.raw: r for r in jobs.validate(parsed(spark, *PATHOLOGIES)).collect()}
    for raw, (disposition, rule) in PATHOLOGIES.items():
        assert (rows[raw].disposition, [f.rule_id for f in rows[raw].findings]) == (disposition, [rule]), raw


def test_clean_plots_have_no_finding(spark):
    row = jobs.validate(parsed(spark, square(108.0055, 12.6455, 0.001))).first()
    assert row.findings == [] and row.disposition == "AUTO_VALID" and not row.needs_review


def test_crs_and_asserted_area(spark):
    df = parsed(spark, "POINT(108.012345 12.654321)", "POINT(108.012345 12.654321)").withColumn("crs", F.lit("EPSG:3857")).withColumn("asserted_area_ha", F.col("plot_id") * 5.2)
    rows = {r.plot_id: [f.rule_id for f in r.findings] for r in jobs.validate(df).collect()}
    assert rows == {0: ["unknown_mixed_crs"], 1: ["unknown_mixed_crs", "geometry_type_vs_asserted_area"]}


def test_crossings_do_not_depend_on_the_grid(spark, monkeypatch):
    df = parsed(spark, *PATHOLOGIES)
    want = sorted(map(tuple, crossings.meetings(df).select("plot_id", "kind", "nth", "o_nth").collect()))
    monkeypatch.setattr(crossings, "PER_CELL", 0.5)
    assert sorted(map(tuple, crossings.meetings(df).select("plot_id", "kind", "nth", "o_nth").collect())) == want


def box(x, y, side):
    return f"({x} {y}, {x + side} {y}, {x + side} {y + side}, {x} {y + side}, {x} {y})"


#: What is said of each shape, what is done about it, and what it becomes.
SHAPES = {
    f"POLYGON({box(0, 0, 10)}, {box(20, 0, 4)})": ("Hole lies outside shell", "NEEDS_REVIEW", "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0)), ((20 0, 24 0, 24 4, 20 4, 20 0)))"),
    f"MULTIPOLYGON(({box(0, 0, 10)}), ({box(2, 2, 4)}))": ("Nested shells", "AUTO_FIXED", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"),
    f"POLYGON({box(0, 0, 10)}, (0 5, 3 3, 3 7, 0 5))": ("Valid Geometry", None, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (0 5, 3 7, 3 3, 0 5))"),
    f"MULTIPOLYGON(({box(0, 0, 10)}), ({box(10, 10, 5)}))": ("Valid Geometry", None, "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0)), ((10 10, 15 10, 15 15, 10 15, 10 10)))"),
    f"POLYGON({box(0, 0, 10)}, (0 5, 5 3, 10 5, 5 7, 0 5))": ("Interior is disconnected", "NEEDS_REVIEW", "MULTIPOLYGON (((0 0, 10 0, 10 5, 5 3, 0 5, 0 0)), ((0 5, 5 7, 10 5, 10 10, 0 10, 0 5)))"),
    f"POLYGON({box(0, 0, 30)}, (5 5, 15 5, 10 10, 5 5), (15 5, 25 5, 20 15, 15 5), (10 10, 20 15, 15 20, 10 10))": ("Interior is disconnected", "NEEDS_REVIEW", "MULTIPOLYGON (((0 0, 30 0, 30 30, 0 30, 0 0), (5 5, 10 10, 15 20, 20 15, 25 5, 15 5, 5 5)), ((10 10, 15 5, 20 15, 10 10)))"),
    f"POLYGON({box(0, 0, 20)}, {box(2, 2, 10)}, {box(4, 4, 3)})": ("Holes are nested", "NEEDS_REVIEW", "POLYGON ((0 0, 20 0, 20 20, 0 20, 0 0), (2 2, 2 12, 12 12, 12 2, 2 2))"),
    f"MULTIPOLYGON(({box(0, 0, 20)}, {box(2, 2, 10)}), ((2 2, 5 3, 4 6, 2 2)))": ("Valid Geometry", None, "MULTIPOLYGON (((0 0, 20 0, 20 20, 0 20, 0 0), (2 2, 2 12, 12 12, 12 2, 2 2)), ((2 2, 5 3, 4 6, 2 2)))"),
    f"MULTIPOLYGON(({box(0, 0, 10)}), ({box(5, 5, 10)}))": ("Self-intersection", "AUTO_FIXED", "POLYGON ((0 0, 10 0, 10 5, 15 5, 15 15, 5 15, 5 10, 0 10, 0 0))"),
    f"POLYGON({box(0, 0, 10)}, {box(5, 5, 10)})": ("Self-intersection", "NEEDS_REVIEW", "POLYGON ((0 0, 10 0, 10 5, 5 5, 5 10, 0 10, 0 0))"),
    "POLYGON((0 0, 10 10, 10 0, 0 10, 0 0))": ("Self-intersection", "NEEDS_REVIEW", "MULTIPOLYGON (((0 0, 5 5, 0 10, 0 0)), ((5 5, 10 0, 10 10, 5 5)))"),
    "POLYGON((0 30, 95 30, 20 90, 50 0, 80 90, 0 30))": ("Self-intersection", "NEEDS_REVIEW", "POLYGON ((0 30, 40 30, 50 0, 60 30, 95 30, 67.368421 52.105263, 80 90, 49.032258 66.774194, 20 90, 32 54, 0 30))"),
    "POLYGON((0 0, 10 0, 10 10, 5 0, 0 10, 0 0))": ("Ring Self-intersection", "NEEDS_REVIEW", "MULTIPOLYGON (((0 0, 5 0, 0 10, 0 0)), ((5 0, 10 0, 10 10, 5 0)))"),
    "POLYGON((0 0, 5 5, 10 10, 0 0))": ("Ring overlaps itself", "NEEDS_REVIEW", None),
}


@pytest.mark.parametrize("per_band", [8, 0.3])
def test_validity_and_repair_of_shapes(spark, monkeypatch, per_band):
    monkeypatch.setattr(crossings, "PER_BAND", per_band)
    df = parsed(spark, *SHAPES)
    said = {r.plot_id: r for r in crossings.validity(df).collect()}
    done = {r.plot_id: r["repair"] for r in crossings.repairs(df).collect()}
    for r in df.select("plot_id", "raw").collect():
        reason, repair, text = SHAPES[r.raw]
        assert (said[r.plot_id].reason, said[r.plot_id].is_valid, done.get(r.plot_id), said[r.plot_id].repaired_wkt) == (reason, reason == "Valid Geometry", repair, text and f"SRID=4326;{text}"), r.raw


def test_random_rings_keep_all_they_wind_around(spark):
    """Area and validity of repaired rings of random points, against winding numbers of points between the lines."""
    draw = random.Random(21)
    rings = []
    for _ in range(25):
        ring = [(1000 * draw.randrange(12), 1000 * draw.randrange(12)) for _ in range(draw.randrange(4, 8))]
        rings.append([*ring, ring[0]])
    df = spark.createDataFrame([(i, "Polygon", [[[{"x": x, "y": y} for x, y in r]]]) for i, r in enumerate(rings)], f"plot_id long, gtype string, parts {g.PARTS}")
    found = crossings.repairs(df).filter("rebuilt is not null")
    shapes = {r.plot_id: [[[(p.x, p.y) for p in ring] for ring in part] for part in r.rebuilt] for r in found.collect()}
    assert len(shapes) > 15

    def winding(ring, x, y):
        total = 0
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay <= y) != (by <= y):
                total += (1 if by > ay else -1) * (ax + (y - ay) * (bx - ax) / (by - ay) > x)
        return total

    for i, parts in shapes.items():
        for _ in range(300):
            x, y = draw.uniform(0, 12_000), draw.uniform(0, 12_000)
            near = min(abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / max(1, ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5) for (ax, ay), (bx, by) in zip(rings[i], rings[i][1:], strict=False))
            if near > 2:  # crossings stand on whole numbers
                inside = sum(winding(part[0], x, y) > 0 and not any(winding(h, x, y) for h in part[1:]) for part in parts)
                assert inside == (winding(rings[i], x, y) != 0)
    again = found.select("plot_id", F.lit("MultiPolygon").alias("gtype"), F.col("rebuilt").alias("parts"))
    assert crossings.meetings(again).filter("kind <> 'touch' or (part = o_part and ring = o_ring)").count() == 0


def boxes_of(spark, n=400, seed=3):
    import random

    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = draw.randrange(30_000), draw.randrange(30_000)
        rows.append((i, x, y, x + draw.choice((500, 1500, 6000)), y + draw.choice((500, 1500, 6000))))
    return rows


def test_overlap_equals_brute_force_for_any_cell(spark):
    rows = boxes_of(spark)
    df = spark.createDataFrame(rows, "plot_id long, x0 long, y0 long, x1 long, y1 long")
    touch, strict = set(), set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            if w >= 0 and h >= 0:
                touch.add((a[0], b[0]))
                holds = lambda p, q: p[1] <= q[1] and p[2] <= q[2] and p[3] >= q[3] and p[4] >= q[4]
                if w > 0 and h > 0 and not holds(a, b) and not holds(b, a):
                    strict.add((a[0], b[0]))
    for cell in (700, 2000, 50_000):
        assert {tuple(r) for r in overlap.touching(df, cell).collect()} == touch
        assert {(r.plot_a, r.plot_b) for r in overlap.overlapping(df, cell).collect()} == strict
    assert {tuple(r) for r in overlap.polygon_overlaps(jobs.as_rings(df)).collect()} == strict


def test_benchmark_plots(spark):
    """6,000 squares of the seeded generator have 133 intersecting pairs."""
    import random

    draw = random.Random(42)
    rows = []
    for i in range(6000):
        x = draw.uniform(107.60, 108.50 - 0.0015)
        y = draw.uniform(12.50, 13.70 - 0.0015)
        rows.append((i, round(x * 1e9), round(y * 1e9), round((x + 0.0015) * 1e9), round((y + 0.0015) * 1e9)))
    df = spark.createDataFrame(rows, "plot_id long, x0 long, y0 long, x1 long, y1 long")
    assert overlap.touching(df, 2_000_000).count() == 133


def test_polygon_coverage_sums_to_its_area(spark):
    df = parsed(spark, "POLYGON((108.0101 12.6401, 108.0149 12.6412, 108.0133 12.6444, 108.0101 12.6401))", square(108.0101, 12.6401, 0.0031))
    overlay = zonal.overlay(df.select("plot_id", "parts"), derive.layers(spark), zonal.raster_runs(derive.cells(spark)))
    sums = {(r.plot_id, r.layer): r.a for r in overlay.groupBy("plot_id", "layer").agg(F.sum(F.col("covered") * F.col("n")).alias("a")).collect()}
    area = {r.plot_id: r.a for r in df.select("plot_id", (F.abs(g.twice_area(F.col("parts")[0][0])) / 2 * 81).alias("a")).collect()}
    assert len(sums) == 6
    for (plot, _), a in sums.items():
        assert a == pytest.approx(area[plot], rel=1e-9)
    boxes = zonal.box_overlay(overlap.boxes(df.filter("plot_id = 1")), derive.layers(spark), derive.cells(spark))
    assert boxes.groupBy("layer").agg(F.sum("covered").alias("a")).select("a").distinct().first().a == area[1]


def clipped(ring, x0, y0, x1, y1):
    """Signed area of a ring within a box, in fractions: cut along the four sides in turn."""
    points = [(Fraction(x), Fraction(y)) for x, y in ring[:-1]]
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for i, p in enumerate(points):
            q = points[i - 1]
            if ((p[axis] - bound) * sign >= 0) != ((q[axis] - bound) * sign >= 0):
                t = (bound - q[axis]) / (p[axis] - q[axis])
                out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if (p[axis] - bound) * sign >= 0:
                out.append(p)
        points = out
    return sum(points[i - 1][0] * p[1] - p[0] * points[i - 1][1] for i, p in enumerate(points)) / 2


def test_coverage_equals_clipping_by_fractions(spark):
    """Rings of any shape, with holes, in parts, crossing themselves, and beyond all sides of the grid."""
    draw = random.Random(11)
    place = lambda spread: (draw.randrange(-spread, 30 + spread), draw.randrange(-spread, 30 + spread))
    shapes = []
    for i in range(60):
        rings = []
        for _ in range(1 + i % 3):
            ring = [place(0 if i < 30 else 25) for _ in range(draw.randrange(3, 9))]
            rings.append([*ring, ring[0]])
        shapes.append([rings] if i % 2 else [[r] for r in rings])
    rows = [(i, [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts]) for i, parts in enumerate(shapes)]
    plots = spark.createDataFrame(rows, f"plot_id long, parts {g.PARTS}")
    layers = spark.createDataFrame([("a", 45, 0, 270, 6, 6), ("b", 45, 0, 270, 6, 6), ("c", 63, 27, 270, 4, 3)], derive.LAYER_COLUMNS)
    got = {}
    for r in zonal.coverage(plots, layers).collect():
        for col in range(r["first"], r["last"] + 1):
            assert (key := (r.plot_id, r.grid, r.row, col)) not in got
            got[key] = r.covered
    want = {}
    for i, parts in enumerate(shapes):
        for cell, west, n_rows, n_cols in ((45, 0, 6, 6), (63, 27, 4, 3)):
            for row in range(n_rows):
                for col in range(n_cols):
                    box = (west + col * cell, 270 - (row + 1) * cell, west + (col + 1) * cell, 270 - row * cell)
                    net = sum((-1 if k else 1) * abs(clipped([(9 * x, 9 * y) for x, y in ring], *box)) for part in parts for k, ring in enumerate(part))
                    if net > 0:
                        want[i, f"{cell}:{west}:270", row, col] = float(net)
    assert got.keys() == want.keys() and len(got) > 800
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_raster_runs_hold_every_cell_once(spark):
    draw = random.Random(12)
    cells = [("a", row, col, draw.randrange(3)) for row in range(4) for col in range(600) if draw.random() < 0.9]
    runs = zonal.raster_runs(spark.createDataFrame(cells, "layer string, row int, col int, value int")).collect()
    assert sorted((r.layer, r.row, c, r.value) for r in runs for c in range(r["first"], r["last"] + 1)) == sorted(cells)
    assert all(r["first"] // zonal.BLOCK_COLS == r["last"] // zonal.BLOCK_COLS == r.block for r in runs)


def test_plots_send_runs_not_cells(spark):
    df = parsed(spark, "POLYGON((108.01 12.65, 108.05 12.65, 108.05 12.69, 108.01 12.69, 108.01 12.65))")
    runs = zonal.coverage(df.select("plot_id", "parts"), derive.layers(spark)).groupBy("grid", "row").count()
    assert runs.agg(F.max("count")).first()[0] <= 3 and runs.count() > 500


def test_tiers_of_the_painted_zones(spark):
    """A point in each zone: its 50 m footprint has the tier of the zone."""
    zones = [(z[1][0] + z[1][1], z[1][2] + z[1][3]) for z in derive.ZONES[:5]]
    points = [f"POINT ({108 + (c / 2 + 0.5) * 800 / 9e6:.6f} {12.7 - (r / 2 + 0.5) * 800 / 9e6:.6f})" for r, c in zones]
    out = jobs.process(spark, parsed(spark, *points), derive.layers(spark), derive.cells(spark)).orderBy("plot_id").collect()
    assert [r.rule_id for r in out] == ["low.outside_2020_forest", "high.inside_forest_post_cutoff_loss", "mins.band21_latency", "mins.inside_forest_no_context", "low.outside_2020_forest"]
    assert [r.boundary_uncertain for r in out] == [False, False, True, False, False]


def sample(spark, **changes):
    row = {"plot_id": 1, "plot_ha": 1.0, "post_bands": [], "pre_bands": [], "loss_ha": 0.0, "forest_fraction": 1.0, "cropland_fraction": 0.0, "covered_cells": 9, "loss_fraction": 0.0} | changes
    schema = "plot_id long, plot_ha double, post_bands array<int>, pre_bands array<int>, loss_ha double, forest_fraction double, cropland_fraction double, covered_cells long, loss_fraction double"
    return spark.createDataFrame([tuple(row.values())], schema)


@pytest.mark.parametrize(
    ("changes", "rule"),
    [
        ({"forest_fraction": 0.49}, "low.outside_2020_forest"),
        ({"cropland_fraction": 0.5, "post_bands": [23], "loss_fraction": 1.0}, "low.crop_context_downgrade"),
        ({"pre_bands": [3]}, "low.pre_cutoff_disturbance_only"),
        ({"post_bands": [21], "loss_fraction": 1.0}, "mins.band21_latency"),
        ({"post_bands": [21, 22], "loss_fraction": 0.1}, "high.inside_forest_post_cutoff_loss"),
        ({"post_bands": [22], "pre_bands": [5], "loss_fraction": 0.5}, "high.inside_forest_post_cutoff_loss"),
        ({"post_bands": [22], "loss_fraction": 0.0999}, "mins.sub_threshold_loss"),
        ({}, "mins.inside_forest_no_context"),
    ],
)
def test_tree(spark, changes, rule):
    assert risk.assess(sample(spark, **changes)).first().rule_id == rule


def test_evidence_and_mutation(spark):
    """Band 21 to 22 flips the tier; only the loss layer's rows differ."""
    before = risk.evidence(risk.assess(sample(spark, post_bands=[21], loss_fraction=0.5)), derive.datasets(spark), "a")
    after = risk.evidence(risk.assess(sample(spark, post_bands=[22], loss_fraction=0.5)), derive.datasets(spark), "b")
    both = before.unionByName(after)
    rows = {r.dataset_name: r for r in ledger.diff(both, "a", "b").collect()}
    assert len(rows) == 3 and all(r.tier_flipped and r.status == "both" and not r.version_changed for r in rows.values())
    assert [n for n, r in rows.items() if r.value_changed] == ["annual loss"]
    assert {r.dataset_name for r in ledger.unlike(both, "a", "b").collect()} == {"annual loss"}
    assert before.filter("layer_order = 0").first().verdict == "more-info-needed|post_cutoff_loss_fraction=0.500000"
    assert ledger.replay(both.withColumn("id", F.lit(1)), "no such run").count() == 0


def test_statement(spark):
    plots = parsed(spark, "POINT (108.005309 12.644637)", square(108.0, 12.67, 0.001)).withColumns({"consignment": F.lit("C1"), "operator": F.lit("op"), "country": F.lit("VN"), "risk": F.when(F.col("plot_id") == 0, "low").otherwise("high")})
    bowtie = parsed(spark, "POLYGON((108.0294 12.6694, 108.0306 12.6706, 108.0306 12.6694, 108.0294 12.6706, 108.0294 12.6694))").withColumns({"plot_id": F.lit(7).cast("long"), "consignment": F.lit("C1"), "operator": F.lit("op"), "country": F.lit("VN"), "risk": F.lit("high")})
    made = statements.collections(plots).first()
    assert made.conformant and made.plot_ids == [0, 1] and made.bytes == len(made.geojson.encode())
    import json

    features = json.loads(made.geojson)["features"]
    assert features[0]["geometry"] == {"type": "Point", "coordinates": [108.005309, 12.644637]}
    assert features[1]["properties"] == {"ProducerName": "", "ProductionPlace": "1", "Area": None}
    countries = spark.createDataFrame([("VN", "low", "simplified_dd")], "country string, risk_class string, due_diligence_path string")
    row = statements.statements(jobs.feature_issues(plots.unionByName(bowtie.select(*plots.columns))), countries, F.to_date(F.lit("2026-06-18")), F.lit("09937884b63dade7")).first()
    assert row.plot_ids == [0, 1] and row.geojson == made.geojson and len(row.legality) == 8  # a bowtie is not eligible
    assert row.reference_number == "EUDR-2026-C1-09937884" and row.determination == "high"
    assert not row.compliance_complete and row.legality_status == "NOT_ASSESSED" and str(row.valid_until) == "2027-06-18"
    assert len(spark.range(1).select(statements.legality().alias("l")).first().l) == 8


def test_plots_of_statements_are_assessed_once(spark, sf_dir, monkeypatch):
    """What a statement is made of asks for its plots several times; their samples are made once."""
    from plotsage.plans import queries

    made, plain = spark.sparkContext.accumulator(0), queries.samples_of

    def counted(spark, plots):
        found = plain(spark, plots)

        def count(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return found.mapInArrow(count, found.schema)

    monkeypatch.setattr(queries, "samples_of", counted)
    assert queries.statement_headers(spark, sf_dir).collect()
    assert made.value == queries.sampleable(spark, sf_dir).count()


def test_issues(spark):
    df = jobs.feature_issues(parsed(spark, *PATHOLOGIES, "POLYGON((0 0, 1 1, 0 0))").filter("gtype is not null"))
    rows = {r.raw: r.issues for r in df.collect()}
    meeting = [raw for raw, found in rows.items() if found == ["self-crossing ring"]]
    assert len(meeting) == 3 and all(PATHOLOGIES[raw][1] == "invalid_geometry" and raw.startswith("POLYGON") for raw in meeting)
    assert rows["POLYGON((0 0, 1 1, 0 0))"] == ["fewer than 4 pairs"]


def test_duplicate_ids_and_dominating(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "external_id string")
    assert [(r.id, r.n) for r in validation.duplicate_ids(df).collect()] == [("a", 2)]
    row = jobs.validate(parsed(spark, "POINT(0 12.6)")).select(validation.dominating(F.col("findings"))["rule_id"].alias("r")).first()
    assert row.r == "null_island"


def cells_of(shape, n=24):
    """Unit cells of parts of rectangles: (x0, y0, x1, y1) less holes."""
    cells = set()
    for (x0, y0, x1, y1), hole in shape:
        cells |= {(x, y) for x in range(x0, x1) for y in range(y0, y1)}
        if hole:
            cells -= {(x, y) for x in range(hole[0], hole[2]) for y in range(hole[1], hole[3])}
    return cells


def rectangle(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_overlaps_of_plots_with_holes_and_parts_equal_unit_cells(spark):
    import random

    draw = random.Random(7)
    shapes = [[((0, 0, 9, 9), (3, 3, 6, 6))], [((3, 3, 6, 6), None)], [((4, 4, 8, 8), None)], [((2, 2, 7, 7), None)], [((0, 0, 9, 9), None)], [((0, 0, 9, 9), (3, 3, 6, 6))], [((4, 4, 5, 5), None)]]
    for _ in range(40):
        x, y, w, h = draw.randrange(12), draw.randrange(12), draw.choice((3, 4, 6)), draw.choice((3, 5, 6))
        hole = (x + 1, y + 1, x + w - 1, y + h - 1) if draw.random() < 0.5 else None
        second = [((x + w + 1, y, x + w + 3, y + 2), None)] if draw.random() < 0.4 else []
        shapes.append([((x, y, x + w, y + h), hole), *second])
    rows = [(i, "Polygon" if len(s) == 1 else "MultiPolygon", [[rectangle(*box), *([rectangle(*hole)] if hole else [])] for box, hole in s]) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, "plot_id long, gtype string, parts array<array<array<struct<x:bigint,y:bigint>>>>")
    held = [cells_of(s) for s in shapes]
    want = {(i, j) for i in range(len(held)) for j in range(i + 1, len(held)) if held[i] & held[j] and held[i] - held[j] and held[j] - held[i]}
    assert (0, 2) in want and (0, 1) not in want and (0, 3) in want and (0, 5) not in want
    for cell in (1, 5, 2000):
        assert {tuple(r) for r in overlap.polygon_overlaps(df, cell).collect()} == want
    assert {tuple(r) for r in overlap.outline_overlaps(df).collect()} == want


def test_overlaps_of_slanted_and_broken_rings(spark):
    rings = {
        1: [(0, 0), (8, 8), (8, 0), (0, 8), (0, 0)],  # a bowtie: lobes to the left and to the right
        2: [(3, 0), (5, 0), (4, 2), (3, 0)],  # below its middle, outside both lobes
        3: [(1, 3), (1, 5), (-4, 4), (1, 3)],  # reaches into the left lobe
        4: [(20, 0), (24, 4), (20, 8), (16, 4), (20, 0)],
        5: [(20, 0), (20, 8), (30, 8), (30, 0), (20, 0)],  # crosses 4 at its corners only
        6: [(40, 0), (44, 0), (44, -9), (44, 0), (48, 0), (48, 4), (40, 4)],  # open, with a spur
        7: [(43, -5), (45, -5), (45, -1), (43, -1), (43, -5)],  # meets the spur alone
        8: [],
    }
    df = spark.createDataFrame([(k, "Polygon", [[r]]) for k, r in rings.items()] + [(9, "Polygon", None), (10, "Point", [[[(4, 4)]]])], "plot_id long, gtype string, parts array<array<array<struct<x:bigint,y:bigint>>>>")
    for found in (overlap.polygon_overlaps(df, 3), overlap.outline_overlaps(df, 3)):
        assert {tuple(r) for r in found.collect()} == {(1, 3), (4, 5)}
    assert overlap.polygon_overlaps(df.limit(0)).count() == 0


def test_overlaps_of_detailed_outlines(spark):
    import math
    import time

    def star(x, y, size, n=5000):
        at = [(size * (1 + 0.1 * math.cos(37 * 2 * math.pi * k / n)), 2 * math.pi * k / n) for k in range(n)]
        ring = [(x + round(r * math.cos(w)), y + round(r * math.sin(w))) for r, w in at]
        return ring + ring[:1]

    # 1 and 2 cross, 3 lies within 1, 4 in the hole of 5, 6 fills that hole and 7 is its twin, 8 meets 5 along half its hole
    hole = star(900_000, 0, 40_000)
    shapes = {1: [star(0, 0, 90_000)], 2: [star(100_000, 5_000, 90_000)], 3: [star(-20_000, 0, 9_000)], 4: [star(900_000, 0, 9_000)], 5: [star(900_000, 0, 90_000), hole], 6: [hole], 7: [hole]}
    shapes[8] = [hole[:2501] + [(900_000 - 60_000, -60_000), hole[0]]]
    rows = [(k, "Polygon", [rings]) for k, rings in shapes.items()]
    df = spark.createDataFrame(rows, "plot_id long, gtype string, parts array<array<array<struct<x:bigint,y:bigint>>>>")
    begun = time.time()
    found = {tuple(r) for r in overlap.outline_overlaps(df).collect()}
    assert found == {(1, 2), (5, 8), (6, 8), (7, 8)}
    assert time.time() - begun < 60


def test_boxes_of_very_different_sizes_meet_once(spark):
    rows = [(1, 0, 0, 10, 10), (2, 5, 5, 100_000, 100_000), (3, -(10**8), -(10**8), 10**8, 10**8), (4, 9, 9, 12, 12), (5, 99_000, 99_000, 99_010, 99_010), (6, None, 0, 1, 1)]
    df = spark.createDataFrame(rows, "plot_id long, x0 long, y0 long, x1 long, y1 long")
    assert sorted(tuple(r) for r in overlap.touching(df, 4).collect()) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5)]


COPIED = {
    "bowtie": [[(0, 0), (8, 8), (8, 0), (0, 8), (0, 0)]], "square": [[(4, 4), (10, 4), (10, 10), (4, 10), (4, 4)]],
    "slanted": [[(20, 0), (24, 4), (20, 8), (16, 4), (20, 0)]], "holed": [[(6, 0), (22, 0), (22, 9), (6, 9), (6, 0)], [(9, 1), (9, 3), (11, 3), (11, 1), (9, 1)]],
}


def copied(spark, shapes, n):
    rows = [(i * len(shapes) + j, "Polygon", [rings]) for i in range(n) for j, rings in enumerate(shapes)]
    return spark.createDataFrame(rows, "plot_id long, gtype string, parts array<array<array<struct<x:bigint,y:bigint>>>>")


def test_no_outline_is_sent_to_all_tasks(spark):
    """the sides of outlines are joined by shuffles, whatever size the planner expects of them."""
    plan = overlap.polygon_overlaps(copied(spark, COPIED.values(), 2))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_no" in line]


def test_outlines_of_few_points_are_compared_in_the_row(spark):
    """joins of sides are for outlines of many points; both ways tell the same."""
    df = copied(spark, COPIED.values(), 3)
    in_row = overlap.outline_overlaps(df)
    assert not [f for f in in_row.inputFiles() if "overlap-met" in f]
    joined = overlap.outline_overlaps(df, in_row=0)
    assert [f for f in joined.inputFiles() if "overlap-met" in f]
    assert sorted(map(tuple, in_row.collect())) == sorted(map(tuple, joined.collect())) != []


def test_copies_of_outlines_are_compared_once_and_paired_in_full(spark, monkeypatch):
    """pairs of all copies, those of a ring that crosses itself among them; rows of outlines do not grow with their copies."""
    kinds, n = list(COPIED), 5
    alone = {tuple(r) for r in overlap.polygon_overlaps(copied(spark, COPIED.values(), 1)).collect()}
    assert {(kinds[a], kinds[b]) for a, b in alone} == {("bowtie", "square"), ("bowtie", "holed"), ("square", "holed"), ("slanted", "holed")}
    kind = lambda i: i % len(kinds)
    pairs = [(a, b) for a in range(n * len(kinds)) for b in range(a + 1, n * len(kinds))]
    want = sorted((a, b) for a, b in pairs if (min(kind(a), kind(b)), max(kind(a), kind(b))) in alone or kind(a) == kind(b) == kinds.index("bowtie"))
    df = copied(spark, COPIED.values(), n)
    assert overlap.outlines(df).count() == len(kinds)
    assert sorted(map(tuple, overlap.polygon_overlaps(df).collect())) == want
    monkeypatch.setattr(overlap, "COPIES", 2)  # copies in several rows
    assert overlap.outlines(df).count() == 3 * len(kinds)
    for found in (overlap.polygon_overlaps(df), overlap.outline_overlaps(df), overlap.outline_overlaps(df, in_row=0)):
        assert sorted(map(tuple, found.collect())) == want


def test_long_thin_boxes_meet_once_in_cells_of_their_own_shape(spark):
    import random

    draw = random.Random(5)
    sides = (3, 300, 9_000, 400_000)
    rows = [(i, x := draw.randrange(3000), y := draw.randrange(3000), x + draw.choice(sides), y + draw.choice(sides)) for i in range(200)]
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    df = spark.createDataFrame(rows, "plot_id long, x0 long, y0 long, x1 long, y1 long")
    assert sorted(map(tuple, overlap.touching(df, 4).collect())) == want


def test_plots_of_one_shape_are_looked_at_once(spark, monkeypatch):
    """what depends on the shape alone is made for each different shape, and put to every plot, null shapes and repeated ids among them."""
    from plotsage.sources.shared import by_shape

    df = copied(spark, COPIED.values(), 5)
    more = spark.createDataFrame([(0, "Polygon", [COPIED["square"]]), (50, "Polygon", None), (51, None, None), (52, "Polygon", None)], df.schema)
    seen = []

    def points(shapes):
        seen.append(shapes.count())
        return shapes.select("plot_id", F.size(F.flatten(F.flatten("parts"))).alias("n"))

    got = sorted((r.plot_id, r.n) for r in by_shape(df.unionByName(more), points).collect())
    size = [sum(map(len, rings)) for rings in COPIED.values()]
    empty = spark.createDataFrame([(None,)], "parts array<int>").select(F.size("parts").alias("n")).first().n
    assert got == sorted([(i, size[i % 4]) for i in range(20)] + [(0, size[1]), (50, empty), (51, empty), (52, empty)]) and seen == [6]

    looked, of = [], crossings._validity
    monkeypatch.setattr(crossings, "_validity", lambda shapes: looked.append(shapes.count()) or of(shapes))
    told = {r.plot_id: r.reason for r in crossings.validity(df).collect()}
    assert looked == [4] and told == {i: crossings.REASONS[0] if i % 4 == 0 else "Valid Geometry" for i in range(20)}


def test_rules_of_processed_plots_are_made_once(spark, sf_dir):
    """what several tables ask for is read from the shared folder."""
    from plotsage.plans.queries import QUERIES

    assert [f for f in QUERIES["processed_plots"](spark, sf_dir).inputFiles() if "/checked-" in f]


def test_boxes_of_few_plots_are_told_without_lists(spark, monkeypatch):
    """boxes of few plots meet as rows of whole numbers, those of many by their lists; a box is what is left without its spurs."""
    import random

    draw = random.Random(9)
    at = [(draw.randrange(40), draw.randrange(40), draw.choice((3, 9, 70)), draw.choice((3, 9, 70))) for _ in range(30)]
    kept = [(i, x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(at[j] for j, n in enumerate((1, 2, 3, 5, 4) * 6) for _ in range(n))]
    rings = [(i, "Polygon", [[rectangle(*box)[i % 4 : 4] + rectangle(*box)[: i % 4 + 1]]]) for i, *box in kept]
    # far from the others: the spur of 90 reaches over 91 and is no part of it; 92 goes round the other way and is 91 again
    spurred = [(90, "Polygon", [[[(900, 0), (910, 0), (940, 0), (910, 0), (910, 9), (900, 9), (900, 0)]]]), (91, "Polygon", [[rectangle(915, -4, 925, 4)]]), (92, "Polygon", [[rectangle(915, -4, 925, 4)[::-1]]]), (93, "Polygon", [[rectangle(905, -4, 918, 4)]]), (None, "Polygon", [[rectangle(0, 0, 9, 9)]])]
    df = spark.createDataFrame(rings + spurred, "plot_id long, gtype string, parts array<array<array<struct<x:bigint,y:bigint>>>>")
    apart = lambda p, q: not (p[1] <= q[1] and p[2] <= q[2] and p[3] >= q[3] and p[4] >= q[4])
    want = {(a[0], b[0]) for a in kept for b in kept if a[0] < b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4] and apart(a, b) and apart(b, a)}
    want = sorted(want | {(90, 93), (91, 93), (92, 93)})
    for few, copies in ((16, 256), (2, 256), (0, 2)):
        monkeypatch.setattr(overlap, "FEW", few)
        monkeypatch.setattr(overlap, "COPIES", copies)
        assert sorted(map(tuple, overlap.polygon_overlaps(df, 4).collect())) == want
        if few == 16:
            plan = overlap.polygon_overlaps(df, 4)._jdf.queryExecution().optimizedPlan().toString()
            assert not [line for line in plan.splitlines() if "Join" in line and "_ids" in line] and "Generate explode(p_ids" not in plan
    assert overlap.outlines(df).filter("box").count() == overlap.outlines(df).count()
