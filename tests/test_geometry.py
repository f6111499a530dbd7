"""Canonical text and hashes, parsing, areas."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plotsage.functions import geodesy as geo
from plotsage.functions import geometry as g
from plotsage.functions import text as t


def parsed(spark, *texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "plot_id long, raw string")
    return df.withColumn("gtype", g.raw_type(F.col("raw"))).withColumn("parts", g.parse_wkt(F.col("raw")))


def square(x, y, s, order=(0, 1, 2, 3, 0)):
    corners = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    return "POLYGON ((" + ", ".join(f"{corners[i][0]:.6f} {corners[i][1]:.6f}" for i in order) + "))"


def test_hash_does_not_depend_on_start_direction_or_noise(spark):
    same = [square(108, 12, 0.001, o) for o in ((0, 1, 2, 3, 0), (2, 3, 0, 1, 2), (0, 3, 2, 1, 0), (3, 2, 1, 0, 3))]
    same.append("POLYGON((108.00000004 12, 108.001 12, 108.001 12.001, 108 12.001, 108 12))")
    rows = parsed(spark, *same, square(108, 12, 0.002)).select(g.geometry_hash(F.col("gtype"), F.col("parts")).alias("h")).collect()
    assert len({r.h for r in rows[:-1]}) == 1
    assert rows[-1].h != rows[0].h


def test_canonical_text(spark):
    rows = parsed(spark, "POINT (108.0053090 -12.644637)", "multipolygon (((2 2, 3 2, 3 3, 2 2)), ((0 0, 1 0, 1 1, 0 0)))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "MULTIPOINT (1 2, 3 4)", "nonsense", None)
    got = [r.c for r in rows.select(g.canonical_wkt(F.col("gtype"), F.col("parts")).alias("c")).collect()]
    assert got == [
        "SRID=4326;POINT (108.005309 -12.644637)",
        "SRID=4326;MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((2 2, 3 2, 3 3, 2 2)))",
        "SRID=4326;POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))",
        "SRID=4326;MULTIPOINT ((1 2), (3 4))",
        None,
        None,
    ]


def test_areas(spark):
    rows = parsed(spark, square(108.04405, 12.66405, 0.0019), square(108.0, 12.67, 0.001), "POINT (108 12)")
    rows = geo.deviations(rows.withColumns(geo.areas(F.col("gtype"), F.col("parts"), F.col("parts")[0][0][0]["x"]))).orderBy("plot_id").collect()
    assert rows[0].geodesic_ha == pytest.approx(4.338248555088043, rel=1e-9)
    assert rows[0].epsg6933_ha == pytest.approx(4.3382485547224015, rel=1e-9)
    assert rows[0].utm_ha == pytest.approx(4.345843359669885, rel=1e-9)
    assert rows[0].epsg3857_ha == pytest.approx(4.585083718798322, rel=1e-9)
    assert rows[0].required_format == "polygon" and not rows[0].borderline
    assert rows[1].geodesic_ha * 1e4 == pytest.approx(12017.056, abs=0.05)
    assert 5.0 < rows[1].delta_3857_pct < 6.5 and rows[1].required_format == "point"
    assert rows[2].geodesic_ha == 0 and rows[2].delta_3857_pct is None and rows[2].delta_6933_pct == 0


def test_footprint_is_a_64_gon_of_50_metres(spark):
    ring = spark.range(1).select(geo.footprint(F.lit(108_030_000), F.lit(12_670_000)).alias("r"))
    r = ring.select(F.size("r").alias("n"), (F.col("r")[0] == F.col("r")[64]).alias("closed"), geo.geodesic_ring(F.col("r")).alias("ha")).first()
    assert r.n == 65 and r.closed
    assert r.ha == pytest.approx(0.5 * 64 * 2500 * math.sin(2 * math.pi / 64) / 1e4, rel=0.01)


def test_spherical_bound_of_the_inflation(spark):
    assert spark.range(1).select(geo.mercator_inflation(F.lit(12.67)).alias("f")).first().f == pytest.approx(1.0505, abs=1e-4)


def test_numbers_as_people_type_them(spark):
    cells = ["108,006000", " 12.5 ", "﻿7,5", "", "NaN", "1,234.5", "n/a", None]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(t.locale_number(F.col("c")).alias("v"), t.is_bad_number(F.col("c")).alias("bad")).collect()
    assert [r.v for r in rows] == [108.006, 12.5, 7.5, None, None, None, None, None]
    assert [r.bad for r in rows] == [False, False, False, False, False, True, True, False]


def test_labels(spark):
    rows = spark.createDataFrame([(x,) for x in (" LOW   risk ", "MoreInfoNeeded", "high", "maybe", None)], "c string").select(t.label(F.col("c")).alias("l")).collect()
    assert [r.l for r in rows] == ["Low", "More info needed", "High", None, None]
    payloads = ['{"Risk_PCrop":"low"}', '{"data":{"Risk_PCrop":"high"}}', '{"data":[{"Risk_PCrop":"x"}]}', "{}"]
    assert [r.l for r in spark.createDataFrame([(p,) for p in payloads], "c string").select(t.payload_label(F.col("c")).alias("l")).collect()] == ["low", "high", "x", None]


def test_verification_number_is_an_hmac(spark):
    import hashlib
    import hmac

    row = spark.range(1).select(t.verification_number(F.lit("EUDR-2026-A-1"), "salt").alias("v"), t.is_pair(F.lit("EUDR-2026-A-1"), F.lit(""), "salt").alias("empty"), t.is_pair(F.lit(None).cast("string"), F.lit("x"), "salt").alias("none")).first()
    assert row.v == hmac.new(b"salt", b"EUDR-2026-A-1", hashlib.sha256).hexdigest()[:32].upper()
    assert not row.empty and not row.none


def test_decimals(spark):
    rows = spark.createDataFrame([(108_000_000,), (108_100_000,), (-12_345_678,)], "v long").select(g.decimals(F.col("v")).alias("d")).collect()
    assert [r.d for r in rows] == [0, 1, 6]
