"""Plots, cells, results, ledgers and labels derived from the relational tables by whole-number arithmetic.

The same text makes them in Spark and in DuckDB; only a few spellings differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    div: str
    list_open: str
    list_close: str
    struct: str

    def point(self, x: str, y: str) -> str:
        return self.struct.format(x=x, y=y)

    def array(self, *items: str) -> str:
        return f"{self.list_open}{', '.join(items)}{self.list_close}"


SPARK = Dialect("div", "array(", ")", "named_struct('x', cast({x} as bigint), 'y', cast({y} as bigint))")
DUCKDB = Dialect("//", "[", "]", "{{'x': CAST({x} AS BIGINT), 'y': CAST({y} AS BIGINT)}}")


def plots_sql(d: Dialect) -> str:
    """Plots of customers: plot_id, consignment, operator, country, asserted_area_ha, crs, external_id, gtype, ring, hole.

    kind: 0 point, 1 swapped, 2 null island, 3 doubled vertex, 4 open ring, 5 hole, 6 bowtie, 7 sliver, 8 spike, 9 far
    west, 10 other reference system, 11 spur, 12 snapped to a tenth, 13 shared id, else clean.
    """
    p, half, third = d.point, f"(s {d.div} 2)", f"(s {d.div} 3)"
    square = [p("x0", "y0"), p("x0 + s", "y0"), p("x0 + s", "y0 + s"), p("x0", "y0 + s"), p("x0", "y0")]
    snap = lambda v: f"{v} {d.div} 100000 * 100000"
    rings = {
        0: [p("x0", "y0")], 1: [p("y0", "x0")], 2: [p("0", "y0")], 9: [p("-x0", "y0")], 12: [p(snap("x0"), snap("y0"))],
        3: [square[0], square[1], *square[1:]], 4: square[:4], 6: [square[0], square[2], square[1], square[3], square[0]],
        7: [p("x0", "y0"), p("x0 + s", "y0"), p("x0 + s", "y0 + 4"), p("x0", "y0 + 4"), p("x0", "y0")],
        8: [square[0], square[1], p("x0 + 500000", f"y0 + {half}"), square[2], square[3], square[0]],
        11: [square[0], p(f"x0 + {half}", "y0"), p(f"x0 + {half}", "y0 - 1"), p(f"x0 + {half}", "y0"), *square[1:]],
    }
    cases = " ".join(f"WHEN {k} THEN {d.array(*r)}" for k, r in rings.items())
    inner = d.array(p(f"x0 + {third}", f"y0 + {third}"), p(f"x0 + {third}", f"y0 + 2 * {third}"), p(f"x0 + 2 * {third}", f"y0 + 2 * {third}"), p(f"x0 + 2 * {third}", f"y0 + {third}"), p(f"x0 + {third}", f"y0 + {third}"))
    return f"""
SELECT k AS plot_id, consignment, operator, country, kind, s, x0, y0,
  CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 60) / CAST(10.0 AS DOUBLE) END AS asserted_area_ha,
  CASE WHEN kind = 10 THEN 'EPSG:3857' WHEN k % 3 = 0 THEN 'EPSG:4326' END AS crs,
  CASE WHEN kind = 13 THEN k {d.div} 64 ELSE 1000000000 + k END AS external_id,
  CASE WHEN kind IN (0, 1, 2, 9, 12) THEN 'Point' ELSE 'Polygon' END AS gtype,
  CASE kind {cases} ELSE {d.array(*square)} END AS ring,
  CASE WHEN kind = 5 THEN {inner} END AS hole
FROM (SELECT c_custkey AS k, c_nationkey AS consignment, n_name AS operator, concat('R', CAST(n_regionkey AS VARCHAR(9))) AS country,
  CAST(c_custkey % 16 AS INT) AS kind, 300 + (c_custkey * 37 % 8) * 250 AS s, 108000000 + c_custkey * 7919 % 57000 AS x0, 12640000 + c_custkey * 104729 % 57000 AS y0
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def multi_sql(d: Dialect) -> str:
    """Plots of several rings, one for each customer: plot_id, kind, gtype, parts.

    kind: 0 hole outside, 1 part in a part, 2 hole that touches its outer ring in a point, 3 parts that touch in a corner, 4 parts that
    overlap, 5 hole that touches its outer ring twice, 6 hole in a hole, 7 two holes, 8 part in a hole, 9 hole that
    crosses its outer ring.
    """
    p = d.point

    def box(x: str, y: str, side: str) -> str:
        return d.array(p(x, y), p(f"{x} + {side}", y), p(f"{x} + {side}", f"{y} + {side}"), p(x, f"{y} + {side}"), p(x, y))

    part, whole = lambda *rings: d.array(*rings), box("x0", "y0", "6 * u")
    inner = lambda n, side: box(f"x0 + {n} * u", f"y0 + {n} * u", f"{side} * u")
    left, right, low, high = p("x0", "y0 + 3 * u"), p("x0 + 6 * u", "y0 + 3 * u"), p("x0 + 3 * u", "y0 + u"), p("x0 + 3 * u", "y0 + 5 * u")
    shapes = [
        d.array(part(whole, inner(8, 2))), d.array(part(whole), part(inner(1, 2))), d.array(part(whole, d.array(left, low, high, left))), d.array(part(whole), part(inner(6, 2))), d.array(part(whole), part(inner(4, 6))),
        d.array(part(whole, d.array(left, low, right, high, left))), d.array(part(whole, inner(1, 4), inner(2, 1))), d.array(part(whole, inner(1, 1), inner(3, 2))), d.array(part(whole, inner(1, 4)), part(inner(2, 1))), d.array(part(whole, inner(4, 6))),
    ]
    cases = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(shapes))
    return f"""
SELECT k AS plot_id, kind, CASE WHEN kind IN (1, 3, 4, 8) THEN 'MultiPolygon' ELSE 'Polygon' END AS gtype, CASE kind {cases} END AS parts
FROM (SELECT c_custkey AS k, CAST(c_custkey % 10 AS INT) AS kind, 50 + c_custkey * 37 % 8 * 40 AS u, 108000000 + c_custkey * 7919 % 57000 AS x0, 12640000 + c_custkey * 104729 % 57000 AS y0 FROM customer)
"""


#: Boxes of orders: the overlap benchmark's plots.
BENCH_SQL = """
SELECT o_orderkey AS plot_id, 107600000 + o_orderkey * 48271 % 898500 AS x0, 12500000 + (o_orderkey * 69621 + o_custkey * 104729) % 1198500 AS y0,
  107600000 + o_orderkey * 48271 % 898500 + 1500 AS x1, 12500000 + (o_orderkey * 69621 + o_custkey * 104729) % 1198500 + 1500 AS y1
FROM orders
"""

# Cell size and origin in units of 1 / 9,000,000 degree, rows, columns.
LAYERS = (("lossyear", 2500, 972_000_000, 114_300_000, 216, 216), ("forest_2020", 800, 972_000_000, 114_300_000, 675, 675), ("landcover_context", 800, 972_000_000, 114_300_000, 675, 675))
LAYER_COLUMNS = "layer string, cell bigint, west bigint, north bigint, n_rows bigint, n_cols bigint"
DATASETS = (("lossyear", "annual loss", "v1.13"), ("forest_2020", "forest 2020", "V3"), ("landcover_context", "land cover", "v200"))

# Painted zones, rows and columns inclusive, loss grid then 10 m grids; forest, loss, land cover.
ZONES = (
    ((180, 208, 7, 36), (562, 652, 22, 112), 0, 18, 40),
    ((180, 208, 43, 72), (562, 652, 135, 225), 1, 22, 10),
    ((180, 208, 79, 108), (562, 652, 247, 337), 1, 21, 10),
    ((180, 208, 115, 144), (562, 652, 360, 450), 1, 0, 10),
    ((180, 208, 151, 180), (562, 652, 472, 562), 0, 0, 40),
    ((167, 167, 192, 192), (517, 540, 585, 607), 1, 22, 10),
)


def cells_sql(d: Dialect) -> str:
    def painted(which: int, value: int, background: int) -> str:
        cases = " ".join(f"WHEN row BETWEEN {z[which][0]} AND {z[which][1]} AND col BETWEEN {z[which][2]} AND {z[which][3]} THEN {z[value]}" for z in ZONES)
        return f"CASE {cases} ELSE {background} END"

    def grid(n: int) -> str:
        return f"(SELECT CAST(id {d.div} {n} AS BIGINT) AS row, CAST(id % {n} AS BIGINT) AS col FROM " + (f"range({n * n})" if d is SPARK else f"range({n * n}) AS t(id)") + ")"

    return f"""
SELECT 'lossyear' AS layer, row, col, {painted(0, 3, 0)} AS value FROM {grid(216)}
UNION ALL SELECT 'forest_2020', row, col, {painted(1, 2, 0)} FROM {grid(675)}
UNION ALL SELECT 'landcover_context', row, col, {painted(1, 4, 40)} FROM {grid(675)}
"""


#: Results of plots (users) by run: the newest counts.
RESULTS_SQL = "SELECT event_id AS id, user_id AS plot_id, event_id % 7 AS run_id, ts AS created_at, event_type AS verdict FROM events"


def ledger_sql(d: Dialect) -> str:
    """Ledger rows of line items: one for each part, run and layer."""
    band = "(year(l_shipdate) - 1995) * 4 + l_linenumber % 2"
    return f"""
SELECT run_id, plot_id, dataset_name, concat('v', CAST(run_id % 3 AS VARCHAR(9))) AS dataset_version, band AS pixel_value, fraction AS covered_fraction,
  CASE WHEN band > 21 AND fraction >= 0.05 THEN 'high|loss' WHEN band > 20 THEN 'more-info-needed|loss' ELSE 'low|none' END AS verdict,
  run_id * 100000000 + plot_id * 3 + layer AS id, layer AS layer_order
FROM (SELECT l_orderkey % 50 AS run_id, l_partkey AS plot_id, CAST(l_linenumber % 3 AS INT) AS layer, concat('layer-', CAST(l_linenumber % 3 AS VARCHAR(9))) AS dataset_name,
  CAST(max({band}) AS DOUBLE) AS band, max(l_discount) AS fraction FROM lineitem GROUP BY l_orderkey % 50, l_partkey, l_linenumber % 3)
"""


def labels_sql(d: Dialect) -> str:
    theirs = d.array("'low risk'", "'HIGH'", "'More information  needed'")
    ours = d.array("'low'", "'more-info-needed'", "'high'")
    at = "{0}[{1}]" if d is SPARK else "{0}[{1} + 1]"
    return f"SELECT c_custkey AS plot_id, {at.format(ours, '(CAST(c_custkey * 17 % 3 AS INT))')} AS tier, {at.format(theirs, '(CAST(c_custkey * 31 % 5 % 3 AS INT))')} AS theirs FROM customer"


#: Records of one derived CSV file.
FILE_RECORDS = 50_000


def csv_sql(d: Dialect) -> str:
    """Cells as people type them: decimal commas in every third row, empty areas in every 17th, no number in every 101st."""
    number = lambda v: f"concat(CAST({v} {d.div} 1000000 AS VARCHAR(19)), CASE WHEN k % 3 = 0 THEN ',' ELSE '.' END, lpad(CAST({v} % 1000000 AS VARCHAR(19)), 6, '0'))"
    return f"""
SELECT k AS pos, {number('x0')} AS lon, concat(' ', {number('y0')}) AS lat, CASE WHEN k % 17 = 0 THEN '' WHEN k % 101 = 0 THEN 'n/a' WHEN k % 3 = 0 THEN concat(CAST(k % 60 AS VARCHAR(9)), ',5') ELSE concat(CAST(k % 60 AS VARCHAR(9)), '.5') END AS area
FROM (SELECT c_custkey AS k, 108000000 + c_custkey * 7919 % 57000 AS x0, 12640000 + c_custkey * 104729 % 57000 AS y0 FROM customer)
"""


def read(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The query over the named tables, each read from Parquet."""
    return spark.sql(sql_with(sql, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def sql_with(sql: str, tables: tuple[str, ...]) -> str:
    import re

    return re.sub(r"\b(FROM|JOIN) (" + "|".join(tables) + r")\b", r"\1 {\2}", sql) if tables else sql


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, plots_sql(SPARK), "customer", "nation")
    # a generator's column is made once; a plain one would be made again wherever a rule names it
    return found.selectExpr("*", "explode(array(array(CASE WHEN hole IS NULL THEN array(ring) ELSE array(ring, hole) END))) AS parts").drop("ring", "hole")


def multi_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, multi_sql(SPARK), "customer")
    return found.select("plot_id", "kind", "gtype", F.explode(F.array("parts")).alias("parts"))


def bench_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, BENCH_SQL, "orders")


def layers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LAYERS), LAYER_COLUMNS)


def datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DATASETS), "layer string, dataset_name string, dataset_version string")


def cells(spark: SparkSession) -> DataFrame:
    return spark.sql(cells_sql(SPARK))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, RESULTS_SQL, "events")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, ledger_sql(SPARK), "lineitem")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, labels_sql(SPARK), "customer")


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, csv_sql(SPARK), "customer")
