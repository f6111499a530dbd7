"""Zonal overlay: how much of each raster cell lies in each plot, and which values those cells have.

Grids are counted in units of 1 / 9,000,000 degree, in which micro-degrees, 1-arc-second cells and 10-metre cells are all
whole numbers. Coverage comes from the edges alone: an edge is cut by the rows and columns of the grid, and each piece
adds its signed height, and the signed area to its right, to the one cell that it crosses. A running sum of heights along a
row then gives what every cell is covered, and the cells between two crossings are one run. So a plot sends runs, not cells.

Rasters are runs as well: cells of a row with one value, cut at blocks of columns. Both meet by an equi-join on grid, row
and block. Layers that share a grid share the coverage; a layer's dimension row holds its grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotsage.functions import geodesy as geo

UNITS = 9
POST_BANDS, PRE_BANDS, LATENCY_BAND = (21, 25), (1, 20), 21
FOREST, CROPLAND = 1, 40
LOSS, BASELINE, CONTEXT = "lossyear", "forest_2020", "landcover_context"
LAYERS = (LOSS, BASELINE, CONTEXT)
#: Columns of a block of a raster, and square units from which on a cell counts as covered: less is rounding.
BLOCK_COLS, LEAST_COVERED = 256, 1e-6


def wanted_cells(boxes: DataFrame, layers: DataFrame) -> DataFrame:
    """Each box (plot_id, x0, y0, x1, y1 in micro-degrees) with each row and column of each layer that it may touch.

    layers: layer, cell (units), west and north (units), n_rows, n_cols; a few rows, by nature of the table. Boxes beyond
    a grid have no cells there.
    """
    grid = boxes.join(F.broadcast(layers))  # one row for each layer
    clipped = lambda lo, hi, n: F.when((lo < F.col(n)) & (hi >= 0) & (lo <= hi), F.sequence(F.greatest(lo, F.lit(0).cast("long")), F.least(hi, F.col(n) - 1)))
    placed = grid.withColumn("cols", clipped(F.floor(F.expr(f"(x0 * {UNITS} - west) / cell")), F.ceil(F.expr(f"(x1 * {UNITS} - west) / cell")) - 1, "n_cols"))
    placed = placed.withColumn("rows", clipped(F.floor(F.expr(f"(north - y1 * {UNITS}) / cell")), F.ceil(F.expr(f"(north - y0 * {UNITS}) / cell")) - 1, "n_rows"))
    return placed.withColumn("row", F.explode("rows")).withColumn("col", F.explode("cols")).drop("rows", "cols")


def box_overlay(boxes: DataFrame, layers: DataFrame, cells: DataFrame) -> DataFrame:
    """plot_id, layer, row, col, value and covered (square units of the cell under the box) of each cell touched."""
    placed = wanted_cells(boxes, layers)
    wide = F.expr(f"least(x1 * {UNITS}, west + (col + 1) * cell) - greatest(x0 * {UNITS}, west + col * cell)")
    high = F.expr(f"least(y1 * {UNITS}, north - row * cell) - greatest(y0 * {UNITS}, north - (row + 1) * cell)")
    covered = placed.withColumn("covered", wide * high).filter("covered > 0").select("plot_id", "layer", "row", "col", "cell", "north", "covered")
    return covered.join(cells.select("layer", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), ["layer", "row", "col"])


def edges(plots: DataFrame) -> DataFrame:
    """plot_id, ring (a number), turn (1, or -1 for holes), x1, y1, x2, y2 of each edge of the rings of plots (plot_id, parts)."""
    rings = F.flatten(F.transform("parts", lambda p: F.transform(p, lambda r, i: F.struct(F.when(i == 0, 1).otherwise(-1).alias("turn"), r.alias("r")))))
    each = plots.select("plot_id", F.posexplode(rings).alias("ring", "of")).select("plot_id", "ring", "of.turn", F.col("of.r").alias("r")).filter("size(r) > 1")
    edge = lambda i: F.struct(F.col("r")[i - 1]["x"].alias("x1"), F.col("r")[i - 1]["y"].alias("y1"), F.col("r")[i]["x"].alias("x2"), F.col("r")[i]["y"].alias("y2"))
    return each.select("plot_id", "ring", "turn", F.explode(F.transform(F.sequence(F.lit(1), F.size("r") - 1), edge)).alias("e")).select("plot_id", "ring", "turn", "e.*")


def grid_name() -> Column:
    return F.concat_ws(":", "cell", "west", "north")


def crossings(plots: DataFrame, layers: DataFrame) -> DataFrame:
    """plot_id, grid, row, ring, turn, cell, n_cols, col, cover and area of each cell that edges of a ring cross.

    cover: signed height of the edges in the cell; area: what lies to their right within it. What is left of the grid
    counts in column -1, what is right of it has nothing to its right."""
    grids = layers.select(grid_name().alias("grid"), "cell", "west", "north", "n_rows", "n_cols").distinct()
    at = edges(plots).filter("y1 <> y2").join(F.broadcast(grids))  # a few grids, by nature of the table
    at = at.selectExpr("plot_id", "ring", "turn", "grid", "cell", "n_rows", "n_cols", f"x1 * {UNITS} - west AS u1", f"north - y1 * {UNITS} AS v1", f"x2 * {UNITS} - west AS u2", f"north - y2 * {UNITS} AS v2")
    at = at.withColumn("r0", F.expr("greatest(floor(least(v1, v2) / cell), 0L)")).withColumn("r1", F.expr("least(ceil(greatest(v1, v2) / cell), n_rows) - 1")).filter("r0 <= r1")
    at = at.withColumn("row", F.explode(F.sequence("r0", "r1")))
    # the part of the edge within the row
    at = at.withColumn("va", F.expr("greatest(row * cell, least((row + 1) * cell, v1))")).withColumn("vb", F.expr("greatest(row * cell, least((row + 1) * cell, v2))"))
    at = at.withColumn("ua", F.expr("u1 + (va - v1) * ((u2 - u1) / (v2 - v1))")).withColumn("ub", F.expr("IF(vb = v2, double(u2), u1 + (vb - v1) * ((u2 - u1) / (v2 - v1)))"))
    at = at.withColumn("lo", F.least("ua", "ub")).withColumn("hi", F.greatest("ua", "ub"))
    at = at.withColumn("c0", F.expr("greatest(floor(lo / cell), -1L)")).withColumn("c1", F.expr("greatest(least(floor(hi / cell), n_cols - 1), -1L)")).filter("c0 <= c1")
    at = at.withColumn("col", F.explode(F.sequence("c0", "c1")))
    # and within the column
    at = at.withColumn("from", F.expr("IF(col < 0, lo, greatest(lo, double(col * cell)))")).withColumn("to", F.expr("least(hi, double((col + 1) * cell))"))
    at = at.withColumn("cover", F.expr("(vb - va) * IF(hi > lo, (to - from) / (hi - lo), 1D)")).withColumn("area", F.expr("cover * ((col + 1) * cell - (from + to) / 2)"))
    return at.groupBy("plot_id", "grid", "row", "ring", "turn", "cell", "n_cols", "col").agg(F.sum("cover").alias("cover"), F.sum("area").alias("area"))


def coverage(plots: DataFrame, layers: DataFrame) -> DataFrame:
    """plot_id, grid, row, first, last and covered of runs of cells: covered is the area, in square units, of the plot in each
    cell of the run, holes taken off.

    A ring covers a cell by the size of its signed area there, whichever way it turns; where a ring crosses itself within
    one cell, lobes that turn both ways offset each other."""
    own = ["plot_id", "grid", "row", "cell", "n_cols"]
    # one shuffle serves all that follows: sums along the row of each ring, then of the plot
    met = crossings(plots, layers).repartition("plot_id", "grid", "row")
    along = Window.partitionBy(*own, "ring", "turn").orderBy("col")
    met = met.withColumn("before", F.coalesce(F.sum("cover").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("next", F.coalesce(F.lead("col").over(along), F.col("n_cols")))
    step = lambda at, size: F.struct(at.alias("col"), (F.col("turn") * size).alias("change"))
    crossed, between = F.abs(F.col("area") + F.col("cell") * F.col("before")), F.abs(F.col("cell") * (F.col("before") + F.col("cover")))
    steps = F.array(step(F.col("col"), crossed), step(F.col("col") + 1, -crossed), step(F.col("col") + 1, between), step(F.col("next"), -between))
    changes = met.select(*own, F.explode(steps).alias("s")).select(*own, F.greatest("s.col", F.lit(0)).alias("col"), "s.change").groupBy(*own, "col").agg(F.sum("change").alias("change"))
    row = Window.partitionBy(*own).orderBy("col")
    runs = changes.withColumn("covered", F.sum("change").over(row)).withColumn("last", F.lead("col").over(row) - 1)
    return runs.filter(f"covered > {LEAST_COVERED} and last >= col").select("plot_id", "grid", "row", F.col("col").alias("first"), "last", "covered")


def raster_runs(cells: DataFrame) -> DataFrame:
    """layer, row, block, first, last and value of the runs of equal values in cells (layer, row, col, value); runs end at blocks."""
    keyed = cells.select("layer", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value").withColumn("block", F.expr(f"col div {BLOCK_COLS}"))
    by = ["layer", "row", "block"]
    # cells of one value lie in one run as long as their columns rise as fast as their number
    nth = F.row_number().over(Window.partitionBy(*by, "value").orderBy("col"))
    return keyed.withColumn("run", F.col("col") - nth).groupBy(*by, "value", "run").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("run")


def overlay(plots: DataFrame, layers: DataFrame, runs: DataFrame) -> DataFrame:
    """plot_id, layer, row, value, covered (square units of each cell) and n (cells) of what plots (plot_id, parts) cover of the
    rasters (see raster_runs)."""
    placed = coverage(plots, layers).withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK_COLS}"), F.expr(f"last div {BLOCK_COLS}"))))
    gridded = runs.join(F.broadcast(layers.select("layer", grid_name().alias("grid"))), "layer").withColumnsRenamed({"first": "from", "last": "to"})
    met = placed.join(gridded, ["grid", "row", "block"]).withColumn("n", F.least("last", "to") - F.greatest("first", "from") + 1)
    return met.filter("n > 0").select("plot_id", "layer", "row", "value", "covered", "n")


def samples(overlay: DataFrame, layers: DataFrame, plots: DataFrame) -> DataFrame:
    """One row for each plot (plot_id, plot_ha): loss bands, hectares and fraction, forest and cropland fractions, of an overlay().

    Plots without cells have fraction 0 everywhere and covered_cells 0: they read as outside the forest.
    """
    # ground area depends on the row of the grid alone: made for each row once, not for each cell
    rows = layers.filter(F.col("layer") == LOSS).select("cell", "north", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).alias("row"))
    ground = rows.select("row", (geo.cell_ground_ha((F.col("north") - (F.col("row") + 1) * F.col("cell")) / UNITS, (F.col("north") - F.col("row") * F.col("cell")) / UNITS, F.col("cell") / UNITS) / (F.col("cell") * F.col("cell"))).alias("ha_by_unit"))
    met = overlay.join(F.broadcast(ground), "row", "left").withColumn("covered", F.col("covered") * F.col("n"))
    loss, base, crop = (F.col("layer") == name for name in LAYERS)
    post, pre = loss & F.col("value").between(*POST_BANDS), loss & F.col("value").between(*PRE_BANDS)
    share = lambda layer, value: F.coalesce(F.sum(F.when(layer & (F.col("value") == value), F.col("covered"))) / F.nullif(F.sum(F.when(layer, F.col("covered"))), F.lit(0)), F.lit(0.0))
    summed = met.groupBy("plot_id").agg(
        F.array_sort(F.collect_set(F.when(post, F.col("value")))).alias("post_bands"),
        F.array_sort(F.collect_set(F.when(pre, F.col("value")))).alias("pre_bands"),
        F.coalesce(F.sum(F.when(post, F.col("covered") * F.col("ha_by_unit"))), F.lit(0.0)).alias("loss_ha"),
        share(base, FOREST).alias("forest_fraction"),
        share(crop, CROPLAND).alias("cropland_fraction"),
        F.sum("n").alias("covered_cells"),
    )
    none = F.array().cast("array<int>")
    full = plots.select("plot_id", "plot_ha").join(summed, "plot_id", "left").withColumns({"post_bands": F.coalesce(F.col("post_bands").cast("array<int>"), none), "pre_bands": F.coalesce(F.col("pre_bands").cast("array<int>"), none)})
    full = full.na.fill(0.0, ["loss_ha", "forest_fraction", "cropland_fraction"]).na.fill(0, ["covered_cells"])
    return full.withColumn("loss_fraction", F.when(F.col("plot_ha") > 0, F.col("loss_ha") / F.col("plot_ha")).otherwise(0.0))
