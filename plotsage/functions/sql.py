"""Functions for SQL, temporary ones of a session: areas, of built-in functions only, and the validity of plots as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotsage.functions.geodesy import A, E, E2, Q_POLE, R2
from plotsage.functions.geometry import PARTS

_S = "sin(radians(p.y / 1e6D))"
_Q = f"({1 - E2!r}D * ({_S} / (1 - {E2!r}D * {_S} * {_S}) - ln((1 - {E!r}D * {_S}) / (1 + {E!r}D * {_S})) / {2 * E!r}D))"
_POINTS = f"transform(r, p -> named_struct('l', radians(p.x / 1e6D), 'q', {_Q}, 't', tan(asin({_Q} / {Q_POLE!r}D) / 2)))"
_EXCESS = "2 * atan2(tan((ps[i].l - ps[i - 1].l) / 2) * (ps[i - 1].t + ps[i].t), 1 + ps[i - 1].t * ps[i].t)"
_CROSS = "((ps[i - 1].l - ps[0].l) * (ps[i].q - ps[0].q) - (ps[i].l - ps[0].l) * (ps[i - 1].q - ps[0].q))"


def _total(term: str, factor: float) -> str:
    """Hectares over all parts, holes taken off; term adds up over the edges of a ring."""
    ring = f"transform(array({_POINTS}), ps -> IF(size(ps) > 1, abs(aggregate(sequence(1, size(ps) - 1), 0D, (acc, i) -> acc + {term})), 0D))[0]"
    part = f"aggregate(transform(part, (r, nth) -> IF(nth = 0, 1D, -1D) * {ring}), 0D, (acc, v) -> acc + v)"
    return f"aggregate(transform(parts, part -> {part}), 0D, (acc, v) -> acc + v) * {factor!r}D"


def register(spark: SparkSession) -> None:
    """fn_area_hectares(parts): geography_ha, epsg6933_ha and delta_frac, their relative difference (0 for no area)."""
    geodesic, flat = _total(_EXCESS, R2 / 1e4), _total(_CROSS, A * A / 4 / 1e4)
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION fn_area_hectares(parts {PARTS})
RETURNS STRUCT<geography_ha: DOUBLE, epsg6933_ha: DOUBLE, delta_frac: DOUBLE>
RETURN transform(array(named_struct('g', {geodesic}, 'e', {flat})), a -> named_struct('geography_ha', a.g, 'epsg6933_ha', a.e, 'delta_frac', IF(a.g = 0, 0D, abs(a.g - a.e) / a.g)))[0]""")


def register_validity(spark: SparkSession, found: DataFrame) -> None:
    """fn_validate_plot(plot): a table of is_valid, reason and repaired_wkt of that plot; no row for unknown and null ids.

    found: what crossings.validity() returns for the plots that SQL may ask for; it stands as the view plot_validity. A lateral
    call for many plots is one join with it.
    """
    found.createOrReplaceTempView("plot_validity")
    kind = found.schema["plot_id"].dataType.simpleString()
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION fn_validate_plot(plot {kind})
RETURNS TABLE(is_valid BOOLEAN, reason STRING, repaired_wkt STRING)
RETURN SELECT v.is_valid, v.reason, v.repaired_wkt FROM plot_validity v WHERE v.plot_id = fn_validate_plot.plot""")
