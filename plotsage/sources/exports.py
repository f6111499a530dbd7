"""Exports: map features, snapshots of plots, ledgers and statements with a manifest, and an index."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plotsage.operators import ledger, risk
from plotsage.operators.statements import coordinates_json
from plotsage.operators.validation import dominating
from plotsage.sources.shared import cut


def map_features(processed: DataFrame, evidence: DataFrame) -> DataFrame:
    """plot_id and feature: a GeoJSON feature with risk, disposition, rationale and n_evidence, keys in fixed order.

    evidence: rows of plot_id, which are counted. A plot that was not assessed has the rule of its worst finding as
    rationale, and risk null.
    """
    counted = evidence.groupBy("plot_id").agg(F.count("*").alias("_n_evidence"))
    processed = processed.join(counted, "plot_id", "left")
    reason = F.coalesce("rationale", dominating(F.col("findings"))["rule_id"], F.lit("not assessed"))
    n_evidence = F.coalesce("_n_evidence", F.lit(0))
    properties = F.struct("plot_id", "risk", "disposition", F.coalesce("boundary_uncertain", F.lit(False)).alias("boundary_uncertain"), reason.alias("rationale"), n_evidence.alias("n_evidence"))
    body = F.to_json(properties, {"ignoreNullFields": "false"})
    geometry = F.concat(F.lit('{"type":"'), F.col("gtype"), F.lit('","coordinates":'), coordinates_json(F.col("gtype"), F.col("parts")), F.lit("}"))
    return processed.filter(F.col("parts").isNotNull()).select("plot_id", F.concat(F.lit('{"type":"Feature","properties":'), body, F.lit(',"geometry":'), geometry, F.lit("}")).alias("feature"))


def write_map(processed: DataFrame, evidence: DataFrame, path: str) -> None:
    """One feature a line: a collection of any size, written in parallel."""
    map_features(processed, evidence).select("feature").write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, *order: str) -> DataFrame:
    """order and line: each row as JSON, nulls written out."""
    return rows.select(*order, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def digests(sections: dict[str, DataFrame]) -> DataFrame:
    """section, n and digest of tables of lines. A digest is that of sums over the hashes of all lines: it tells which lines there are
    and how often, whatever their order, and no task gathers them."""
    places, bits = (1, 16, 31, 46), (0, 20, 40)
    # each number of 60 bits in three parts, whose sums are whole numbers of 64 bits for any table
    sums = [F.sum(F.shiftright(f"v{at}", bit).bitwiseAND(F.lit((1 << 20) - 1))).alias(f"s{at}_{bit}") for at in places for bit in bits]
    whole = lambda at: functools.reduce(Column.__add__, [F.coalesce(F.col(f"s{at}_{bit}"), F.lit(0)).cast("decimal(38,0)") * F.lit(1 << bit).cast("decimal(13,0)") for bit in bits]).cast("decimal(38,0)").cast("string")
    each = []
    for name, lines in sections.items():
        hashed = lines.select(F.sha2("line", 256).alias("sha")).select(*[F.conv(F.substring("sha", at, 15), 16, 10).cast("long").alias(f"v{at}") for at in places])
        found = hashed.agg(F.count("*").alias("n"), *sums)
        each.append(found.select(F.lit(name).alias("section"), "n", F.sha2(F.concat_ws(":", "n", *map(whole, places)), 256).alias("digest")))
    return functools.reduce(DataFrame.unionByName, each)


def stored(rows: DataFrame, label: str) -> DataFrame:
    """rows as a table that does not change: as they are if cut() gave them, else cut. Types that are null alone become text."""
    if hasattr(rows, "cut_path"):
        return rows
    void = r"(?<![^:<])void(?![^,>])"
    return cut(rows.select(*[F.col(f"`{c}`").cast(re.sub(void, "string", kind)).alias(c) if re.search(void, kind) else F.col(f"`{c}`") for c, kind in rows.dtypes]), label)


def publish(sections: dict[str, tuple[DataFrame, list[str]]], path: str, as_of: str) -> None:
    """Write tables as JSON lines, in the order of the columns named, under path/<section>-<digest>, and then path/manifest.

    The manifest has section, n, digest, folder and as_of, a clock the caller sets. It is written last: an export that was killed
    leaves the one before as it was. A section whose lines have not changed keeps its folder and is not written again, so a
    second export of the same rows at the same clock is equal byte by byte. Rows are kept as columns and made lines where
    lines are asked for; those that cut() gave are not copied.
    """
    spark = next(iter(sections.values()))[0].sparkSession
    kept = {name: (stored(rows, f"export-{name}"), order) for name, (rows, order) in sections.items()}
    fresh = digests({name: json_lines(rows) for name, (rows, _) in kept.items()})
    folder = F.concat_ws("-", "section", F.substring("digest", 1, 16))
    manifest = cut(fresh.select("section", "n", "digest", folder.alias("folder"), F.lit(as_of).alias("as_of")), "export-manifest")
    try:
        known = {r["folder"] for r in spark.read.schema(manifest.schema).json(f"{path}/manifest").collect()}  # one row for each section
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = set()
    for r in manifest.collect():
        rows, order = kept[r["section"]]
        if r["folder"] not in known:
            json_lines(rows.repartitionByRange(*order), *order).sortWithinPartitions(*order, "line").select("line").write.mode("overwrite").text(f"{path}/{r['folder']}")
    manifest.coalesce(1).sortWithinPartitions("section").write.mode("overwrite").json(f"{path}/manifest")


def snapshot(processed: DataFrame, evidence: DataFrame, path: str, as_of: str, statements: DataFrame | None = None) -> None:
    """Payload of each plot, the numbered ledger, the index of tiers and uncertain plots, and statements, with a manifest."""
    sections = {"plots": (processed, ["plot_id"]), "ledger": (ledger.numbered(evidence, "plot_id"), ["run_id", "row_id"]), "index": (index(processed), ["risk"])}
    if statements is not None:
        sections["statements"] = (statements, ["consignment"])
    publish(sections, path, as_of)


def index(processed: DataFrame) -> DataFrame:
    """A row for each tier: n, and the ids of its plots of uncertain boundary, in order."""
    counts = risk.tier_counts(processed)
    uncertain = processed.filter("boundary_uncertain").groupBy("risk").agg(F.array_sort(F.collect_list("plot_id")).alias("uncertain"))
    return counts.join(uncertain, "risk", "left")


def showcase(validated: DataFrame) -> DataFrame:
    """plot_id, disposition, needs_review and findings as JSON of a table of cases."""
    return validated.select("plot_id", "disposition", "needs_review", F.to_json("findings").alias("findings"))
