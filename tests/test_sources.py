"""Readers, sinks, exports and the stream."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plotsage.plans import derive, jobs
from plotsage.sources import exports, submissions, tables
from plotsage.sources.shared import cut, shared_folder
from plotsage.streaming.ingest import ingest, ingest_unique

COLLECTION = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [108.01, 12.64]}, "properties": {"id": "x", "area_ha": "1,5"}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[108, 12], [108.001, 12], [108.001, 12.001], [108, 12]]]}, "properties": {"plot_id": "b"}},
        {"type": "Feature", "geometry": None, "properties": {"wkt": "POLYGON((1 1, 2  2, 1 2))"}},
        {"type": "Feature", "geometry": None, "properties": {"note": "dropped"}},
    ],
}
CSV = '﻿ID , Lon,lat,asserted_area_ha,wkt\nr1,"108,006","12,646","1,2",\nr2,,,,"POLYGON((1 1, 2 2, 1 2))"\n,108.5,12.5,,\nnone,,,,\n'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.geojson").write_text("﻿" + json.dumps(COLLECTION), encoding="utf-8")
    (tmp_path / "in/b.csv").write_text(CSV, encoding="utf-8")
    (tmp_path / "in/c.dat").write_text('{"type":"Point","coordinates":[108.02,12.65]}', encoding="utf-8")
    return tmp_path


def test_formats(spark, folder):
    rows = {(r.source_format, r.pos, r.external_id): r for r in submissions.read_submissions(spark, f"{folder}/in").collect()}
    assert set(rows) == {("geojson", 0, "a"), ("geojson", 1, "b"), ("geojson", 2, "feature-2"), ("geojson", 0, "feature-0"), ("csv", 0, "r1"), ("csv", 1, "r2"), ("csv", 2, "row-2")}
    assert rows["geojson", 0, "a"].asserted_area_ha == 1.5
    assert rows["csv", 0, "r1"].parts[0][0][0].x == 108_006_000 and rows["csv", 0, "r1"].asserted_area_ha == 1.2
    assert rows["geojson", 2, "feature-2"].parts is None and rows["geojson", 2, "feature-2"].gtype == "Polygon"
    assert rows["geojson", 2, "feature-2"].geom_hash == rows["csv", 1, "r2"].geom_hash  # blanks do not count


def test_csv_reader_equals_text_parser(spark, folder):
    a = submissions.read_csv(spark, f"{folder}/in/b.csv").select("pos", "external_id", "geom_hash").collect()
    b = submissions.read_submissions(spark, f"{folder}/in").filter("source_format = 'csv'").select("pos", "external_id", "geom_hash").collect()
    assert sorted(a) == sorted(b)


def test_sinks_add_nothing_twice(spark, folder):
    features = submissions.read_submissions(spark, f"{folder}/in")
    for _ in range(2):
        tables.append_plots(features, f"{folder}/plots")
        tables.append_runs(features, f"{folder}/runs")
    plots, runs = spark.read.parquet(f"{folder}/plots"), spark.read.parquet(f"{folder}/runs")
    assert plots.count() == 5 and runs.count() == 3
    assert plots.filter("length(plot_id) <> 16").count() == 0
    assert {r.n_raw for r in runs.collect()} == {0, 1}


def test_stream_replay_adds_nothing(spark, folder):
    for checkpoint in ("one", "one", "two"):  # the second run finds no files; the third reads all of them again
        ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/{checkpoint}").awaitTermination()
    assert spark.read.parquet(f"{folder}/out/plots").count() == 5
    assert spark.read.parquet(f"{folder}/out/runs").count() == 3


def test_stream_keeps_the_first_of_each_shape(spark, folder):
    """Two files with one plot come together, and one of them again later: one row, though the table is never read."""
    (folder / "in/d.geojson").write_text(json.dumps(COLLECTION), encoding="utf-8")
    run = lambda: ingest_unique(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state").awaitTermination()
    run()
    first = {r.geom_hash: r.submission for r in spark.read.parquet(f"{folder}/out").collect()}
    assert len(first) == 5
    (folder / "in/e.geojson").write_text(json.dumps(COLLECTION), encoding="utf-8")
    (folder / "in/f.dat").write_text('{"type":"Point","coordinates":[108.03,12.65]}', encoding="utf-8")
    run()
    again = spark.read.parquet(f"{folder}/out").collect()
    assert len(again) == 6 and {r.geom_hash: r.submission for r in again if r.geom_hash in first} == first
    assert all(r.plot_id == r.geom_hash[:16] for r in again)


def test_stream_of_packed_submissions(spark, folder, sf_dir):
    """Many submissions in one Parquet file give the plots that they give as files of their own."""
    from plotsage.plans import queries

    files = spark.createDataFrame([(p.name, p.read_text(encoding="utf-8-sig")) for p in (folder / "in").iterdir()], "submission string, value string")
    files.unionByName(files.withColumn("submission", F.concat(F.lit("again-"), "submission"))).coalesce(1).write.parquet(f"{folder}/packed")
    ingest_unique(spark, f"{folder}/packed", f"{folder}/out", f"{folder}/state", packed=True).awaitTermination()
    ingest_unique(spark, f"{folder}/in", f"{folder}/out2", f"{folder}/state2").awaitTermination()
    hashes = lambda path: sorted(r.geom_hash for r in spark.read.parquet(f"{folder}/{path}").collect())
    assert hashes("out") == hashes("out2") and len(hashes("out")) == 5
    # the query's files do not grow with the submissions: fewer than these, twice
    found = queries.streamed_plots(spark, sf_dir)
    came = found.inputFiles()[0].split("/plots/")[0].removeprefix("file://") + "/in"
    assert len(list(Path(came).glob("**/*.parquet"))) < queries.geojson_submissions(spark, sf_dir).count()


def test_killed_write_of_a_run_is_made_good(spark, tmp_path):
    """A run whose files are there but which is not in the list was not written whole: the next write replaces it."""
    rows = spark.createDataFrame([("r1", 1), ("r1", 2), (None, 3), ("r2", 4)], "run_id string, plot_id long")
    path = f"{tmp_path}/ledger"
    rows.filter("plot_id = 1").write.partitionBy("run_id").parquet(path)  # what the killed write left
    stored = lambda: sorted((r.run_id or "", r.plot_id) for r in tables.read_or_empty(spark, path, rows).collect())
    for _ in range(2):
        tables.append_ledger(rows.filter("plot_id < 4"), path)
        assert stored() == [("", 3), ("r1", 1), ("r1", 2)]
    tables.append_ledger(rows.withColumn("plot_id", F.col("plot_id") * 10), path)  # r1 and null are recorded
    assert stored() == [("", 3), ("r1", 1), ("r1", 2), ("r2", 40)]
    tables.append_ledger(rows.limit(0), path)
    assert len(stored()) == 4


def test_exports_at_one_clock_are_equal(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("plot_id"), F.when(F.col("id") % 3 > 0, F.col("id") / 8).alias("ha"))
    index = spark.createDataFrame([("low", 3), (None, 1)], "risk string, n long")
    told = lambda: {p.name: p.read_bytes() for p in (tmp_path / "x/manifest").glob("*.json")}.values()
    text = lambda folder: b"".join(p.read_bytes() for p in sorted((tmp_path / "x" / folder).glob("part-*")))
    exports.publish({"plots": (rows, ["plot_id"]), "index": (index, ["risk"])}, f"{tmp_path}/x", "2026-01-01")
    first, folders = b"".join(told()), {p.name: p.stat().st_mtime_ns for p in (tmp_path / "x").iterdir() if p.name != "manifest"}
    lines = [json.loads(x) for x in first.splitlines()]
    assert [(x["section"], x["n"], x["as_of"]) for x in lines] == [("index", 2, "2026-01-01"), ("plots", 500, "2026-01-01")]
    assert [json.loads(x) for x in text(lines[1]["folder"]).splitlines()] == [{"plot_id": i, "ha": i / 8 if i % 3 else None} for i in range(500)]
    # the same rows in another order: equal bytes, and nothing is written but the manifest
    exports.publish({"plots": (rows.repartition(7, "ha"), ["plot_id"]), "index": (index, ["risk"])}, f"{tmp_path}/x", "2026-01-01")
    assert b"".join(told()) == first and {p.name: p.stat().st_mtime_ns for p in (tmp_path / "x").iterdir() if p.name != "manifest"} == folders
    # one row twice: another digest, another folder; the other section stays
    exports.publish({"plots": (rows.unionByName(rows.limit(1)), ["plot_id"]), "index": (index, ["risk"])}, f"{tmp_path}/x", "2026-01-02")
    again = [json.loads(x) for x in b"".join(told()).splitlines()]
    assert again[0]["folder"] == lines[0]["folder"] and again[1]["folder"] != lines[1]["folder"] and again[1]["n"] == 501
    exports.publish({"none": (rows.limit(0), ["plot_id"])}, f"{tmp_path}/y", "2026-01-01")  # an empty table has a folder and a digest too


def test_exports_copy_no_stored_rows_and_write_no_lines_twice(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("plot_id"), F.lit(None).alias("none"), F.array().alias("empty"), F.col("id").cast("string").alias("void"))
    shared = Path(shared_folder(spark).removeprefix("file://"))
    tables_of = lambda label: sorted(shared.glob(f"{label}-*"))
    before = tables_of("export-stored")
    exports.publish({"stored": (cut(rows.select("plot_id"), "rows"), ["plot_id"])}, f"{tmp_path}/x", "2026-01-01")
    assert tables_of("export-stored") == before
    exports.publish({"typed": (rows, ["plot_id"])}, f"{tmp_path}/y", "2026-01-01")
    assert "line" not in spark.read.parquet(f"file://{tables_of('export-typed')[-1]}").columns
    [told] = spark.read.json(f"{tmp_path}/y/manifest").collect()
    lines = [f'{{"plot_id":{i},"none":null,"empty":[],"void":"{i}"}}' for i in range(300)]
    assert [r.value for r in spark.read.text(f"{tmp_path}/y/{told.folder}").collect()] == lines
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    sums = [sum(int(x[at : at + 15], 16) for x in sha) for at in (0, 15, 30, 45)]
    assert told.n == 300 and told.digest == hashlib.sha256(":".join(map(str, [300, *sums])).encode()).hexdigest()


def test_append_reads_the_keys_that_a_batch_asks_for(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "key string, n long")
    tables.append_new(rows.filter("n < 3"), f"{tmp_path}/t", "key")
    tables.append_new(rows, f"{tmp_path}/t", "key")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 2, 4]


def test_ledger_and_results_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1, [1]), ("r1", 2, [2])], "run_id string, plot_id long, risk array<int>")
    tables.append_results(rows, f"{tmp_path}/results")
    tables.append_results(rows.withColumn("plot_id", F.col("plot_id") + 7), f"{tmp_path}/results")
    assert [r.risk for r in spark.read.parquet(f"{tmp_path}/results").orderBy("plot_id").collect()] == ["[1]", "[2]"]
    for _ in range(2):
        tables.append_ledger(rows.drop("risk"), f"{tmp_path}/ledger")
    assert spark.read.parquet(f"{tmp_path}/ledger").filter("run_id = 'r1'").count() == 2


def test_consignments_and_dataset_versions(spark):
    plots = spark.createDataFrame([(1, "old"), (2, None)], "plot_id long, consignment string")
    fresh = spark.createDataFrame([(2, "new")], "plot_id long, consignment string")
    assert {r.plot_id: r.consignment for r in tables.with_consignments(plots, fresh).collect()} == {1: "old", 2: "new"}
    data = spark.createDataFrame([(0, "Annual Loss v9", "9"), (1, "loss too", "1")], "pos int, name string, version string")
    needles = spark.createDataFrame([("LOSS",), ("cover",)], "needle string")
    assert {r.needle: (r.dataset_name, r.dataset_version) for r in tables.dataset_version(data, needles).collect()} == {"LOSS": ("Annual Loss v9", "9"), "cover": ("cover", "unknown")}


def test_label_file(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"_note": "remark", "p1": "LOW RISK", "p2": "odd"}')
    assert {r.point_id: r.label for r in submissions.read_labels(spark, f"{tmp_path}/l.json").collect()} == {"p1": "Low", "p2": None}
    assert submissions.label_note(spark, f"{tmp_path}/l.json").first().note == "remark"


def test_map_export(spark, tmp_path):
    from test_geometry import parsed

    done = jobs.process(spark, parsed(spark, "POINT (108.034445 12.645555)", "POINT (0 12.6)"), derive.layers(spark), derive.cells(spark))
    evidence = spark.createDataFrame([(0, layer) for layer in range(3)], "plot_id long, layer_order int")
    features = [json.loads(r.feature) for r in exports.map_features(done, evidence).orderBy("plot_id").collect()]
    assert features[0]["properties"]["n_evidence"] == 3 and features[0]["properties"]["risk"] is not None
    assert features[1]["properties"] == {"plot_id": 1, "risk": None, "disposition": "NEEDS_REVIEW", "boundary_uncertain": False, "rationale": "null_island", "n_evidence": 0}
    assert list(features[0]["properties"]) == ["plot_id", "risk", "disposition", "boundary_uncertain", "rationale", "n_evidence"]
    exports.write_map(done, evidence, f"{tmp_path}/map")
    assert spark.read.text(f"{tmp_path}/map").count() == 2
    assert sum(r.n for r in exports.index(done).collect()) == 2


def test_csv_records_and_cells_in_quotes(spark):
    text = '﻿Id,"No, te",Lon,LAT\r\n1,"two\nlines, ""x""",108.1,12.6\r\n\r\n2, plain ,108.2,12.7\n,,"108,3",12.8\n4,"",108.4,n/a\n5,"never closed,108.5'
    files = spark.createDataFrame([("f", text), ("g", ""), ("h", None), ("i", "id,lon,lat")], "submission string, value string")
    found = submissions.parse_csv_text(files)
    rows = {r.pos: r for r in found.collect()}
    assert sorted(rows) == [0, 1, 2] and {r.submission for r in rows.values()} == {"f"}
    assert rows[0].properties["no, te"] == 'two\nlines, "x"' and rows[1].properties["no, te"] == "plain" and rows[2].external_id == "row-2"
    assert rows[2].parts[0][0][0].x == 108_300_000


def test_long_csv_cells_take_time_in_proportion(spark):
    import time

    wkt = "POLYGON((" + ", ".join(f"108.{i % 1000:03d} 12.5" for i in range(60_000)) + "))"
    files = spark.createDataFrame([("f", "id,wkt\n" + f'a,"{wkt}"\n' * 3)], "submission string, value string")
    begun = time.time()
    assert [r.n for r in submissions.parse_csv_text(files).select(F.length("raw").alias("n")).collect()] == [len(wkt)] * 3
    assert time.time() - begun < 30


def test_csv_positions_are_counted_by_file(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.csv").write_text(f'id,lon,lat\na{i},108.1,12.6\n"b\n{i}",108.2,12.6\n')
    for read in (submissions.read_csv, submissions.read_submissions):
        rows = read(spark, str(tmp_path)).collect()
        assert len(rows) == 60 and {(r.external_id[0], r.pos) for r in rows} == {("a", 0), ("b", 1)}


@pytest.mark.parametrize("size", ["150b", "128m"])
def test_csv_files_are_split_anywhere(spark, tmp_path, size):
    import random

    draw, heads = random.Random(3), ["id,lon,lat,note", "Note,ID,id,lat,lon", "id,wkt,note"]
    for f, head in enumerate(heads):
        rows = ["\ufeff" * (f % 2) + head]
        for i in range(60):
            note = '"a\nb ""q"", c\n\n"' if draw.random() < 0.3 else '""' if draw.random() < 0.1 else "plain" * draw.choice((1, 1, 30))
            rows.append((f"r{i},108.{i:03d},12.5,{note}", f'{note},x,r{i},12.5,"108,{i:03d}"', f'r{i},"POINT(108.{i:03d} 12.5)",{note}')[f])
            rows += draw.choice([[], [], [""], ["  "]])
        end = "\r\n" if f == 1 else "\n"
        (tmp_path / f"{f}.csv").write_text(end.join(rows) + end * (f > 0), newline="")
    (tmp_path / "open.csv").write_text('id,lon,lat\na,1,2\nb,"3,4\nc,5,6\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("\n\nid,lon,lat\n")
    columns = ("submission", "pos", "external_id", "gtype", "geom_hash", "properties")
    texts = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("submission"), "value")
    rows = lambda df: sorted((*r[:5], sorted(r.properties.items())) for r in df.select(*columns).collect())
    want = rows(submissions.parse_csv_text(texts))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert size != "150b" or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 40
        assert rows(submissions.read_csv(spark, str(tmp_path))) == want and len(want) == 181
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_reject_tables(spark, tmp_path):
    files = spark.createDataFrame([("f", "id,wkt,lon,area_ha\na,POINT(1 2),east,1.5\nb,POINT(1 2),,n/a\nc,POINT(1 2),nan,\n")], "submission string, value string")
    found = submissions.rejected(submissions.parse_csv_text(files))
    assert {tuple(r) for r in found.collect()} == {("f", 0, "a", "lon", "east"), ("f", 1, "b", "asserted_area_ha", "n/a")}
    (tmp_path / "l.json").write_text('{"_note": "remark", "p1": "LOW RISK", "p2": "odd"}')
    assert [tuple(r) for r in submissions.rejected_labels(spark, f"{tmp_path}/l.json").collect()] == [("p2", "odd")]


def test_properties_are_merged_without_overwriting(spark):
    rows = [("a", 1.5, {"id": "own", "x": "y"}), ("b", None, None), ("c", 2.0, {"asserted_area_ha": "7"})]
    df = spark.createDataFrame(rows, "external_id string, asserted_area_ha double, properties map<string,string>")
    got = [r.properties for r in submissions.validation_properties(df).collect()]
    assert got == [{"id": "own", "x": "y", "asserted_area_ha": "1.5"}, {"id": "b"}, {"asserted_area_ha": "7", "id": "c"}]


def test_consignments_are_inserted_once_and_results_read_back(spark, tmp_path):
    fresh = spark.createDataFrame([("c1", "B"), ("c1", "A"), (None, "x")], "consignment string, operator string")
    tables.append_consignments(fresh, f"{tmp_path}/c")
    tables.append_consignments(fresh.withColumn("operator", F.lit("Z")), f"{tmp_path}/c")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/c").collect()] == [("c1", "A")]
    rows = spark.createDataFrame([("r", 2, [1, 2]), ("r", 1, None)], "run_id string, plot_id long, risk array<int>")
    tables.append_results(rows, f"{tmp_path}/r")
    stored = tables.results_from_json(spark.read.parquet(f"{tmp_path}/r"), rows)
    assert [tuple(r) for r in tables.plots_of_run(stored, "r").collect()] == [("r", 1, None), ("r", 2, [1, 2])]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.parquet").write_text("no table")
    with pytest.raises(Exception):
        tables.append_new(rows.select("run_id"), f"{tmp_path}/bad", "run_id")


def test_validity_and_repair(spark):
    from test_geometry import parsed

    from plotsage.operators import crossings

    df = jobs.closed(parsed(spark, "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON((0 0, 2 2, 2 0, 0 2, 0 0))", "POLYGON((0 0, 1 0, 1 -0.001, 1 0, 2 0, 2 2, 0 2, 0 0))", "POINT(1 1)"))
    rows = {r.plot_id: r for r in crossings.validity(df).collect()}
    assert [rows[i].is_valid for i in range(4)] == [True, False, False, True]
    assert [rows[i].reason for i in range(4)] == ["Valid Geometry", "Self-intersection", "Ring overlaps itself", "Valid Geometry"]
    assert rows[1].repaired_wkt == "SRID=4326;MULTIPOLYGON (((0 0, 1 1, 0 2, 0 0)), ((1 1, 2 0, 2 2, 1 1)))"
    assert rows[2].repaired_wkt == "SRID=4326;POLYGON ((0 0, 1 0, 2 0, 2 2, 0 2, 0 0))" and rows[3].repaired_wkt == "SRID=4326;POINT (1 1)"


def test_headers_that_are_equal_but_for_case(spark):
    text = spark.createDataFrame([("a.csv", "id,ID,lon,lat\n1,one,108,12\n2,,108,13\n")], "submission string, value string")
    assert [(r.external_id, r.gtype) for r in submissions.parse_csv_text(text).orderBy("pos").collect()] == [("one", "Point"), ("row-1", "Point")]
    cells = spark.createDataFrame([("a", 0, "1", "one", "108", "12")], "submission string, pos int, id string, `ID ` string, lon string, lat string")
    assert submissions.parse_cells(cells, "excel").first().external_id == "one"


def test_files_that_cannot_be_read_are_told(spark):
    rows = {
        "cut.geojson": '{"type":"FeatureCollection","features":[{"type":"Fea', "other.json": '{"a": 1}', "list.json": "[1, 2]", "good.geojson": '\ufeff{"type":"FeatureCollection","features":[]}', "bare.json": '{"type":"Point","coordinates":[1,2]}',
        "head.csv": "id,lon,lat\n", "good.csv": "id,lon,lat\n1,2,3", "none.txt": " ", "guess.txt": "{", "sheet.xlsx": "PK",
    }
    found = submissions.rejected_files(spark.createDataFrame(list(rows.items()), "submission string, value string"))
    want = {"cut.geojson": "not valid JSON", "other.json": "no GeoJSON", "list.json": "no GeoJSON", "head.csv": "no records", "none.txt": "empty", "guess.txt": "not valid JSON", "sheet.xlsx": "no text"}
    assert {r.submission: r.reason for r in found.collect()} == want


def test_ledger_numbers_go_on_over_ranges(spark):
    from plotsage.operators import ledger

    rows = [(f"run{i % 3 if i % 7 else 9}", i * 37 % 500, layer, "x") for i in range(500) for layer in range(3)]
    df = spark.createDataFrame(rows, "run_id string, pos int, layer_order int, _n string").repartition(7)
    found = ledger.numbered(df).withColumn("part", F.spark_partition_id()).collect()
    for run in {r[0] for r in rows}:
        own = sorted((r.row_id, r.pos, r.layer_order) for r in found if r.run_id == run)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted(r[1:3] for r in rows if r[0] == run)
