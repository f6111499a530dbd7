"""Submissions: GeoJSON, CSV and tables of text cells to one row for each feature.

Columns: submission (file), source_format, pos, external_id, gtype, parts (or null), raw (WKT as typed, or null),
asserted_area_ha, crs, properties (a map of text), geom_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotsage.functions import geometry as g
from plotsage.functions import text as t

FEATURE = "struct<id:string,geometry:string,properties:map<string,string>>"
#: Records of a file that meet its header in one group.
RECORDS = 100_000
COLUMNS = ("submission", "source_format", "pos", "external_id", "gtype", "parts", "raw", "asserted_area_ha", "crs", "properties", "geom_hash")


def _points(numbers: Column) -> Column:
    return F.transform(numbers, lambda c: g.point(g.micro(c[0]), g.micro(c[1])))


def geojson_parts(geometry: Column) -> Column:
    """parts of a GeoJSON geometry text; null where its type or coordinates cannot be read."""
    gtype, numbers = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    read = lambda depth: F.from_json(numbers, "array<" * depth + "double" + ">" * depth)
    return (
        F.when(gtype == "Point", F.array(F.array(F.array(g.point(g.micro(read(1)[0]), g.micro(read(1)[1]))))))
        .when(gtype.isin("MultiPoint", "LineString"), F.array(F.array(_points(read(2)))))
        .when(gtype == "Polygon", F.array(F.transform(read(3), _points)))
        .when(gtype == "MultiPolygon", F.transform(read(4), lambda p: F.transform(p, _points)))
    )


def finished(features: DataFrame) -> DataFrame:
    """Features (submission, source_format, pos, fallback, own_id, geometry_type, parts, raw, properties) with all columns.

    A feature with neither geometry nor text is dropped. The id of the feature comes before those of its properties.
    """
    gtype = F.coalesce("geometry_type", g.raw_type(F.col("raw")))
    kept = features.filter("parts is not null or raw is not null").withColumn("gtype", gtype)
    kept = kept.withColumn("external_id", F.coalesce(F.nullif("own_id", F.lit("")), t.first_present(F.col("properties"), t.ID_KEYS), F.concat("fallback", F.col("pos").cast("string"))))
    kept = kept.withColumn("asserted_area_ha", t.locale_number(t.first_present(F.col("properties"), t.AREA_KEYS))).withColumn("crs", F.try_element_at("properties", F.lit("crs")))
    shaped = F.when(F.col("parts").isNotNull(), g.geometry_hash(F.col("gtype"), F.col("parts"))).otherwise(g.raw_hash(F.col("raw")))
    return kept.withColumn("geom_hash", shaped).select(*COLUMNS)


def parse_geojson(files: DataFrame) -> DataFrame:
    """Features of texts (submission, value): a collection, one feature, or a bare geometry; a leading mark is dropped."""
    value = F.regexp_replace("value", "^﻿", "")
    texts = files.select("submission", value.alias("value")).withColumn("type", F.get_json_object("value", "$.type"))
    many = F.from_json(F.get_json_object("value", "$.features"), f"array<{FEATURE}>")
    one = F.array(F.from_json("value", FEATURE))
    bare = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.col("value").alias("geometry"), F.create_map().cast("map<string,string>").alias("properties")))
    found = F.when(F.col("type") == "FeatureCollection", many).when(F.col("type") == "Feature", one).otherwise(bare)
    each = texts.select("submission", F.posexplode(found).alias("pos", "f"))
    properties = F.coalesce("f.properties", F.create_map().cast("map<string,string>"))
    rows = each.select("submission", F.lit("geojson").alias("source_format"), "pos", F.lit("feature-").alias("fallback"), F.col("f.id").alias("own_id"), F.get_json_object("f.geometry", "$.type").alias("geometry_type"), geojson_parts(F.col("f.geometry")).alias("parts"), properties.alias("properties"))
    raw = F.when(F.col("parts").isNull(), t.first_present(F.col("properties"), t.WKT_KEYS))
    return finished(rows.withColumn("raw", raw))


def parse_cells(rows: DataFrame, source_format: str = "csv") -> DataFrame:
    """Features of a table of text cells with submission and pos: keys trimmed and in lower case, WKT or lon and lat.

    A row with a WKT cell stays text; else lon and lat make a point; rows with neither are dropped. Of keys that are equal
    then the last counts. Works alike for CSV and for spreadsheet cells as text.
    """
    names = [c for c in rows.columns if c not in ("submission", "pos")]
    tidy = {c.replace("﻿", "").strip().lower(): c for c in names}
    cells = F.map_from_arrays(F.array(*map(F.lit, tidy)), F.array(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in tidy.values()]))
    mapped = rows.select("submission", "pos", cells.alias("properties"))
    raw = t.first_present(F.col("properties"), tuple(dict.fromkeys(k.lower() for k in t.WKT_KEYS)))
    at = lambda *keys: t.locale_number(t.first_present(F.col("properties"), keys))
    lon, lat = at("lon", "longitude", "x"), at("lat", "latitude", "y")
    point = F.when(F.col("raw").isNull() & lon.isNotNull() & lat.isNotNull(), F.array(F.array(F.array(g.point(g.micro(lon), g.micro(lat))))))
    made = mapped.withColumn("raw", raw).withColumn("parts", point)
    kind = F.when(F.col("parts").isNotNull(), "Point")
    return finished(made.select("submission", F.lit(source_format).alias("source_format"), "pos", F.lit("row-").alias("fallback"), F.lit(None).cast("string").alias("own_id"), kind.alias("geometry_type"), "parts", "raw", "properties"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return parse_geojson(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("submission"), "value"))


def read_csv(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """Files of any headers, split over tasks wherever they are long. pos is the order of records in the file. only: a glob of file names.

    As parse_csv_text, of which this is the form for files of any size.
    """
    return from_records(csv_records(spark, path, only))


def csv_records(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """submission, head (cells of the file's first record, array), pos and line of every further record of CSV files.

    A file is read in pieces by many tasks, each of which knows the lines of its piece alone. Whether a line begins inside
    quotes is told by the parity of all quotes before it: those of its piece are counted there, and a running sum over the
    pieces of the file (one small row each) gives parity and number of records for each piece's begin. Records of one line stay
    where they are; only the lines of the others, and the last of each piece, are brought together. A record is held by
    one task, so a quote that is never closed must not be followed by more than a task can hold.
    """
    reader = spark.read.option("pathGlobFilter", only) if only else spark.read
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("submission"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at"), "value")
    own, before = Window.partitionBy("submission", "piece").orderBy("at"), Window.unboundedPreceding
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    told = lines.withColumn("quotes", quotes).withColumn("odd", F.coalesce(F.sum("quotes").over(own.rowsBetween(before, -1)), F.lit(0)) % 2)
    # a line that would begin a record if its piece began outside quotes (even) or inside (odd); blank ones begin none
    begins = lambda parity: ((F.col("odd") == parity) & (F.trim("value") != "")).cast("long")
    counted = told.groupBy("submission", "piece").agg((F.sum("quotes") % 2).alias("parity"), F.sum(begins(0)).alias("even"), F.sum(begins(1)).alias("odds"))
    earlier = Window.partitionBy("submission").orderBy("piece").rowsBetween(before, -1)
    inside = counted.withColumn("inside", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    offset = F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odds"))).over(earlier), F.lit(0))
    placed = told.join(inside.select("submission", "piece", "inside", offset.alias("offset")), ["submission", "piece"])
    outside = F.col("odd") == F.col("inside")
    placed = placed.withColumn("begins", outside & (F.trim("value") != "")).filter(F.col("begins") | ~outside)
    placed = placed.withColumn("pos", F.col("offset") + F.sum(F.col("begins").cast("long")).over(own.rowsBetween(before, 0)) - 2)
    placed = placed.withColumn("alone", F.col("begins") & F.coalesce(F.lead("begins").over(own), F.lit(False)))
    single = placed.filter("alone").select("submission", "pos", F.col("value").alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("piece", "at", "value")))
    several = placed.filter("not alone").groupBy("submission", "pos").agg(parts.alias("l")).select("submission", "pos", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("line"))
    records = single.unionByName(several).withColumn("line", F.when(F.col("pos") == -1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))
    heads = records.filter("pos = -1").select("submission", _head(F.col("line")).alias("head"))
    # a long file is one key: its records go by thousands, and its header to each of these
    step = F.floor(F.col("pos") / RECORDS)
    last = records.groupBy("submission").agg(F.max("pos").alias("last"))
    spread = heads.join(last, "submission").select("submission", "head", F.explode(F.sequence(F.lit(0), F.floor(F.greatest("last", F.lit(0)) / RECORDS))).alias("step"))
    return records.filter("pos >= 0").withColumn("step", step).join(spread, ["submission", "step"]).select("submission", "head", F.col("pos").cast("int"), "line")


def source_format(path: Column, value: Column) -> Column:
    """By suffix; for others by the first character: a brace or bracket is GeoJSON, else CSV."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("geojson", "json"), "geojson").when(suffix == "csv", "csv").when(suffix.isin("xlsx", "xls"), "excel").when(F.substring(F.ltrim(F.regexp_replace(value, "^﻿", "")), 1, 1).isin("{", "["), "geojson").otherwise("csv")


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Every file under path, by its format. CSV files by name are split over tasks. Files of other suffixes that are not GeoJSON are read as CSV text."""
    files = spark.read.text(path, wholetext=True).filter(~F.lower(F.col("_metadata.file_name")).endswith(".csv")).select(F.col("_metadata.file_path").alias("submission"), "value")
    told = files.withColumn("format", source_format(F.col("submission"), F.col("value")))
    geo = parse_geojson(told.filter("format = 'geojson'"))
    return geo.unionByName(parse_csv_text(told.filter("format = 'csv'"))).unionByName(read_csv(spark, path, "*.[cC][sS][vV]"))


def _cells(record: Column) -> Column:
    """The cells of a record, trimmed and without their quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',((?:[^",]++|"[^"]*+"?+)*+)'), F.lit(1))
    inner = lambda c: F.regexp_replace(F.regexp_extract(c, r'(?s)^\s*"(.*?)"?\s*$', 1), '""', '"')
    return F.transform(found, lambda c: F.trim(F.when(c.rlike(r'^\s*"'), inner(c)).otherwise(c)))


def _head(record: Column) -> Column:
    """The names of a header in lower case; null for all but the last of equal ones."""
    return g.let(F.transform(_cells(record), F.lower), lambda head: F.transform(head, lambda h, i: F.when(~F.array_contains(F.slice(head, i + 2, F.size(head)), h), h)))


def parse_csv_text(files: DataFrame) -> DataFrame:
    """Features of CSV texts (submission, value) of any headers: cells are named by position in the header.

    Of headers that are equal but for case the last counts. Records end at line ends outside quotes, cells at commas outside quotes; a doubled quote is one. A quote that is never
    closed runs to the end of the text. Records without anything in them are no rows. Each character is read once.
    """
    text = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r\n?", "\n")
    records = F.filter(F.regexp_extract_all(text, F.lit(r'(?:[^"\n]++|"[^"]*+"?+)++'), F.lit(0)), lambda x: F.trim(x) != "")
    lines = files.select("submission", records.alias("lines")).withColumn("head", _head(F.get("lines", F.lit(0))))
    return from_records(lines.select("submission", "head", F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("pos", "line")))


def from_records(each: DataFrame) -> DataFrame:
    """Features of CSV records (submission, head, pos, line)."""
    pairs = F.filter(F.arrays_zip(F.col("head").alias("k"), _cells(F.col("line")).alias("v")), lambda p: p["k"].isNotNull() & (p["k"] != ""))
    mapped = each.select("submission", "pos", F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], F.coalesce(p["v"], F.lit(""))))).alias("properties"))
    raw = t.first_present(F.col("properties"), ("wkt", "geom_wkt", "geometry_wkt"))
    number = lambda *keys: t.locale_number(t.first_present(F.col("properties"), keys))
    lon, lat = number("lon", "longitude", "x"), number("lat", "latitude", "y")
    made = mapped.withColumn("raw", raw)
    point = F.when(F.col("raw").isNull() & lon.isNotNull() & lat.isNotNull(), F.array(F.array(F.array(g.point(g.micro(lon), g.micro(lat))))))
    made = made.withColumn("parts", point)
    kind = F.when(F.col("parts").isNotNull(), "Point")
    return finished(made.select("submission", F.lit("csv").alias("source_format"), "pos", F.lit("row-").alias("fallback"), F.lit(None).cast("string").alias("own_id"), kind.alias("geometry_type"), "parts", "raw", "properties"))


def rejected_files(files: DataFrame) -> DataFrame:
    """submission and reason of each of files (submission, value) from which no feature can be read: those that are taken for
    GeoJSON and are no JSON, or JSON of another kind; those taken for CSV that have no record; empty ones."""
    value = F.regexp_replace("value", "^﻿", "")
    told = files.select("submission", value.alias("value"), source_format(F.col("submission"), F.col("value")).alias("format"))
    json = F.try_parse_json("value")
    kind = F.get_json_object("value", "$.type")
    lines = F.size(F.filter(F.split("value", "\r\n?|\n"), lambda x: F.trim(x) != ""))
    reason = (
        F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "empty")
        .when((F.col("format") == "geojson") & json.isNull(), "not valid JSON")
        .when((F.col("format") == "geojson") & ~F.coalesce(kind.isin("FeatureCollection", "Feature", *g.TYPES), F.lit(False)), "no GeoJSON")
        .when((F.col("format") == "csv") & (lines < 2), "no records")
        .when(F.col("format") == "excel", "no text")
    )
    return told.select("submission", reason.alias("reason")).filter("reason is not null")


def rejected(features: DataFrame) -> DataFrame:
    """The reject table: submission, pos, external_id, field and cell of each number of a feature that is none."""
    numbers = {"asserted_area_ha": t.AREA_KEYS, "lon": ("lon", "longitude", "x"), "lat": ("lat", "latitude", "y")}
    cells = F.array(*[F.struct(F.lit(name).alias("field"), t.first_present(F.col("properties"), keys).alias("cell")) for name, keys in numbers.items()])
    return features.select("submission", "pos", "external_id", F.explode(F.filter(cells, lambda c: t.is_bad_number(c["cell"]))).alias("c")).select("submission", "pos", "external_id", "c.*")


def rejected_labels(spark: SparkSession, path: str) -> DataFrame:
    """point_id and text of labels whose spelling is not known."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("point_id", "text"))
    return found.filter(~F.col("point_id").startswith("_") & t.label(F.col("text")).isNull())


def validation_properties(features: DataFrame) -> DataFrame:
    """features whose properties also hold the asserted area and the id, unless these are there already; a null area adds nothing."""
    there = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
    more = F.map_filter(F.create_map(F.lit("asserted_area_ha"), F.col("asserted_area_ha").cast("string"), F.lit("id"), F.col("external_id").cast("string")), lambda k, v: v.isNotNull() & ~F.map_contains_key(there, k))
    return features.withColumn("properties", F.map_concat(there, more))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """point_id and label of a JSON object of labels; keys that begin with _ are remarks. An unknown label is null."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("point_id", "text"))
    return found.filter(~F.col("point_id").startswith("_")).select("point_id", t.label(F.col("text")).alias("label"))


def label_note(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$._note").alias("note"))
