"""File sources and sinks."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.labels import classify_facility
from emberline.operators.features import first_seen
from emberline.operators.quality import REQUIRED, clean_detections, without_infinities

DETECTION_FIELDS = ("latitude", "longitude", "brightness", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence", "version", "bright_t31", "frp", "daynight")


def _sensor(file_name: Column, sensors: dict[str, tuple[str, bool]]) -> Column:
    """The source of the first sensor whose part is in the file's name, null for disabled and unknown ones."""
    name, source = F.upper(file_name), None
    for part, (label, enabled) in sensors.items():
        value = F.lit(label if enabled else None).cast("string")
        source = F.when(F.contains(name, F.lit(part.upper())), value) if source is None else source.when(F.contains(name, F.lit(part.upper())), value)
    return F.lit(None).cast("string") if source is None else source


def _files_by_header(spark: SparkSession, paths: list[str], sensors: dict[str, tuple[str, bool]]) -> list[tuple[list[str], bool, list[str]]]:
    """(columns, whether quoted cells go over lines, files) of the wanted files, those with the same header together.

    One pass over the lines; what comes back is a row for each header, with the names of its files, which the scan lists anyway.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(paths)
    lines = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at")).filter(_sensor(F.col("_metadata.file_name"), sensors).isNotNull())
    head = F.contains("value", F.lit("latitude")) & F.contains("value", F.lit("longitude"))
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    files = lines.groupBy("path").agg(F.min_by(F.when(head, F.col("value")), F.when(head, F.col("at"))).alias("header"), F.coalesce(F.bool_or(odd), F.lit(False)).alias("long"))
    groups = files.filter("header is not null").groupBy("header", "long").agg(F.collect_list("path").alias("paths"))
    found = []
    for r in groups.collect():
        columns = [c.strip().removeprefix("\ufeff") for c in next(csv.reader([r["header"]]))]
        if all(c in columns for c in REQUIRED):
            found.append((columns, r["long"], sorted(r["paths"])))
    return found


def _parsed(spark: SparkSession, columns: list[str], long: bool, paths: list[str], sensors: dict[str, tuple[str, bool]]) -> DataFrame:
    """All cells of files with one header as text by place, the line as ``_rejected`` where it has too few or too many, and the source."""
    schema = ", ".join(f"_c{i} string" for i in range(len(columns))) + ", _rejected string"
    reader = spark.read.schema(schema).option("columnPruning", False).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rejected")
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", long).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return reader.csv(paths).withColumn("satellite_source", _sensor(F.col("_metadata.file_name"), sensors)).withColumn("_file", F.col("_metadata.file_name"))


def scan_detections(spark: SparkSession, paths: list[str], sensors: dict[str, tuple[str, bool]], fields: tuple[str, ...] = DETECTION_FIELDS) -> DataFrame:
    """Detection CSVs under ``paths``, folders searched in depth, all columns as text; satellite_source by file name.

    ``sensors``: part of the file name to (source, enabled), first match in order; files of disabled or unknown sensors are skipped.  Files with the same header
    are one scan, in which quoted cells may hold commas, quotes and line ends; files without a required column give no row.  Large files are split over tasks, but
    for those with a line end in a cell.  Rows with too few or too many cells are left to ``rejected_rows``.  Empty cells are null, fields that a file lacks too.
    """
    parts = []
    for columns, long, files in _files_by_header(spark, paths, sensors):
        rows = _parsed(spark, columns, long, files, sensors).filter(F.col("_rejected").isNull())
        place = {c: i for i, c in reversed([*enumerate(columns)])}  # the first of equal names
        cell = lambda c, place=place: F.nullif(F.trim(F.col(f"_c{place[c]}")), F.lit("")) if c in place else F.lit(None).cast("string")
        rows = rows.filter(~F.coalesce(F.col(f"_c{place['latitude']}") == "latitude", F.lit(False)))  # a header that is repeated within a file
        parts.append(rows.select(*(cell(c).alias(c) for c in fields), "satellite_source"))
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in (*fields, "satellite_source")))
    return reduce(DataFrame.unionByName, parts, none)


def rejected_rows(spark: SparkSession, paths: list[str], sensors: dict[str, tuple[str, bool]]) -> DataFrame:
    """(file_name, first_cell, record) of the rows that ``scan_detections`` leaves out as their cells don't fit the header."""
    none = spark.createDataFrame([], "file_name string, first_cell string, record string")
    parts = [_parsed(spark, *group, sensors).select(F.col("_file").alias("file_name"), F.col("_c0").alias("first_cell"), F.col("_rejected").alias("record")).filter("record is not null") for group in _files_by_header(spark, paths, sensors)]
    return reduce(DataFrame.unionByName, parts, none)


def typed_detections(raw: DataFrame) -> DataFrame:
    """P1-P4, P8 over scanned text: typed, cleaned and distinct detections."""
    return clean_detections(raw.withColumns({"acq_date": F.try_to_date("acq_date", "yyyy-MM-dd"), "acq_time": F.col("acq_time").try_cast("int")}))


def write_clean(df: DataFrame, path: str) -> None:
    """The clean table by date."""
    df.write.mode("overwrite").partitionBy("acq_date").parquet(path)


def boundary_edges(spark: SparkSession, path: str, region: str, names: tuple[str, ...] = ("NAME_1", "ST_NM", "state", "name")) -> DataFrame:
    """Edges (poly_id, ring, x1, y1, x2, y2) of the region's polygons in a GeoJSON file; the name is compared without regard to case, the first present property counts."""
    properties = ", ".join(f"{n}: string" for n in names)
    feature = f"struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"features array<{feature}>")["features"]).alias("f"))
    rows = rows.filter(F.lower(F.coalesce(*(F.col(f"f.properties.{n}") for n in names))) == region.lower())
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    one = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    polygons = rows.select(F.posexplode(F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one)).alias("poly_id", "rings"))
    rings = polygons.select("poly_id", F.posexplode("rings").alias("ring", "points"))
    points = rings.select("poly_id", "ring", "points", F.explode(F.sequence(F.lit(0), F.size("points") - 2)).alias("i"))
    at = lambda k, j: F.col("points")[F.col("i") + k][j]
    return points.select("poly_id", "ring", at(0, 0).alias("x1"), at(0, 1).alias("y1"), at(1, 0).alias("x2"), at(1, 1).alias("y2"))


def facilities(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Facilities from element files; nodes lie at lat and lon, ways and relations at their center, elements without coordinates are dropped, the first of each (type, id) stays."""
    kind = "elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
    rows = spark.read.schema(kind).json(paths, multiLine=True).withColumn("source_tile", F.input_file_name()).select("source_tile", F.explode("elements").alias("e"))
    at = lambda n: F.when(F.col("e.type") == "node", F.col(f"e.{n}")).otherwise(F.col(f"e.center.{n}"))
    rows = rows.select("source_tile", F.col("e.type").alias("osm_type"), F.col("e.id").alias("osm_id"), at("lat").alias("latitude"), at("lon").alias("longitude"), F.col("e.tags").alias("tags"))
    tag = lambda n: F.element_at("tags", n)
    rows = rows.filter("latitude is not null and longitude is not null").withColumns({"name": tag("name"), "operator": tag("operator"), "_c": classify_facility(tag("power"), tag("industrial"), tag("man_made"), tag("landuse"), tag("building"), tag("name"))})
    return first_seen(rows.select("*", "_c.*").drop("_c"), ("osm_type", "osm_id"), ("source_tile",))


def write_facilities(df: DataFrame, path: str) -> None:
    """CSV with the tags as JSON text."""
    df.withColumn("raw_tags", F.to_json("tags")).drop("tags").write.mode("overwrite").csv(path, header=True)


def read_tags(df: DataFrame, column: str = "raw_tags") -> DataFrame:
    """The tags back as a map."""
    return df.withColumn("tags", F.from_json(column, "map<string,string>"))


def write_classified(df: DataFrame, path: str) -> None:
    """CSV, infinities and NaN as null."""
    without_infinities(df).write.mode("overwrite").csv(path, header=True)


def geojson_lines(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One GeoJSON point feature per row as text in ``value``."""
    clean = without_infinities(df)
    rest = [c for c in clean.columns if c not in (lat, lon)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return clean.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def write_geojson(df: DataFrame, path: str) -> None:
    """S13."""
    geojson_lines(df).write.mode("overwrite").text(path)


def write_review_sheets(extremes: DataFrame, path: str, label: str = "predicted_class") -> None:
    """One folder of CSV per class."""
    extremes.write.mode("overwrite").partitionBy(label).csv(path, header=True)


def read_dashboard(spark: SparkSession, path: str) -> DataFrame:
    """Everything as text; ``parse_dashboard`` types it."""
    return spark.read.csv(path, header=True, inferSchema=False)
