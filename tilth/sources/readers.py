"""Readers of field outlines, farm logs, weather files, telemetry and flight lists, in DataFrame operations.

Each reader takes a path (or text column) and gives typed rows; bad rows are kept beside the good ones
with the reason, so that a caller can refuse a file by name of the offending row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions.soils import given_inches_per_foot

#: Synonyms of irrigation methods and of the sides water enters by (fixed values).
IRRIGATION = {"furrow": "furrow", "flood": "flood", "border": "border", "basin": "basin", "drip": "drip", "sprinkler": "sprinkler", "pivot": "pivot", "none": "none", "rainfed": "none", "dryland": "none", "center pivot": "pivot", "centre pivot": "pivot", "surface": "furrow", "gravity": "furrow", "micro": "drip", "microsprinkler": "sprinkler"}
SIDES = {"n": "N", "north": "N", "s": "S", "south": "S", "e": "E", "east": "E", "w": "W", "west": "W"}
#: Kinds of farm-log rows and their synonyms (fixed values).
LOG_KINDS = {"planted": "planted", "planting": "planted", "irrigated": "irrigated", "irrigation": "irrigated", "rain": "rain", "rainfall": "rain", "harvested": "harvested", "harvest": "harvested"}
LOG_DATES = ("yyyy-MM-dd", "M/d/yyyy", "d-MMM-yyyy")
POINT = "struct<x:double,y:double>"


def pick(table: dict[str, str], text: Column) -> Column:
    """Value of a synonym table for trimmed, lower-cased text."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.lower(F.trim(text))]


def _unknown(table: dict[str, str], text: Column) -> Column:
    """Whether a text is given that the table lacks."""
    return F.coalesce((F.trim(text) != "") & pick(table, text).isNull(), F.lit(False))


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """Fields of a GeoJSON collection: id, name, crop, acres, irrigation, water_enters, soil_awc_in_ft, ring, problem."""
    schema = "features array<struct<properties:struct<id:string,name:string,crop:string,acres:double,irrigation:string,water_enters:string,soil_awc_in_ft:string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rows = rows.select("f.properties.*", F.col("f.geometry.type").alias("kind"), ring.alias("ring"))
    soil, soil_problem = given_inches_per_foot(F.col("soil_awc_in_ft"))
    problem = (
        F.when(F.col("id").isNull() | F.col("name").isNull() | F.col("crop").isNull(), "id, name or crop is missing")
        .when(F.col("kind") != "Polygon", "not a polygon")
        .when(F.size("ring") < 4, "fewer than four corners")
        .when(F.exists("ring", lambda p: (F.abs(p["x"]) > 180) | (F.abs(p["y"]) > 90)), "outside longitude and latitude")
        .when(F.col("acres") <= 0, "acres must be above 0")
        .when(_unknown(IRRIGATION, F.col("irrigation")), "irrigation is no known method")
        .when(_unknown(SIDES, F.col("water_enters")), "water_enters is no side")
        .when(soil_problem.isNotNull(), F.concat(F.lit("soil_awc_in_ft: "), soil_problem))
    )
    twice = rows.groupBy("id").agg(F.count("*").alias("times"))
    rows = rows.join(twice, "id", "left").withColumn("problem", F.coalesce(problem, F.when(F.col("times") > 1, "id occurs twice")))
    return rows.select("id", "name", "crop", "acres", pick(IRRIGATION, F.col("irrigation")).alias("irrigation"), pick(SIDES, F.col("water_enters")).alias("water_enters"), soil.alias("soil_awc_in_ft"), "ring", "problem")


def read_field_log(spark: SparkSession, path: str) -> DataFrame:
    """Farm log rows: field_id, day, kind, inches, notes, problem; blank lines are left out."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    day = F.coalesce(*(F.try_to_date(F.trim(F.col("date")), f) for f in LOG_DATES))
    inches = F.trim(F.col("inches")).try_cast("double")
    out = rows.where(F.coalesce(F.trim("field_id"), F.lit("")) != "").select(F.trim("field_id").alias("field_id"), day.alias("day"), pick(LOG_KINDS, F.col("event")).alias("kind"), inches.alias("inches"), "notes")
    return out.withColumn("problem", F.when(F.col("day").isNull(), "date cannot be read").when(F.col("kind").isNull(), "unknown event").when(F.col("inches") < 0, "inches below 0"))


def read_station(spark: SparkSession, path: str) -> DataFrame:
    """Station CSV to date, eto_mm, rain_mm: columns and units are found by the header, the last row of a date wins."""
    frame = spark.read.option("header", True).csv(path)
    names = {c: c.lower() for c in frame.columns}

    def column(tokens: tuple[str, ...]) -> Column:
        for c, low in names.items():
            if any(t in low for t in tokens):
                if "mm" not in low and "in" not in low.replace("rain", "").split("_") and "(in)" not in low:
                    raise ValueError(f"column {c} names no unit")
                return F.col(f"`{c}`").try_cast("double") * (1.0 if "mm" in low else 25.4)
        raise ValueError(f"no column of {tokens}")

    date = next(c for c, low in names.items() if low.strip() in ("date", "day", "fecha"))
    rows = frame.select(F.coalesce(F.try_to_date(F.col(f"`{date}`"), "yyyy-MM-dd"), F.try_to_date(F.col(f"`{date}`"), "M/d/yyyy")).alias("date"), column(("eto", "et0", "ref_et", "pet")).alias("eto_mm"), column(("rain", "precip", "lluvia")).alias("rain_mm"), F.monotonically_increasing_id().alias("pos"))
    rows = rows.where(F.col("date").isNotNull() & (F.coalesce("eto_mm", F.lit(0.0)) <= 20))
    return rows.groupBy("date").agg(F.max_by(F.struct("eto_mm", "rain_mm"), "pos").alias("r")).select("date", "r.*")


def power_days(texts: DataFrame, column: str) -> DataFrame:
    """Point weather JSON (parameter -> day -> value) to one row for each parameter and day; -999 is missing."""
    parsed = F.from_json(column, "properties struct<parameter:map<string,map<string,double>>>")
    rows = texts.select(F.explode(parsed["properties"]["parameter"]).alias("parameter", "days")).select("parameter", F.explode("days").alias("day", "value"))
    return rows.select("parameter", F.try_to_date("day", F.lit("yyyyMMdd")).alias("date"), F.when(F.col("value") > -999, F.col("value")).alias("value"))


def soil_layers(texts: DataFrame, column: str, divisors: dict[str, float]) -> DataFrame:
    """Layered soil JSON to property, depth label and mean in plain units."""
    parsed = F.from_json(column, "properties struct<layers:array<struct<name:string,depths:array<struct<label:string,values:struct<mean:double>>>>>>")
    rows = texts.select(F.explode(parsed["properties"]["layers"]).alias("l")).select(F.col("l.name").alias("name"), F.explode("l.depths").alias("d"))
    divisor = F.create_map(*(F.lit(x) for kv in divisors.items() for x in kv))
    return rows.select("name", F.col("d.label").alias("depth"), (F.col("d.values.mean") / divisor[F.col("name")]).alias("value")).where("value is not null")


def telemetry(texts: DataFrame, column: str) -> DataFrame:
    """Subtitle telemetry blocks: seq, start and end in seconds, latitude, longitude, relative altitude."""
    block = texts.select(F.posexplode(F.split(column, r"\n\s*\n")).alias("seq", "block")).where(F.trim("block") != "")
    time = lambda n: sum((F.regexp_extract("block", r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)", n + i).try_cast("double") * m for i, m in enumerate((3600.0, 60.0, 1.0, 0.001))), F.lit(0.0))
    value = lambda key: F.regexp_extract("block", rf"{key}\s*:\s*([-\d.]+)", 1).try_cast("double")
    gps = r"GPS\s*\(\s*([-\d.]+)\s*,\s*([-\d.]+)"
    lon, lat = F.regexp_extract("block", gps, 1).try_cast("double"), F.regexp_extract("block", gps, 2).try_cast("double")
    return block.select("seq", time(1).alias("start"), time(5).alias("end"), F.coalesce(value("latitude"), lat).alias("lat"), F.coalesce(value("longitude"), lon).alias("lon"), value("rel_alt").alias("rel_alt_m")).where("start is not null")


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    """Flight list JSON (id -> flight) to one row for each flight."""
    schema = "flights map<string,struct<field_id:string,flown_on:date,crop:string,notes:string,ground_elevation_m:double,source:string,row_spacing_m:double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("flights").alias("flight_id", "f")).select("flight_id", "f.*")
