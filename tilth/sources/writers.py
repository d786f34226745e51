"""Writers: snapshots that replace a table in one step, GeoJSON and field-log exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.operators.merges import upsert
from tilth.sources.shared import materialize


def replace_table(rows: DataFrame, path: str) -> None:
    """Overwrite a Parquet table with rows that may come from it: they are written aside first."""
    materialize(rows).write.mode("overwrite").parquet(path)


def merge_into(path: str, new: DataFrame, keys: list[str]) -> None:
    """Upsert rows into a Parquet table by key."""
    spark = new.sparkSession
    replace_table(upsert(spark.read.parquet(path), new, keys), path)


def features(rows: DataFrame, prefix: str, by: str, order: str) -> DataFrame:
    """One GeoJSON feature for each row (ring of points), numbered within its crop."""
    numbered = rows.withColumn("n", F.expr(f"row_number() over (partition by {by} order by {order} desc, id)"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    properties = F.struct(F.concat(F.lit(prefix), F.lit("-"), F.col(by), F.lit("-"), F.col("n").cast("string")).alias("id"), F.col(by).alias("crop"))
    return numbered.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def confirmed_log(events: DataFrame, fields: DataFrame) -> DataFrame:
    """Standing events of exportable fields as farm-log rows."""
    ready = fields.where("outline is not null and crop is not null").select(F.col("id").alias("field_id"))
    return events.where("voided_at is null").join(ready, "field_id", "left_semi").select("field_id", F.col("day").alias("date"), F.col("kind").alias("event"), "inches", F.col("note").alias("notes"))
