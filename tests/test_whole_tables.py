"""Queries that once read a part of their rows read every row: their SQL has no choice by id, and each row shows in what they give."""

import pytest
from pyspark.sql import functions as F

from tests.duck import DATA, check
from tilth.plans import registry

SF = "sf0.001"
PARTS = ["interval_join", "row_gaps", "box_pairs", "grid_neighbours", "lattice_anti", "thin_stretches", "bilinear"]


@pytest.mark.parametrize("part", PARTS)
def test_rows_equal_sql_of_all_rows(spark, part):
    sql = registry.ORACLE_SQL[part]
    for chosen in ("event_id %", "p_partkey % 3 = 0", "p_partkey % 5 = 0", "l_orderkey %", "id % 7", "doy % 60", "raster ="):
        assert chosen not in sql
    df = registry.QUERIES[part](spark, str(DATA / SF))
    assert df.count() > 0
    check(df, sql, SF)


def test_each_event_is_a_point_or_a_span(spark):
    events = spark.read.parquet(str(DATA / SF / "events.parquet"))
    points = registry.QUERIES["interval_join"](spark, str(DATA / SF))
    assert points.select("point").distinct().count() == events.where(F.col("event_type") != "purchase").count()
