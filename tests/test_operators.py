"""Operators on hand-made rows with known answers."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tilth.functions import agronomy, dates, geo, spectral, stats, text
from tilth.operators import climatology, merges, raster, sequences, spatial, units, water
from tilth.sources import readers, writers


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_fisher_known_value(spark):
    r = one(spark, p=stats.fisher_greater(*(F.lit(x).cast("long") for x in (8, 2, 1, 5))))
    assert r.p == pytest.approx(280 / 11440, abs=1e-9)


def test_log_factorial(spark):
    import math

    rows = spark.range(0, 300).select("id", stats.log_factorial(F.col("id")).alias("l")).collect()
    assert all(r.l == pytest.approx(math.lgamma(r.id + 1), abs=1e-8) for r in rows)


def test_circular_distance_wraps(spark):
    r = one(spark, d=stats.circular_distance(F.lit(3), F.lit(364)))
    assert r.d == 5


def test_normalized_difference_guards(spark):
    nd = lambda a, b: spectral.normalized_difference(F.lit(a), F.lit(b))
    r = one(spark, a=nd(0.5, 0.1), b=nd(0.1, -0.1), c=nd(0.5, -0.1), d=spectral.to_reflectance(F.lit(0)))
    assert r.a == pytest.approx(2 / 3) and r.b is None and r.c is None and r.d is None


def test_utm_and_area(spark):
    e, n = geo.utm(F.lit(-98.2), F.lit(26.2), geo.utm_zone(F.lit(-98.2)))
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))))
    r = one(spark, zone=geo.utm_zone(F.lit(-98.2)), e=e, n=n, area=geo.ring_area(ring), inside=geo.in_ring(F.lit(1.0), F.lit(1.0), ring), outside=geo.in_ring(F.lit(5.0), F.lit(1.0), ring))
    assert r.zone == 14 and r.e == pytest.approx(579_926.6, abs=50) and r.n == pytest.approx(2_898_199.0, abs=500)
    assert r.area == 12 and r.inside and not r.outside


def test_degree_units_published_example(spark):
    r = one(spark, a=agronomy.degree_units(F.lit(35.0), F.lit(20.0)), b=agronomy.degree_units(F.lit(45.0), F.lit(5.0)))
    assert r.a == pytest.approx((95 + 68) / 2 - 50) and r.b == pytest.approx(25)


def test_reference_et_is_near_the_published_example(spark):
    # FAO-56 example 18: Uccle, 6 July: 3.9 mm a day (dew point and wind converted)
    r = one(spark, e=agronomy.reference_et(*(F.lit(x) for x in (21.5, 12.3, 12.0, 2.078, 22.07, 50.8, 100.0, 187.0))))
    assert r.e == pytest.approx(3.9, abs=0.15)


def test_stored_water_is_linear_between_knots(spark):
    soil = agronomy.uniform_storage_cm(F.lit(2.0))
    r = one(spark, a=agronomy.stored_water_mm(F.lit(0.3048), soil), b=agronomy.stored_water_mm(F.lit(3.048), soil))
    assert r.a == pytest.approx(50.8) and r.b == pytest.approx(508)


def test_constant_history_stays_constant_and_wraps(spark):
    rows = spark.range(366).selectExpr("'f' as field", "cast(id + 1 as int) as doy", "cast(2000 + id % 4 as int) as year", "5.0D as value")
    out = climatology.smoothed(climatology.climatology(rows, ["field"]), ["field"]).collect()
    assert len(out) == 366 and all(r.median == 5.0 and r.n_obs == 25 for r in out)


def test_empty_days_are_filled_by_smoothing_only(spark):
    rows = spark.createDataFrame([("f", 100, 2000, 1.0), ("f", 100, 2001, 3.0)], "field string, doy int, year int, value double")
    out = {r.doy: r for r in climatology.smoothed(climatology.climatology(rows, ["field"]), ["field"]).collect()}
    assert out[100].median == 2.0 and out[100].confidence == "low"
    assert out[119].median == 2.0 and out[119].interpolated == 1 and out[119].confidence == "none"
    assert out[120].median is None and out[120].n_obs == 0


def test_trailing_runs_and_islands(spark):
    rows = spark.createDataFrame([("a", i, b) for i, b in enumerate([True, False, True, True])] + [("b", 0, False)], "k string, i int, b boolean")
    assert {r.k: r.run for r in sequences.trailing_runs(rows, ["k"], ["i"], F.col("b")).collect()} == {"a": 2, "b": 0}
    got = sorted((r.first, r.last, r.length) for r in sequences.islands(rows.where("k = 'a'"), ["k"], "i", F.col("b")).collect())
    assert got == [(0, 0, 1), (2, 3, 2)]


def test_interpolation_is_flat_beyond_ends(spark):
    rows = spark.createDataFrame([("a", date(2024, 1, 1), None), ("a", date(2024, 1, 2), 1.0), ("a", date(2024, 1, 4), 3.0), ("a", date(2024, 1, 5), None)], "k string, d date, v double")
    assert [r.v for r in sequences.interpolate(rows, ["k"], "d", "v").orderBy("d").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_covered_ranges(spark):
    rows = spark.createDataFrame([("a", 0, 5, 10), ("a", 5, 5, 10), ("b", 0, 4, 10), ("b", 5, 5, 10)], "k string, start long, length long, total long")
    assert {r.k: r.complete for r in sequences.covered_bytes(rows, ["k"]).collect()} == {"a": True, "b": False}


def test_priority_merge_and_upsert(spark):
    rows = spark.createDataFrame([("d", 1, None, 9.0), ("d", 0, None, None), ("d", 2, 3.0, 8.0)], "day string, src int, eto double, tmax double")
    r = merges.priority_merge(rows, ["day"], F.col("src"), ["eto"], ["tmax"]).first()
    assert r.eto is None and r.tmax == 9.0
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, v string, t double")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 4.0)], "k int, v string, t double")
    assert sorted(tuple(r) for r in merges.upsert(old, new, ["k"]).collect() if r.k < 3) == [(1, "a", 1.0), (2, "c", None)]
    assert {r.k: (r.v, r.t) for r in merges.upsert_keeping(old, new, ["k"], ["t"]).collect()} == {1: ("a", 1.0), 2: ("c", 2.0), 3: ("d", 4.0)}
    assert {r.k: r.v for r in merges.insert_absent(old, new, ["k"]).collect()} == {1: "a", 2: "b", 3: "d"}


def test_projection_edges(spark):
    rows = spark.createDataFrame([(10.0, 5.0, 1.0), (0.0, 10.0, 3.0), (0.0, 1000.0, 1.0), (0.0, 10.0, 0.0)], "dr double, raw double, etc double")
    assert [(r.days, r.status) for r in water.project(rows).collect()] == [(0, "water now"), (4, "water this week"), (None, "ok for now"), (None, "ok for now")]


def test_small_groups_are_not_judged(spark):
    rows = spark.createDataFrame([("b", float(i), 1.0, 1.0, 1.0) for i in range(5)] + [("b", None, 1.0, 1.0, 1.0)], "block string, size double, exg double, cover double, area double")
    assert sorted(r.flag for r in units.classify(rows, ["block"], "size", "exg", "cover", "area").collect()) == ["HEALTHY"] * 5 + ["NO_DATA"]


def test_components_and_holes(spark):
    rows = spark.createDataFrame([(0, r, c, None if (r, c) in {(1, 1), (3, 3), (3, 4)} else float(r * 5 + c)) for r in range(5) for c in range(5)], "raster int, row long, col long, v double")
    labels = raster.components(rows.where("v is null").select("raster", "row", "col")).collect()
    assert len({r.label for r in labels}) == 2
    filled = {(r.row, r.col): r for r in raster.fill_small_holes(rows, 1, 2).collect()}
    assert filled[1, 1].v == 1.0 and filled[1, 1].filled and filled[3, 3].v is None


def test_gaussian_keeps_constants(spark):
    rows = spark.createDataFrame([(0, r, c, 2.0 if (r, c) != (2, 2) else None) for r in range(6) for c in range(6)], "raster int, row long, col long, v double")
    out = raster.focal(rows, raster.gaussian(1.0)).collect()
    assert all(r.f == pytest.approx(2.0) if r.v is not None else r.f is None for r in out)


def test_robust_plane_ignores_outliers(spark):
    rows = spark.createDataFrame([("a", float(x), float(y), 1 + 2.0 * x - 3.0 * y + (100 if (x, y) == (3, 3) else 0)) for x in range(8) for y in range(8)], "k string, x double, y double, z double")
    r = spatial.robust_plane(rows, ["k"]).first()
    assert (r.a, r.b, r.c) == (pytest.approx(1), pytest.approx(2), pytest.approx(-3))


def test_greedy_pick_equals_the_scan(spark):
    import random

    random.seed(3)
    pts = [(i, random.random() * 20, random.random() * 20, float(random.randint(0, 9))) for i in range(200)]
    got = spatial.greedy_pick(spark.createDataFrame([("k", *p) for p in pts], "k string, id long, x double, y double, score double"), ["k"], 8, 4.0).collect()
    picks = []
    for p in sorted(pts, key=lambda p: (-p[3], p[0])):
        if len(picks) < 8 and all((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 >= 16 for q in picks):
            picks.append(p)
    assert sorted(r.id for r in got) == sorted(p[0] for p in picks)


def test_level_frames_recovers_offsets(spark):
    rows = [(f, c, 10, 10 * (c * 0.5 + o)) for f, o in ((0, -1.0), (1, 0.0), (2, 1.0)) for c in range(20)]
    out = {r.frame: r.o for r in raster.level_frames(spark.createDataFrame(rows, "frame int, cell int, n int, s double"), anchor=0.0).collect()}
    assert out[2] - out[0] == pytest.approx(2.0)


def test_text_readers(spark):
    r = one(
        spark, n=text.normalize(F.lit("¡Regué  MAÑANA, 2.5!")), feet=text.water_inches(F.lit("2 acre-feet"), F.lit(8.0)), phone=text.phone(F.lit("(956) 123-4567")), bad=text.phone(F.lit("12")),
        seg=text.sms_segments(F.lit("x" * 161)), uni=text.sms_segments(F.lit("ñ日" * 40)), li=text.listing(F.array(*map(F.lit, "abc"))), ago=text.relative_date(dates.tokens(F.lit("hace 2 semanas")), F.lit("2024-01-30").cast("date")),
        year=text.infer_year(F.lit(12), F.lit(25), F.lit("2024-01-30").cast("date")), dec=text.plain_decimal(F.lit(2.50)),
    )
    assert (r.n, r.feet, r.phone, r.bad) == ("regue manana, 2.5", 3.0, "+19561234567", None)
    assert (r.seg, r.uni, r.li, r.dec) == (2, 2, "a, b and c", "2.5")
    assert (r.ago, r.year) == (date(2024, 1, 16), date(2023, 12, 25))


def test_readers(spark, tmp_path):
    (tmp_path / "log.csv").write_text("field_id,date,event,inches,notes\nf1,2024-03-01,Irrigation,2.5,x\n\nf1,3/5/2024,rain,,\nf2,soon,rain,1,\n")
    rows = {(r.field_id, r.kind): r for r in readers.read_field_log(spark, str(tmp_path / "log.csv")).collect()}
    assert rows["f1", "irrigated"].inches == 2.5 and rows["f1", "rain"].day == date(2024, 3, 5) and rows["f2", "rain"].problem == "date cannot be read"
    (tmp_path / "s.csv").write_text("Date,ETo (in),Rain (mm)\n2024-01-01,0.1,2\n2024-01-01,0.2,3\n")
    r = readers.read_station(spark, str(tmp_path / "s.csv")).first()
    assert r.eto_mm == pytest.approx(5.08) and r.rain_mm == 3
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"id":"a","name":"A","crop":"corn","acres":2,"irrigation":"Rainfed"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"properties":{"id":"a","name":"B","crop":"corn"},"geometry":{"type":"Point","coordinates":[]}}]}')
    got = readers.read_fields(spark, str(tmp_path / "f.json")).collect()
    assert len(got) == 2 and {r.irrigation for r in got} == {"none", None} and all(r.problem for r in got)
    t = spark.createDataFrame([("1\n00:00:01,500 --> 00:00:02,000\n[latitude: 26.1] [longitude: -98.2] [rel_alt: 30.5]\n\n2\n00:00:02,000 --> 00:00:03,000\nGPS(-98.3,26.2,10)\n",)], "t string")
    got = readers.telemetry(t, "t").orderBy("seq").collect()
    assert (got[0].start, got[0].lat, got[0].rel_alt_m, got[1].lon) == (1.5, 26.1, 30.5, -98.3)


def test_merge_into(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    writers.merge_into(path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def square(x, y, w):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w))]


RING = "ring array<struct<x:double,y:double>>"


def test_overlaps_on_cells(spark):
    from tilth.operators import overlap

    a = spark.createDataFrame([(1, square(0, 0, 4)), (2, square(10, 10, 4))], f"a int, {RING}")
    b = spark.createDataFrame([(7, square(2, 0, 4)), (8, square(0, 0, 2))], f"b int, {RING}")
    assert sorted((r.unit, r.share) for r in overlap.assign_blocks(a, b, 1.0).collect()) == [("1@7", 0.5), ("1@8", 0.25)]
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 11.0, 11.0), (3, 50.0, 50.0)], "id int, x double, y double")
    assert {r.id: r.unit for r in overlap.label_points(points, a.withColumnRenamed("a", "unit"), 2.0).collect()} == {1: 1, 2: 2, 3: None}


def test_crowns_follow_tops_and_rows_are_found(spark):
    import math

    from tilth.operators import flight

    cells = [(0, i, j, 10 - math.hypot(i - 3, j - 3)) for i in range(7) for j in range(7)] + [(0, i, j, 10 - math.hypot(i - 3, j - 20)) for i in range(7) for j in range(17, 24)]
    out = flight.crowns(spark.createDataFrame(cells, "raster int, row long, col long, v double"), 1.0).groupBy("crown").count().collect()
    assert sorted(r["count"] for r in out) == [49, 49]
    wave = [math.sin(2 * math.pi * j * 0.1 / 0.8) for i in range(64) for j in range(64)]
    r = flight.row_geometry(spark.createDataFrame([(1, 0.1, 64, wave)], "tile long, cell_m double, n int, v array<double>"), 0.3, 3.0).first()
    assert r.spacing_m == pytest.approx(0.8) and r.across_deg == pytest.approx(0) and r.strength > 10
    points = spark.createDataFrame([("k", float(i % 10), float(i // 10) * 3) for i in range(40)], "k string, x double, y double")
    assert flight.row_direction(points, ["k"]).first().direction == 90


def test_net_learns_a_plane(spark):
    from tilth.operators import nets

    rows = spark.createDataFrame([(float(i % 7), float(i % 11), 2.0 * (i % 7) - (i % 11)) for i in range(500)], "x double, y double, t double")
    net = nets.fit(rows, ["x", "y"], "t", steps=800)
    assert nets.predict(rows, ["x", "y"], [net]).agg(F.avg(F.abs(F.col("prediction") - F.col("t")))).first()[0] < 0.1


def test_stream_equals_batch_conversation(spark):
    from tests.duck import DATA
    from tilth.plans import messages
    from tilth.streaming.messages import step

    expected = {}
    for r in spark.read.parquet(str(DATA / "sf0.001" / "events.parquet")).orderBy("event_id").collect():
        state, yes, no = expected.get(r.user_id, ("idle", 0, 0))
        state, y, n = step(state, r.event_type)
        yes += y
        expected[r.user_id] = (state, yes, no + min(n, yes - no))
    got = messages.stream_conversations(spark, str(DATA / "sf0.001")).collect()
    assert {r.user_id: (r.state, r.confirmed, r.voided) for r in got} == expected


def test_disc_sums_do_not_hang_on_the_order_of_pixels(spark):
    from tilth.operators import ground

    heights = [1e16, 1.0, 1.0, 1.0, 1.0]
    cells = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    trees = spark.createDataFrame([(1, 0, 0)], "tree long, row long, col long")
    for turn in (1, -1):
        px = [(*c, h, h) for c, h in zip(cells, heights, strict=True)][::turn]
        got = ground.disc_statistics(trees, spark.createDataFrame(px, "row long, col long, h double, green double").coalesce(1), 1, 0.5, 1.0).first()
        assert (got.volume, got.canopy_green) == (1e16 + 4, (1e16 + 4) / 5)


def test_notes_of_scenes_round_as_printf_and_keep_nulls(spark, tmp_path):
    import duckdb
    from tilth.plans import registry

    rows = [(i, n, a) for i, (n, a) in enumerate((n, a) for n in (1, 7, 13, 4000, None) for a in (500.0, 1500.0, 2500.0, 4000.0, 4000.05, -300.0, 7500.0, 8500.0, 1.5e9, None))]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    sql = registry.ORACLE_SQL["field_notes"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = registry.QUERIES["field_notes"](spark, str(tmp_path)).orderBy("s_suppkey").collect()
    assert [tuple(r) for r in got] == sorted(duckdb.sql(sql).fetchall())
