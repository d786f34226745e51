"""Message readers, quantiles, relief, scenes and soils against figures worked out by hand or by numpy."""

from __future__ import annotations

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth.functions import agronomy, dates, rules, soils, stats, text
from tilth.operators import ground, scenes, spatial, water
from tilth.operators.quantiles import exact_quantiles

TODAY = date(2025, 6, 19)  # a Thursday


def read(spark, said, reach=400):
    rows = spark.createDataFrame([(s,) for s in said], "s string").withColumn("t", text.normalize(F.col("s"))).withColumn("today", F.lit(TODAY))
    rows = rows.withColumn("read", dates.tokens(F.col("t"))).withColumn("days", dates.candidates(F.col("read"), F.col("today")))
    return {r.s: r.f for r in rows.select("s", dates.find_date(F.col("days"), F.col("read"), F.col("today"), reach).alias("f")).collect()}


def test_dates(spark):
    days = {
        "Sembré el 2025-04-08": date(2025, 4, 8), "this morning": date(2025, 6, 19), "anoche llovió": date(2025, 6, 18), "the day before yesterday": date(2025, 6, 17), "hace 3 semanas": date(2025, 5, 29), "twelve days ago": date(2025, 6, 7),
        "7 de junio": date(2025, 6, 7), "Nov. 30": date(2024, 11, 30), "3 ago": date(2024, 8, 3), "July 4": date(2025, 7, 4), "jueves": date(2025, 6, 19), "el jueves pasado": date(2025, 6, 12), "on tuesday": date(2025, 6, 17), "el 20": date(2025, 5, 20), "the 3rd": date(2025, 6, 3),
        "5/27/25 at noon": date(2025, 5, 27), "27-5-2025": date(2025, 5, 27), "april 2nd, 2025": date(2025, 4, 2), "25 de dic. del 2024": date(2024, 12, 25),
    }
    got = read(spark, days)
    future = got.pop("July 4")
    assert {s: f.day for s, f in got.items()} == {s: d for s, d in days.items() if s != "July 4"}
    assert (future.problem, future.near) == ("future", date(2025, 7, 4))
    odd = read(spark, ["4/6", "6/25", "last month", "en marzo", "2023-01-31", "gracias", "2/30", "", "12/25/2024/7", "3.5/6", "el 31 de feb"])
    assert odd["4/6"].options == [date(2025, 4, 6), date(2025, 6, 4)] and odd["4/6"].day is None
    assert (odd["6/25"].problem, odd["6/25"].near) == ("future", date(2025, 6, 25))
    assert [odd[s].problem for s in ("last month", "en marzo", "2023-01-31", "gracias", "")] == ["vague", "vague", "old", None, None]
    assert all(odd[s].day is None and odd[s].problem is None for s in ("2/30", "12/25/2024/7", "3.5/6", "el 31 de feb"))


def test_days_named(spark):
    rows = spark.createDataFrame([(s,) for s in ("10/12 or 2024-02-03", "Mar 5, 6 de abril", "1.10/12 13/40", "no day")], "s string")
    got = rows.select("s", dates.days_named(dates.tokens(text.normalize(F.col("s")))).alias("d")).collect()
    assert [[tuple(x) for x in r.d] for r in got] == [[(2, 3), (10, 12)], [(3, 5), (4, 6)], [], []]


def test_answers(spark):
    rows = spark.createDataFrame([(s,) for s in ("no sé", "No, fue el 3", "sí", "that's right", "de acuerdo", "maybe", "?", None, "nel")], "s string").withColumn("t", text.normalize(F.col("s")))
    got = {r.s: r.y for r in rows.select("s", text.yes_no(F.col("s"), F.col("t")).alias("y")).collect()}
    assert got == {"no sé": None, "No, fue el 3": False, "sí": True, "that's right": True, "de acuerdo": True, "maybe": None, "?": None, None: None, "nel": False}


def test_guards_of_reference_et(spark):
    day = dict(tmax=30.0, tmin=20.0, dew=15.0, wind=2.0, solar=20.0, lat=26.0, elevation=30.0, doy=180)

    def eto(**change):
        args = {k: F.lit(v).cast("double") if v is not None else F.lit(None).cast("double") for k, v in (day | change).items()}
        return spark.range(1).select(agronomy.reference_et(*(args[k] for k in day)).alias("e")).first().e

    assert eto(wind=0.1) == eto(wind=0.5) and eto(solar=-3.0) == eto(solar=0.0) and eto(dew=40.0) == eto(dew=60.0)
    assert eto(lat=80.0, doy=1) is None and eto(wind=None) is None and eto() == pytest.approx(4.5, abs=1.0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 70_000])
def test_exact_quantiles(spark, n):
    rnd = np.random.default_rng(n)
    values = np.round(rnd.lognormal(size=n), 3)
    rows = spark.createDataFrame([(1, float(v)) for v in values] + [(2, 5.0), (2, None), (2, float("nan"))], "k int, v double")
    got = {r.k: r.q for r in exact_quantiles(rows, ["k"], "v", [0.02, 0.25, 0.5, 0.9]).collect()}
    assert got[1] == pytest.approx(np.quantile(values, [0.02, 0.25, 0.5, 0.9]).tolist()) and got[2] == [5.0] * 4


def test_spots_equal_a_plain_labelling(spark):
    rnd = random.Random(4)
    cells = {(r, c): rnd.choice([-9.0, 0.0, 9.0]) for r in range(12) for c in range(12)}
    seen, expected = set(), []
    for start in cells:
        if start in seen or abs(cells[start]) < 4:
            continue
        todo, patch = [start], set()
        while todo:
            p = todo.pop()
            if p in patch or cells.get(p) != cells[start]:
                continue
            patch.add(p)
            todo += [(p[0] + a, p[1] + b) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]
        seen |= patch
        if len(patch) >= 3:
            expected.append(("H" if cells[start] > 0 else "L", float(len(patch)), cells[start]))
    rows = spark.createDataFrame([("f", r, c, v) for (r, c), v in cells.items()], "raster string, row long, col long, v double")
    got = ground.find_spots(rows, 1.0, 4.0, 3.0, 0.0).collect()
    assert sorted((r.kind, r.area_m2, r.peak_cm) for r in got) == sorted(expected)
    assert {r.spot for r in got if r.kind == "H"} == {f"H{i + 1}" for i in range(sum(e[0] == "H" for e in expected))}


def test_curvature_of_a_dome(spark):
    rows = spark.createDataFrame([("a", x / 10, y / 10, 1 - (x / 10) ** 2 - 0.5 * (y / 10) ** 2 + 0.2 * x / 10) for x in range(-10, 11) for y in range(-10, 11)], "k string, x double, y double, z double")
    got = ground.curvature(rows, ["k"], spatial.plane_sums(rows, ["k"]).drop("n")).first()
    z = np.array([-((x / 10) ** 2) - 0.5 * (y / 10) ** 2 for x in range(-10, 11) for y in range(-10, 11)]) * 100
    assert got.kind == "dome" and got.depth_cm == pytest.approx(np.percentile(z, 98) - np.percentile(z, 2), abs=1.0)


def test_planting_grid(spark):
    turn = np.radians(20)
    points = [(i * 10 + j, 4.0 * i * np.cos(turn) - 6.0 * j * np.sin(turn), 4.0 * i * np.sin(turn) + 6.0 * j * np.cos(turn)) for i in range(8) for j in range(8)]
    rows = spark.createDataFrame([("k", i, float(x), float(y)) for i, x, y in points], "k string, id long, x double, y double")
    near = spatial.nearest(rows, ["k"], 4, 7.0)
    at = lambda i, x, y: rows.select(F.col("id").alias(i), F.col("x").alias(x), F.col("y").alias(y))
    pairs = near.join(at("id", "x1", "y1"), "id").join(at("other", "x2", "y2"), "other").select("k", (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    got = ground.planting_grid(pairs, ["k"]).first()
    assert (got.angle, got.spacing_a, got.spacing_b) == pytest.approx((20.0, 4.0, 6.0), abs=1e-6)


def test_scenes_to_read(spark):
    rows = [
        (1, "a", True, 5.0, 1.0, [1, 2, 3]), (1, "b", True, 2.0, 9.0, [1, 2, 3]), (1, "c", False, 0.0, 0.0, [1, 2, 3]), (2, "d", True, 1.0, 1.0, [1, 2]), (2, "e", True, 1.0, 1.0, [2, 3]), (2, "f", True, 1.0, 1.0, [2]),
        (3, "g", False, None, None, [1]), (4, "h", True, 1.0, 1.0, []), (4, "i", True, 1.0, 1.0, []),
    ]
    df = spark.createDataFrame([("x", *r, 3) for r in rows], "field string, day int, scene string, readable boolean, nodata double, cloud double, cells array<bigint>, n_cells int")
    got = {r.day: (r.primary, r.others) for r in scenes.reading_order(df).collect()}
    assert got == {1: (["b"], ["a"]), 2: (["d", "e"], []), 3: (["g"], []), 4: (["h", "i"], [])}


def test_soil_layers(spark):
    layers = F.array(*(F.struct(F.lit(b).alias("bottom_cm"), F.lit(f).alias("fraction"), F.lit(s).alias("stones_pct")) for b, f, s in ((30.0, 0.2, 50.0), (60.0, 0.1, 0.0))))
    assert spark.range(1).select(soils.profile_cm(layers, (0.25, 0.5, 1.0)).alias("p")).first().p == pytest.approx([2.5, 5.0, 10.0])
    water_of = lambda s, c, o: spark.range(1).select(soils.available_water_fraction(F.lit(s), F.lit(c), F.lit(o)).alias("w")).first().w
    assert water_of(40.0, 20.0, 2.5) == pytest.approx(0.145, abs=0.01) and water_of(90.0, 5.0, 1.0) < 0.08


def test_weather_is_filled_at_the_end_only(spark):
    day = lambda d: date(2026, 9, d)
    rows = [("a", day(d), 5.0 if d < 8 else 7.0, None) for d in range(1, 11)] + [("b", day(d), 4.0, 1.0) for d in (1, 2, 4)] + [("c", day(d), 3.0, 1.0) for d in range(3, 6)]
    weather = spark.createDataFrame(rows, "field string, date date, eto double, rain double")
    spans = spark.createDataFrame([("a", day(1), day(12)), ("b", day(1), day(5)), ("c", day(1), day(6)), ("d", day(1), day(2))], "field string, start date, as_of date")
    got = water.complete_weather(weather, spans).collect()
    assert {r.field: r.problem for r in got} == {"a": None, "b": "missing days", "c": "starts late", "d": "no weather"}
    last = {r.date.day: (round(r.eto, 6), r.rain, r.filled) for r in got if r.field == "a" and r.date.day > 9}
    assert last == {10: (7.0, 0.0, False), 11: (round((4 * 5 + 3 * 7) / 7, 6), 0.0, True), 12: (round((4 * 5 + 3 * 7) / 7, 6), 0.0, True)}


def test_run_logs(spark):
    log = "Running opensfm stage\n\x1b[31mRunning odm_dem stage\nnot enough overlap"
    got = spark.range(1).select(rules.last_stage(F.lit(log)).alias("s"), rules.diagnosis(F.lit(log), F.lit(1)).alias("d"), rules.diagnosis(F.lit("x"), F.lit(137)).alias("k")).first()
    assert tuple(got) == ("odm_dem", "overlap", "memory")


def test_tokens_are_read_once(spark):
    """a text is cut into tokens once for all patterns, and empty finds are not cast."""
    texts = [("hace 2 semanas",), ("watered 3/4/2024, thanks",), ("el 30 de febrero",), ("",), (None,), ("99999999999 ok once",)]
    rows = spark.createDataFrame(texts, "text string").withColumn("t", text.normalize(F.col("text"))).withColumn("read", dates.tokens(F.col("t")))
    said = rows.select("read", dates.candidates(F.col("read"), F.lit("2024-03-10").cast("date")).alias("days"))
    assert said._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = said.select("read.shape", "read.values", F.col("days").cast("array<string>").alias("days")).collect()
    assert [r.shape for r in got] == ["hdS", "zd/d/y,z", "ldeM", "", "", "zzn"]
    assert [r["values"] for r in got] == [[None, 2, None], [None, 3, None, 4, None, 2024, None, None], [None, 30, None, 2], [], [], [None, None, 11]]
    assert [r.days for r in got] == [["2024-02-25"], ["2024-03-04", "2024-04-03"], [], None, None, None]
    found = spark.createDataFrame([("",), ("2.5",), (None,)], "x string").select(stats.number(F.col("x"), "double").alias("n")).collect()
    assert [r.n for r in found] == [None, 2.5, None]
