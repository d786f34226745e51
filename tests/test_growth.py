"""What large tables broke: sides that go through the driver, and pairs that are written out."""

import math
import random
import statistics

import pytest

from tilth.operators import climatology, distances, flight, overlap, raster, rows, sequences, spatial
from tilth.plans import field
from tilth.sources.shared import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """Plans of all frames that the operators write between steps."""
    seen = []
    for module in (spatial, raster, distances, rows):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, keep=keep: (seen.append(plan(df)), keep(df))[1])
    return seen


def test_neighbours_are_not_broadcast(spark):
    points = spark.createDataFrame([("a", i, float(i % 7), float(i % 5)) for i in range(200)], "k string, id long, x double, y double")
    assert "Broadcast" not in plan(spatial.nearest_within(materialize(points), ["k"], 3, 2.0))  # files, whose size is known


def test_copies_of_a_place_are_neighbours_in_order_of_id(spark):
    points = [(i, float(i % 4), float(i % 3)) for i in range(60)]
    got = spatial.nearest_within(spark.createDataFrame([("a", *p) for p in points], "k string, id long, x double, y double"), ["k"], 6, 1.0).collect()
    want = {}
    for i, x, y in points:
        near = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, o) for o, a, b in points if o != i)
        want |= {(i, r + 1): (o, d) for r, (d, o) in enumerate([n for n in near if n[0] <= 1.0][:6])}
    assert {(r.id, r.rank): (r.other, r.d) for r in got} == want and len(got) == len(want)


def test_neighbours_at_any_distance_are_not_broadcast(spark, plans):
    points = spark.createDataFrame([("a", i, float(i % 7), float(i % 5) * i) for i in range(200)], "k string, id long, x double, y double")
    assert "Broadcast" not in plan(spatial.nearest(points, ["k"], 3, 2.0))
    assert len(plans) > 2 and not any("Broadcast" in p and "gx" in p for p in plans)


def test_planting_grids_do_not_broadcast_points(spark, monkeypatch):
    from tilth.operators import ground
    from tilth.plans import registry

    seen = []
    monkeypatch.setattr(ground, "planting_grid", lambda df, keys: seen.append(plan(df)) or df)
    registry.QUERIES["planting_grids"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in seen[0]


def test_picks_are_not_broadcast_and_stand_for_their_copies(spark, plans):
    points = spark.createDataFrame([("a", i, float(i % 7), float(i % 5), float(i % 11)) for i in range(400)] + [("a", 400, float("nan"), 0.0, 1.0)], "k string, id long, x double, y double, score double")
    got = spatial.greedy_pick(points, ["k"], 50, 3.0).collect()
    assert 400 in {r.id for r in got} and not any("Broadcast" in p for p in plans)


def test_equal_boxes_are_compared_once(spark):
    boxes = [(i, float(i % 3), 0.0, float(i % 3) + 2.0, 9.0) for i in range(30)] + [(30, 50.0, 50.0, 51.0, 51.0), (31, None, 0.0, 1.0, 1.0)]
    df = overlap.box_pairs(spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double"), 4.0, 0.3)
    assert "HashAggregate" not in plan(df)  # pairs are not made distinct: none is met twice
    wide = lambda a, b: min(a[3], b[3]) - max(a[1], b[1])
    want = sorted((a[0], b[0], wide(a, b) * 9.0 / 18.0) for a in boxes[:30] for b in boxes[:30] if a[0] < b[0] and wide(a, b) * 9.0 / 18.0 >= 0.3)
    assert sorted(map(tuple, df.collect())) == want


def test_pairs_of_ids_are_not_shuffled(spark, monkeypatch):
    rnd = random.Random(3)
    corner = lambda: (x := rnd.randrange(-5, 12), y := rnd.randrange(-5, 12), x + rnd.randrange(-1, 7), y + rnd.randrange(-1, 7))
    shapes = [tuple(map(float, corner())) for _ in range(40)]
    boxes = [(i, *rnd.choice(shapes)) for i in range(150)] + [(200 + i, 0.0, 0.0, 4.0, 4.0) for i in range(50)] + [(500, 0.0, 0.0, None, 4.0), (None, 0.0, 0.0, 4.0, 4.0)]
    boxes += boxes[:9] + [(7, 0.0, 0.0, 4.0, 4.0)]  # rows that stand twice count twice, as in SQL, and an id with two boxes is no pair
    monkeypatch.setattr(overlap, "LISTED", 3, raising=False)
    monkeypatch.setattr(overlap, "MET", 500, raising=False)
    df = overlap.box_pairs(spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double"), 4.0, 0.3)
    assert plan(df).count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan(df)
    want = []
    for a in boxes:
        for b in boxes:
            if None not in a + b and a[0] < b[0]:
                w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
                if w > 0 and h > 0 and (share := w * h / min((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2]))) >= 0.3:
                    want.append((a[0], b[0], share))
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_running_median_writes_no_pairs(spark):
    rnd = random.Random(5)
    rows_ = [("a", i, rnd.randrange(-3000, 30000), rnd.choice([rnd.random(), None, 0.5])) for i in range(400)] + [("b", 0, 7, None), ("b", 1, 10**6, float("nan")), (None, 2, 7, 1.0), ("b", 3, None, 1.0)]
    df = sequences.running_median(spark.createDataFrame(rows_, "k string, id long, s long, v double"), ["k"], "s", "v", 100)
    assert "Join" not in plan(df)
    got = {(r.k, r.id): (r.median, r.n) for r in df.collect()}
    assert got.pop(("b", 0)) == (None, 1) and math.isnan(got.pop(("b", 1))[0])
    for k, i, s, _ in rows_[:400]:
        near = [r[3] for r in rows_[:400] if abs(r[2] - s) <= 100]
        known = [v for v in near if v is not None]
        assert got.pop((k, i)) == (pytest.approx(statistics.median(known)) if known else None, len(near))
    assert not got


def test_days_of_keys_are_not_broadcast(spark):
    seen = spark.createDataFrame([(i % 9, 1 + i * 7 % 366, 1995 + i % 4, float(i)) for i in range(100)], "field long, doy int, year int, value double")
    assert "Broadcast" not in plan(climatology.climatology(materialize(seen), ["field"]))


def test_places_are_not_broadcast_to_places(spark, plans):
    pixels = spark.createDataFrame([(0, r, c, float((r + c) % 5)) for r in range(20) for c in range(20)], "raster long, row long, col long, v double")
    geometry = spark.createDataFrame([(0, 0.0)], "raster long, direction_deg double")
    df = rows.repeat_spacing(pixels, geometry, 0.2)
    assert not any("BroadcastHashJoin" in p and "bin" in p.split("BroadcastHashJoin")[1].split("]")[0] for p in [*plans[1:], plan(df)])


def test_cells_are_not_broadcast_to_cells(spark, plans):
    classes = spark.createDataFrame([(0, r, c, 1) for r in range(20) for c in range(20)], "raster long, row long, col long, v int")
    distances.traced_fields(classes, [1], 30.0, inset_m=30.0, neck_m=30.0)
    assert len(plans) > 6 and not any("BroadcastHashJoin" in p and "col" in p.split("BroadcastHashJoin")[1].split("]")[0] for p in plans)
    raster.components(classes.select("raster", "row", "col"))
    assert not any("BroadcastHashJoin" in p and "cell" in p.split("BroadcastHashJoin")[1].split("]")[0] for p in plans)


def test_labels_and_not_cells_meet_over_the_edges_of_tiles(spark, monkeypatch):
    rnd = random.Random(8)
    cells = {("a", r, c) for r in range(-7, 30) for c in range(41) if rnd.random() < 0.62} | {("b", r, c) for r in range(20) for c in range(20) if (r % 4 == 0 or c == (19 if r // 4 % 2 == 0 else 0)) and r < 17}
    written = []
    keep = raster.materialize
    monkeypatch.setattr(raster, "materialize", lambda df: (written.append(keep(df)), written[-1])[1])
    rows_ = [*sorted(cells), ("a", None, 1), (None, 1, 1)]
    df = raster.components(spark.createDataFrame(rows_, "raster string, row int, col int"), tile=5)
    got = {(x.raster, x.row, x.col): x.label for x in df.collect()}
    assert df.dtypes == [("raster", "string"), ("row", "int"), ("col", "int"), ("label", "bigint")] and got.keys() == cells
    key = lambda p: p[1] * (1 << 31) + p[2]
    left, want = set(cells), {}
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            part.add(p := todo.pop())
            near = {(p[0], p[1] + a, p[2] + b) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))} & left
            left -= near
            todo += near
        want |= dict.fromkeys(part, min(map(key, part)))
    assert got == want and len(set(want.values())) > 5
    assert written[0].count() == len(cells) and all(df.count() < len(cells) for df in written[1:])
    once = raster.components(spark.createDataFrame(rows_, "raster string, row int, col int").withColumn("name", raster.F.col("row") * 7), ("name",), tile=64).collect()
    assert {(x.raster, x.row, x.col): x.label for x in once} == want and all(x.name == 7 * x.row for x in once)


@pytest.fixture
def no_small_sides(spark):
    """As with tables too large to be broadcast unasked."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_a_large_group_are_not_one_task_for_its_quantiles(spark, no_small_sides):
    from tilth.plans import registry

    assert "SortMergeJoin" not in plan(registry.QUERIES["robust_z_group"](spark, "/root/testdata/sf0.001"))


def test_figures_reach_rows_of_few_and_of_many_groups_alike(spark):
    from tilth.operators.quantiles import beside

    values = spark.createDataFrame([(i % 5, float(i)) for i in range(300)] + [(None, 1.0), (9, 2.0)], "k long, v double")
    figures = values.where("k < 9").groupBy("k").agg({"v": "max"}).withColumnRenamed("max(v)", "top")
    few, many, want = (sorted(map(tuple, df.collect())) for df in (beside(values, figures, ["k"]), beside(values, figures, ["k"], few=0), values.join(figures, "k")))
    assert few == many == want and len(want) == 300


def test_places_are_not_broadcast_for_the_sizes_of_their_keys(spark, plans):
    points = spark.createDataFrame([("a", i, float(i % 7), float(i % 5) * i) for i in range(200)], "k string, id long, x double, y double")
    spatial.nearest(materialize(points), ["k"], 3, 2.0)  # a small file of places is one that the planner would send
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_rows_of_a_large_group_are_not_one_task_for_its_plane(spark, plans, no_small_sides):
    points = spark.createDataFrame([("a", float(i % 7), float(i % 5), float(i % 7 + (i % 5) / 2 + (i % 11 == 0) * 50)) for i in range(300)], "k string, x double, y double, z double")
    fit = spatial.robust_plane(points, ["k"]).first()
    assert abs(fit.b - 1) < 1e-9 and abs(fit.c - 0.5) < 1e-9
    assert len(plans) == 6 and not any("SortMergeJoin" in p for p in plans)


def test_photos_of_one_place_are_one_pair(spark):
    """many photos at one place meet a cell once, as the first of them."""
    photos = spark.range(5_000).selectExpr("id + 7 as photo", "double(id % 5) as px", "0d as py")
    cells = spark.range(20).selectExpr("id as i", "0 as j", "double(id) as x", "0d as y")
    made = flight.paint(photos, cells, 3.0)
    assert sorted(tuple(r) for r in made.collect()) == [(i, 0, 7 + min(i, 4), float(max(0, i - 4))) for i in range(8)]
    tree, join = plan(made), plan(made).index("Join")
    assert "HashAggregate(keys=[px" in tree[join:]  # below the join


def test_pieces_are_sorted_once(spark, tmp_path):
    """pieces are not joined with their totals, so a task holds one sort."""
    spark.createDataFrame([(1, 1, 10.0), (1, 2, 12.0), (2, 1, 9.0), (2, 2, 12.0), (3, 2, 12.0)], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = field.covered_ranges(spark, str(tmp_path))
    assert "Join" not in plan(made) and plan(made).count("Sort [") == 1
    assert sorted(tuple(r) for r in made.collect()) == [(1, True, 22), (2, False, 22), (3, False, 22)]


def test_history_is_not_multiplied_for_ranks(spark):
    """the season's observations are sent to the days of their pools, not the history."""
    columns = "field long, doy int, year int, value double"
    past = [(i % 2, 1 + i * 11 % 366, 1995 + i % 4, float(i % 23)) for i in range(700)] + [(0, 5, 1996, None), (0, 5, 1996, float("nan")), (0, 5, 1997, -0.0)]
    now = [(i % 3, 1 + i * 37 % 366, 1999, float(i % 25)) for i in range(60)] + [(0, 5, 1999, None), (0, 5, 1999, float("nan"))]
    history, season = (spark.createDataFrame(rows, columns) for rows in (past, now))
    base = climatology.smoothed(climatology.climatology(history, ["field"]), ["field"])
    made = climatology.score_observations(season, base, history, ["field"])
    big = lambda v: (v != v, 0.0 if v != v else v)  # noqa: E731  NaN after all others

    def percentile(field, doy, value):
        pool = [big(v) for f, d, _, v in past if f == field and v is not None and min(abs(d - doy), 366 - abs(d - doy)) <= 12]
        return None if value is None or not pool else 100 * (sum(v < big(value) for v in pool) + 0.5 * sum(v == big(value) for v in pool)) / len(pool)

    key = lambda r: (r[0], r[1], str(r[2]), r[3] is None, r[3] or 0)
    got = sorted(((r.field, r.doy, r.value, r.percentile) for r in made.collect()), key=key)
    assert str(got) == str(sorted(((f, d, v, percentile(f, d, v)) for f, d, _, v in now), key=key))
    from pyspark.sql import DataFrame

    seen: list[DataFrame] = []
    spread = climatology.spread_to_days
    climatology.spread_to_days = lambda rows, *more: seen.append(rows) or spread(rows, *more)
    try:
        climatology.score_observations(season, base, history, ["field"])
    finally:
        climatology.spread_to_days = spread
    assert [rows.count() for rows in seen] == [61]  # 61 of the season's 62 have a value
