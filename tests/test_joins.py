"""Joins whose sides are tables or exploded from them are dealt by keys: copies would go by way of the driver."""

import math
import random

from curbline import params
from curbline.operators import bikeways, components, roads, spatial, walking
from curbline.plans import compiled, derive
from curbline.session import Workspace

SF = "/root/testdata/sf0.001"


def copied(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().sparkPlan().toString()


def test_bikeways_meet_streets_by_cells_and_no_side_is_copied(spark):
    assert not copied(bikeways.match(derive.segments(spark, SF), derive.bikeways(spark, SF)))


def test_a_bikeway_just_in_reach_across_any_cell_border_is_met(spark):
    line = "array(named_struct('lon', {0}, 'lat', {1}), named_struct('lon', {2}, 'lat', {3}))".format
    for lat, turn in ((37.7, 0.0), (-66.4, 1.0)):
        up, on = (params.MATCH_M - 0.1) / 110_574.0, (params.MATCH_M - 0.1) / (111_320.0 * math.cos(math.radians(lat)))
        streets, ways = [], []
        for i in range(8):  # borders of cells lie in every way to the sample
            x, y = -122.4 + i * 1e-4, lat + i * 1e-3 + i * 7e-5
            dx, dy = (0.0, 1e-3) if turn else (1e-3, 0.0)
            sx, sy = (on, 0.0) if turn else (0.0, up)
            streets.append(f"({i}, 'residential', {line(x, y, x + dx, y + dy)})")
            ways.append(f"(2, cast(null as string), false, {line(x + sx, y + sy, x + dx + sx, y + dy + sy)})")
        segments = spark.sql(f"select * from values {', '.join(streets)} as t(seg_id, class, geometry)").selectExpr("seg_id", "class", "cast(geometry as array<struct<lon:double,lat:double>>) as geometry")
        lines = spark.sql(f"select * from values {', '.join(ways)} as t(cls, dir, contraflow, geometry)").selectExpr("cls", "dir", "contraflow", "cast(geometry as array<struct<lon:double,lat:double>>) as geometry")
        assert sorted((r.seg_id, r.fwd, r.bwd) for r in bikeways.match(segments, lines).collect()) == [(i, 2, 2) for i in range(8)]


def test_edges_take_limits_and_bikeways_without_a_copy(spark):
    segments = derive.segments(spark, SF)
    inferred = spark.range(3).selectExpr("id as seg_id", "30 as inferred")
    surveyed = spark.range(3).selectExpr("id as seg_id", "1 as fwd", "0 as bwd", "0 as opened")
    found = roads.edges(segments, inferred, surveyed)
    assert not copied(found) and not copied(roads.with_climb(found, derive.nodes(spark, SF)))


def watched(spark, plans):
    class Watched(Workspace):
        def write(self, df, name):
            plans[name] = copied(df)
            return super().write(df, name)

    return Watched(spark, "watched")


def test_walks_meet_junctions_edges_and_each_other_without_a_copy(spark):
    plans = {}
    asked = derive.trips(spark, SF).where("req_id < 40").select("start_lon", "start_lat", "end_lon", "end_lat")
    found = walking.solve(asked, derive.nodes(spark, SF), compiled.edges(spark, SF), watched(spark, plans))
    assert not copied(found)
    assert {n: plans[n] for n in ("walk-trips", "walk-steps", "walk-pairs", "walk-starts", "walk-goals", "walk-found") if plans[n]} == {}


def test_components_are_renamed_without_a_copy(spark):
    plans = {}
    components.label_components(compiled.class_access(spark, SF), compiled.turns(spark, SF), derive.nodes(spark, SF), watched(spark, plans))
    assert any(n.startswith("scc-cells") for n in plans) and {n for n, c in plans.items() if c and n.startswith(("scc-part", "scc-cells"))} == set()


def test_nearest_cells_double(spark, monkeypatch):
    sides = []
    cell = spatial.cell
    monkeypatch.setattr(spatial, "cell", lambda lon, lat, deg: sides.append(deg) or cell(lon, lat, deg))
    sites = spark.range(400).selectExpr("id as row_id", "(id % 20) * 1e-3 as lon", "cast(floor(id / 20) as double) * 1e-3 as lat")
    point = spark.sql("select 0.0095D as lon, 0.0095D as lat")
    got = [r.row_id for r in spatial.nearest_k(point, sites, 64, Workspace(spark, "near")).orderBy("rank").collect()]
    flat = lambda i: round(math.hypot((i % 20 * 1e-3 - 0.0095) * math.cos(math.radians(0.0095)), i // 20 * 1e-3 - 0.0095), 12)
    assert got == sorted(range(400), key=lambda i: (flat(i), i))[:64]
    assert len(sides) == 2 and sides[1] < 2.01 * sides[0]


def test_among_nearest_says_what_ranking_says_and_ranks_only_where_it_must(spark):
    rng = random.Random(3)
    sites = [(i, -122.4 + rng.uniform(0, 0.02), 37.7 + rng.uniform(0, 0.02)) for i in range(120)] + [(1000 + i, -122.39, 37.71) for i in range(9)]
    asked = [(-122.4 + rng.uniform(0, 0.02), 37.7 + rng.uniform(0, 0.02), rng.choice(sites)[0]) for _ in range(300)] + [(-122.3901, 37.7101, 1000 + i) for i in range(9)]
    sites = spark.createDataFrame(sites, "row_id long, lon double, lat double")
    asked = spark.createDataFrame(asked, "lon double, lat double, row_id long")
    key = ["plon", "plat", "row_id"]
    for k in (5, 40):
        ranked = spatial.nearest_k(asked, sites, k, Workspace(spark, "ranked")).select(*key)
        want = asked.toDF(*key).distinct().join(ranked, key, "left_semi")
        assert {tuple(r) for r in spatial.among_nearest(asked, sites, k, Workspace(spark, "among")).collect()} == {tuple(r) for r in want.collect()}
    plans = {}
    close = spark.createDataFrame([(-122.3901, 37.7101, 1000)], "lon double, lat double, row_id long")
    assert spatial.among_nearest(close, sites, 64, watched(spark, plans)).count() == 1 and plans == {"among-asked": False, "among-few": False, "among-rest": False}
