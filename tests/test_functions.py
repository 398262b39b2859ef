"""Column functions, record cleaning, nearest joins and the ride logic."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from curbline import params, session
from curbline.functions import geo, policy, text
from curbline.operators import bikeways, roads, search, snap, spatial
from curbline.sources import landed, sinks


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_distance_text_against_its_rule(spark):
    """Multiples of 5 ft up to 97.5 ft, then of 10, ties to even; from a tenth of a mile on, miles."""
    metres = [0.37 * k for k in range(500)] + [97.5 / params.FEET_PER_M, 0.1 * params.MILE_M, 2.345 * params.MILE_M]
    for r in spark.createDataFrame([(m,) for m in metres], "m double").select("m", geo.distance_text("m").alias("got")).collect():
        feet = r.m * params.FEET_PER_M
        step = 5 if feet < 97.5 else 10
        assert r.got == (f"{round(feet / step) * step} ft" if r.m < 0.1 * params.MILE_M else f"{r.m / params.MILE_M:.1f} mi")


def test_category_of_every_class_speed_and_survey(spark):
    """All combinations against the policy's order of precedence."""
    classes = [*params.CLASS_SPEED, *params.OFF_STREET_CLASSES, *params.UNRIDDEN_CLASSES, "steps", "footway", "unknown"]
    rows = [(c, s, d, b) for c in classes for s in (None, 12, 20, 21, 28, 29, 45, 46) for d in (False, True) for b in (None, 0, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "c string, s int, d boolean, b int").select("*", policy.category("c", "s", F.col("d"), F.col("b")).alias("got"))
    for r in df.collect():
        mph = r.s if r.s is not None else params.CLASS_SPEED.get(r.c, params.OTHER_CLASS_SPEED)
        lane = r.d if r.b is None else r.b == 2
        if r.c in params.UNRIDDEN_CLASSES:
            want = None
        elif r.c == "steps":
            want = "steps"
        elif r.c in params.OFF_STREET_CLASSES or r.b in (1, 4):
            want = "bike_path"
        elif lane:
            want = "bike_lane"
        elif r.c in ("footway", "living_street"):
            want = {"footway": "sidewalk", "living_street": "living_street"}[r.c]
        else:
            want = None if mph > params.TOP_SPEED else "quiet" if mph <= params.QUIET_TOP else "shared" if mph <= params.SHARED_TOP else "arterial"
        assert r.got == want, r


def test_words_of_any_length_and_all_entities(spark):
    long = "a" * 10_050
    r = one(spark, text.title(F.lit(long)).alias("a"), text.blockface_street(F.lit(long)).alias("b"), text.unescape(F.lit("&eacute;&#8211;&#x2019;&amp;lt; &quot;x&quot; &unknown;")).alias("c"))
    assert (r.a, r.b) == ("A" + long[1:], "A" + long[1:])
    assert r.c == "é–’&lt; \"x\" &unknown;"


def test_text(spark):
    r = one(spark, text.fold(F.lit("Crème Brûlée")).alias("a"), text.unpadded_street(F.lit("03RD ST")).alias("b"), text.display_address(F.lit("123"), F.lit("03RD O'FARRELL ST")).alias("c"),
            text.house_number(F.lit("3rd st 12b")).alias("d"), text.street_words(F.lit("12b  3rd  st")).alias("e"), text.category_text(F.lit("book_store")).alias("f"), text.blockface_street(F.lit("04TH AVE")).alias("g"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("creme brulee", "3RD ST", "123 03rd O'Farrell St", "12", "3rd st", "Book Store", "4th Ave")


def test_speed_and_hills(spark):
    mph = lambda cap, road, cat="shared": policy.travel_mph(F.lit(cap), F.lit(cat), F.lit(road))
    r = one(spark, mph(15.0, 25.0).alias("a"), mph(20.0, 25.0).alias("b"), mph(30.0, 25.0).alias("c"), mph(15.0, 25.0, "sidewalk").alias("d"),
            policy.hill_cost(F.lit("A"), F.lit(100.0), F.lit(-5.0)).alias("e"), policy.hill_cost(F.lit("A"), F.lit(100.0), F.lit(20.0)).alias("f"), policy.hill_cost(F.lit("A"), F.lit(100.0), F.lit(-25.0)).alias("g"))
    assert (r.a, r.b, r.c, r.d) == (11.25, 15.0, 18.75, 3.0)
    assert r.e == 0 and r.f == pytest.approx(400 + 12 * 60) and r.g > 0


def test_trimming_nested_records(spark):
    schema = landed.SEGMENT_SCHEMA.replace("geometry binary", "geometry array<struct<lon:double,lat:double>>")
    when = lambda heading=None, mode=None, vehicle=None: (heading, mode, vehicle)
    heavy = [("weight", "greater_than", 3.0, "t")]
    def rec(i, rules, limits=None):
        return (i, "road", "residential", ("Street",), None, [(-122.4, 37.7), (-122.39, 37.7)], [("b", 1.0), ("a", None)], rules, limits, [([("a", "s9"), ("z", "s8")], when("forward"))], [("s9", "a", [("Downtown",)], None), ("s9", "a", [], None)])
    rows = [rec("1", [("designated", None, when(mode=["bicycle"])), ("denied", None, when(vehicle=heavy))]), rec("2", [("denied", None, when())]), rec("3", [("denied", None, when("backward"))]),
            rec("4", [("denied", None, when(mode=["bicycle"]))]), rec("5", [("denied", [0.0, 0.5], when())], [((60.0, "mph"), None, when(mode=["hgv"])), ((40.0, "km/h"), [0.0, 1.0], None)]),
            rec("6", None, [((30.0, "mph"), None, None), ((20.0, None), [0.0, 0.2], None)])]
    got = {r.seg_id: r for r in roads.trim_segments(spark.createDataFrame(rows, schema)).collect()}
    assert [(got[i].ow, got[i].ow_moto, got[i].bike_desig) for i in "12345"] == [(3, 3, 3), (0, 0, 0), (1, 1, 0), (0, 3, 0), (3, 3, 0)]
    assert got["5"].speed == 25 and got["6"].speed == 20 and got["1"].speed is None
    assert got["1"].conns[0].connector_id == "a" and got["1"].prohib == [("a", "s9", 1)] and got["1"].dest == [("s9", "a", "Downtown", 3)]


def test_well_known_binary(spark):
    import struct

    line = struct.pack("<BII4d", 1, 2, 2, -122.4, 37.7, -122.3, 37.8)
    point = struct.pack(">BI2d", 0, 1, -122.4, 37.7)
    df = spark.createDataFrame([(bytearray(line),), (bytearray(point),), (bytearray(b"\x01\x02"),)], "g binary")
    rows = df.select(landed.wkb_line("g").alias("line"), landed.wkb_point(F.col("g")).alias("pt")).collect()
    assert rows[0].line == [(-122.4, 37.7), (-122.3, 37.8)] and rows[0].pt is None
    assert rows[1].pt == (-122.4, 37.7) and rows[1].line is None and rows[2].line is None


def test_features_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "Rack", -122.4, 37.7), ("b", None, -122.3, 37.8)], "id string, name string, lon double, lat double")
    sinks.write_features(df, str(tmp_path / "f"), ["name"])
    back = landed.point_features(spark, str(tmp_path / "f"), "name:string").select("id", "name", "lon", "lat")
    assert sorted(back.collect()) == sorted(df.collect())


def test_bikeway_match(spark):
    """One street per case, 400 m apart, each 180 m long to the north-east, with a survey line beside it or not."""
    from conftest import SEGMENT, place

    def at(k, along, aside):
        return place(400.0 * k + 0.8 * along + 0.6 * aside, 0.6 * along - 0.8 * aside)

    cases = {  # class of the street, survey class, direction, contraflow, metres aside, where the line runs, what is matched
        "lane": ("residential", 2, None, False, 3, (0, 180), (2, 2, 0)), "one_way_track": ("residential", 4, "E", False, 3, (0, 180), (4, 0, 0)), "against": ("service", 2, "W", True, 2, (0, 180), (0, 2, 2)),
        "signed": ("tertiary", 3, None, False, 1, (0, 180), (3, 3, 0)), "walk": ("footway", 2, None, False, 3, (0, 180), None), "trail": ("footway", 1, None, False, 3, (0, 180), (1, 1, 0)),
        "far": ("residential", 2, None, False, 60, (0, 180), None), "brief": ("residential", 2, None, False, 3, (0, 30), None)}
    segs = [(n, None, c[0], None, 3, 3, 0, [("x", 0.0), ("y", 1.0)], [at(k, 0, 0), at(k, 180, 0)]) for k, (n, c) in enumerate(cases.items())]
    lines = [(k, c[1], c[2], c[3], [at(k, c[5][0], c[4]), at(k, c[5][1], c[4])]) for k, c in enumerate(cases.values())]
    got = bikeways.match(spark.createDataFrame(segs, SEGMENT), spark.createDataFrame(lines, "line_id int, cls int, dir string, contraflow boolean, geometry array<struct<lon:double,lat:double>>"))
    assert {r.seg_id: (r.fwd, r.bwd, r.opened) for r in got.collect()} == {n: c[6] for n, c in cases.items() if c[6]}


@pytest.mark.parametrize("lat", [0.0, 37.7, 60.5, 70.0, 80.0, -84.9])
@pytest.mark.parametrize("lon", [12.0, 179.9995, -180.0])
def test_pairs_at_every_latitude_and_the_date_line(spark, lat, lon):
    rng = random.Random(int(lat * 10))
    wrap = lambda x: (x + 540.0) % 360.0 - 180.0
    spread = 0.004 / max(0.05, math.cos(math.radians(lat)))
    spot = lambda: (wrap(lon + (rng.random() - 0.5) * spread), lat + (rng.random() - 0.5) * 0.004)
    left, right = [(i, *spot()) for i in range(25)], [(i, *spot()) for i in range(25)]
    got = spatial.pairs_within(spark.createDataFrame(left, "a int, lon double, lat double"), spark.createDataFrame(right, "b int, lon double, lat double"), 150.0, ["a"], ["b"])

    def metres(p, q):
        return math.hypot(math.radians((q[1] - p[1] + 540.0) % 360.0 - 180.0) * math.cos(math.radians(p[2])), math.radians(q[2] - p[2])) * params.EARTH_M

    want = {(p[0], q[0]) for p in left for q in right if metres(p, q) <= 150.0}
    assert want and {(r.a, r.b) for r in got.collect()} == want


def test_the_namesake_in_the_city_is_shown(spark):
    ws = session.Workspace(spark, "namesakes")
    empty = "row_id bigint, id string, name string, lon double, lat double, address string"
    inside = (params.SERVICE_BOX[0] + 0.01, params.SERVICE_BOX[1] + 0.01)
    stations = [(i, f"s{i}", "Harbour Charge", -120.0, 37.0, "x") for i in range(9)] + [(9, "s9", "Harbour Charge", *inside, "x")]
    places = spark.createDataFrame([], "row_id bigint, id string, name string, category string, address string, lon double, lat double, source int")
    addresses = spark.createDataFrame([], "row_id bigint, street string, number string, unit string, postcode string, lon double, lat double")
    got = search.unified_search(spark.createDataFrame([(1, "harbour")], "query_id int, query string"), spark.createDataFrame(stations, empty), spark.createDataFrame([], empty), places, addresses, ws)
    assert [(r.station_id, r.in_city) for r in got.collect()] == [("s9", True)]


def test_nearest_joins_equal_brute_force(spark):
    rng = random.Random(7)
    spot = lambda: (-122.45 + rng.random() * 0.05, 37.75 + rng.random() * 0.04)
    sites = [(i, *spot()) for i in range(400)] + [(400 + i, -122.44, 37.76) for i in range(30)]  # thirty at one place
    points = [(i, *spot()) for i in range(60)] + [(60 + i, -122.44, 37.7601) for i in range(20)]
    s = spark.createDataFrame(sites, "row_id int, lon double, lat double")
    p = spark.createDataFrame(points, "id int, lon double, lat double")

    def flat(a, b):
        return math.hypot(math.radians(b[0] - a[0]) * math.cos(math.radians(a[1])), math.radians(b[1] - a[1])) * params.EARTH_M

    got = {(r.plon, r.plat): (r.site.row_id, r.dist_m) for r in spatial.nearest_within(p, s, 150.0, session.Workspace(spark, "t")).collect()}
    for _, lon, lat in points:
        d, i = min((round(flat((lon, lat), x[1:]), 6), x[0]) for x in sites)
        assert ((lon, lat) in got) == (d <= 150)
        if d <= 150:
            assert got[lon, lat][0] == i
    k = spatial.nearest_k(p, s, 5, session.Workspace(spark, "t"))
    ranked = {}
    for r in k.collect():
        ranked.setdefault((r.plon, r.plat), {})[r.rank] = r.row_id
    for _, lon, lat in points:
        want = sorted((round(math.hypot((x[1] - lon) * math.cos(math.radians(lat)), x[2] - lat), 12), x[0]) for x in sites)[:5]
        assert [ranked[lon, lat][i + 1] for i in range(5)] == [i for _, i in want]


def test_close_streets_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ABCE ST") for _ in range(n)).strip() or "A"
    streets = sorted({word(rng.randint(1, 9)) for _ in range(150)})
    typed = sorted({word(rng.randint(1, 9)) for _ in range(40)})
    got = {}
    rows = search.close_streets(spark.createDataFrame([(t,) for t in typed], "q string"), spark.createDataFrame([(s,) for s in streets], "street string"), 30)
    for r in rows.collect():
        got.setdefault(r.q, {})[r.rank] = r.street
    for t in typed:
        want = difflib.get_close_matches(t, streets, n=30, cutoff=0.75)
        assert [got.get(t, {}).get(i + 1) for i in range(len(want))] == want


def test_snapped_share_of_a_bent_street_equals_the_whole_line(spark):
    """Ends meet a street leg by leg; where they land is judged against the undivided line."""
    def at(x, y):
        return -122.44 + x / 88000.0, 37.74 + y / 110574.0

    bends = [at(0, 0), at(150, 40), at(180, 260), at(420, 250), at(700, 300)]
    spots = [at(80, 45), at(175, 150), at(300, 280), at(560, 255), at(5000, 5000)]
    where = "lon double, lat double"
    nodes = spark.createDataFrame([(1, *bends[0]), (2, *bends[-1])], f"node_id bigint, {where}")
    access = spark.createDataFrame([("a", "e1", 7, 1, 2, 900.0, "street", bends), ("a", "e2", 7, 2, 1, 900.0, "street", bends[::-1])],
                                   f"who string, edge_id string, seg_id bigint, from_node bigint, to_node bigint, length_m double, category string, geometry array<struct<{where.replace(' double', ':double').replace(', ', ',')}>>")
    ends = spark.createDataFrame([(i, "a", True, *p) for i, p in enumerate(spots)], f"end_id bigint, who string, forward boolean, {where}")
    joined = spark.createDataFrame([("a", True, 1), ("a", True, 2)], "who string, forward boolean, node bigint")
    found = {(r.end_id, r.edge_id): (r.frac, r.snap_m) for r in snap.snap_streets(ends, nodes, access, joined, session.Workspace(spark, "bent")).collect()}
    whole = ends.crossJoin(access.select("edge_id", "geometry")).withColumn("at", geo.project(F.col("geometry"), "lon", "lat")).where("at.dist_m <= 200")
    want = {(r.end_id, r.edge_id): (r["at"].along, r["at"].dist_m) for r in whole.collect()}
    assert len(want) == 8 and found == want
