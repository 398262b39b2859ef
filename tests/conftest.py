"""One session, and a made-up lattice town that plain Python can solve too.

Junctions stand on a skewed lattice: rows are avenues, columns are lanes that
lean east. Classes, one-way rules and heights follow from row and column, so a
test can say what it expects of any street without a table of results.
"""

from __future__ import annotations

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from curbline import params, session  # noqa: E402
from curbline.functions import policy  # noqa: E402
from curbline.operators import components, itinerary, paths, roads, steps, walking  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

LON, LAT = -122.44, 37.74
ROWS, COLS = 6, 8
AVENUES = ("Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir")
AVENUE_CLASS = ("secondary", "residential", "tertiary", "cycleway", "living_street", "service")
SEGMENT = ("seg_id string, name string, class string, speed int, ow int, ow_moto int, bike_desig int, "
           "conns array<struct<connector_id:string,at:double>>, geometry array<struct<lon:double,lat:double>>")


def place(x: float, y: float) -> tuple[float, float]:
    """Metres east and north of the town's corner."""
    return LON + x / (111320.0 * math.cos(math.radians(LAT))), LAT + y / 111320.0


def spot(r: int, c: int) -> tuple[float, float]:
    return 130.0 * c + 35.0 * r, 110.0 * r


def junctions():
    return [(f"j{r}{c}", *place(*spot(r, c)), 3.0 * max(0, 3 - abs(c - 4)) if r == 1 else 0.0) for r in range(ROWS) for c in range(COLS)]


def streets():
    """Avenue 2 runs east only (motorcycles both ways), lane 5 north only; lane 3 is stairs between avenues 3 and 4."""
    out = []

    def add(seg, name, cls, a, b, ow=3, ow_moto=3, speed=None, bend=None):
        ends = [place(*spot(*a)), place(*spot(*b))]
        line = [ends[0], *([place(*bend)] if bend else []), ends[1]]
        out.append((seg, name, cls, speed, ow, ow_moto, 0, [(f"j{a[0]}{a[1]}", 0.0), (f"j{b[0]}{b[1]}", 1.0)], line))

    for r in range(ROWS):
        for c in range(COLS - 1):
            add(f"a{r}{c}", f"{AVENUES[r]} Avenue", AVENUE_CLASS[r], (r, c), (r, c + 1), ow=1 if r == 2 else 3, speed=30 if (r, c) == (1, 0) else None,
                bend=(spot(r, c)[0] + 65.0, spot(r, c)[1] + 9.0) if r == 4 else None)
    for c in range(COLS):
        for r in range(ROWS - 1):
            stairs = (r, c) == (3, 3)
            add(f"l{r}{c}", None if c == 6 else f"{c} Lane", "steps" if stairs else "residential", (r, c), (r + 1, c), ow=1 if c == 5 else 3, ow_moto=1 if c == 5 else 3)
    return out


#: Off avenue 0 eastward into lane 2, and off lane 4 northward into avenue 1 eastward.
BANS = [("a01", "j02", "l02", 1), ("l04", "j14", "a14", 1), ("a01", "j02", "gone", 3)]


def tables(spark):
    return spark.createDataFrame(junctions(), "node_id string, lon double, lat double, elev double"), spark.createDataFrame(streets(), SEGMENT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.local_session("curbline-tests", 8, str(tmp_path_factory.mktemp("shared")))
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    session.ship()
    return s


@pytest.fixture(scope="session")
def graph(spark):
    ws = session.Workspace(spark, "town")
    nodes, segs = tables(spark)
    nodes, segs = ws.write(nodes, "nodes"), ws.write(segs, "segs")
    inferred = ws.write(components.street_speeds(segs, ws), "inferred")
    edges = ws.write(roads.with_climb(roads.edges(roads.whole_segments(segs, nodes), inferred), nodes), "edges")
    raw = spark.createDataFrame(BANS, "seg_id string, connector_id string, to_seg string, mask int")
    # the city lifts the second ban for bicycles
    lon, lat = place(*spot(1, 4))
    rules = spark.createDataFrame([(1, "only_left_turn", lon, lat, ["4 Lane"], ["Birch Avenue"]), (2, "no_right_turn", lon, lat, ["4 Lane"], ["Birch Avenue"])],
                                  "rule_id int, restriction string, via_lon double, via_lat double, from_names array<string>, to_names array<string>")
    bans = ws.write(roads.lift_bans_for_bicycles(roads.resolved_bans(raw, segs, nodes), rules, segs, nodes), "bans")
    classes = params.vehicles(spark).where("routable and vehicle = rides_as")
    access = roads.edge_access(edges, classes).select(
        F.col("vehicle").alias("who"), "mode", "profile", "edge_id", "seg_id", "heading", "bit", "from_node", "to_node", "length_m", "category",
        policy.edge_cost("profile", "category", "length_m", "climb_m").alias("cost"), "geometry")
    access = ws.write(access, "access")
    turns = ws.write(roads.legal_turns(access, bans), "turns")
    comps = ws.write(components.class_components(edges, access, nodes, ws), "comps")
    joined = ws.write(components.joined_nodes(access, ws, comps=comps), "joined")
    return {"nodes": nodes, "segments": segs, "edges": edges, "bans": bans, "access": access, "turns": turns, "comps": comps, "loops": ws.write(components.label_components(access, turns, nodes, ws), "loops"), "joined": joined, "inferred": inferred}


def trips():
    """Junction to junction in steps through the town, for all vehicles, and some that start or end amid a block."""
    rides = ("scooter", "emb", "ebike_c3", "moped")
    out = []
    for k in range(40):
        a, b = (k * 5 % ROWS, k * 3 % COLS), (k * 7 % ROWS, (k * 5 + 3) % COLS)
        out.append((f"t{k}", rides[k % 4], *place(*spot(*a)), *place(*spot(*b))))
    x, y = spot(1, 2)
    mid = place(x + 50.0, y - 4.0)
    out += [("mid", "ebike_c3", *mid, *place(*spot(5, 6))), ("into", "moped", *place(*spot(5, 1)), *mid), ("short", "ebike_c3", *mid, *place(x + 90.0, y + 3.0)), ("back", "ebike_c3", *place(x + 90.0, y + 3.0), *mid)]
    out += [("same", "scooter", *place(*spot(2, 2)), *place(*spot(2, 2))), ("emoto", "emoto", *mid, *mid), ("odd", "sled", *mid, *mid), ("far", "scooter", *place(-900.0, 0.0), *mid), ("out", "scooter", -123.5, 37.5, *mid)]
    return out


BOX = (-123.0, 37.0, -122.0, 38.5)


@pytest.fixture(scope="session", params=[None, 0.003], ids=["wide", "narrow"])
def answers(request, spark, graph):
    """All trips solved, once with the usual tiles and once with tiles of a few blocks."""
    usual = paths.FIRST_TILE_DEG
    paths.FIRST_TILE_DEG = request.param or usual
    ws = session.Workspace(spark, "town-routes")
    asked = spark.createDataFrame(trips(), "req_id string, vehicle string, start_lon double, start_lat double, end_lon double, end_lat double")
    vehicles = params.vehicles(spark)
    asked = ws.write(paths.request_status(asked, vehicles, BOX), "asked")
    g = graph
    out = paths.solve(asked.where("status is null"), g["nodes"], g["access"], g["turns"], g["edges"], g["comps"], g["loops"], g["joined"], ws)
    paths.FIRST_TILE_DEG = usual
    ends = ["who", "start_lon", "start_lat", "end_lon", "end_lat"]
    r = asked.join(out["routes"].withColumnRenamed("status", "found"), ends, "left").withColumn("status", F.coalesce("status", "found"))
    r = ws.write(r, "answers")
    pairs = r.where("status = 'ok'").select("src", "dst", "vehicle").distinct()
    parts = ws.write(itinerary.ridden(out["route_edges"], pairs, g["edges"], vehicles), "parts")
    key = ["src", "dst", "vehicle"]
    facts = itinerary.with_headline(itinerary.with_warnings(r.where("status = 'ok'").join(itinerary.facts(parts), key, "left"), vehicles))
    signs = spark.createDataFrame([], "from_seg string, to_seg string, at_node string, label string, mask int, pos int")
    told = steps.build(parts, signs, g["nodes"])
    by_req = lambda df: r.select("req_id", *key).join(df, key)
    return {
        "rows": {x.req_id: x for x in r.collect()}, "facts": {x.req_id: x for x in facts.collect()},
        "edges": _grouped(by_req(parts), "seq"), "steps": _grouped(by_req(told), "index"), "traffic": _grouped(by_req(itinerary.traffic_runs(parts)), "run")}


def _grouped(df, order):
    out: dict = {}
    for row in df.orderBy("req_id", order).collect():
        out.setdefault(row.req_id, []).append(row)
    return out


@pytest.fixture(scope="session")
def strolls(spark, graph):
    rows = [(f"w{k}", *place(*spot(k % ROWS, k % COLS)), *place(*spot(k * 5 % ROWS, (k * 3 + 1) % COLS))) for k in range(20)] + [("away", *place(0.0, 0.0), *place(9000.0, 0.0))]
    asked = spark.createDataFrame(rows, "id string, start_lon double, start_lat double, end_lon double, end_lat double")
    found = walking.solve(asked.drop("id"), graph["nodes"], graph["edges"], session.Workspace(spark, "town-walks"))
    return {x.id: x for x in asked.join(found, ["start_lon", "start_lat", "end_lon", "end_lat"]).collect()}
