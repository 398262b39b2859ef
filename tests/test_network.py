"""Graph, routes, steps and walks of the lattice town against plain Python."""

import heapq
import math

import pytest

from conftest import AVENUE_CLASS, COLS, ROWS, junctions, place, spot, streets, trips
from curbline import params

RIDE = {v[0]: v for v in params.VEHICLES}


def test_every_street_has_the_edges_its_rules_allow(graph):
    rows = graph["edges"].collect()
    by_seg = {}
    for r in rows:
        by_seg.setdefault(r.seg_id, []).append(r)
    for seg, _, cls, speed, ow, ow_moto, _, conns, line in streets():
        assert len(by_seg[seg]) == (ow | ow_moto).bit_count(), seg
        for r in by_seg[seg]:
            ends = [c[0] for c in conns]
            assert [r.from_node, r.to_node] == (ends if r.heading == 0 else ends[::-1])
            assert r.length_m == pytest.approx(sum(haversine(p, q) for p, q in zip(line, line[1:])), rel=1e-6)
            assert r.climb_m == pytest.approx(height(r.to_node) - height(r.from_node))
    want = {"secondary": "arterial", "residential": "shared", "tertiary": "shared", "cycleway": "bike_path", "living_street": "living_street", "service": "quiet"}
    for r in range(ROWS):
        assert {e.category for e in by_seg[f"a{r}5"]} == {want[AVENUE_CLASS[r]] if r != 1 else "arterial"}  # 30 mph posted on one block of avenue 1 spreads
    assert {e.category for e in by_seg["l33"]} == {"steps"}


def haversine(p, q):
    a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
    return 2 * params.EARTH_M * math.asin(math.sqrt(a))


def height(node):
    return next(j[3] for j in junctions() if j[0] == node)


def test_one_posted_limit_spreads_along_its_avenue(graph):
    assert {r.seg_id for r in graph["inferred"].collect()} == {f"a1{c}" for c in range(1, COLS - 1)}
    rows = {r.seg_id: r for r in graph["edges"].collect()}
    assert rows["a13"].eff_mph == 30 and rows["a13"].posted_mph is None and rows["a10"].posted_mph == 30


def test_bans_with_known_streets_and_those_lifted(graph):
    assert {(r.from_seg, r.at_node, r.to_seg): r.moto_only for r in graph["bans"].collect()} == {("a01", "j02", "l02"): False, ("l04", "j14", "a14"): True}
    moves = {(r.who, r.in_edge, r.out_edge) for r in graph["turns"].collect()}
    who = {w for w, _, _ in moves}
    assert all((w, "a01>1", "l02>1") not in moves and (w, "a01>1", "a02>1") in moves for w in who if w not in ("scooter", "emb"))
    assert ("moped", "l04>1", "a14>1") not in moves and ("ebike_c3", "l04>1", "a14>1") in moves
    assert not any(a[:3] == b[:3] for _, a, b in moves)  # nobody turns round on a street


def test_access_of_stairs_one_ways_and_arterials(graph):
    can = {(r.who, r.edge_id) for r in graph["access"].select("who", "edge_id").collect()}
    assert not any(e.startswith("l33") for _, e in can)
    assert ("scooter", "a24>1") in can and ("scooter", "a24<1") not in can and ("moped", "a24<1") in can
    assert ("moped", "l15<1") not in can and ("moped", "l15>1") in can
    assert ("scooter", "a04>1") not in can and ("ebike_c3", "a04>1") in can  # 40 mph by its class


def cheapest(graph, who, start, end):
    """Edge by edge, from all edges out of a junction to any edge into another."""
    if start == end:
        return 0.0
    access, ahead = graph
    heap = [(e[2], i) for i, e in access[who].items() if e[0] == start]
    heapq.heapify(heap)
    done = set()
    while heap:
        cost, edge = heapq.heappop(heap)
        if edge in done:
            continue
        done.add(edge)
        if access[who][edge][1] == end:
            return cost
        for nxt in ahead[who].get(edge, ()):
            heapq.heappush(heap, (cost + access[who][nxt][2], nxt))
    return None


@pytest.fixture(scope="module")
def plain(graph):
    access, ahead = {}, {}
    for r in graph["access"].select("who", "edge_id", "from_node", "to_node", "cost").collect():
        access.setdefault(r.who, {})[r.edge_id] = (r.from_node, r.to_node, r.cost)
    for r in graph["turns"].collect():
        ahead.setdefault(r.who, {}).setdefault(r.in_edge, []).append(r.out_edge)
    return access, ahead


def test_routes_cost_the_least(answers, plain):
    solved = 0
    for k in range(40):
        row = answers["rows"][f"t{k}"]
        a, b = f"j{k * 5 % ROWS}{k * 3 % COLS}", f"j{k * 7 % ROWS}{(k * 5 + 3) % COLS}"
        if row.src_node != a or row.dst_node != b:
            continue  # a junction that this vehicle cannot use: it starts from another
        want = cheapest(plain, row.who, a, b)
        assert row.status == ("ok" if want is not None else "no_route"), row.req_id
        if want is not None:
            assert row.cost == pytest.approx(want, abs=1e-6)
            path = [r.edge_id for r in answers["edges"].get(row.req_id, ())]
            assert sum(plain[0][row.who][e][2] for e in path) == pytest.approx(want, abs=1e-6)
            assert all(b in plain[1][row.who].get(a, ()) for a, b in zip(path, path[1:]))
            solved += 1
    assert solved >= 20


def test_statuses(answers):
    s = {k: r.status for k, r in answers["rows"].items()}
    assert (s["emoto"], s["odd"], s["far"], s["out"]) == ("vehicle_not_street_legal", "unknown_vehicle", "off_network", "outside_area")
    assert all(s[k] == "ok" for k in ("mid", "into", "short", "back", "same"))
    assert answers["rows"]["same"].cost == 0 and answers["facts"]["same"].headline == "You're already there"


def length(answers, req):
    return sum(r.length_m for r in answers["edges"][req])


def test_trips_that_begin_or_end_amid_a_block(answers):
    assert [(r.seg_id, r.heading) for r in answers["edges"]["short"]] == [("a12", 0)] and length(answers, "short") == pytest.approx(40, abs=0.5)
    assert [(r.seg_id, r.heading) for r in answers["edges"]["back"]] == [("a12", 1)] and length(answers, "back") == pytest.approx(40, abs=0.5)
    first = answers["edges"]["mid"][0]
    assert first.seg_id == "a12" and (first.f0, first.f1)[0] == pytest.approx(50 / 130 if first.heading == 0 else 80 / 130, abs=0.01)
    last = answers["edges"]["into"][-1]
    assert last.seg_id == "a12" and last.f1 == pytest.approx(50 / 130 if last.heading == 0 else 80 / 130, abs=0.01)
    assert answers["rows"]["mid"].start_snap_m == pytest.approx(4.0, abs=0.1)


def test_steps_tell_the_whole_route(answers):
    for req, rows in answers["steps"].items():
        assert [s["index"] for s in rows] == list(range(1, len(rows) + 1))
        assert rows[0].maneuver == "depart" and rows[-1].maneuver == "arrive" and rows[-1].instruction == "Arrive at your destination."
        assert sum(s.distance_m for s in rows) == pytest.approx(length(answers, req), abs=0.01)
        assert sum(s.duration_s for s in rows) == pytest.approx(sum(r.seconds for r in answers["edges"][req]), abs=0.01)
        for s in rows[1:-1]:
            assert s.road is None or s.road in s.instruction or s.maneuver in ("straight", "uturn")
            assert s.maneuver.split("_")[-1] in ("left", "right", "straight", "uturn")


def test_a_turn_is_told_by_its_side(answers):
    sides = {(s.maneuver, s.instruction.split(" onto ")[0]) for rows in answers["steps"].values() for s in rows[1:-1] if " onto " in s.instruction}
    assert sides and all(m.split("_")[-1] in words for m, words in sides)


def test_traffic_runs_are_the_stretches_off_paths(answers):
    vehicles_out_of_traffic = {v[0] for v in params.VEHICLES if v[-1]}
    for req, vehicle, *_ in trips():
        rows = answers["edges"].get(req)
        if not rows or vehicle not in vehicles_out_of_traffic:
            continue
        mixed = sum(r.length_m for r in rows if r.category in params.TRAFFIC_CATEGORIES)
        assert sum(r.distance_m for r in answers["traffic"].get(req, ())) == pytest.approx(mixed, abs=0.01)


def test_walks_are_shortest_both_ways_along_every_street(graph, strolls):
    arcs = {}
    for r in graph["edges"].select("from_node", "to_node", "length_m").collect():
        for a, b in ((r.from_node, r.to_node), (r.to_node, r.from_node)):
            arcs.setdefault(a, {})[b] = min(r.length_m, arcs.get(a, {}).get(b, math.inf))
    for k in range(20):
        start, end = f"j{k % ROWS}{k % COLS}", f"j{k * 5 % ROWS}{(k * 3 + 1) % COLS}"
        best, heap = {}, [(0.0, start)]
        while heap:
            d, n = heapq.heappop(heap)
            if n in best:
                continue
            best[n] = d
            for m, w in arcs[n].items():
                heapq.heappush(heap, (d + w, m))
        row = strolls[f"w{k}"]
        assert row.status == "ok" and row.distance_m == pytest.approx(best[end], abs=0.5)
        assert row.duration_s == pytest.approx(row.distance_m / (params.WALK_MPH * params.MPS_PER_MPH))
        lon, lat = place(*spot(k * 5 % ROWS, (k * 3 + 1) % COLS))
        assert (row.path[-1].lon, row.path[-1].lat) == pytest.approx((lon, lat), abs=1e-6)
    assert strolls["away"].status == "off_network" and strolls["away"].path is None
