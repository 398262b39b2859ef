"""SQL fragments for the oracles: the derived tables and shared formulas."""

from __future__ import annotations

from .. import params

N = "(SELECT count(*) FROM part)"


def hav(a, b, c, d, radius="6371000.0e0"):
    return (f"2*{radius}*asin(sqrt(pow(sin(radians(({d})-({b}))/2),2)+cos(radians({b}))*cos(radians({d}))*pow(sin(radians(({c})-({a}))/2),2)))")


def flat(a, b, c, d):
    return f"6371000.0e0*sqrt(pow(radians(({c})-({a}))*cos(radians({b})),2)+pow(radians(({d})-({b})),2))"


def pmod(x, m):
    return f"((({x})%({m}))+({m}))%({m})"


NODES = """nodes AS (SELECT p_partkey AS node_id, p_partkey%100 AS x, CAST(floor(p_partkey/100) AS BIGINT) AS y, p_size AS s,
  -1.2253e2+1.6e-3*(p_partkey%100) AS lon, 3.7705e1+9e-4*CAST(floor(p_partkey/100) AS BIGINT) AS lat, 4e-1*p_size AS elev FROM part)"""

SEGS = f"""seg0 AS (
  SELECT 2*node_id AS seg_id, s, y AS k, node_id AS a, node_id+1 AS b, lon AS alon, lat AS alat, -1.2253e2+1.6e-3*(x+1) AS blon, lat AS blat, 'Row '||y||' St' AS street
  FROM nodes WHERE x<99 AND node_id+1<{N}
  UNION ALL
  SELECT 2*node_id+1, s, x, node_id, node_id+100, lon, lat, lon, 3.7705e1+9e-4*(y+1), 'Col '||x||' Ave' FROM nodes WHERE node_id+100<{N}),
segs AS (SELECT seg_id, s, a, b, alon, alat, blon, blat, CASE WHEN s%13=0 THEN NULL ELSE street END AS name,
  CASE WHEN s%17=0 THEN 'cycleway' WHEN s%23=0 THEN 'steps' WHEN s%29=0 THEN 'footway' WHEN s=31 THEN 'bridleway'
    ELSE ['residential','tertiary','service','secondary','living_street','primary'][k%6+1] END AS class,
  CASE WHEN s=50 THEN 55 WHEN s%3=0 THEN 15+5*(s%7) END AS speed,
  CASE s%11 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS ow,
  CASE WHEN s%19=0 THEN 0 WHEN s%11=0 THEN 1 WHEN s%11=1 THEN 2 ELSE 3 END AS ow_moto,
  CASE WHEN s%5=0 THEN 3 ELSE 0 END AS bike_desig FROM seg0)"""

INFERRED = """ends AS (SELECT seg_id, a AS at, name, class, speed FROM segs WHERE name IS NOT NULL UNION ALL SELECT seg_id, b, name, class, speed FROM segs WHERE name IS NOT NULL),
spread AS (
  SELECT DISTINCT e.seg_id, p.speed AS v FROM ends e JOIN ends p ON e.at=p.at AND e.name=p.name AND e.class=p.class WHERE e.speed IS NULL AND p.speed IS NOT NULL
  UNION
  SELECT e.seg_id, s.v FROM spread s JOIN ends m ON m.seg_id=s.seg_id JOIN ends e ON e.at=m.at AND e.name=m.name AND e.class=m.class WHERE e.speed IS NULL),
inferred AS (SELECT seg_id, max(v) AS inferred FROM spread GROUP BY seg_id)"""

CLASS_SPEED = "CASE class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in params.CLASS_SPEED.items()) + f" ELSE {params.OTHER_CLASS_SPEED} END"


def category(code="NULL"):
    return f"""CASE WHEN class='bridleway' THEN NULL WHEN class='steps' THEN 'steps'
    WHEN class IN ('cycleway','path','track') OR coalesce({code} IN (1,4), false) THEN 'bike_path'
    WHEN coalesce({code}=2, (bike_desig & bit)<>0) THEN 'bike_lane' WHEN class='footway' THEN 'sidewalk' WHEN class='living_street' THEN 'living_street'
    WHEN coalesce(lim,{CLASS_SPEED})>45 THEN NULL WHEN coalesce(lim,{CLASS_SPEED})<=20 THEN 'quiet'
    WHEN coalesce(lim,{CLASS_SPEED})<=28 THEN 'shared' ELSE 'arterial' END"""


EDGES = f"""dir AS (SELECT s.*, coalesce(s.speed, i.inferred) AS lim, h.heading, h.heading+1 AS bit FROM segs s LEFT JOIN inferred i USING (seg_id), (VALUES (0),(1)) h(heading)
  WHERE ((s.ow | s.ow_moto) & (h.heading+1))<>0),
edges AS (SELECT seg_id||CASE heading WHEN 0 THEN '>1' ELSE '<1' END AS edge_id, seg_id, heading, bit, CASE heading WHEN 0 THEN a ELSE b END AS from_node,
  CASE heading WHEN 0 THEN b ELSE a END AS to_node, {hav('alon','alat','blon','blat')} AS length_m, name, class, {category()} AS category,
  coalesce(lim,{CLASS_SPEED}) AS eff_mph, speed AS posted_mph, ow, ow_moto,
  CASE heading WHEN 0 THEN alon ELSE blon END AS flon, CASE heading WHEN 0 THEN alat ELSE blat END AS flat,
  CASE heading WHEN 0 THEN blon ELSE alon END AS tlon, CASE heading WHEN 0 THEN blat ELSE alat END AS tlat
  FROM dir WHERE {category()} IS NOT NULL),
climbs AS (SELECT e.*, 4e-1*(t.s-f.s) AS climb_m FROM edges e JOIN nodes f ON f.node_id=e.from_node JOIN nodes t ON t.node_id=e.to_node)"""


def _lit(v):
    return "NULL" if v is None else ("true" if v is True else "false" if v is False else f"'{v}'" if isinstance(v, str) else f"{v:.1f}e0")


VEHICLES = "vehicles(ordinal, vehicle, label, cap_mph, routable, profile, road_max, max_included, lane_exempt, mode, avoids_traffic, rides_as) AS (VALUES " + ", ".join(
    f"({i}, " + ", ".join([_lit(v[0]), _lit(v[1]), "CAST(" + _lit(v[2]) + " AS DOUBLE)", _lit(v[3]), "CAST(" + _lit(v[4]) + " AS VARCHAR)",
                           "CAST(" + _lit(v[5]) + " AS DOUBLE)", *[_lit(x) for x in v[6:]], "CAST(" + _lit(params.rides_as(v)) + " AS VARCHAR)"]) + ")"
    for i, v in enumerate(params.VEHICLES)) + ")"

ALLOWED = """routable AND ((CASE mode WHEN 'motorcycle' THEN ow_moto ELSE ow END) & bit)<>0 AND category<>'steps'
  AND (road_max IS NULL OR (lane_exempt AND category IN ('bike_lane','bike_path')) OR category IN ('sidewalk','living_street') OR eff_mph<=road_max)"""

FACTOR = "CASE profile||'/'||category " + " ".join(
    f"WHEN '{p}/{c}' THEN {v}e0" for p, cats in params.COST_FACTOR.items() for c, v in cats.items()) + " END"


def hill(i):
    return "CASE profile " + " ".join(f"WHEN '{p}' THEN {v[i]}e0" for p, v in params.HILLS.items()) + " END"


HILL_COST = (f"(greatest(climb_m,0e0)*{hill(0)} + greatest(greatest(climb_m,0e0)-8e-2*length_m,0e0)*{hill(0)}*{hill(1)}"
             f" + greatest(greatest(-climb_m,0e0)-1.5e-1*length_m,0e0)*{hill(0)}*{hill(2)})")
COST = f"(length_m*{FACTOR}+{HILL_COST})"
MPH = "(CASE WHEN category='sidewalk' THEN 3e0 ELSE least(coalesce(cap_mph,15e0),eff_mph)*7.5e-1 END)"
SECONDS = f"(length_m/({MPH}*4.4704e-1)*(1e0+{hill(3)}*greatest(climb_m,0e0)/length_m))"

ACCESS = f"access AS (SELECT v.vehicle, v.label, v.cap_mph, v.profile, v.mode, v.rides_as, c.* FROM climbs c, vehicles v WHERE {ALLOWED})"

BANS = f"""prohib AS (SELECT 2*(node_id-1) AS from_seg, bit, node_id AS at_node, 2*node_id+1 AS to_seg FROM nodes, (VALUES (1),(2)) b(bit) WHERE s%9=0 AND x>0 AND node_id+100<{N}),
rules AS (SELECT node_id AS rule_id, CASE WHEN s%4=0 THEN 'only_right_turn' ELSE 'no_left_turn' END AS restriction, lon AS vlon, lat+5e-5 AS vlat, 'Row '||y||' St' AS fname, 'Col '||x||' Ave' AS tname
  FROM nodes WHERE s%18=0 AND x>0 AND node_id+100<{N}),
lifted AS (SELECT DISTINCT p.from_seg, p.bit, p.at_node, p.to_seg FROM prohib p JOIN nodes n ON n.node_id=p.at_node
  JOIN rules r ON r.vlat BETWEEN n.lat-2e-4 AND n.lat+2e-4 AND r.vlon BETWEEN n.lon-2e-4 AND n.lon+2e-4 AND {flat('r.vlon','r.vlat','n.lon','n.lat')}<=15
  JOIN segs f ON f.seg_id=p.from_seg JOIN segs t ON t.seg_id=p.to_seg
  WHERE f.name=r.fname AND (r.restriction LIKE 'only\\_%' ESCAPE '\\' OR t.name=r.tname)),
bans AS (SELECT p.*, l.from_seg IS NOT NULL AS moto_only FROM prohib p LEFT JOIN lifted l USING (from_seg, bit, at_node, to_seg))"""

TURNS = f"""cls AS (SELECT a.*, a.vehicle AS who, {COST} AS cost FROM access a WHERE a.vehicle=a.rides_as),
turns AS (SELECT i.who, i.edge_id AS in_edge, o.edge_id AS out_edge, i.to_node AS node, o.cost AS cost FROM cls i JOIN cls o ON o.who=i.who AND o.from_node=i.to_node
  WHERE NOT (i.seg_id=o.seg_id AND i.heading<>o.heading)
  AND NOT EXISTS (SELECT 1 FROM bans b WHERE b.from_seg=i.seg_id AND b.bit=i.bit AND b.at_node=i.to_node AND b.to_seg=o.seg_id AND (NOT b.moto_only OR i.mode='motorcycle')))"""

GRAPH = f"{NODES},\n{SEGS},\n{INFERRED},\n{EDGES},\n{VEHICLES}"


def box(b, lon="lon", lat="lat"):
    return f"({lon} BETWEEN {b[0]}e0 AND {b[2]}e0 AND {lat} BETWEEN {b[1]}e0 AND {b[3]}e0)"


IN_CITY = box(params.SERVICE_BOX)


def at(lon_mult="7919", key="c_custkey"):
    return f"-1.2253e2+({key}*{lon_mult}%160000)/1e6"


ADDR = f"""addr AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey%3=0 THEN lpad(CAST(4+c_custkey%15 AS VARCHAR),2,'0')||'TH ST' ELSE (4+c_custkey%15)||'TH ST' END AS street,
  CAST(c_custkey%200 AS VARCHAR) AS number, CASE WHEN c_custkey%4=0 THEN c_mktsegment END AS unit, '941'||lpad(CAST(c_nationkey AS VARCHAR),2,'0') AS postcode,
  -1.2253e2+(c_custkey*7919%160000)/1e6 AS lon, 3.7705e1+(c_custkey*104729%({N}*9))/1e6 AS lat FROM customer)"""

PLACES = """places AS (SELECT p_partkey AS row_id, 'pl-'||p_partkey AS id, p_name AS name, lower(p_type) AS category, CASE WHEN p_size%2=0 THEN NULL ELSE p_brand END AS address,
  -1.2253e2+1.6e-3*(p_partkey%100)+3e-4 AS lon, 3.7705e1+9e-4*CAST(floor(p_partkey/100) AS BIGINT)+2e-4 AS lat FROM part)"""

POIS = f"""pois AS (SELECT s_suppkey AS row_id, 'poi-'||s_suppkey AS id, ['charger','locker','rack','moto'][s_suppkey%4+1] AS kind, CASE WHEN s_suppkey%5=0 THEN NULL ELSE s_name END AS name,
  CASE WHEN s_suppkey%3=0 THEN NULL ELSE s_nationkey||' Dock St' END AS address,
  -1.2253e2+(s_suppkey*7919%160000)/1e6 AS lon, 3.7705e1+(s_suppkey*104729%({N}*9))/1e6 AS lat FROM supplier)"""

POINTS = f"""points AS (SELECT o_orderkey AS point_id, ['scooter','emb','euc','ebike_c1','ebike_c2','ebike_c3','moped','emoto'][o_orderkey%8+1] AS vehicle,
  -1.2253e2+(o_custkey*6151%160000)/1e6 AS lon, 3.7705e1+(o_custkey*3571%({N}*9))/1e6 AS lat FROM orders)"""

TRIPS = f"""trips0 AS (SELECT o_orderkey AS req_id, {N} AS n, 31*o_orderkey%{N} AS a FROM orders),
trips1 AS (SELECT req_id, a, n, a+least(req_id%5, 99-a%100) AS e FROM trips0),
trips2 AS (SELECT req_id, a, e+CASE WHEN e+100*(req_id%3)<n THEN 100*(req_id%3) ELSE 0 END AS b FROM trips1),
trips AS (SELECT req_id, ['scooter','emb','euc','ebike_c1','ebike_c2','ebike_c3','moped','emoto'][req_id%8+1] AS vehicle,
  -1.2253e2+1.6e-3*(a%100)+CASE WHEN req_id%7=0 THEN 5e-4 ELSE 0e0 END AS start_lon, 3.7705e1+9e-4*CAST(floor(a/100) AS BIGINT) AS start_lat,
  -1.2253e2+1.6e-3*(b%100) AS end_lon, 3.7705e1+9e-4*CAST(floor(b/100) AS BIGINT) AS end_lat FROM trips2)"""

FAR_TRIPS = f"""trips0 AS (SELECT s_suppkey AS req_id, 37*s_suppkey%{N} AS a, (7919*s_suppkey+53)%{N} AS b FROM supplier),
trips AS (SELECT req_id, ['scooter','emb','euc','ebike_c1','ebike_c2','ebike_c3','moped','emoto'][req_id%8+1] AS vehicle,
  -1.2253e2+1.6e-3*(a%100) AS start_lon, 3.7705e1+9e-4*CAST(floor(a/100) AS BIGINT) AS start_lat, -1.2253e2+1.6e-3*(b%100) AS end_lon, 3.7705e1+9e-4*CAST(floor(b/100) AS BIGINT) AS end_lat FROM trips0)"""
