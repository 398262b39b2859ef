"""Queries over the street graph: edges, access, cost, rules, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params
from ..functions import geo, policy
from ..operators import bikeways, components, elevation, roads
from ..session import Workspace, table
from . import compiled, derive
from . import sqltext as q
from .catalog import query

WITH = "WITH RECURSIVE "


@query("vehicle_edge_costs", f"""{WITH}{q.GRAPH},\n{q.ACCESS}
SELECT vehicle, category, count(*) AS edges, round(sum(length_m),1) AS length_m, round(sum({q.COST}),1) AS cost, round(sum({q.SECONDS}),1) AS seconds
FROM access GROUP BY vehicle, category""")
def vehicle_edge_costs(spark, sf):
    """The flagship: what each vehicle may ride, by category, and its cost."""
    who = roads.edge_access(compiled.edges(spark, sf), params.vehicles(spark))
    return (
        who.withColumn("cost", policy.edge_cost("profile", "category", "length_m", "climb_m"))
        .withColumn("seconds", policy.edge_seconds("cap_mph", "profile", "category", "eff_mph", "length_m", "climb_m"))
        .groupBy("vehicle", "category")
        .agg(F.count("*").alias("edges"), F.round(F.sum("length_m"), 1).alias("length_m"),
             F.round(F.sum("cost"), 1).alias("cost"), F.round(F.sum("seconds"), 1).alias("seconds"))
    )


@query("graph_edges", f"""{WITH}{q.GRAPH}
SELECT edge_id, seg_id, heading, from_node, to_node, round(length_m,3) AS length_m, name, category, CAST(eff_mph AS DOUBLE) AS eff_mph, posted_mph FROM edges""")
def graph_edges(spark, sf):
    return compiled.edges(spark, sf).select(
        "edge_id", "seg_id", "heading", "from_node", "to_node", F.round("length_m", 3).alias("length_m"), "name", "category", "eff_mph", "posted_mph")


@query("edge_geometry", f"""{WITH}{q.GRAPH}
SELECT edge_id, 0 AS pos, round(flon,6) AS lon, round(flat,6) AS lat FROM edges UNION ALL SELECT edge_id, 1, round(tlon,6), round(tlat,6) FROM edges""")
def edge_geometry(spark, sf):
    points = compiled.edges(spark, sf).select("edge_id", F.posexplode("geometry").alias("pos", "p"))
    return points.select("edge_id", "pos", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("edge_category_stats", f"""{WITH}{q.GRAPH}
SELECT category, class, count(*) AS edges, round(sum(length_m),1) AS length_m, max(posted_mph) AS max_posted FROM edges GROUP BY category, class""")
def edge_category_stats(spark, sf):
    return compiled.edges(spark, sf).groupBy("category", "class").agg(
        F.count("*").alias("edges"), F.round(F.sum("length_m"), 1).alias("length_m"), F.max("posted_mph").alias("max_posted"))


@query("vehicle_access", f"""{WITH}{q.GRAPH},\n{q.ACCESS}
SELECT edge_id, vehicle FROM access""")
def vehicle_access(spark, sf):
    return roads.edge_access(compiled.edges(spark, sf), params.vehicles(spark)).select("edge_id", "vehicle")


@query("edges_per_vehicle", f"""{WITH}{q.GRAPH},\n{q.ACCESS}
SELECT vehicle, count(*) AS edges, count(DISTINCT from_node) AS out_nodes, count(DISTINCT to_node) AS in_nodes FROM access GROUP BY vehicle""")
def edges_per_vehicle(spark, sf):
    return roads.vehicle_counts(compiled.edges(spark, sf), params.vehicles(spark))


@query("edge_costs", f"""{WITH}{q.GRAPH},\n{q.ACCESS}
SELECT edge_id, vehicle, round({q.COST},3) AS cost, round({q.HILL_COST},3) AS hill, round(climb_m,3) AS climb_m FROM access""")
def edge_costs(spark, sf):
    who = roads.edge_access(compiled.edges(spark, sf), params.vehicles(spark))
    return who.select("edge_id", "vehicle", F.round(policy.edge_cost("profile", "category", "length_m", "climb_m"), 3).alias("cost"),
                      F.round(policy.hill_cost("profile", "length_m", "climb_m"), 3).alias("hill"), F.round("climb_m", 3).alias("climb_m"))


@query("edge_durations", f"""{WITH}{q.GRAPH},\n{q.ACCESS}
SELECT edge_id, vehicle, round({q.MPH},3) AS mph, round({q.SECONDS},3) AS seconds FROM access""")
def edge_durations(spark, sf):
    who = roads.edge_access(compiled.edges(spark, sf), params.vehicles(spark))
    return who.select("edge_id", "vehicle", F.round(policy.travel_mph("cap_mph", "category", "eff_mph"), 3).alias("mph"),
                      F.round(policy.edge_seconds("cap_mph", "profile", "category", "eff_mph", "length_m", "climb_m"), 3).alias("seconds"))


@query("node_degrees", f"""{WITH}{q.GRAPH}
SELECT node_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT from_node AS node_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT to_node, 0, 1 FROM edges) GROUP BY node_id""")
def node_degrees(spark, sf):
    ends = compiled.edges(spark, sf).select(F.explode(F.array(
        F.struct(F.col("from_node").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("to_node").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


RULES = """rules AS (SELECT l_orderkey AS seg_id, CASE l_returnflag WHEN 'A' THEN 'denied' WHEN 'N' THEN 'designated' ELSE 'allowed' END AS kind,
  CASE l_linenumber%3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS mask, l_partkey%4 AS m, l_suppkey%7=0 AS scoped,
  l_quantity<35 AS whole, CASE WHEN l_quantity<15 THEN 0e0 WHEN l_quantity<35 THEN 1e0 ELSE 5e-1 END AS span,
  CASE WHEN l_partkey%5=0 THEN (15+5*(l_suppkey%8))*6.21371e-1 ELSE (15+5*(l_suppkey%8))*1e0 END AS mph FROM lineitem)"""


@query("access_masks", f"""WITH {RULES}
SELECT seg_id, 3-bit_or(CASE WHEN kind='denied' AND NOT scoped AND whole AND m IN (0,1) THEN mask ELSE 0 END) AS ow,
  3-bit_or(CASE WHEN kind='denied' AND NOT scoped AND whole AND m IN (0,2) THEN mask ELSE 0 END) AS ow_moto,
  bit_or(CASE WHEN kind='designated' AND whole AND m=1 THEN mask ELSE 0 END) AS bike_desig FROM rules GROUP BY seg_id""")
def access_masks(spark, sf):
    return roads.access_masks(derive.segment_rules(spark, sf))


@query("posted_speed", f"""WITH {RULES}, ranked AS (SELECT seg_id, mph, row_number() OVER (PARTITION BY seg_id ORDER BY span DESC, mph) AS r FROM rules WHERE m IN (0,1))
SELECT seg_id, CAST(round_even(mph,0) AS INTEGER) AS speed FROM ranked WHERE r=1""")
def posted_speed(spark, sf):
    return roads.posted_speeds(derive.segment_rules(spark, sf))


@query("prohib_resolved", f"""{WITH}{q.NODES},\n{q.SEGS},\n{q.BANS}
SELECT from_seg, bit, at_node, to_seg, moto_only FROM bans""")
def prohib_resolved(spark, sf):
    """Bans by heading, and whether bicycles are exempt."""
    return compiled.bans(spark, sf)


@query("turn_table", f"""{WITH}{q.GRAPH},\n{q.ACCESS},\n{q.BANS},\n{q.TURNS}
SELECT who, in_edge, out_edge, node FROM turns""")
def turn_table(spark, sf):
    return compiled.turns(spark, sf)


@query("signposts", f"""{WITH}{q.NODES},\n{q.SEGS}
SELECT 2*(node_id-1) AS from_seg, 2*node_id+1 AS to_seg, node_id AS at_node, 'District '||s AS label, 1+s%3 AS mask FROM nodes WHERE s%7=0 AND x>0 AND node_id+100<{q.N}""")
def signposts(spark, sf):
    found = roads.resolved_signs(derive.signs(spark, sf), derive.segments(spark, sf), derive.nodes(spark, sf))
    return found.drop("pos")


@query("speed_inheritance", f"""{WITH}{q.NODES},\n{q.SEGS},\n{q.INFERRED}
SELECT seg_id, inferred FROM inferred""")
def speed_inheritance(spark, sf):
    return compiled.inferred_speeds(spark, sf)


LINES = f"""lines AS (SELECT node_id AS line_id, CAST(1+CAST(floor(y/4) AS BIGINT)%4 AS INTEGER) AS cls, CASE WHEN x%3=0 THEN 'E' END AS dir, x%6=0 AS contra,
  lon AS alon, lat+3e-5 AS alat, -1.2253e2+1.6e-3*(x+1) AS blon, lat+3e-5 AS blat FROM nodes WHERE y%4=0 AND x<99 AND node_id+1<{q.N})"""
KX = "1.1132e5*cos(radians(3.770503e1))"
GAP = "least(abs(lb-sb)%360, 360-abs(lb-sb)%360)"
MATCH = f"""{LINES},
pieces AS (SELECT *, alon*{KX} AS ax, alat*1.10574e5 AS ay, blon*{KX} AS bx, blat*1.10574e5 AS byy FROM lines),
samples AS (SELECT seg_id, class, f, alon+(blon-alon)*f AS lon, alat+(blat-alat)*f AS lat,
   ((degrees(atan2((blon-alon)*{KX},(blat-alat)*1.10574e5))%360)+360)%360 AS brg FROM segs, (VALUES (2.5e-1),(5e-1),(7.5e-1)) v(f)),
near AS (SELECT s.seg_id, s.f, s.brg, l.cls, l.dir, l.contra,
   greatest(0e0, least(1e0, ((s.lon*{KX}-l.ax)*(l.bx-l.ax)+(s.lat*1.10574e5-l.ay)*(l.byy-l.ay))/(pow(l.bx-l.ax,2)+pow(l.byy-l.ay,2)))) AS t, s.lon*{KX} AS px, s.lat*1.10574e5 AS py, l.ax, l.ay, l.bx, l.byy,
   degrees(atan2(l.bx-l.ax,l.byy-l.ay))%180 AS lb, s.brg%180 AS sb, s.class
   FROM samples s JOIN pieces l ON s.lat BETWEEN l.alat-2e-4 AND l.alat+2e-4 AND s.lon BETWEEN l.alon-2e-4 AND l.blon+2e-4),
hits AS (SELECT * FROM near WHERE {GAP}<=30 AND sqrt(pow(px-ax-t*(bx-ax),2)+pow(py-ay-t*(byy-ay),2))<=12
   AND CASE WHEN class='footway' THEN cls=1 WHEN class IN ('cycleway','path','track','pedestrian') THEN cls IN (1,4) ELSE cls IN (2,3,4) END),
votes AS (SELECT seg_id, o.h AS h, f, cls, bool_or(contra AND dir IS NOT NULL AND cls IN (1,2,4)) AS lane FROM hits, (VALUES (0),(1)) o(h)
   WHERE dir IS NULL OR least(abs(90-((brg+180*o.h)%360))%360, 360-abs(90-((brg+180*o.h)%360))%360)<90 GROUP BY ALL),
won AS (SELECT seg_id, h, cls FROM votes GROUP BY ALL HAVING count(DISTINCT f)>=2),
best AS (SELECT seg_id, h, arg_max(cls, CASE cls WHEN 4 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END) AS cls FROM won GROUP BY ALL),
lanes AS (SELECT seg_id, h FROM votes WHERE lane GROUP BY ALL HAVING count(DISTINCT f)>=2),
bw AS (SELECT b.seg_id, max(CASE WHEN b.h=0 THEN b.cls ELSE 0 END) AS fwd, max(CASE WHEN b.h=1 THEN b.cls ELSE 0 END) AS bwd,
   CAST(sum(CASE WHEN l.seg_id IS NOT NULL AND b.cls IN (1,2,4) THEN b.h+1 ELSE 0 END) AS INTEGER) AS opened FROM best b LEFT JOIN lanes l USING (seg_id, h) GROUP BY b.seg_id)"""


@query("bikeway_match", f"""{WITH}{q.NODES},\n{q.SEGS},\n{MATCH}
SELECT seg_id, fwd, bwd, opened FROM bw""")
def bikeway_match(spark, sf):
    return bikeways.match(derive.segments(spark, sf), derive.bikeways(spark, sf))


@query("surveyed_edges", f"""{WITH}{q.NODES},\n{q.SEGS},\n{q.INFERRED},\n{MATCH},
dir AS (SELECT s.*, (s.ow | coalesce(bw.opened,0)) AS ow2, coalesce(s.speed, i.inferred) AS lim, h.heading, h.heading+1 AS bit, CASE h.heading WHEN 0 THEN coalesce(bw.fwd,0) ELSE coalesce(bw.bwd,0) END AS code
  FROM segs s LEFT JOIN inferred i USING (seg_id) LEFT JOIN bw USING (seg_id), (VALUES (0),(1)) h(heading))
SELECT category, count(*) AS edges, CAST(sum(CASE WHEN (ow2 & bit)<>0 THEN 1 ELSE 0 END) AS BIGINT) AS open_to_bikes FROM (SELECT *, {q.category('code')} AS category FROM dir WHERE ((ow2 | ow_moto) & bit)<>0)
WHERE category IS NOT NULL GROUP BY category""")
def surveyed_edges(spark, sf):
    """The graph with surveyed bikeway classes in place of the map's flag."""
    segments = derive.segments(spark, sf)
    found = roads.edges(segments, compiled.inferred_speeds(spark, sf), bikeways.match(segments, derive.bikeways(spark, sf)))
    return found.groupBy("category").agg(F.count("*").alias("edges"), F.count_if(F.col("ow").bitwiseAND(F.col("bit")) != 0).alias("open_to_bikes"))


@query("bikeway_records", f"""WITH RECURSIVE {q.NODES}, {LINES}
SELECT cls, dir, contra AS contraflow, count(*) AS lines, round(sum({q.hav('alon','alat','blon','blat')})/1e3,3) AS km FROM lines WHERE cls<>3 GROUP BY ALL""")
def bikeway_records(spark, sf):
    """Survey records cleaned from their landed form, those a map draws."""
    raw = derive.bikeways(spark, sf).select(
        F.col("line_id"), F.concat(F.lit(" class "), F.element_at(F.array(*[F.lit(c) for c in ("i", "ii", "iii", "iv")]), F.col("cls"))).alias("facility_t"),
        F.lit(None).cast("string").alias("streetname"), F.concat(F.lower("dir"), F.lit(" ")).alias("dir"),
        F.when(F.col("contraflow"), "yes").alias("contraflow"), F.lit("LineString").alias("geometry_type"), "geometry")
    shown = bikeways.shown(bikeways.records(raw))
    return shown.groupBy("cls", "dir", "contraflow").agg(F.count("*").alias("lines"), F.round(F.sum(geo.line_length(F.col("geometry"))) / 1e3, 3).alias("km"))


DEM = f"""dem AS (SELECT p_partkey%100 AS px, CAST(floor(({q.N}-1)/100) AS BIGINT)-CAST(floor(p_partkey/100) AS BIGINT) AS py,
  (127+p_size%2)*256e0+(p_size*5)%256+((p_partkey*7)%256)/256e0-32768e0 AS elev FROM part)"""
ORIGIN_X = "CAST(floor((-1.2253e2+180)/360*262144) AS BIGINT)"
ORIGIN_Y = f"CAST(floor((1-ln(tan(radians((3.7705e1+9e-4*ceil({q.N}/100e0))))+1/cos(radians((3.7705e1+9e-4*ceil({q.N}/100e0)))))/pi())/2*262144) AS BIGINT)"


@query("elevation_sample", f"""{WITH}{q.ADDR},\n{DEM},
size AS (SELECT max(px) AS mx, max(py) AS my FROM dem),
pt AS (SELECT row_id, (lon+180)/360*262144-{ORIGIN_X}-5e-1 AS fx, (1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*262144-{ORIGIN_Y}-5e-1 AS fy FROM addr),
inn AS (SELECT row_id, fx, fy, CAST(floor(fx) AS BIGINT) AS c0, CAST(floor(fy) AS BIGINT) AS r0, least(CAST(floor(fx) AS BIGINT)+1,mx) AS c1, least(CAST(floor(fy) AS BIGINT)+1,my) AS r1 FROM pt, size WHERE fx>=0 AND fy>=0 AND fx<=mx AND fy<=my),
val AS (SELECT i.row_id, (a.elev*(1-(fx-c0))+b.elev*(fx-c0))*(1-(fy-r0))+(c.elev*(1-(fx-c0))+d.elev*(fx-c0))*(fy-r0) AS e FROM inn i
  JOIN dem a ON a.px=c0 AND a.py=r0 JOIN dem b ON b.px=c1 AND b.py=r0 JOIN dem c ON c.px=c0 AND c.py=r1 JOIN dem d ON d.px=c1 AND d.py=r1)
SELECT a.row_id, round(CASE WHEN v.e IS NOT NULL THEN greatest(v.e,0e0) END,3) AS elev FROM addr a LEFT JOIN val v USING (row_id)""")
def elevation_sample(spark, sf):
    """Ground under each address, from a raster of one pixel per part."""
    pixels = elevation.decoded(derive.dem(spark, sf))
    top = F.lit(37.705) + 9e-4 * F.ceil(derive.n_nodes(spark, sf) / 100.0)
    ox, oy = elevation.origin(-122.53, top, derive.DEM_ZOOM)
    points = derive.addresses(spark, sf).select("row_id", "lon", "lat")
    return elevation.sample(points, pixels, "row_id", derive.DEM_ZOOM, ox, oy).select("row_id", F.round("elev", 3).alias("elev"))


@query("reachable_pairs", f"""{WITH}{q.GRAPH},
hops AS (SELECT DISTINCT from_node AS u, to_node AS v FROM edges),
fwd AS (SELECT node_id AS n, node_id AS r FROM nodes UNION SELECT f.n, h.v FROM fwd f JOIN hops h ON h.u=f.r),
asked AS (SELECT o_orderkey AS pair_id, 31*o_orderkey%{q.N} AS a, 17*o_custkey%{q.N} AS b FROM orders)
SELECT o.pair_id, f.n IS NOT NULL AS reachable FROM asked o LEFT JOIN fwd f ON f.n=o.a AND f.r=o.b""")
def reachable_pairs(spark, sf):
    """Whether any way leads from one junction to another, for a pair per order."""
    ws = Workspace(spark, "reachable")
    asked = table(spark, sf, "orders").withColumn("n", derive.n_nodes(spark, sf)).selectExpr("o_orderkey as pair_id", "31 * o_orderkey % n as a", "17 * o_custkey % n as b")
    comp = compiled.strong(spark, sf).where("who = 'any'")
    of = lambda node, name: comp.select(F.col("node").alias(node), F.col("comp").alias(name))
    asked = ws.write(asked.join(of("a", "src_comp"), "a").join(of("b", "dst_comp"), "b"), "asked")
    arcs = compiled.edges(spark, sf).select("from_node", "to_node").distinct().join(of("from_node", "src_comp"), "from_node").join(of("to_node", "dst_comp"), "to_node")
    dag = ws.write(arcs.where("src_comp <> dst_comp").select("src_comp", "dst_comp").distinct(), "dag")
    ways = components.reachable_pairs(asked, dag, ws).withColumn("reachable", F.lit(True))
    return asked.join(ways, ["src_comp", "dst_comp"], "left").select("pair_id", F.coalesce("reachable", F.lit(False)).alias("reachable"))


@query("strong_components", f"""{WITH}{q.GRAPH},
pairs AS (SELECT DISTINCT from_node AS u, to_node AS v FROM edges),
fwd AS (SELECT node_id AS n, node_id AS r FROM nodes UNION SELECT f.n, p.v FROM fwd f JOIN pairs p ON p.u=f.r),
comp AS (SELECT a.n, min(a.r) AS comp FROM fwd a JOIN fwd b ON a.n=b.r AND a.r=b.n GROUP BY a.n)
SELECT n AS node_id, comp FROM comp""")
def strong_components(spark, sf):
    return compiled.strong(spark, sf).where("who = 'any'").select(F.col("node").alias("node_id"), "comp")


@query("component_arcs", f"""{WITH}{q.GRAPH},
pairs AS (SELECT DISTINCT from_node AS u, to_node AS v FROM edges),
fwd AS (SELECT node_id AS n, node_id AS r FROM nodes UNION SELECT f.n, p.v FROM fwd f JOIN pairs p ON p.u=f.r),
comp AS (SELECT a.n, min(a.r) AS comp FROM fwd a JOIN fwd b ON a.n=b.r AND a.r=b.n GROUP BY a.n)
SELECT DISTINCT a.comp AS src_comp, b.comp AS dst_comp FROM pairs p JOIN comp a ON a.n=p.u JOIN comp b ON b.n=p.v WHERE a.comp<>b.comp""")
def component_arcs(spark, sf):
    arcs = compiled.edges(spark, sf).select(F.col("from_node").alias("u"), F.col("to_node").alias("v"))
    return components.component_arcs(arcs, compiled.strong(spark, sf).where("who = 'any'"))


@query("display_roads", f"""{WITH}{q.NODES},\n{q.SEGS}
SELECT class, count(*) AS features, round(sum(abs(round(blon,5)-round(alon,5))+abs(round(blat,5)-round(alat,5))),5) AS extent FROM segs GROUP BY class""")
def display_roads(spark, sf):
    features = derive.segments(spark, sf).select("class", F.lit("LineString").alias("geometry_type"), F.array("geometry").alias("lines"))
    drawn = roads.display_roads(features).withColumn("line", F.get("lines", 0))
    a, b = F.get("line", 0), F.get("line", 1)
    return drawn.groupBy("class").agg(F.count("*").alias("features"), F.round(F.sum(
        F.abs(b["lon"] - a["lon"]) + F.abs(b["lat"] - a["lat"])), 5).alias("extent"))


@query("vehicle_list", f"""WITH {q.VEHICLES}, used AS (SELECT ['scooter','emb','euc','ebike_c1','ebike_c2','ebike_c3','moped','emoto'][o_orderkey%8+1] AS vehicle, count(*) AS requests FROM orders GROUP BY 1)
SELECT v.ordinal, v.vehicle, v.label, v.routable, v.cap_mph, v.avoids_traffic, v.vehicle='scooter' AS is_default, coalesce(u.requests,0) AS requests FROM vehicles v LEFT JOIN used u USING (vehicle)""")
def vehicle_list(spark, sf):
    """Vehicles in canonical order with how many requests name each."""
    used = derive.trips(spark, sf).groupBy("vehicle").agg(F.count("*").alias("requests"))
    return (
        params.vehicles(spark).join(used, "vehicle", "left").orderBy("ordinal")
        .select("ordinal", "vehicle", "label", "routable", "cap_mph", "avoids_traffic",
                (F.col("vehicle") == params.DEFAULT_VEHICLE).alias("is_default"), F.coalesce("requests", F.lit(0)).alias("requests"))
    )
