"""Queries over points: nearest joins, parking, feeds, clusters, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params
from ..functions import geo, policy, text
from ..operators import parking, spatial
from ..session import Workspace, table
from ..sources import landed, sinks
from . import compiled, derive
from . import sqltext as q
from .catalog import query


def _nearest_sql(rank: int) -> str:
    return f"""WITH {q.POIS}, {q.POINTS}, spots AS (SELECT DISTINCT lon, lat FROM points),
d AS (SELECT p.lon AS plon, p.lat AS plat, s.id, s.row_id, sqrt(pow((s.lon-p.lon)*cos(radians(p.lat)),2)+pow(s.lat-p.lat,2)) AS flat, {q.hav('p.lon','p.lat','s.lon','s.lat')} AS m FROM spots p, pois s WHERE s.kind='charger'),
r AS (SELECT *, row_number() OVER (PARTITION BY plon, plat ORDER BY round(flat,12), row_id) AS rk FROM d)
SELECT p.point_id, CAST(r.rk AS INTEGER) AS rank, r.id, round(r.m,3) AS dist_m FROM points p JOIN r ON r.plon=p.lon AND r.plat=p.lat WHERE rk<={rank}"""


@query("nearest_stations", _nearest_sql(5))
def nearest_stations(spark, sf):
    """The five nearest chargers of every request point."""
    ws = Workspace(spark, "knn")
    points = derive.riders_at(spark, sf)
    found = spatial.nearest_k(points, derive.pois(spark, sf).where("kind = 'charger'").select("row_id", "id", "lon", "lat"), 5, ws)
    return points.select("point_id", F.col("lon").alias("plon"), F.col("lat").alias("plat")).join(found, ["plon", "plat"]).select(
        "point_id", "rank", "id", F.round("dist_m", 3).alias("dist_m"))


REVERSE = f"""{q.ADDR}, {q.POINTS}, spots AS (SELECT DISTINCT lon, lat FROM points),
d AS (SELECT p.lon AS plon, p.lat AS plat, a.*, {q.flat('p.lon','p.lat','a.lon','a.lat')} AS m FROM spots p JOIN addr a ON a.lat BETWEEN p.lat-2e-3 AND p.lat+2e-3 AND a.lon BETWEEN p.lon-2e-3 AND p.lon+2e-3),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plon, plat ORDER BY round(m,6), row_id) AS rk FROM d WHERE m<=150) WHERE rk=1),
shown AS (SELECT *, number||' '||lower(regexp_replace(street,'\\b0+(\\d)','\\1','g'))[1:-3]||'St' AS address FROM hit)"""


@query("reverse_geocode", f"""WITH {REVERSE}
SELECT p.point_id, h.number, regexp_replace(h.street,'\\b0+(\\d)','\\1','g') AS street, h.unit, round(h.m,3) AS dist_m FROM points p JOIN hit h ON h.plon=p.lon AND h.plat=p.lat""")
def reverse_geocode(spark, sf):
    from ..operators.search import reverse

    points = derive.riders_at(spark, sf)
    found = reverse(points, derive.addresses(spark, sf), Workspace(spark, "reverse"))
    return found.where("dist_m is not null").select("point_id", "number", "street", "unit", F.round("dist_m", 3).alias("dist_m"))


@query("reverse_label", f"""WITH {REVERSE}
SELECT p.point_id, CASE WHEN h.m IS NULL THEN 'Dropped pin' WHEN h.m<=25 THEN h.address ELSE 'Near '||h.address END AS label, h.address, round(h.m,1) AS dist_m
FROM points p LEFT JOIN shown h ON h.plon=p.lon AND h.plat=p.lat""")
def reverse_label(spark, sf):
    from ..operators.search import point_labels, reverse

    found = reverse(derive.riders_at(spark, sf), derive.addresses(spark, sf), Workspace(spark, "labels"))
    return point_labels(found).select("point_id", "label", "address", F.round("dist_m", 1).alias("dist_m"))


PARK = f"""{q.POIS}, {q.POINTS}, fits(vehicle, kind) AS (SELECT v.vehicle, k.kind FROM (SELECT DISTINCT vehicle FROM points) v, (VALUES ('charger'),('locker'),('rack'),('moto')) k(kind)
  WHERE CASE WHEN v.vehicle IN ('moped','emoto') THEN k.kind IN ('charger','moto') ELSE k.kind<>'moto' END),
spots AS (SELECT DISTINCT f.kind, p.lon, p.lat FROM points p JOIN fits f USING (vehicle)),
d AS (SELECT p.lon AS plon, p.lat AS plat, s.*, {q.hav('p.lon','p.lat','s.lon','s.lat','6371008.8e0')} AS m FROM spots p JOIN pois s USING (kind) WHERE {q.box(params.SERVICE_BOX,'s.lon','s.lat')}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, plon, plat ORDER BY round(m,6), row_id) AS rk FROM d WHERE m<=1609) WHERE rk=1),
park AS (SELECT p.point_id, p.vehicle, p.lon AS plon, p.lat AS plat, b.kind, b.id, b.name, b.lon, b.lat, b.m FROM points p JOIN fits f USING (vehicle) JOIN best b ON b.kind=f.kind AND b.plon=p.lon AND b.plat=p.lat)"""


@query("park_near", f"""WITH {PARK}
SELECT point_id, vehicle, kind, id, CASE kind WHEN 'charger' THEN coalesce(name,'Charging station') WHEN 'locker' THEN coalesce(name,'BikeLink locker')
  WHEN 'moto' THEN 'Motorcycle parking'||coalesce(' · '||name,'') ELSE 'Bike rack'||coalesce(' · '||name,'') END AS label, round(m,3) AS dist_m FROM park""")
def park_near(spark, sf):
    found = parking.nearest_parking(derive.riders_at(spark, sf), derive.pois(spark, sf), Workspace(spark, "park"))
    return found.select("point_id", "vehicle", "kind", "id", "label", F.round("dist_m", 3).alias("dist_m"))


@query("parking_layers", f"""WITH {q.POIS}, v(vehicle) AS (SELECT DISTINCT ['scooter','emb','euc','ebike_c1','ebike_c2','ebike_c3','moped','emoto'][o_orderkey%8+1] FROM orders)
SELECT v.vehicle, p.kind, count(*) AS pins FROM pois p, v WHERE CASE WHEN v.vehicle IN ('moped','emoto') THEN p.kind IN ('charger','moto') ELSE true END GROUP BY ALL""")
def parking_layers(spark, sf):
    """The four layers as one, and how many pins each vehicle sees."""
    pois = derive.pois(spark, sf)
    parts = [pois.where(F.col("kind") == k).drop("kind") for k in ("charger", "locker", "rack", "moto")]
    counts = parking.all_parking(*parts).groupBy("kind").agg(F.count("*").alias("pins"))
    return parking.pins(counts, params.vehicles(spark)).select("vehicle", "kind", "pins")




@query("pin_clusters", f"""WITH {q.POIS}, z AS (SELECT CAST(unnest(range(0,15)) AS INTEGER) AS zoom),
b AS (SELECT zoom, CAST(floor((lon+180)/360*8388608/pow(2,14-zoom)/55) AS BIGINT) AS bx,
  CAST(floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*8388608/pow(2,14-zoom)/55) AS BIGINT) AS byy, lon, lat FROM pois, z)
SELECT zoom, bx, byy AS "by", count(*) AS pins, round(sum(lon),6) AS lon_sum, round(sum(lat),6) AS lat_sum FROM b GROUP BY zoom, bx, byy""")
def pin_clusters(spark, sf):
    found = spatial.grid_clusters(derive.pois(spark, sf).select("lon", "lat"), range(0, 15))
    return found.select("zoom", "bx", "by", "pins", F.round(F.col("lon") * F.col("pins"), 6).alias("lon_sum"), F.round(F.col("lat") * F.col("pins"), 6).alias("lat_sum"))


@query("moto_sites", f"""WITH n AS (SELECT {q.N} AS n), sp AS (SELECT l_orderkey*8+l_linenumber AS space_id, CASE WHEN l_suppkey%11=0 THEN NULL ELSE 'bf-'||l_suppkey END AS bf,
  (1+l_suppkey%9)||'th Ave' AS street, CAST(l_partkey%500 AS VARCHAR) AS num, CASE l_returnflag WHEN 'A' THEN 'M' WHEN 'R' THEN 'U' ELSE 'L' END AS flag, CASE l_linestatus WHEN 'O' THEN 'ON' ELSE 'OFF' END AS onoff,
  -1.2253e2+(l_suppkey*7919%160000)/1e6+(l_partkey%10)*1e-5 AS lon, 3.7705e1+(l_suppkey*104729%(n*9))/1e6 AS lat FROM lineitem, n),
k AS (SELECT *, coalesce(bf, printf('%.4f,%.4f',lon,lat)) AS site FROM sp WHERE flag<>'L' AND {q.box(params.EXTRACT_BOX)}),
m AS (SELECT site, street, onoff, avg(lon) AS mlon, avg(lat) AS mlat, count(*) AS spaces, count(*) FILTER (flag IN ('M','P')) AS metered FROM k GROUP BY ALL),
r AS (SELECT k.site, k.street, k.onoff, k.num, row_number() OVER (PARTITION BY k.site, k.street, k.onoff ORDER BY round(pow(lon-mlon,2)+pow(lat-mlat,2),15), space_id, k.num) AS rk FROM k JOIN m USING (site, street, onoff))
SELECT 'moto-'||site||'-'||lower(onoff) AS id, m.street AS name, CASE WHEN r.num<>'0' THEN r.num||' '||m.street ELSE m.street END AS address, spaces, metered, onoff='OFF' AS offstreet, CAST(printf('%.5f',mlon) AS DOUBLE) AS lon, CAST(printf('%.5f',mlat) AS DOUBLE) AS lat
FROM m JOIN r USING (site, street, onoff) WHERE rk=1""")
def moto_sites(spark, sf):
    return parking.motorcycle_sites(derive.meter_spaces(spark, sf))


@query("lockers_clean", f"""WITH {q.POIS}
SELECT 'bl-'||row_id AS id, coalesce(name,'') AS name, ['eLocker','eRack','Group Parking','Bike Hangar'][row_id%5+1] AS facility_type, address, CASE WHEN row_id%2=0 THEN 'SF' END AS city,
  CAST(row_id%9 AS INTEGER) AS num_spaces, CASE WHEN row_id%3=0 THEN 'App|Card' WHEN row_id%3=1 THEN 'App' ELSE '' END AS access_devices, CAST(printf('%.5f',lon) AS DOUBLE) AS lon, CAST(printf('%.5f',lat) AS DOUBLE) AS lat
FROM pois WHERE row_id%7<>0 AND row_id%5<>4 AND {q.box(params.EXTRACT_BOX)}""")
def lockers_clean(spark, sf):
    raw = derive.pois(spark, sf).selectExpr(
        "cast(row_id as string) as url_id", "concat(' ', name, ' ') as human_name", "concat(address, ' ') as street_address", "if(row_id % 2 = 0, 'SF ', ' ') as city",
        "lon as longitude", "lat as latitude", "element_at(array('eLocker','eRack','Group Parking','Bike Hangar','Card Vendor'), cast(row_id % 5 as int) + 1) as location_friendly_type",
        "row_id % 7 = 0 as coming_soon", "cast(row_id % 9 as int) as num_spaces",
        """case row_id % 3 when 0 then array(named_struct('key','a','name','App'), named_struct('key','c','name','Card')) when 1 then array(named_struct('key','a','name','App')) end as access_device_types""")
    return landed.lockers(raw).withColumn("access_devices", F.array_join("access_devices", "|"))


@query("racks_clean", f"""WITH {q.ADDR}
SELECT 'rack-'||row_id AS id, CASE WHEN row_id%3=0 THEN number||' '||street WHEN row_id%3=1 THEN 'Dock Mill Street' ELSE 'Bike rack' END AS name, CASE WHEN row_id%4=0 THEN 'Plaza' END AS landmark, 'Sidewalk' AS placement,
  CASE WHEN row_id%5<>0 THEN CAST(row_id%5 AS INTEGER) END AS racks, CAST(row_id%7 AS INTEGER) AS spaces, CASE WHEN row_id%2=0 THEN 2000+CAST(row_id%20 AS INTEGER) END AS install_yr, CAST(printf('%.5f',lon) AS DOUBLE) AS lon, CAST(printf('%.5f',lat) AS DOUBLE) AS lat
FROM addr WHERE {q.box(params.EXTRACT_BOX)}""")
def racks_clean(spark, sf):
    raw = derive.addresses(spark, sf).selectExpr(
        "cast(row_id as string) as objectid", "if(row_id % 3 = 0, concat(number, ' ', street, ' '), '') as address", "if(row_id % 4 = 0, ' Plaza', null) as location",
        "if(row_id % 3 = 1, 'DOCK MILL', null) as street", "'SIDEWALK' as placement", "if(row_id % 5 = 0, 'n/a', cast(row_id % 5 as string)) as racks",
        "cast(row_id % 7 as string) as spaces", "if(row_id % 2 = 0, cast(2000 + row_id % 20 as string), '') as install_yr",
        "named_struct('type', 'Point', 'coordinates', array(lon, lat)) as shape")
    return landed.racks(raw)


@query("page_payload", """SELECT CAST(page_id AS VARCHAR) AS url_id, url AS human_name, html AS street_address, CAST(page_id%9 AS INTEGER) AS num_spaces FROM pages
UNION ALL SELECT page_id||'-b', url||' "&" <b>', NULL, NULL FROM pages""")
def page_payload(spark, sf):
    """Records landed as escaped JSON in a page attribute, read back whole."""
    pages = table(spark, sf, "pages")
    record = """to_json(array(named_struct('url_id', cast(page_id as string), 'human_name', url, 'street_address', html, 'num_spaces', cast(page_id % 9 as int)),
        named_struct('url_id', concat(page_id, '-b'), 'human_name', concat(url, ' "&" <b>'), 'street_address', null, 'num_spaces', null)))"""
    escaped = "replace(replace(replace(replace({}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')".format(record)
    landed_pages = pages.select(F.expr(f"concat('<div data-maps--map-locations-value=\"', {escaped}, '\"></div>', html)").alias("html"))
    return landed.page_locations(landed_pages).select("url_id", "human_name", "street_address", "num_spaces")


@query("exempt_turns", f"""WITH {q.NODES}
SELECT node_id AS rule_id, CASE WHEN s%4=0 THEN 'only_right_turn' ELSE 'no_left_turn' END AS restriction, round(lon,6) AS via_lon, round(lat,6) AS via_lat,
  'Row '||y||' St|Row '||y||' St West' AS from_names, CASE WHEN s%5=0 THEN '' ELSE 'Col '||x||' Ave' END AS to_names FROM nodes WHERE s%3<>0 AND s%7<>0""")
def exempt_turns(spark, sf):
    """Turn rules parsed from payloads of relations, ways and nodes."""
    way = "named_struct('type','way','id',{id},'tags',map('name',{name}),'members',null,'lon',null,'lat',null)"
    empty = "cast(null as array<struct<type:string,ref:bigint,role:string>>)"
    elements = f"""to_json(named_struct('elements', array(
        named_struct('type','relation','id',node_id,'tags',map('restriction', if(s % 4 = 0,'only_right_turn','no_left_turn'), 'except', if(s % 3 = 0,'psv','psv;bicycle')),
          'members', array(named_struct('type','way','ref',4*node_id,'role','from'), named_struct('type','way','ref',4*node_id+1,'role','from'),
            named_struct('type','way','ref',4*node_id+2,'role','to'), named_struct('type',if(s % 7 = 0,'way','node'),'ref',node_id,'role','via')), 'lon', cast(null as double), 'lat', cast(null as double)),
        named_struct('type','way','id',4*node_id,'tags',map('name',concat('Row ',y,' St West'),'k','v'),'members',{empty},'lon',null,'lat',null),
        named_struct('type','way','id',4*node_id+1,'tags',map('name',concat('Row ',y,' St'),'k','v'),'members',{empty},'lon',null,'lat',null),
        named_struct('type','way','id',4*node_id+2,'tags',if(s % 5 = 0, map('k','v','l','w'), map('name',concat('Col ',x,' Ave'),'k','v')),'members',{empty},'lon',null,'lat',null),
        named_struct('type','node','id',node_id,'tags',map('k','v','l','w'),'members',{empty},'lon',lon,'lat',lat))))"""
    del way
    payloads = derive.nodes(spark, sf).select(F.expr(elements).alias("payload"))
    found = landed.turn_rules(payloads)
    return found.select("rule_id", "restriction", F.round("via_lon", 6).alias("via_lon"), F.round("via_lat", 6).alias("via_lat"),
                        F.array_join("from_names", "|").alias("from_names"), F.array_join("to_names", "|").alias("to_names"))


@query("in_city_points", f"""WITH {q.POINTS} SELECT {q.IN_CITY} AS in_city, count(*) AS points FROM points GROUP BY 1""")
def in_city_points(spark, sf):
    return derive.riders_at(spark, sf).groupBy(geo.in_service_area("lon", "lat").alias("in_city")).agg(F.count("*").alias("points"))


@query("stations_by_name", f"""WITH {q.POIS} SELECT id, name, address, CAST(printf('%.5f',lon) AS DOUBLE) AS lon, CAST(printf('%.5f',lat) AS DOUBLE) AS lat, row_number() OVER (ORDER BY lower(coalesce(name,'')), id) AS pos FROM pois WHERE kind='charger'""")
def stations_by_name(spark, sf):
    """Stations out of place records, listed by name. The list order is a
    range-partitioned sort; the position is added for the check alone, from
    counts per sorted partition."""
    from ..operators.search import positions

    raw = derive.pois(spark, sf).selectExpr(
        "id", "if(kind = 'charger', 'ev_charging_station', kind) as basic_category", "named_struct('primary', name) as names",
        "named_struct('names', named_struct('primary', cast(null as string))) as brand", "if(address is null, null, array(named_struct('freeform', address))) as addresses",
        "cast(null as array<string>) as phones", "cast(null as array<string>) as websites", "0.5e0 as confidence", "named_struct('lon', lon, 'lat', lat) as p")
    ordered = landed.stations(raw).orderBy(F.lower(F.coalesce("name", F.lit(""))), "id")
    return positions(ordered, Workspace(spark, "stations")).select("id", "name", "address", "lon", "lat", "pos")


@query("layer_counts", f"""WITH RECURSIVE {q.GRAPH}, {q.ADDR}
SELECT 'nodes' AS layer, count(*) AS rows FROM nodes UNION ALL SELECT 'segments', count(*) FROM segs UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'addresses', count(*) FROM addr UNION ALL SELECT 'places', count(*) FROM part UNION ALL SELECT 'pois', count(*) FROM supplier""")
def layer_counts(spark, sf):
    return sinks.layer_counts({
        "nodes": derive.nodes(spark, sf), "segments": derive.segments(spark, sf), "edges": compiled.edges(spark, sf),
        "addresses": derive.addresses(spark, sf), "places": derive.places(spark, sf), "pois": derive.pois(spark, sf)})


@query("geo_measures", f"""WITH {q.TRIPS}
SELECT req_id, round({q.hav('start_lon','start_lat','end_lon','end_lat')},3) AS meters, round({q.flat('start_lon','start_lat','end_lon','end_lat')},3) AS flat_m,
  CASE WHEN start_lon=end_lon AND start_lat=end_lat THEN 'north' ELSE ['north','northeast','east','southeast','south','southwest','west','northwest'][CAST(floor(brg/45+5e-1) AS INTEGER)%8+1] END AS heads, round(brg,2) AS bearing
FROM (SELECT *, ((degrees(atan2(sin(radians(end_lon-start_lon))*cos(radians(end_lat)), cos(radians(start_lat))*sin(radians(end_lat))-sin(radians(start_lat))*cos(radians(end_lat))*cos(radians(end_lon-start_lon))))%360)+360)%360 AS brg FROM trips)""")
def geo_measures(spark, sf):
    t = derive.trips(spark, sf)
    brg = geo.bearing("start_lon", "start_lat", "end_lon", "end_lat")
    ends = ("start_lon", "start_lat", "end_lon", "end_lat")
    return t.select("req_id", F.round(geo.haversine(*ends), 3).alias("meters"), F.round(geo.flat_distance(*ends), 3).alias("flat_m"),
                    geo.cardinal(brg).alias("heads"), F.round(brg, 2).alias("bearing"))


@query("turn_angles", f"""WITH {q.TRIPS}, a AS (SELECT req_id, (req_id*37%3600)/1e1 AS before, (req_id*91%3600)/1e1 AS after FROM trips),
b AS (SELECT *, ((after-before+540)%360+360)%360-180 AS ang FROM a)
SELECT req_id, round(ang,1) AS angle, CASE WHEN abs(ang)<=25 THEN 'straight' WHEN abs(ang)>=150 THEN 'uturn' WHEN abs(ang)<60 THEN 'slight_'||CASE WHEN ang>0 THEN 'right' ELSE 'left' END ELSE CASE WHEN ang>0 THEN 'right' ELSE 'left' END END AS maneuver,
  round(least(abs(before-after)%360,360-abs(before-after)%360),1) AS gap FROM b""")
def turn_angles(spark, sf):
    t = derive.trips(spark, sf).selectExpr("req_id", "(req_id * 37 % 3600) / 1e1 as before", "(req_id * 91 % 3600) / 1e1 as after")
    angle = geo.turn_angle("before", "after")
    return t.select("req_id", F.round(angle, 1).alias("angle"), policy.maneuver(angle).alias("maneuver"), F.round(geo.undirected_gap("before", "after"), 1).alias("gap"))


@query("distance_texts", """WITH v AS (SELECT o_orderkey AS req_id, o_totalprice/7e1 AS m FROM orders), f AS (SELECT *, m*3.28084e0 AS ft FROM v)
SELECT req_id, CASE WHEN m<1.609344e2 THEN CAST(round_even(ft/CASE WHEN ft<97.5 THEN 5e0 ELSE 1e1 END,0)*CASE WHEN ft<97.5 THEN 5 ELSE 10 END AS BIGINT)||' ft' ELSE printf('%.1f mi', m/1.609344e3) END AS shown,
  greatest(1,CAST(floor(m/6e1+5e-1) AS BIGINT))||' min' AS minutes,
  CASE WHEN ft<1000 THEN greatest(50,CAST(floor(ft/5e1+5e-1)*50 AS BIGINT))||' feet' ELSE printf('%.1f miles', m/1.609344e3) END AS spoken FROM f""")
def distance_texts(spark, sf):
    v = table(spark, sf, "orders").selectExpr("o_orderkey as req_id", "o_totalprice / 7e1 as m")
    return v.select("req_id", geo.distance_text("m").alias("shown"), geo.minutes_text("m").alias("minutes"), geo.spoken_distance("m").alias("spoken"))


@query("address_labels", f"""WITH {q.ADDR}, u AS (SELECT *, regexp_replace(street,'\\b0+(\\d)','\\1','g') AS st FROM addr)
SELECT row_id, number||' '||lower(st)[1:-3]||'St' AS shown, number||' '||st||coalesce(' ('||unit||')','') AS label, st AS street FROM u""")
def address_labels(spark, sf):
    a = derive.addresses(spark, sf).withColumn("st", text.unpadded_street("street"))
    return a.select("row_id", text.display_address("number", "st").alias("shown"), text.address_label("number", "st", "unit").alias("label"), F.col("st").alias("street"))
