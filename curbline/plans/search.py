"""Search queries: addresses, places, everything."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params
from ..operators import places, requests, search
from ..session import Workspace, table
from . import derive
from . import sqltext as q
from .catalog import query


def address_queries(spark, sf):
    """A query per customer: numbered, street only, prefix, padded."""
    return table(spark, sf, "customer").selectExpr(
        "c_custkey as query_id", "4 + (c_custkey * 7) % 15 as k", "c_custkey * 13 % 200 as num").selectExpr(
        "query_id", """case query_id % 6 when 0 then concat(num, ' ', k, 'th st') when 1 then concat(' ', k, 'th  St ') when 2 then concat(num, 'B ', lpad(cast(k as string), 3, '0'), 'TH ST')
            when 3 then concat('1', if(query_id % 4 = 0, '0t', '')) when 4 then concat(k, 'TH ST ', num) else '' end as query""")


ASKED = f"""{q.ADDR}, asked0 AS (SELECT c_custkey AS query_id, 4+(c_custkey*7)%15 AS k, c_custkey*13%200 AS num FROM customer),
asked1 AS (SELECT query_id, CASE query_id%6 WHEN 0 THEN num||' '||k||'th st' WHEN 1 THEN ' '||k||'th  St ' WHEN 2 THEN num||'B '||lpad(CAST(k AS VARCHAR),3,'0')||'TH ST' WHEN 3 THEN '1'||CASE WHEN query_id%4=0 THEN '0t' ELSE '' END WHEN 4 THEN k||'TH ST '||num ELSE '' END AS query FROM asked0)"""


def _address_sql(limit: int) -> str:
    per = max(1, limit // 3)
    return f"""asked AS (SELECT query_id, nullif(regexp_extract(trim(query),'\\b(\\d{{1,6}})[A-Za-z]?\\b',1),'') AS num,
  regexp_replace(upper(trim(regexp_replace(regexp_replace(trim(query),'\\b(\\d{{1,6}})[A-Za-z]?\\b',''),'\\s+',' ','g'))),'\\b0+(\\d)','\\1','g') AS q FROM asked1),
book AS (SELECT *, regexp_replace(street,'\\b0+(\\d)','\\1','g') AS st, min(row_id) OVER (PARTITION BY street) AS bucket FROM addr),
streets AS (SELECT st, min(row_id) AS first FROM book GROUP BY st),
cand AS (SELECT a.q, s.st, row_number() OVER (PARTITION BY a.q ORDER BY s.first) AS rk FROM (SELECT DISTINCT q FROM asked WHERE q<>'') a JOIN streets s ON CASE WHEN EXISTS (SELECT 1 FROM streets z WHERE z.st=a.q) THEN s.st=a.q ELSE starts_with(s.st,a.q) END),
nums AS (SELECT st, number, row_number() OVER (PARTITION BY st ORDER BY min(struct_pack(b:=bucket, r:=row_id))) AS nth FROM book GROUP BY st, number),
heads AS (SELECT st, number FROM nums WHERE nth<={per}),
stops AS (SELECT b.st, b.bucket, min(b.row_id) AS stop FROM book b JOIN nums n ON n.st=b.st AND n.number IS NOT DISTINCT FROM b.number WHERE n.nth>{per} GROUP BY ALL),
readable AS (SELECT b.* FROM book b LEFT JOIN stops s ON s.st=b.st AND s.bucket=b.bucket WHERE s.stop IS NULL OR b.row_id<s.stop),
folded AS (SELECT 'n' AS how, st, number, count(*) AS n, arg_min(struct_pack(unit:=unit, postcode:=postcode, lon:=lon, lat:=lat), struct_pack(u:=unit IS NOT NULL, b:=bucket, r:=row_id)) AS r, min(struct_pack(b:=bucket, r:=row_id)) AS seen FROM book GROUP BY st, number
  UNION ALL SELECT 's', b.st, b.number, count(*), arg_min(struct_pack(unit:=unit, postcode:=postcode, lon:=lon, lat:=lat), struct_pack(u:=unit IS NOT NULL, b:=bucket, r:=row_id)), min(struct_pack(b:=bucket, r:=row_id)) FROM readable b JOIN heads h ON h.st=b.st AND h.number=b.number GROUP BY b.st, b.number),
rows0 AS (SELECT a.query_id, c.rk, f.st, f.number, f.n, f.r, f.seen, CASE WHEN a.num IS NULL THEN 60 ELSE 100 END AS score FROM asked a JOIN cand c ON c.q=a.q AND c.rk<=30 JOIN folded f ON f.st=c.st AND f.how=CASE WHEN a.num IS NULL THEN 's' ELSE 'n' END AND (a.num IS NULL OR f.number=a.num)),
per AS (SELECT query_id, rk, count(*) AS k FROM rows0 GROUP BY ALL),
used AS (SELECT query_id, rk FROM (SELECT *, coalesce(sum(k) OVER (PARTITION BY query_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM per) WHERE before<{2 * limit}),
addr_hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(st), coalesce(number,''), rk, seen) AS INTEGER) AS pos, CASE WHEN NOT (n>1 AND r.unit IS NOT NULL) THEN r.unit END AS unit FROM rows0 JOIN used USING (query_id, rk)),
addr_top AS (SELECT query_id, pos AS rank, number||' '||st||coalesce(' ('||unit||')','') AS text, st AS street, number, unit, r.postcode AS postcode, r.lon AS lon, r.lat AS lat, score FROM addr_hits WHERE pos<={limit})"""


@query("geocode_search", f"""WITH {ASKED}, {_address_sql(10)}
SELECT query_id, rank, text, street, number, unit, postcode, round(lon,6) AS lon, round(lat,6) AS lat, score FROM addr_top""")
def geocode_search(spark, sf):
    found = search.search_addresses(address_queries(spark, sf), derive.addresses(spark, sf), Workspace(spark, "geocode"))
    return found.withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))


REFS = """SELECT query_id AS ref_id, CASE query_id%5 WHEN 0 THEN 'poi-'||(query_id%150) WHEN 1 THEN '' END AS station_id,
  CASE WHEN query_id%5 IN (0,2,3) THEN query END AS query,
  CASE WHEN query_id%5 IN (1,3) THEN -1.2245e2+(query_id%100)*1e-4 END AS lon, CASE WHEN query_id%5=1 THEN 3.775e1 END AS lat,
  CASE WHEN query_id%2=0 THEN 'Spot '||query_id END AS label"""


@query("resolved_requests", f"""WITH {ASKED}, {_address_sql(1)}, refs AS ({REFS} FROM asked1),
n AS (SELECT count(*) AS n FROM part),
poi AS (SELECT 'poi-'||s_suppkey AS id, s_suppkey%4 AS kind, CASE WHEN s_suppkey%5=0 THEN NULL ELSE s_name END AS name,
  -1.2253e2+(s_suppkey*7919%160000)/1e6 AS lon, 3.7705e1+(s_suppkey*104729%(n*9))/1e6 AS lat FROM supplier, n WHERE s_suppkey%4 IN (0,1)),
hit AS (SELECT query_id, text, lon, lat FROM addr_top WHERE rank=1)
SELECT r.ref_id,
  CASE WHEN coalesce(r.station_id,'')<>'' THEN CASE WHEN p.id IS NULL THEN 'unknown_station' END WHEN coalesce(r.query,'')<>'' THEN CASE WHEN h.query_id IS NULL THEN 'address_not_found' END
    WHEN r.lon IS NULL OR r.lat IS NULL THEN 'bad_request' END AS problem,
  round(CASE WHEN coalesce(r.station_id,'')<>'' THEN p.lon WHEN coalesce(r.query,'')<>'' THEN h.lon WHEN r.lat IS NOT NULL THEN r.lon END,6) AS point_lon,
  round(CASE WHEN coalesce(r.station_id,'')<>'' THEN p.lat WHEN coalesce(r.query,'')<>'' THEN h.lat WHEN r.lon IS NOT NULL THEN r.lat END,6) AS point_lat,
  CASE WHEN coalesce(r.station_id,'')<>'' THEN CASE WHEN p.id IS NOT NULL THEN coalesce(p.name, CASE p.kind WHEN 0 THEN 'charging station' ELSE 'BikeLink locker' END) END
    WHEN coalesce(r.query,'')<>'' THEN h.text WHEN r.lon IS NOT NULL AND r.lat IS NOT NULL THEN coalesce(r.label,'map location') END AS point_label
FROM refs r LEFT JOIN poi p ON p.id=r.station_id LEFT JOIN hit h ON h.query_id=r.ref_id""")
def resolved_requests(spark, sf):
    """A reference per customer: a station or locker, an address, a point, or too little."""
    refs = spark.sql(REFS + " FROM {asked}", asked=address_queries(spark, sf))
    pois = derive.pois(spark, sf)
    found = requests.resolve(refs, pois.where("kind = 'charger'"), pois.where("kind = 'locker'"), derive.addresses(spark, sf), Workspace(spark, "requests"))
    return found.select("ref_id", "problem", F.round("point_lon", 6).alias("point_lon"), F.round("point_lat", 6).alias("point_lat"), "point_label")


@query("close_streets")
def close_streets(spark, sf):
    """Misspelled streets and the streets closest to them."""
    typed = table(spark, sf, "customer").selectExpr(
        "c_custkey as query_id", "concat(4 + c_custkey % 15, case c_custkey % 3 when 0 then 'HT ST' when 1 then 'TH STR' else 'TH T' end) as query")
    found = search.search_addresses(typed, derive.addresses(spark, sf), Workspace(spark, "close"))
    return found.select("query_id", "rank", "text", "street", "score")


def place_queries(spark, sf):
    """A query per part: its name, the start of it, or a piece of it."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey as query_id", """case p_partkey % 5 when 0 then concat(' ', upper(p_name)) when 1 then substring(p_name, 1, 1 + cast(p_partkey % 4 as int)) when 2 then substring(p_name, 3, 5)
            when 3 then substring_index(p_name, ' ', -1) else concat(p_name, 'zz') end as query""")


def _place_hits(limit: int) -> str:
    """place_top from asked2(query_id, q) and pl(source,row_id,name,category,address,lon,lat)."""
    return f"""pkeys AS (SELECT *, lower(name) AS key FROM pl), pcount AS (SELECT key, count(*) AS n FROM pkeys GROUP BY key), pq AS (SELECT DISTINCT q FROM asked2 WHERE q<>''),
phits AS (SELECT q, key, n, CASE WHEN key=q THEN 100 WHEN starts_with(key,q) THEN 80 ELSE 60 END AS score FROM pq JOIN pcount ON contains(key,q) AND (starts_with(key,q) OR length(q)>=3)),
ptier AS (SELECT q, coalesce(sum(n) FILTER (score=100),0) AS n100, coalesce(sum(n) FILTER (score=80),0) AS n80 FROM phits GROUP BY q),
pok AS (SELECT h.* FROM phits h JOIN ptier t USING (q) WHERE score=100 OR (score=80 AND n100<{2 * limit}) OR (score=60 AND n100<{2 * limit} AND n100+n80<{2 * limit})),
prank AS (SELECT o.q, k.*, o.score, CAST(row_number() OVER (PARTITION BY o.q ORDER BY o.score DESC, length(k.name), lower(k.name), CASE WHEN o.score=80 THEN k.key ELSE '' END, k.source, k.row_id) AS INTEGER) AS rank FROM pok o JOIN pkeys k USING (key)),
place_top AS (SELECT a.query_id, r.rank, r.name, list_aggregate(list_transform(string_split(replace(r.category,'_',' '),' '), lambda w: upper(w[1:1])||lower(w[2:])),'string_agg',' ') AS category, r.address, r.lon, r.lat, r.score FROM asked2 a JOIN prank r USING (q) WHERE r.rank<={limit})"""


ADDED = " UNION ALL ".join(
    f"SELECT 0 AS source, {i} AS row_id, '{r[1]}' AS name, '{r[2]}' AS category, {'NULL' if r[3] is None else repr(r[3])} AS address, {r[4]}e0 AS lon, {r[5]}e0 AS lat" for i, r in enumerate(params.ADDED_PLACES))
PL = f"{q.PLACES}, pl AS ({ADDED} UNION ALL SELECT 1, row_id, name, category, address, lon, lat FROM places)"
PQ = """asked2 AS (SELECT p_partkey AS query_id, lower(trim(CASE p_partkey%5 WHEN 0 THEN ' '||upper(p_name) WHEN 1 THEN p_name[1:1+p_partkey%4] WHEN 2 THEN p_name[3:7] WHEN 3 THEN split_part(p_name,' ',-1) ELSE p_name||'zz' END)) AS q FROM part)"""


@query("place_search", f"""WITH {PL}, {PQ}, {_place_hits(10)}
SELECT query_id, rank, name, category, address, round(lon,6) AS lon, round(lat,6) AS lat, score FROM place_top""")
def place_search(spark, sf):
    found = search.search_places(place_queries(spark, sf), places.fixed(derive.places(spark, sf)), Workspace(spark, "places"))
    return found.withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))


def everything_queries(spark, sf):
    """A query per supplier: chargers and lockers, places, or addresses."""
    names = table(spark, sf, "supplier").withColumn("n", derive.n_nodes(spark, sf)).selectExpr("s_suppkey as query_id", "s_name", "s_suppkey * 37 % n as part")
    parts = table(spark, sf, "part").selectExpr("p_partkey as part", "p_name")
    return names.join(parts, "part").selectExpr("query_id", """case query_id % 5 when 0 then s_name when 1 then 'supplier#' when 2 then p_name
        when 3 then concat(query_id % 200, ' ', 4 + query_id % 15, 'th st') else substring(p_name, 1, 1 + cast(query_id % 3 as int)) end as query""")


EVERY = f"""{q.ADDR}, {q.POIS}, {PL}, asked1 AS (SELECT s_suppkey AS query_id, trim(CASE s_suppkey%5 WHEN 0 THEN s_name WHEN 1 THEN 'supplier#' WHEN 2 THEN p_name WHEN 3 THEN s_suppkey%200||' '||(4+s_suppkey%15)||'th st' ELSE p_name[1:1+s_suppkey%3] END) AS query
  FROM supplier JOIN part ON p_partkey=s_suppkey*37%{q.N}), valid AS (SELECT * FROM asked1 WHERE length(query)>=2), asked2 AS (SELECT query_id, lower(query) AS q FROM valid), {_place_hits(16)}, {_address_sql(8).replace('FROM asked1', 'FROM valid', 1)}"""


@query("unified_search", f"""WITH {EVERY},
near AS (SELECT *, 'Near '||number||' '||lower(st)[1:-3]||'St' AS label FROM book),
items AS (SELECT a.query_id, CASE p.kind WHEN 'charger' THEN 'station' ELSE 'bikelink' END AS kind, p.name AS text, CASE p.kind WHEN 'charger' THEN 'EV Charging' ELSE 'Bike Parking' END AS category, p.lon, p.lat, p.address, p.id AS station_id,
   CASE WHEN lower(p.name)=a.q THEN 100 WHEN starts_with(lower(p.name),a.q) THEN 80 ELSE 60 END AS score, CASE p.kind WHEN 'charger' THEN 1 ELSE 2 END AS turn, p.row_id AS ord
   FROM asked2 a JOIN pois p ON p.kind IN ('charger','locker') AND (starts_with(lower(p.name),a.q) OR (length(a.q)>=3 AND contains(lower(p.name),a.q)))
 UNION ALL SELECT query_id, 'place', name, category, lon, lat, address, NULL, score, 3, rank FROM place_top
 UNION ALL SELECT query_id, 'address', text, 'Address', lon, lat, NULL, NULL, score, 4, rank FROM addr_top),
o AS (SELECT *, {q.IN_CITY} AS in_city, row_number() OVER (PARTITION BY query_id, kind, lower(text), category ORDER BY NOT {q.IN_CITY}, score DESC, turn, ord) AS dup FROM items),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY NOT in_city, score DESC, lower(text), turn, ord) AS INTEGER) AS rank FROM o WHERE dup=1),
top AS (SELECT * FROM t WHERE rank<=8),
nn AS (SELECT s.lon AS plon, s.lat AS plat, n.label, row_number() OVER (PARTITION BY s.lon, s.lat ORDER BY round({q.flat('s.lon','s.lat','n.lon','n.lat')},6), n.row_id) AS rk
  FROM (SELECT DISTINCT lon, lat FROM top) s JOIN near n ON n.lat BETWEEN s.lat-2e-3 AND s.lat+2e-3 AND n.lon BETWEEN s.lon-2e-3 AND s.lon+2e-3 WHERE {q.flat('s.lon','s.lat','n.lon','n.lat')}<=150)
SELECT query_id, rank, kind, text, category, round(lon,6) AS lon, round(lat,6) AS lat, CASE WHEN address IS NULL AND kind<>'address' THEN label ELSE address END AS address, station_id, in_city
FROM top LEFT JOIN nn ON nn.plon=top.lon AND nn.plat=top.lat AND nn.rk=1""")
def unified_search(spark, sf):
    pois = derive.pois(spark, sf)
    found = search.unified_search(everything_queries(spark, sf), pois.where("kind = 'charger'"), pois.where("kind = 'locker'"),
                                  places.fixed(derive.places(spark, sf)), derive.addresses(spark, sf), Workspace(spark, "unified"))
    return found.withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))
