"""Queries over place records and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params
from ..functions import text
from ..operators import places
from ..session import table
from ..sources import landed
from . import derive
from . import sqltext as q
from .catalog import query


def _raw_places(spark, sf):
    """Place records with repeats, one per line item."""
    rows = derive.table(spark, sf, "lineitem").withColumn("n", derive.n_nodes(spark, sf))
    return rows.selectExpr(
        "l_orderkey * 8 + l_linenumber as row_id", "concat('r', l_orderkey, '-', l_linenumber) as id",
        "case when l_linenumber = 7 then 'ev_charging_station' when l_returnflag = 'A' then 'cafe' when l_returnflag = 'N' then 'book_store' end as basic_category",
        "named_struct('primary', case when l_partkey % 50 = 0 then '' when l_linenumber % 2 = 0 then upper(concat('Shop ', l_partkey % 40)) else concat('Shop ', l_partkey % 40) end) as names",
        "if(l_linestatus = 'O', array(named_struct('freeform', concat(l_partkey % 90, ' Dock St'))), null) as addresses",
        f"named_struct('lon', {derive.LON0} + (l_suppkey * 7919 % 160000) / 1e6, 'lat', {derive.LAT0} + (l_suppkey * 104729 % (n * 9)) / 1e6) as p")


@query("places_dedupe", f"""WITH n AS (SELECT {q.N} AS n), raw AS (SELECT l_orderkey*8+l_linenumber AS row_id, 'r'||l_orderkey||'-'||l_linenumber AS id,
  CASE WHEN l_returnflag='A' THEN 'cafe' WHEN l_returnflag='N' THEN 'book_store' END AS category, CASE WHEN l_linenumber%2=0 THEN upper('Shop '||l_partkey%40) ELSE 'Shop '||l_partkey%40 END AS name,
  CASE WHEN l_linestatus='O' THEN l_partkey%90||' Dock St' END AS address,
  CAST(printf('%.5f',-1.2253e2+(l_suppkey*7919%160000)/1e6) AS DOUBLE) AS lon, CAST(printf('%.5f',3.7705e1+(l_suppkey*104729%(n*9))/1e6) AS DOUBLE) AS lat FROM lineitem, n WHERE l_linenumber<>7 AND l_partkey%50<>0)
SELECT id, name, category, address, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), lon, lat ORDER BY row_id, id, name, category NULLS FIRST, address NULLS FIRST) AS rk FROM raw) WHERE rk=1""")
def places_dedupe(spark, sf):
    return landed.named_places(_raw_places(spark, sf)).drop("row_id")


BAD_SQL = "bad(name, category) AS (VALUES " + ", ".join("('" + n.replace("'", "''") + "', " + ("CAST(NULL AS VARCHAR)" if c is None else f"'{c}'") + ")" for n, c in params.BAD_PLACES) + ")"
ADDED_SQL = " UNION ALL ".join(
    f"SELECT 0 AS source, {i} AS row_id, '{r[0]}' AS id, '{r[1]}' AS name, '{r[2]}' AS category, {'NULL' if r[3] is None else repr(r[3])} AS address, {r[4]}e0 AS lon, {r[5]}e0 AS lat" for i, r in enumerate(params.ADDED_PLACES))
MIXED = f"""{q.PLACES}, {BAD_SQL}, listed AS (SELECT *, row_number() OVER () - 1 AS i FROM bad),
mixed AS (SELECT p.row_id, p.id, CASE WHEN p.row_id%40<20 AND p.row_id%3=0 THEN upper(l.name) WHEN p.row_id%40=25 THEN 'Oakland-San Francico Bay Bridge' ELSE p.name END AS name,
  CASE WHEN p.row_id%40<20 AND p.row_id%6=0 THEN coalesce(l.category, p.category) ELSE p.category END AS category, p.address, p.lon, p.lat FROM places p LEFT JOIN listed l ON l.i=p.row_id%40)"""


def _mixed_places(spark, sf):
    """Places, some of them under the names of misplaced records."""
    names = F.array(*[F.lit(n) for n, _ in params.BAD_PLACES])
    cats = F.array(*[F.lit(c).cast("string") for _, c in params.BAD_PLACES])
    i = (F.col("row_id") % 40).cast("int")
    return derive.places(spark, sf).withColumn("old", F.col("category")).select(
        "row_id", "id", F.when((i < 20) & (F.col("row_id") % 3 == 0), F.upper(F.get(names, i))).when(i == 25, "Oakland-San Francico Bay Bridge").otherwise(F.col("name")).alias("name"),
        F.when((i < 20) & (F.col("row_id") % 6 == 0), F.coalesce(F.get(cats, i), F.col("old"))).otherwise(F.col("old")).alias("category"), "address", "lon", "lat")


@query("fix_places", f"""WITH {MIXED}, kept AS (SELECT * FROM mixed m WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE lower(b.name)=lower(m.name) AND (b.category IS NULL OR b.category=m.category)))
SELECT source, id, name, category, address, round(lon,6) AS lon, round(lat,6) AS lat FROM ({ADDED_SQL} UNION ALL
 SELECT 1, row_id, id, CASE WHEN name='Oakland-San Francico Bay Bridge' THEN 'Oakland-San Francisco Bay Bridge' ELSE name END, category, address, lon, lat FROM kept)""")
def fix_places(spark, sf):
    return places.fixed(_mixed_places(spark, sf)).select("source", "id", "name", "category", "address", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("place_suspects", f"""WITH {MIXED}, named AS (SELECT *, CASE row_id%5 WHEN 0 THEN name||' OAKLAND' WHEN 1 THEN name||', San Mateo' WHEN 2 THEN name||' Marinade' ELSE name END AS nm FROM mixed)
SELECT id, nm AS name, category FROM named m WHERE address IS NULL AND {q.IN_CITY} AND regexp_matches(nm, '\\b({"|".join(params.OUTSIDE_NAMES)})\\b', 'i')
 AND NOT EXISTS (SELECT 1 FROM bad b WHERE lower(b.name)=lower(m.nm) AND (b.category IS NULL OR b.category=m.category))""")
def place_suspects(spark, sf):
    named = _mixed_places(spark, sf).withColumn("name", F.expr(
        "case row_id % 5 when 0 then concat(name, ' OAKLAND') when 1 then concat(name, ', San Mateo') when 2 then concat(name, ' Marinade') else name end"))
    return places.suspects(named).select("id", "name", "category")


SAKES = """sakes AS (SELECT p_partkey AS row_id, 'pl-'||p_partkey AS id, CAST(floor(p_partkey/8) AS BIGINT)%40 AS k, CASE WHEN p_partkey%8=0 THEN 'Plaza '||CAST(floor(p_partkey/8) AS BIGINT)%40 ELSE 'PLAZA '||CAST(floor(p_partkey/8) AS BIGINT)%40||' '||p_name END AS name,
  CASE WHEN p_partkey%8>0 AND p_size%2=0 THEN p_brand END AS address,
  -1.2250e2+2e-3*(CAST(floor(p_partkey/8) AS BIGINT)%40)+CASE WHEN p_partkey%16=0 THEN 2e-2 ELSE 0e0 END+(p_size%(3+CAST(floor(p_partkey/8) AS BIGINT)%40*2))*1e-4 AS lon, 3.775e1+(p_partkey%7)*1e-4 AS lat FROM part)"""


@query("far_from_namesakes", f"""WITH {SAKES}, asked AS (SELECT * FROM sakes WHERE address IS NULL AND {q.IN_CITY}),
names AS (SELECT DISTINCT lower(name) AS key FROM asked), m AS (SELECT n.key, s.lon, s.lat FROM names n JOIN sakes s ON starts_with(lower(s.name), n.key||' ')),
c AS (SELECT key, median(lon) AS clon, median(lat) AS clat, count(*) AS n FROM m GROUP BY key HAVING count(*)>=3),
t AS (SELECT m.key, any_value(clon) AS clon, any_value(clat) AS clat, median({q.hav('m.lon','m.lat','clon','clat')}) AS spread FROM m JOIN c USING (key) GROUP BY m.key)
SELECT a.id, a.name, round({q.hav('a.lon','a.lat','clon','clat')},1) AS dist_m FROM asked a JOIN t ON t.key=lower(a.name) WHERE spread<=400 AND {q.hav('a.lon','a.lat','clon','clat')}>=1000""")
def far_from_namesakes(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey as row_id", "concat('pl-', p_partkey) as id", "cast(floor(p_partkey / 8) as bigint) % 40 as k", "p_partkey", "p_size", "p_name", "p_brand").selectExpr(
        "row_id", "id", "if(p_partkey % 8 = 0, concat('Plaza ', k), concat('PLAZA ', k, ' ', p_name)) as name", "cast(null as string) as category",
        "case when p_partkey % 8 > 0 and p_size % 2 = 0 then p_brand end as address",
        "-1.2250e2 + 2e-3 * k + if(p_partkey % 16 = 0, 2e-2, 0e0) + (p_size % (3 + k * 2)) * 1e-4 as lon", "3.775e1 + (p_partkey % 7) * 1e-4 as lat")
    return places.far_from_namesakes(rows).select("id", "name", F.round("dist_m", 1).alias("dist_m"))


@query("text_fold", """SELECT doc_id, md5(replace(lower(strip_accents(text)),'ß','ss')) AS folded FROM documents""")
def text_fold(spark, sf):
    """Search keys of whole documents, by digest."""
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold("text")).alias("folded"))


@query("category_texts", """SELECT lower(p_type)||'_shop' AS category, list_aggregate(list_transform(string_split(replace(lower(p_type),'_',' ')||' shop',' '), lambda w: upper(w[1:1])||w[2:]),'string_agg',' ') AS shown, count(*) AS places FROM part GROUP BY 1,2""")
def category_texts(spark, sf):
    rows = table(spark, sf, "part").select(F.concat(F.lower("p_type"), F.lit("_shop")).alias("category"))
    return rows.groupBy("category", text.category_text("category").alias("shown")).agg(F.count("*").alias("places"))
