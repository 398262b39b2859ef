"""Map tables derived from the given star-schema tables.

Each table has the shape its landed counterpart has, and one row of it comes
from one row (or one group) of a given table, so work grows with the input.
Fractional literals are in exponent form: they are doubles in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# The grid: 100 nodes wide, west to east and south to north.
LON0, LAT0, DLON, DLAT = "-1.2253e2", "3.7705e1", "1.6e-3", "9e-4"


def n_nodes(spark: SparkSession, sf: str):
    return table(spark, sf, "part").agg(F.count("*")).scalar()


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Junctions, for joins that deal them out by their keys, and not by way of the driver: packed
    files tell little of their number. What is derived from them is joined likewise."""
    return (
        table(spark, sf, "part").select("p_partkey", "p_size")
        .selectExpr("p_partkey as node_id", "p_partkey % 100 as x", "cast(floor(p_partkey / 100) as bigint) as y", "p_size as s")
        .selectExpr("node_id", "x", "y", "s", f"{LON0} + {DLON} * x as lon", f"{LAT0} + {DLAT} * y as lat", "4e-1 * s as elev")
        .hint("merge")
    )


SEGMENT_COLUMNS = [
    "seg_id", "case when s % 13 = 0 then null else street end as name",
    """case when s % 17 = 0 then 'cycleway' when s % 23 = 0 then 'steps' when s % 29 = 0 then 'footway'
       when s = 31 then 'bridleway' when k % 6 = 0 then 'residential' when k % 6 = 1 then 'tertiary'
       when k % 6 = 2 then 'service' when k % 6 = 3 then 'secondary' when k % 6 = 4 then 'living_street'
       else 'primary' end as class""",
    "case when s = 50 then 55 when s % 3 = 0 then 15 + 5 * (s % 7) end as speed",
    "case s % 11 when 0 then 1 when 1 then 2 else 3 end as ow",
    "case when s % 19 = 0 then 0 when s % 11 = 0 then 1 when s % 11 = 1 then 2 else 3 end as ow_moto",
    "case when s % 5 = 0 then 3 else 0 end as bike_desig",
    """array(named_struct('connector_id', a, 'at', 0e0), named_struct('connector_id', b, 'at', 1e0)) as conns""",
    """array(named_struct('lon', alon, 'lat', alat), named_struct('lon', blon, 'lat', blat)) as geometry""",
]


def segments(spark: SparkSession, sf: str) -> DataFrame:
    base = nodes(spark, sf).withColumn("n", n_nodes(spark, sf))
    both = base.selectExpr(
        "x", "y", "s", "n", "node_id as a", "lon as alon", "lat as alat",
        "inline(array(named_struct('east', true, 'b', node_id + 1), named_struct('east', false, 'b', node_id + 100)))",
    ).where("b < n and (not east or x < 99)")
    return both.selectExpr(
        "2 * a + if(east, 0, 1) as seg_id", "s", "if(east, y, x) as k", "a", "b", "alon", "alat",
        "if(east, concat('Row ', y, ' St'), concat('Col ', x, ' Ave')) as street",
        f"{LON0} + {DLON} * if(east, x + 1, x) as blon", f"{LAT0} + {DLAT} * if(east, y, y + 1) as blat",
    ).selectExpr(*SEGMENT_COLUMNS)


def bans(spark: SparkSession, sf: str) -> DataFrame:
    """From the east street arriving at a node into its north street."""
    return (
        nodes(spark, sf).withColumn("n", n_nodes(spark, sf))
        .where("s % 9 = 0 and x > 0 and node_id + 100 < n")
        .selectExpr("2 * (node_id - 1) as seg_id", "node_id as connector_id", "2 * node_id + 1 as to_seg", "3 as mask")
    )


def signs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        nodes(spark, sf).withColumn("n", n_nodes(spark, sf))
        .where("s % 7 = 0 and x > 0 and node_id + 100 < n")
        .selectExpr("2 * (node_id - 1) as seg_id", "2 * node_id + 1 as to_seg", "node_id as connector_id",
                    "concat('District ', s) as label", "1 + s % 3 as mask", "0 as pos")
    )


def exempt_turns(spark: SparkSession, sf: str) -> DataFrame:
    return (
        nodes(spark, sf).withColumn("n", n_nodes(spark, sf))
        .where("s % 18 = 0 and x > 0 and node_id + 100 < n")
        .selectExpr("node_id as rule_id", "case when s % 4 = 0 then 'only_right_turn' else 'no_left_turn' end as restriction",
                    "lon as via_lon", "lat + 5e-5 as via_lat",
                    "array(concat('Row ', y, ' St')) as from_names", "array(concat('Col ', x, ' Ave')) as to_names")
    )


def bikeways(spark: SparkSession, sf: str) -> DataFrame:
    return (
        nodes(spark, sf).withColumn("n", n_nodes(spark, sf)).where("y % 4 = 0 and x < 99 and node_id + 1 < n")
        .selectExpr(
            "node_id as line_id", "cast(1 + cast(floor(y / 4) as bigint) % 4 as int) as cls",
            "case when x % 3 = 0 then 'E' end as dir", "x % 6 = 0 as contraflow",
            f"""array(named_struct('lon', lon, 'lat', lat + 3e-5),
                named_struct('lon', {LON0} + {DLON} * (x + 1), 'lat', lat + 3e-5)) as geometry""")
    )


DEM_ZOOM = 10


def dem(spark: SparkSession, sf: str) -> DataFrame:
    """One raster pixel per node: column x, row y counted from the north."""
    return (
        table(spark, sf, "part").withColumn("n", n_nodes(spark, sf))
        .selectExpr("p_partkey % 100 as px", "cast(floor((n - 1) / 100) as bigint) - cast(floor(p_partkey / 100) as bigint) as py",
                    "127 + p_size % 2 as red", "(p_size * 5) % 256 as green", "(p_partkey * 7) % 256 as blue")
    )


RULES = """
select l_orderkey as seg_id, l_linenumber as pos,
  case l_returnflag when 'A' then 'denied' when 'N' then 'designated' else 'allowed' end as access_type,
  case l_linenumber % 3 when 1 then 'forward' when 2 then 'backward' end as heading,
  case l_partkey % 4 when 1 then array('bicycle') when 2 then array('motorcycle') when 3 then array('hgv') end as mode,
  l_suppkey % 7 = 0 as scoped,
  case when l_quantity < 15 then null when l_quantity < 35 then 0e0 else 0e0 end as lo,
  case when l_quantity < 15 then null when l_quantity < 35 then 1e0 else 5e-1 end as hi,
  cast(15 + 5 * (l_suppkey % 8) as double) as speed,
  case when l_partkey % 5 = 0 then 'km/h' else 'mph' end as unit
from {lineitem}"""


def segment_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Access and speed rules, one row each, as they come out of `inline`."""
    return spark.sql(RULES, lineitem=table(spark, sf, "lineitem"))


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "customer").withColumn("n", n_nodes(spark, sf)).withColumn("k", F.expr("4 + c_custkey % 15"))
        .selectExpr(
            "c_custkey as row_id",
            "case when c_custkey % 3 = 0 then concat(lpad(cast(k as string), 2, '0'), 'TH ST') else concat(k, 'TH ST') end as street",
            "cast(c_custkey % 200 as string) as number", "case when c_custkey % 4 = 0 then c_mktsegment end as unit",
            "concat('941', lpad(cast(c_nationkey as string), 2, '0')) as postcode",
            f"{LON0} + (c_custkey * 7919 % 160000) / 1e6 as lon", f"{LAT0} + (c_custkey * 104729 % (n * 9)) / 1e6 as lat")
    )


def places(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.selectExpr(
        "p_partkey as row_id", "concat('pl-', p_partkey) as id", "p_name as name", "lower(p_type) as category",
        "case when p_size % 2 = 0 then null else p_brand end as address",
        f"{LON0} + {DLON} * (p_partkey % 100) + 3e-4 as lon", f"{LAT0} + {DLAT} * cast(floor(p_partkey / 100) as bigint) + 2e-4 as lat")


KINDS = "array('charger', 'locker', 'rack', 'moto')"


def pois(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "supplier").withColumn("n", n_nodes(spark, sf))
        .selectExpr("s_suppkey as row_id", "concat('poi-', s_suppkey) as id", f"element_at({KINDS}, cast(s_suppkey % 4 as int) + 1) as kind",
                    "case when s_suppkey % 5 = 0 then null else s_name end as name",
                    "case when s_suppkey % 3 = 0 then null else concat(s_nationkey, ' Dock St') end as address",
                    f"{LON0} + (s_suppkey * 7919 % 160000) / 1e6 as lon", f"{LAT0} + (s_suppkey * 104729 % (n * 9)) / 1e6 as lat")
    )


def meter_spaces(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem").withColumn("n", n_nodes(spark, sf))
        .selectExpr(
            "l_orderkey * 8 + l_linenumber as space_id",
            "case when l_suppkey % 11 = 0 then null else concat('bf-', l_suppkey) end as blockface_id",
            "concat('0', 1 + l_suppkey % 9, 'TH AVE') as street_name", "cast(l_partkey % 500 as string) as street_num",
            "case l_returnflag when 'A' then 'M' when 'R' then 'U' else 'L' end as flag",
            "case l_linestatus when 'O' then 'ON' else 'OFF' end as onoff",
            f"{LON0} + (l_suppkey * 7919 % 160000) / 1e6 + (l_partkey % 10) * 1e-5 as lon",
            f"{LAT0} + (l_suppkey * 104729 % (n * 9)) / 1e6 as lat")
    )


VEHICLE_IDS = "array('scooter', 'emb', 'euc', 'ebike_c1', 'ebike_c2', 'ebike_c3', 'moped', 'emoto')"


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """One request per order: junction to junction, or from mid-block."""
    return (
        table(spark, sf, "orders").select("o_orderkey").withColumn("n", n_nodes(spark, sf))
        .selectExpr("o_orderkey as req_id", "n", "31 * o_orderkey % n as a")
        .selectExpr("req_id", "n", "a", "a + least(req_id % 5, 99 - a % 100) as e")
        .selectExpr("req_id", "a", "e + if(e + 100 * (req_id % 3) < n, 100 * (req_id % 3), 0) as b")
        .selectExpr(
            "req_id", f"element_at({VEHICLE_IDS}, cast(req_id % 8 as int) + 1) as vehicle",
            f"{LON0} + {DLON} * (a % 100) + if(req_id % 7 = 0, 5e-4, 0e0) as start_lon",
            f"{LAT0} + {DLAT} * cast(floor(a / 100) as bigint) as start_lat",
            f"{LON0} + {DLON} * (b % 100) as end_lon", f"{LAT0} + {DLAT} * cast(floor(b / 100) as bigint) as end_lat")
    )


def far_trips(spark: SparkSession, sf: str) -> DataFrame:
    """One request per supplier, from anywhere on the grid to anywhere."""
    return (
        table(spark, sf, "supplier").select("s_suppkey").withColumn("n", n_nodes(spark, sf))
        .selectExpr("s_suppkey as req_id", "37 * s_suppkey % n as a", "(7919 * s_suppkey + 53) % n as b")
        .selectExpr(
            "req_id", f"element_at({VEHICLE_IDS}, cast(req_id % 8 as int) + 1) as vehicle",
            f"{LON0} + {DLON} * (a % 100) as start_lon", f"{LAT0} + {DLAT} * cast(floor(a / 100) as bigint) as start_lat",
            f"{LON0} + {DLON} * (b % 100) as end_lon", f"{LAT0} + {DLAT} * cast(floor(b / 100) as bigint) as end_lat")
    )


def riders_at(spark: SparkSession, sf: str) -> DataFrame:
    """One point per order, used as query points for nearest joins."""
    return (
        table(spark, sf, "orders").select("o_orderkey", "o_custkey").withColumn("n", n_nodes(spark, sf))
        .selectExpr("o_orderkey as point_id", f"element_at({VEHICLE_IDS}, cast(o_orderkey % 8 as int) + 1) as vehicle",
                    f"{LON0} + (o_custkey * 6151 % 160000) / 1e6 as lon", f"{LAT0} + (o_custkey * 3571 % (n * 9)) / 1e6 as lat")
    )
