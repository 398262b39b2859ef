"""Where a request's ends lie: stations, addresses and coordinates as points with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .search import search_addresses


def resolve(refs: DataFrame, stations: DataFrame, lockers: DataFrame, addresses: DataFrame, ws: Workspace) -> DataFrame:
    """Adds point_lon, point_lat, point_label and problem to references (ref_id, station_id, query, lon, lat, label).

    A station id counts before a query and a query before coordinates; empty
    texts count as none. An id is sought among the stations, then the lockers
    (id, name, lon, lat, row_id; of equal ids the first row counts). A query is
    its first address. `problem` is unknown_station, address_not_found or
    bad_request, and null where there is a point. Distinct texts and ids are
    looked up once.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = ws.write(refs.withColumns({"sid": given("station_id"), "text": F.when(given("station_id").isNull(), given("query"))}), "refs")

    def first(sites: DataFrame, rank: int, unnamed: str) -> DataFrame:
        return sites.groupBy(F.col("id").alias("sid")).agg(F.min_by(F.struct(F.lit(rank).alias("rank"), "lon", "lat", F.coalesce(given("name"), F.lit(unnamed)).alias("label")), "row_id").alias("site"))

    sites = first(stations, 0, "charging station").unionByName(first(lockers, 1, "BikeLink locker")).groupBy("sid").agg(F.min("site").alias("site"))
    asked = ws.write(rows.where("text is not null").select("text").distinct().withColumn("query_id", F.monotonically_increasing_id()), "ref-texts")
    hits = search_addresses(asked.select("query_id", F.col("text").alias("query")), addresses, ws, 1).select("query_id", F.struct("lon", "lat", F.col("text").alias("label")).alias("hit"))
    found = asked.join(hits, "query_id").select("text", "hit")
    rows = rows.join(sites, "sid", "left").join(found, "text", "left")
    here = F.col("sid").isNull() & F.col("text").isNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    pick = lambda c, own: F.when(F.col("sid").isNotNull(), F.col(f"site.{c}")).when(F.col("text").isNotNull(), F.col(f"hit.{c}")).when(here, own)
    problem = (F.when(F.col("sid").isNotNull(), F.when(F.col("site").isNull(), "unknown_station"))
               .when(F.col("text").isNotNull(), F.when(F.col("hit").isNull(), "address_not_found")).when(~here, "bad_request"))
    return rows.select(*refs.columns, pick("lon", F.col("lon")).alias("point_lon"), pick("lat", F.col("lat")).alias("point_lat"),
                       pick("label", F.coalesce(given("label"), F.lit("map location"))).alias("point_label"), problem.alias("problem"))
