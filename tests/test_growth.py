"""What a query holds or moves, where it once grew faster than its input."""

import pytest
from pyspark.sql import functions as F

from curbline import params
from curbline.operators import roads, search
from curbline.plans import compiled

SF = "/root/testdata/sf0.001"


def test_a_text_brings_no_more_names_than_a_list_shows(spark):
    lat, lon = 37.75, -122.45
    rows = spark.range(200).selectExpr("concat('dock ', lpad(id, 3, '0')) as key", "concat('dock ', lpad(id, 3, '0')) as low", "concat('Dock ', lpad(id, 3, '0')) as name",
                                       f"if(id % 2 = 0, {lon}, 10.0) as lon", f"{lat} as lat", "cast(null as string) as address", "string(id) as id", "id as row_id")
    hits = rows.select(F.lit("dock").alias("q"), "key", F.lit(80).alias("score")).unionByName(rows.where("row_id = 3").select(F.lit("dock 003").alias("q"), "key", F.lit(100).alias("score")))
    got = sorted((r.q, r.row_id) for r in search.first_names(hits, rows, 8).collect())
    assert got == [("dock", 2 * i) for i in range(8)] + [("dock 003", 3)]


@pytest.mark.parametrize("few", [False, True])
def test_vehicle_counts_keep_a_row_a_junction(spark, few):
    edges, vehicles = compiled.edges(spark, SF), params.vehicles(spark)
    edges = edges.where("from_node < 30") if few else edges
    counted = roads.vehicle_counts(edges, vehicles)
    assert "Expand" not in counted._jdf.queryExecution().optimizedPlan().toString()
    plain = roads.edge_access(edges, vehicles).groupBy("vehicle").agg(F.count("*"), F.countDistinct("from_node"), F.countDistinct("to_node"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, plain.collect())) != []
