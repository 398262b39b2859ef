"""Registered queries against SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from curbline.plans import routes
from oracle_check import compare

SF = "/root/testdata/sf0.001"
NAMES = ("vehicle_edge_costs", "graph_edges", "access_masks", "posted_speed", "turn_table", "bikeway_match", "elevation_sample", "reverse_label", "park_near",
         "moto_sites", "places_dedupe", "far_from_namesakes", "geocode_search", "place_search", "snap_street", "batch_walks")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    msg, ok = compare(spark, SF, name, contract.queries()[name], contract.oracle_sql()[name])
    assert ok, msg


def test_routes_equal_sql(spark):
    msg, ok = compare(spark, SF, "batch_routes", contract.queries()["batch_routes"], routes.ROUTES_SQL)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
