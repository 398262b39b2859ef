"""Graph tables compiled once per application and input, then shared."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..operators import components, roads
from ..session import Workspace, at_once
from . import derive

_DONE: dict[tuple, DataFrame] = {}
_BUSY: dict[tuple, threading.RLock] = {}


def once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """The table `name`, written on first use in this application. Chains that run at the same time wait for it."""
    key = (spark.sparkContext.applicationId, sf, name)
    with _BUSY.setdefault(key, threading.RLock()):
        if key not in _DONE:
            ws = Workspace(spark, name)
            _DONE[key] = ws.write(build(ws), "table")
        return _DONE[key]


def forget() -> None:
    _DONE.clear()


def inferred_speeds(spark, sf) -> DataFrame:
    return once(spark, sf, "inferred", lambda ws: components.street_speeds(derive.segments(spark, sf), ws))


def edges(spark, sf) -> DataFrame:
    def build(ws):
        nodes = derive.nodes(spark, sf)
        whole = roads.whole_segments(derive.segments(spark, sf), nodes)
        return roads.with_climb(roads.edges(whole, inferred_speeds(spark, sf)), nodes)

    return once(spark, sf, "edges", build)


def bans(spark, sf) -> DataFrame:
    def build(ws):
        nodes, segments = derive.nodes(spark, sf), derive.segments(spark, sf)
        found = roads.resolved_bans(derive.bans(spark, sf), segments, nodes)
        return roads.lift_bans_for_bicycles(found, derive.exempt_turns(spark, sf), segments, nodes)

    return once(spark, sf, "bans", build)


def class_access(spark, sf) -> DataFrame:
    """Edges × routing classes that may ride them, with their cost."""
    def build(ws):
        from ..functions import policy

        classes = params.vehicles(spark).where("routable and vehicle = rides_as")
        who = roads.edge_access(edges(spark, sf), classes)
        return who.select(
            F.col("vehicle").alias("who"), "mode", "profile", "edge_id", "seg_id", "heading", "bit", "from_node", "to_node", "length_m", "category",
            policy.edge_cost("profile", "category", "length_m", "climb_m").alias("cost"), "geometry")

    return once(spark, sf, "class-access", build)


def turns(spark, sf) -> DataFrame:
    def build(ws):
        return roads.legal_turns(*at_once(spark, lambda: class_access(spark, sf), lambda: bans(spark, sf)))

    return once(spark, sf, "turns", build)


def joined(spark, sf) -> DataFrame:
    return once(spark, sf, "joined", lambda ws: components.joined_nodes(class_access(spark, sf), ws, nodes=derive.nodes(spark, sf)))


def strong(spark, sf) -> DataFrame:
    return once(spark, sf, "strong", lambda ws: components.class_components(edges(spark, sf), class_access(spark, sf), derive.nodes(spark, sf), ws))


def strong_any(spark, sf) -> DataFrame:
    """The strong components of the whole network alone."""
    return once(spark, sf, "strong-any", lambda ws: components.class_components(edges(spark, sf), None, derive.nodes(spark, sf), ws))


def loops(spark, sf) -> DataFrame:
    return once(spark, sf, "loops", lambda ws: components.label_components(class_access(spark, sf), turns(spark, sf), derive.nodes(spark, sf), ws))
