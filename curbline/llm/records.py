"""The library's own rows as the operators here take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def places(named: DataFrame, key: str = "id") -> DataFrame:
    """(place_id, name, ...) of place records, as `landed.named_places` and `landed.place_records` give them; other columns are kept."""
    return named.withColumnRenamed(key, "place_id")


def routes(steps: DataFrame) -> DataFrame:
    """(route_id, directions) of steps, as `steps.build` gives them: the instructions of a route in order, one a line.

    A route is a pair of ends and a vehicle, and has as many steps as turns, so it fits in a row.
    """
    key = ("src", "dst", "vehicle")
    lines = steps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("index", "instruction"))).alias("s"))
    return lines.select(F.concat_ws("/", *(F.col(c).cast("string") for c in key)).alias("route_id"), F.array_join(F.transform("s", lambda x: F.coalesce(x["instruction"], F.lit(""))), "\n").alias("directions"))
