"""What a route is made of: totals, categories, traffic, paths, warnings.

All of it is windows and aggregates over route edges, keyed by
(src, dst, vehicle): requests that share a route and vehicle share the work.
A window partition is one route, which is as long as a trip and no longer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import geo, policy

KEY = ["src", "dst", "vehicle"]


def ridden(parts: DataFrame, asked: DataFrame, edges: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Route edges with attributes of the part ridden: length, seconds, climb
    and the geometry between the two fractions."""
    v = vehicles.select("vehicle", "cap_mph", "profile")
    about = edges.select("edge_id", "seg_id", "heading", "from_node", "to_node", "length_m", "name", "class", "category", "eff_mph", "posted_mph", "climb_m", "geometry")
    rows = parts.join(asked, ["src", "dst"]).join(F.broadcast(v), "vehicle").join(about, "edge_id")
    share = F.greatest(F.col("f1") - F.col("f0"), F.lit(0.0))
    metric = geo.local_metric(F.get("geometry", 0)["lat"])
    rows = (
        rows.withColumn("share", share).withColumn("full_m", F.col("length_m"))
        .withColumn("seconds", policy.edge_seconds("cap_mph", "profile", "category", "eff_mph", "length_m", "climb_m") * F.col("share"))
        .withColumn("length_m", F.col("length_m") * F.col("share")).withColumn("climb_m", F.col("climb_m") * F.col("share"))
        .withColumn("cum", geo.running(geo.leg_lengths(F.col("geometry"), metric)))
    )
    return rows.withColumn("line", geo.stretch(F.col("geometry"), F.col("cum"), F.col("f0"), F.col("f1"))).select(
        *KEY, "seq", "edge_id", "seg_id", "heading", "from_node", "to_node", "f0", "f1", "length_m", "seconds", "climb_m", "name", "class", "category", "posted_mph", "line")


def totals(parts: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return parts.groupBy(*KEY).agg(
        F.sum("length_m").alias("distance_m"), F.sum("seconds").alias("duration_s"), F.sum(F.greatest("climb_m", zero)).alias("climb_m"),
        F.sum(F.greatest(-F.col("climb_m"), zero)).alias("descent_m"), F.count("*").alias("edges"))


def by_category(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEY, "category").agg(F.sum("length_m").alias("distance_m"), F.max("posted_mph").alias("max_speed_mph"))


def _route() -> "Window":
    return Window.partitionBy(*KEY).orderBy("seq")


def joined_line(rows: "F.Column") -> "F.Column":
    """Ordered array of (seq, line) as one line without repeated points."""
    return geo.without_repeats(F.flatten(F.transform(F.array_sort(rows), lambda r: r["line"])))


def paths(parts: DataFrame) -> DataFrame:
    """The whole line of every route."""
    return parts.groupBy(*KEY).agg(F.collect_list(F.struct("seq", "line")).alias("rows")).select(*KEY, joined_line(F.col("rows")).alias("path"))


def traffic_runs(parts: DataFrame) -> DataFrame:
    """(key, run, distance_m, path): maximal stretches in mixed traffic."""
    mixed = F.col("category").isin(*params.TRAFFIC_CATEGORIES) & (F.size("line") > 1)
    starts = F.when(F.col("mixed") & ~F.coalesce(F.lag("mixed").over(_route()), F.lit(False)), 1).otherwise(0)
    rows = parts.select(*KEY, "seq", "length_m", "line", mixed.alias("mixed")).withColumn("new", starts).withColumn("run", F.sum("new").over(_route())).where("mixed")
    return rows.groupBy(*KEY, "run").agg(F.sum("length_m").alias("distance_m"), F.collect_list(F.struct("seq", "line")).alias("rows")).select(
        *KEY, "run", "distance_m", joined_line(F.col("rows")).alias("path"))


def path_runs(parts: DataFrame) -> DataFrame:
    """(key, run, name, near, distance_m): off-street bike paths in order. A
    run without a name is placed by the last named street before it."""
    on_path = F.col("class").isin(*params.OFF_STREET_CLASSES)
    before = _route().rowsBetween(Window.unboundedPreceding, -1)
    street = F.when((F.coalesce("name", F.lit("")) != "") & ~F.col("on_path"), F.col("name"))
    prev_same = F.lag("on_path").over(_route()) & F.lag("name").over(_route()).eqNullSafe(F.col("name"))
    rows = parts.select(*KEY, "seq", "length_m", "name", on_path.alias("on_path"))
    rows = rows.withColumn("near", F.last(street, ignorenulls=True).over(before)).withColumn(
        "new", F.when(F.col("on_path") & ~F.coalesce(prev_same, F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("new").over(_route())).where("on_path")
    return rows.groupBy(*KEY, "run").agg(F.min_by("name", "seq").alias("name"), F.min_by("near", "seq").alias("near"), F.sum("length_m").alias("distance_m"))


def _firsts(runs: DataFrame, col: str, out: str) -> DataFrame:
    """The first two distinct values of a column, in order of first use."""
    seen = runs.where(F.coalesce(F.col(col), F.lit("")) != "").groupBy(*KEY, col).agg(F.min("run").alias("at"))
    return seen.groupBy(*KEY).agg(F.slice(F.array_sort(F.collect_list(F.struct("at", F.col(col).alias("v")))), 1, 2).alias("two")).select(
        *KEY, F.transform("two", lambda r: r["v"]).alias(out))


def facts(parts: DataFrame) -> DataFrame:
    """Everything warnings and headlines are decided on, one row a route."""
    runs = path_runs(parts)
    pick = lambda c: F.col("category") == c
    length = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("length_m"))), F.lit(0.0))
    sums = parts.groupBy(*KEY).agg(
        F.sum("length_m").alias("distance_m"), F.sum("seconds").alias("duration_s"), F.sum(F.greatest("climb_m", F.lit(0.0))).alias("climb_m"),
        length(pick("sidewalk")).alias("sidewalk_m"), length(pick("arterial")).alias("arterial_m"), F.max(F.when(pick("arterial"), F.col("posted_mph"))).alias("arterial_mph"),
        length(F.col("category").isin("shared", "arterial")).alias("shared_m"),
        length(F.col("category").isin(*params.TRAFFIC_CATEGORIES) & (F.size("line") > 1)).alias("traffic_m"),
        length(F.col("class").isin(*params.OFF_STREET_CLASSES)).alias("path_m"), F.max(F.col("class").isin(*params.OFF_STREET_CLASSES)).alias("on_paths"))
    return sums.join(_firsts(runs, "name", "path_names"), KEY, "left").join(_firsts(runs, "near", "path_near"), KEY, "left")


def with_warnings(rows: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Adds `warnings`, in a fixed order, from the facts of a route."""
    d = geo.distance_text
    amount = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mph = F.when(F.coalesce("arterial_mph", F.lit(0)) > 0, F.concat(F.lit(" (up to "), F.col("arterial_mph").cast("string"), F.lit(" mph posted)"))).otherwise("")
    where = (F.when(F.size("path_names") > 0, F.concat(F.lit(" on "), F.array_join("path_names", ", ")))
             .when(F.size("path_near") > 0, F.concat(F.lit(" off "), F.array_join("path_near", ", "))).otherwise(""))
    board = F.col("avoids_traffic")
    texts = [
        F.when(amount("start_snap_m") > 50, F.concat(F.lit("start snapped "), d(amount("start_snap_m")), F.lit(" to the nearest street"))),
        F.when(amount("end_snap_m") > 50, F.concat(F.lit("destination snapped "), d(amount("end_snap_m")), F.lit(" to the nearest street"))),
        F.when(amount("sidewalk_m") > 0, F.concat(F.lit("route includes "), d(amount("sidewalk_m")), F.lit(" of sidewalk — walk your vehicle where riding is prohibited"))),
        F.when(amount("arterial_m") > 0, F.concat(F.lit("route uses "), d(amount("arterial_m")), F.lit(" of fast arterial street"), mph, F.lit(" — share the road with care"))),
        F.when((F.col("vehicle") == "moped") & F.coalesce("on_paths", F.lit(False)),
               F.concat(F.lit("route uses "), d(amount("path_m")), F.lit(" of bike path"), where, F.lit(", which is usually reserved for bicycles"))),
        F.when(board & (amount("traffic_m") >= 1), F.concat(F.lit("no bike path or lane for "), d(amount("traffic_m")), F.lit(": those stretches are with car traffic (red on the map)"))),
        F.when(~board & (amount("distance_m") > 0) & (amount("shared_m") > F.greatest(F.lit(200.0), 0.3 * amount("distance_m"))),
               F.concat(F.lit("route shares the roadway with car traffic for "), d(amount("shared_m")), F.lit(" — ride alert"))),
    ]
    v = vehicles.select("vehicle", "avoids_traffic")
    return rows.join(F.broadcast(v), "vehicle").withColumn("warnings", F.array_compact(F.array(*texts)))


def with_headline(rows: DataFrame) -> DataFrame:
    """Adds the one-line summary and the all-bikeway note."""
    m = F.coalesce("distance_m", F.lit(0.0))
    here = m < 1
    feet = F.floor(F.coalesce("climb_m", F.lit(0.0)) * params.FEET_PER_M / 10.0 + 0.5) * 10
    climb = F.when(feet >= 10, F.concat(F.lit("↗ "), feet.cast("string"), F.lit(" ft")))
    line = F.concat_ws(" · ", geo.distance_text(m, half_up=True), geo.minutes_text(F.coalesce("duration_s", F.lit(0.0))), climb)
    note = F.when(~here & F.col("avoids_traffic") & (F.coalesce("traffic_m", F.lit(0.0)) < 1), "All on bike paths and lanes, no car traffic")
    return rows.withColumn("headline", F.when(here, "You're already there").otherwise(line)).withColumn("note", note)
