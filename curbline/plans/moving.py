"""Ride queries: the streaming job run over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import Workspace, table
from ..sources import landed
from ..streaming import ride
from . import compiled
from .catalog import query

LON0, LAT0 = -122.40, 37.78
SPAN_M = 520.0
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"


def _line_point(x: str, y: str) -> tuple[str, str]:
    return f"{LON0}e0 + ({x}) / (1.1132e5 * cos(radians({LAT0}e0)))", f"{LAT0}e0 + ({y}) / 1.1132e5"


def fixes_from(events, first, last):
    """Each rider covers an L of 300 m east and 200 m south over the span of
    the events, strays 60 m on an error, and wobbles otherwise."""
    rows = events.withColumn("first", first).withColumn("last", last)
    rows = rows.withColumn("m", F.expr(f"{SPAN_M}e0 * (unix_micros(cast(ts as timestamp)) - first) / (last - first)"))
    rows = rows.withColumn("side", F.expr("if(event_type = 'error', 6e1, value % 20)"))
    lon, lat = _line_point("if(m <= 300, m, 300 + side)", "if(m <= 300, side, -(m - 300))")
    return rows.selectExpr("cast(user_id as string) as rider", "event_id as seq", "cast(ts as timestamp) as ts", f"{lon} as lon", f"{lat} as lat",
                           "cast(5 + 40 * (event_id % 3) as double) as accuracy", "value % 8 as speed", "cast(if(event_id % 5 = 0, null, event_id % 360) as double) as heading", "cast(null as double) as compass")


def _points(*xy):
    return ", ".join("named_struct('lon', {}, 'lat', {})".format(*_line_point(f"{x}e0", f"{y}e0")) for x, y in xy)


def plan():
    corner = _line_point("300e0", "0e0")
    step = "named_struct('maneuver','{}','instruction','{}','distance_m',{}e0,'duration_s',{}e0,'turn_lon',{},'turn_lat',{})".format
    steps = ", ".join([step("depart", "Head east on Main Street.", 300, 60, "cast(null as double)", "cast(null as double)"),
                       step("right", "Turn right onto Cycle Path.", 200, 50, *corner), step("arrive", "Arrive at your destination.", 0, 0, "cast(null as double)", "cast(null as double)")])
    return F.expr(f"named_struct('version', 1L, 'path', array({_points((0, 0), (300, 0), (300, -200))}), 'steps', array({steps}))")


def ride_events(spark, sf):
    """The events of all riders: the stream run to the end of its input."""
    def build(ws: Workspace):
        events = table(spark, sf, "events")
        micros = F.expr("unix_micros(cast(ts as timestamp))")
        span = events.agg(F.min(micros).alias("a"), F.max(micros).alias("b")).first()  # two numbers, needed as literals in a stream
        starts = events.groupBy(F.col("user_id").cast("string").alias("rider")).agg(F.min(F.col("ts").cast("timestamp")).alias("ts"))
        routes = ws.write(starts.withColumn("route", plan()), "plans")
        # a pattern takes a table that is one file and one that is a folder of part files
        stream_in = landed.fixes(spark, f"{sf.rstrip('/')}/events.parque[t]", events.schema, files_at_once=100)
        plans_in = spark.readStream.schema(routes.schema).parquet(ws.path("plans"))
        before = spark.conf.get(STORE_CONF)
        spark.conf.set(STORE_CONF, ride.STORE)
        try:  # a job takes its store as it starts; other streams of the session keep theirs
            out = ride.follow_riders(plans_in, fixes_from(stream_in, F.lit(span["a"]), F.lit(span["b"])))
            job = ride.write_events(out, ws.path("events"), ws.path("offsets"), available_now=True)
        finally:
            spark.conf.set(STORE_CONF, before)
        job.awaitTermination()
        return spark.read.schema(ride.EVENT_SCHEMA).parquet(ws.path("events"))

    return compiled.once(spark, sf, "ride", build)


@query("ride_progress")
def ride_progress(spark, sf):
    rows = ride_events(spark, sf).where("event = 'progress'")
    return rows.select("rider", "ts", F.round("along_m", 2).alias("along_m"), F.round("off_m", 2).alias("off_m"), "on_route", "next_step", F.round("next_m", 2).alias("next_m"),
                       F.round("seconds_to_go", 2).alias("seconds_to_go"), F.round("heading", 2).alias("heading"), "rotate")


@query("ride_off_route")
def ride_off_route(spark, sf):
    return ride_events(spark, sf).where("event = 'reroute'").select("rider", "ts", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "text")


@query("ride_prompts")
def ride_prompts(spark, sf):
    return ride_events(spark, sf).where("event = 'prompt'").select("rider", "ts", "next_step", F.round("next_m", 2).alias("next_m"), "text")


@query("ride_arrivals")
def ride_arrivals(spark, sf):
    return ride_events(spark, sf).where("event = 'arrived'").select("rider", "ts", F.round("along_m", 2).alias("along_m"), "text")


TURNING = """WITH span AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events)
SELECT event_id AS fix, CASE WHEN m<=300 THEN round(m,2) ELSE round(m,2) END AS along_m FROM (SELECT event_id, 5.2e2*(epoch_us(ts)-a)/(b-a) AS m FROM events, span)"""


@query("ride_true_positions", TURNING)
def ride_true_positions(spark, sf):
    """How far along each event's rider truly is, before any noise."""
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    events = table(spark, sf, "events")
    rows = events.withColumn("a", events.agg(F.min(micros)).scalar()).withColumn("b", events.agg(F.max(micros)).scalar())
    return rows.select(F.col("event_id").alias("fix"), F.round(F.expr(f"{SPAN_M}e0 * (unix_micros(cast(ts as timestamp)) - a) / (b - a)"), 2).alias("along_m"))
