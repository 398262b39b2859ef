"""From road segments to a directed street graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import geo, policy
from .spatial import dealt, pairs_within


# -- segment rules -----------------------------------------------------------

def rule_mask(heading) -> Column:
    """Headings a rule binds: 1 forward, 2 backward, 3 both."""
    h = geo.col(heading)
    return F.when(h == "forward", 1).when(h == "backward", 2).otherwise(3)


def rule_covers_all(lo, hi) -> Column:
    return F.coalesce((geo.col(lo) <= 0) & (geo.col(hi) >= 1), F.lit(True))


def rule_binds(mode, want: str) -> Column:
    """No mode list binds every mode."""
    return F.coalesce(F.array_contains(geo.col(mode), want), F.lit(True))


def denied_bits(access_type, heading, mode, scoped, lo, hi, want: str) -> Column:
    hit = (geo.col(access_type) == "denied") & ~geo.col(scoped) & rule_covers_all(lo, hi) & rule_binds(mode, want)
    return F.when(F.coalesce(hit, F.lit(False)), rule_mask(heading)).otherwise(0)


def designated_bits(access_type, heading, mode, lo, hi) -> Column:
    """Only a rule that names bicycles designates; one without modes does not."""
    hit = (geo.col(access_type) == "designated") & rule_covers_all(lo, hi) & F.array_contains(geo.col(mode), "bicycle")
    return F.when(F.coalesce(hit, F.lit(False)), rule_mask(heading)).otherwise(0)


def speed_key(value, unit, lo, hi) -> Column:
    """Sorts the dominant limit first as a maximum: widest coverage, then the
    lowest speed. A rule without a range covers nothing."""
    mph = F.when(geo.col(unit) == "km/h", geo.col(value) * params.MPH_PER_KMH).otherwise(geo.col(value))
    span = F.greatest(F.lit(0.0), F.least(geo.col(hi), F.lit(1.0)) - F.greatest(geo.col(lo), F.lit(0.0)))
    return F.struct(F.coalesce(F.when(geo.col(lo).isNotNull(), span), F.lit(0.0)).alias("span"), (-mph).alias("slow"))


def access_masks(rules: DataFrame) -> DataFrame:
    """Per segment, from rule rows: headings open to bicycles and to
    motorcycles, and headings designated for bicycles. OR is order-free, so
    rows are combined before they are shuffled and a segment with very many
    rules costs no more than another."""
    args = ("access_type", "heading", "mode", "scoped", "lo", "hi")
    return rules.groupBy("seg_id").agg(
        F.bit_or(denied_bits(*args, "bicycle")).alias("no_bike"),
        F.bit_or(denied_bits(*args, "motorcycle")).alias("no_moto"),
        F.bit_or(designated_bits("access_type", "heading", "mode", "lo", "hi")).alias("bike_desig"),
    ).select("seg_id", (F.lit(3) - F.col("no_bike")).alias("ow"), (F.lit(3) - F.col("no_moto")).alias("ow_moto"), "bike_desig")


def posted_speeds(rules: DataFrame) -> DataFrame:
    """Per segment, the dominant limit (whole mph) among rules for bicycles."""
    return (
        rules.where(F.col("speed").isNotNull() & rule_binds("mode", "bicycle"))
        .groupBy("seg_id").agg(F.max(speed_key("speed", "unit", "lo", "hi")).alias("best"))
        .select("seg_id", F.rint(-F.col("best.slow")).cast("int").alias("speed"))
    )


def trim_segments(raw: DataFrame) -> DataFrame:
    """Landed segment records cut to what routing needs. The rules are nested
    in the record, so this is a projection and shuffles nothing."""
    when = lambda r: r["when"]

    def bits(fn):
        return F.aggregate(F.coalesce(F.col("access_restrictions"), F.array().cast(raw.schema["access_restrictions"].dataType)),
                           F.lit(0), lambda acc, r: acc.bitwiseOR(fn(r)))

    def args(r):
        scoped = F.coalesce(F.size(when(r)["vehicle"]) > 0, F.lit(False))
        return r["access_type"], when(r)["heading"], when(r)["mode"], scoped, F.get(r["between"], 0), F.get(r["between"], 1)

    limits = F.filter(F.col("speed_limits"), lambda r: r["max_speed"].isNotNull() & rule_binds(when(r)["mode"], "bicycle"))
    keys = F.transform(limits, lambda r: speed_key(
        r["max_speed"]["value"], F.coalesce(r["max_speed"]["unit"], F.lit("mph")), F.get(r["between"], 0), F.get(r["between"], 1)))
    bans = F.filter(F.col("prohibited_transitions"), lambda t: F.size(t["sequence"]) > 0)
    signs = F.filter(F.col("destinations"), lambda d: F.size(d["labels"]) > 0)
    conns = F.array_sort(F.transform(F.col("connectors"), lambda c: F.struct(
        F.coalesce(c["at"], F.lit(0.0)).alias("at"), c["connector_id"].alias("connector_id"))))
    return (
        raw.where(F.size("connectors") >= 2)
        .select(
            F.col("id").alias("seg_id"), F.col("names.primary").alias("name"), F.coalesce("class", F.lit("unknown")).alias("class"),
            F.rint(-F.array_max(keys)["slow"]).cast("int").alias("speed"),
            (F.lit(3) - bits(lambda r: denied_bits(*args(r), "bicycle"))).alias("ow"),
            (F.lit(3) - bits(lambda r: denied_bits(*args(r), "motorcycle"))).alias("ow_moto"),
            bits(lambda r: designated_bits(args(r)[0], args(r)[1], args(r)[2], args(r)[4], args(r)[5])).alias("bike_desig"),
            F.transform(bans, lambda t: F.struct(
                F.get(t["sequence"], 0)["connector_id"].alias("connector_id"), F.get(t["sequence"], 0)["segment_id"].alias("to_seg"),
                rule_mask(when(t)["heading"]).alias("mask"))).alias("prohib"),
            F.transform(signs, lambda d: F.struct(
                d["to_segment_id"].alias("to_seg"), d["to_connector_id"].alias("connector_id"),
                F.get(d["labels"], 0)["value"].alias("label"), rule_mask(when(d)["heading"]).alias("mask"))).alias("dest"),
            F.transform(conns, lambda c: F.struct(c["connector_id"].alias("connector_id"), c["at"].alias("at"))).alias("conns"),
            geo.rounded(F.col("geometry"), 5).alias("geometry"),
        )
    )


# -- graph -------------------------------------------------------------------

def whole_segments(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments with two or more connectors, all of them known. Only ids are
    shuffled to find the misses; the segments themselves are filtered by the
    (few) ids that missed."""
    ends = segments.select("seg_id", F.explode("conns.connector_id").alias("node_id"))
    missing = ends.join(nodes.select("node_id"), "node_id", "left_anti").select("seg_id").distinct()
    return segments.where(F.size("conns") >= 2).join(missing, "seg_id", "left_anti")


def resolved_bans(bans: DataFrame, segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ban rows (seg_id, connector_id, to_seg, mask) whose junction and target
    exist, one row per heading bit."""
    known = segments.select(F.col("seg_id").alias("to_seg"))
    return (
        bans.join(known, "to_seg", "left_semi")
        .join(nodes.select(F.col("node_id").alias("connector_id")), "connector_id", "left_semi")
        .withColumn("bit", F.explode(F.array(F.lit(1), F.lit(2))))
        .where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
        .select(F.col("seg_id").alias("from_seg"), "bit", F.col("connector_id").alias("at_node"), "to_seg").distinct()
    )


def resolved_signs(signs: DataFrame, segments: DataFrame, nodes: DataFrame) -> DataFrame:
    known = segments.select(F.col("seg_id").alias("to_seg"))
    return (
        signs.join(known, "to_seg", "left_semi")
        .join(nodes.select(F.col("node_id").alias("connector_id")), "connector_id", "left_semi")
        .select(F.col("seg_id").alias("from_seg"), "to_seg", F.col("connector_id").alias("at_node"), "label", "mask", "pos")
    )


def lift_bans_for_bicycles(bans: DataFrame, rules: DataFrame, segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bans with `moto_only`: true where a rule exempts bicycles from it.

    A rule meets the junctions within 15 m of its via point (a join on map
    cells), binds bans leaving a street it names, and lifts every one of them
    (`only_`) or those into a street it names (`no_`).
    """
    via = rules.select("rule_id", F.col("via_lon").alias("lon"), F.col("via_lat").alias("lat"), "restriction", "from_names", "to_names")
    at = nodes.join(bans.select(F.col("at_node").alias("node_id")), "node_id", "left_semi").select("node_id", "lon", "lat")
    met = pairs_within(via, at, params.EXEMPT_RADIUS_M, keep_left=["restriction", "from_names", "to_names"], keep_right=["node_id"])
    names = segments.select("seg_id", "name")
    lifted = (
        bans.join(met.withColumnRenamed("node_id", "at_node"), "at_node")
        .join(names.select(F.col("seg_id").alias("from_seg"), F.col("name").alias("from_name")), "from_seg")
        .where(F.array_contains("from_names", F.col("from_name")))
        .join(names.select(F.col("seg_id").alias("to_seg"), F.col("name").alias("to_name")), "to_seg")
        .where(F.col("restriction").startswith("only_") | F.array_contains("to_names", F.col("to_name")))
        .select("from_seg", "bit", "at_node", "to_seg").distinct().withColumn("moto_only", F.lit(True))
    )
    return bans.join(lifted, ["from_seg", "bit", "at_node", "to_seg"], "left").withColumn("moto_only", F.coalesce("moto_only", F.lit(False)))


def edges(segments: DataFrame, inferred: DataFrame | None = None, surveyed: DataFrame | None = None) -> DataFrame:
    """Directed edges between consecutive connectors, both headings that any
    vehicle may use. `inferred` (seg_id, inferred) holds limits taken from the
    same street; `surveyed` (seg_id, fwd, bwd, opened) the bikeway classes: a
    missing table differs from one with no match for a segment.
    """
    df = segments
    if inferred is not None:
        df = df.join(dealt(inferred.select("seg_id", "inferred")), "seg_id", "left")
    else:
        df = df.withColumn("inferred", F.lit(None).cast("int"))
    if surveyed is not None:
        df = df.join(dealt(surveyed.select("seg_id", "fwd", "bwd", "opened")), "seg_id", "left").na.fill(0, ["fwd", "bwd", "opened"])
    else:
        df = df.select("*", *[F.lit(None).cast("int").alias(c) for c in ("fwd", "bwd", "opened")])
    opened = F.coalesce("opened", F.lit(0))
    n = F.size("conns")
    stops = F.array_sort(F.transform("conns", lambda c: F.struct(c["at"].alias("at"), c["connector_id"].alias("node"))))
    pairs = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.struct(
        i.alias("pos"), F.element_at(F.col("stops"), i).alias("a"), F.element_at(F.col("stops"), i + 1).alias("b")))
    df = (
        df.withColumn("n", n).where("n >= 2").withColumn("stops", stops)
        .withColumn("cum", geo.running(geo.leg_lengths(F.col("geometry")))).withColumn("seg_m", F.element_at("cum", -1)).where("seg_m > 0")
        .withColumn("ow", F.coalesce("ow", F.lit(3)).bitwiseOR(opened)).withColumn("ow_moto", F.coalesce("ow_moto", F.lit(3)))
        .withColumn("limit", F.coalesce("speed", "inferred"))
        .withColumn("pair", F.explode(pairs)).withColumn("heading", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("bit", policy.heading_bit("heading"))
        .where((F.col("pair.b.at") - F.col("pair.a.at") > 1e-9) & (F.col("ow").bitwiseOR(F.col("ow_moto")).bitwiseAND(F.col("bit")) != 0))
    )
    ahead = F.col("heading") == 0
    code = F.when(ahead, F.col("fwd")).otherwise(F.col("bwd"))
    designated = F.coalesce("bike_desig", F.lit(0)).bitwiseAND(F.col("bit")) != 0
    piece = geo.stretch(F.col("geometry"), F.col("cum"), F.col("pair.a.at"), F.col("pair.b.at"))
    return (
        df.withColumn("category", policy.category("class", "limit", designated, code)).where("category is not null")
        .select(
            F.concat(F.col("seg_id").cast("string"), F.when(ahead, ">").otherwise("<"), F.col("pair.pos").cast("string")).alias("edge_id"),
            "seg_id", "heading", "bit",
            F.when(ahead, F.col("pair.a.node")).otherwise(F.col("pair.b.node")).alias("from_node"),
            F.when(ahead, F.col("pair.b.node")).otherwise(F.col("pair.a.node")).alias("to_node"),
            (F.col("seg_m") * (F.col("pair.b.at") - F.col("pair.a.at"))).alias("length_m"),
            "name", "class", "category", policy.effective_speed("class", "limit").alias("eff_mph"),
            F.col("speed").alias("posted_mph"), "ow", "ow_moto",
            F.when(ahead, piece).otherwise(F.reverse(piece)).alias("geometry"),
        )
    )


def with_climb(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds climb_m: ground at the end less ground at the start, 0 if unknown."""
    ground = nodes.select("node_id", "elev")
    return (
        edges.join(ground.select(F.col("node_id").alias("from_node"), F.col("elev").alias("elev0")), "from_node", "left")
        .join(ground.select(F.col("node_id").alias("to_node"), F.col("elev").alias("elev1")), "to_node", "left")
        .withColumn("climb_m", F.coalesce(F.nanvl(F.col("elev1") - F.col("elev0"), F.lit(0.0)), F.lit(0.0))).drop("elev0", "elev1")
    )


def edge_access(edges: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Edges × the vehicles that may ride them. The vehicle table is a fixed
    eight rows, so it is broadcast."""
    open_bits = F.when(F.col("mode") == "motorcycle", F.col("ow_moto")).otherwise(F.col("ow"))
    allowed = (F.col("routable") & (open_bits.bitwiseAND(F.col("bit")) != 0)
               & policy.may_ride("category", "eff_mph", "road_max", "max_included", "lane_exempt"))
    return edges.join(F.broadcast(vehicles), allowed)


def vehicle_counts(edges: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(vehicle, edges, out_nodes, in_nodes): edges a vehicle may ride, and junctions with one to leave or to arrive by.

    A junction is one row with a bit for each vehicle and direction, and not a row for each vehicle.
    """
    bits = vehicles.select("vehicle", F.expr("shiftleft(1, cast(ordinal as int))").alias("mark"))
    who = edge_access(edges, vehicles.join(F.broadcast(bits), "vehicle"))
    ends = who.select(F.explode(F.array(
        F.struct(F.col("from_node").alias("node"), F.col("mark").alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("to_node").alias("node"), F.lit(0).alias("out"), F.col("mark").alias("into")))).alias("e")).select("e.*")
    nodes = ends.where("node is not null").groupBy("node").agg(F.bit_or("out").alias("out"), F.bit_or("into").alias("into"))
    has = lambda c: F.col(c).bitwiseAND(F.col("mark")) != 0
    seen = nodes.join(F.broadcast(bits), has("out") | has("into")).groupBy("vehicle").agg(F.count_if(has("out")).alias("out_nodes"), F.count_if(has("into")).alias("in_nodes"))
    return who.groupBy("vehicle").agg(F.count("*").alias("edges")).join(seen, "vehicle", "left").select(
        "vehicle", "edges", F.coalesce("out_nodes", F.lit(0)).alias("out_nodes"), F.coalesce("in_nodes", F.lit(0)).alias("in_nodes"))


def legal_turns(access: DataFrame, bans: DataFrame) -> DataFrame:
    """Edge-to-edge moves at a junction per vehicle or routing class: no
    reversal on one segment, no banned move. `access` needs who, mode."""
    into = access.select("who", "mode", F.col("edge_id").alias("in_edge"), F.col("seg_id").alias("in_seg"),
                         F.col("heading").alias("in_heading"), F.col("bit").alias("in_bit"), F.col("to_node").alias("node"))
    out = access.select("who", F.col("edge_id").alias("out_edge"), F.col("seg_id").alias("out_seg"),
                        F.col("heading").alias("out_heading"), F.col("from_node").alias("node"))
    moves = into.join(dealt(out), ["who", "node"]).where(~((F.col("in_seg") == F.col("out_seg")) & (F.col("in_heading") != F.col("out_heading"))))
    ban = bans.select(F.col("from_seg").alias("in_seg"), F.col("bit").alias("in_bit"), F.col("at_node").alias("node"),
                      F.col("to_seg").alias("out_seg"), "moto_only")
    b = ban.alias("b")
    m = moves.alias("m")
    hit = ((F.col("m.in_seg") == F.col("b.in_seg")) & (F.col("m.in_bit") == F.col("b.in_bit")) & (F.col("m.node") == F.col("b.node"))
           & (F.col("m.out_seg") == F.col("b.out_seg")) & (~F.col("b.moto_only") | (F.col("m.mode") == "motorcycle")))
    return m.join(b, hit, "left_anti").select("who", "in_edge", "out_edge", "node")


def display_roads(features: DataFrame) -> DataFrame:
    """Features (class, geometry type, lines) cut to what a map draws. `lines`
    is an array of lines; one line for a LineString."""
    drawn = features.where(F.col("geometry_type").isin("LineString", "MultiLineString") & (F.size("lines") > 0))
    return drawn.select(F.col("class"), "geometry_type", F.transform("lines", lambda line: geo.rounded(line, 5)).alias("lines"))
