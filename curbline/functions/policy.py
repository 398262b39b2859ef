"""Road categories, access, cost and speed as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params
from .geo import col


def lookup(key: Column, values: dict) -> Column:
    """A small fixed table as a CASE; NULL for other keys."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def effective_speed(road_class, posted) -> Column:
    default = F.coalesce(lookup(col(road_class), {k: float(v) for k, v in params.CLASS_SPEED.items()}), F.lit(float(params.OTHER_CLASS_SPEED)))
    return F.coalesce(col(posted).cast("double"), default)


def category(road_class, speed, designated: Column, bikeway: Column | None = None) -> Column:
    """Cost category of one heading of a street; NULL where nothing rides.

    `bikeway` is the surveyed class code, NULL where no survey was supplied:
    only then does the map's own bicycle flag make a lane.
    """
    cls = col(road_class)
    code = F.lit(None).cast("int") if bikeway is None else bikeway
    mph = effective_speed(cls, speed)
    return (
        F.when(cls.isin(*params.UNRIDDEN_CLASSES), F.lit(None).cast("string"))
        .when(cls == "steps", "steps")
        .when(cls.isin(*params.OFF_STREET_CLASSES) | F.coalesce(code.isin(1, 4), F.lit(False)), "bike_path")
        .when(F.coalesce(code == 2, designated), "bike_lane")
        .when(cls == "footway", "sidewalk")
        .when(cls == "living_street", "living_street")
        .when(mph > params.TOP_SPEED, F.lit(None).cast("string"))
        .when(mph <= params.QUIET_TOP, "quiet")
        .when(mph <= params.SHARED_TOP, "shared")
        .otherwise("arterial")
    )


def may_ride(cat, mph, road_max, max_included, lane_exempt) -> Column:
    cat, mph, road_max = col(cat), col(mph), col(road_max)
    return (
        F.when(cat == "steps", False)
        .when(road_max.isNull(), True)
        .when(col(lane_exempt) & cat.isin("bike_lane", "bike_path"), True)
        .when(cat.isin("sidewalk", "living_street"), True)
        .when(col(max_included), mph <= road_max)
        .otherwise(mph < road_max)
    )


def heading_bit(heading) -> Column:
    return F.when(col(heading) == 0, F.lit(1)).otherwise(F.lit(2))


def cost_factor(profile, cat) -> Column:
    rows = {(p, c): v for p, cats in params.COST_FACTOR.items() for c, v in cats.items()}
    return lookup(F.concat_ws("/", col(profile), col(cat)), {f"{p}/{c}": v for (p, c), v in rows.items()})


def lowest_factor(profile) -> Column:
    return lookup(col(profile), {p: min(c.values()) for p, c in params.COST_FACTOR.items()})


def hill_cost(profile, length_m, climb_m) -> Column:
    """Metres of flat riding an edge's climb and steep descent are worth."""
    p, length = col(profile), col(length_m)
    climb = F.coalesce(F.nanvl(col(climb_m), F.lit(0.0)), F.lit(0.0))
    zero = F.lit(0.0)
    up, down = F.greatest(climb, zero), F.greatest(-climb, zero)
    steep_up = F.greatest(up - params.STEEP_UP * length, zero)
    steep_down = F.greatest(down - params.STEEP_DOWN * length, zero)
    k, steep, desc = (lookup(p, {n: v[i] for n, v in params.HILLS.items()}) for i in range(3))
    return up * k + steep_up * k * steep + steep_down * k * desc


def edge_cost(profile, cat, length_m, climb_m) -> Column:
    return col(length_m) * cost_factor(profile, cat) + hill_cost(profile, length_m, climb_m)


def travel_mph(cap_mph, cat, road_mph) -> Column:
    cap = F.coalesce(col(cap_mph), F.lit(params.DEFAULT_CAP_MPH))
    road = col(road_mph)
    rode = F.when(road > 0, F.least(cap, road)).otherwise(cap)
    return F.when(col(cat) == "sidewalk", F.lit(params.WALK_MPH)).otherwise(rode * params.CRUISE_SHARE)


def edge_seconds(cap_mph, profile, cat, road_mph, length_m, climb_m) -> Column:
    length = col(length_m)
    flat = length / (travel_mph(cap_mph, cat, road_mph) * params.MPS_PER_MPH)
    slow = lookup(col(profile), {n: v[3] for n, v in params.HILLS.items()})
    grade = F.when(length > 0, F.greatest(F.coalesce(col(climb_m), F.lit(0.0)), F.lit(0.0)) / length).otherwise(0.0)
    return flat * (1.0 + slow * grade)


def maneuver(angle) -> Column:
    a = col(angle)
    size, side = F.abs(a), F.when(a > 0, "right").otherwise("left")
    return (F.when(size <= params.STRAIGHT_DEG, "straight").when(size >= params.UTURN_DEG, "uturn")
            .when(size < params.SLIGHT_DEG, F.concat(F.lit("slight_"), side)).otherwise(side))


def per_vehicle(vehicle, rows: dict) -> Column:
    """Array of kinds for a vehicle, from a table with a default row."""
    v = col(vehicle)
    out = None
    for name, kinds in rows.items():
        if name == "default":
            continue
        arr = F.array(*[F.lit(k) for k in kinds])
        out = F.when(v == name, arr) if out is None else out.when(v == name, arr)
    return out.otherwise(F.array(*[F.lit(k) for k in rows["default"]]))
