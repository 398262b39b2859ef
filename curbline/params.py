"""Policy, costs and service areas.

These must equal the published policy for results to agree, so they are kept
together as plain data. Everything that decides a result and is not data lives
in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Boxes as (west, south, east, north).
EXTRACT_BOX = (-122.55, 37.65, -122.30, 37.87)
SERVICE_BOX = (-122.52, 37.70, -122.35, 37.84)

EARTH_M = 6_371_000.0
PARKING_EARTH_M = 6_371_008.8  # the parking distance uses the mean radius
MPS_PER_MPH = 0.44704
MILE_M = 1609.344
FEET_PER_M = 3.28084
MPH_PER_KMH = 0.621371

# Effective limits (mph) for streets with no posted one, by road class.
CLASS_SPEED = {
    "residential": 25, "living_street": 15, "unclassified": 25, "service": 20, "pedestrian": 10,
    "tertiary": 25, "secondary": 40, "trunk": 50, "primary": 55, "motorway": 65,
}
OTHER_CLASS_SPEED = 25
TOP_SPEED = 45
QUIET_TOP = 20
SHARED_TOP = 28

UNRIDDEN_CLASSES = ("bridleway",)
OFF_STREET_CLASSES = ("cycleway", "path", "track")
TRAFFIC_CATEGORIES = ("quiet", "shared", "arterial")

# Cost per metre, by profile and category.
COST_FACTOR = {
    "A": {"bike_path": 0.85, "bike_lane": 0.85, "living_street": 0.9, "sidewalk": 20.0,
          "quiet": 1.0, "shared": 1.3, "arterial": 3.0, "steps": 1000.0},
    "B": {"bike_path": 0.85, "bike_lane": 0.85, "living_street": 0.9, "sidewalk": 20.0,
          "quiet": 1.0, "shared": 1.0, "arterial": 1.6, "steps": 1000.0},
    "C": {"bike_path": 3.0, "bike_lane": 3.0, "living_street": 0.9, "sidewalk": 20.0,
          "quiet": 1.1, "shared": 0.9, "arterial": 1.0, "steps": 1000.0},
    "D": {"bike_path": 0.8, "bike_lane": 1.4, "living_street": 1.3, "sidewalk": 20.0,
          "quiet": 3.0, "shared": 5.0, "arterial": 10.0, "steps": 1000.0},
}

# Per profile: cost of a metre climbed, extra weight of its steep part, weight
# of a steep descent, and how much a grade slows the ride.
HILLS = {
    "A": (20.0, 3.0, 4.0, 6.0),
    "B": (10.0, 2.0, 1.0, 4.0),
    "C": (3.0, 1.0, 0.0, 1.5),
    "D": (20.0, 3.0, 4.0, 6.0),
}
STEEP_UP = 0.08
STEEP_DOWN = 0.15

CRUISE_SHARE = 0.75
WALK_MPH = 3.0
DEFAULT_CAP_MPH = 15.0

# Vehicles in canonical order: id, label, speed cap, routable, cost profile,
# top road speed, that speed included, bike lanes exempt, access mode, keeps
# out of traffic.
VEHICLES = (
    ("scooter", "E-scooter", 15.0, True, "A", 25.0, True, True, "bicycle", False),
    ("emb", "E-skateboard / Onewheel", 15.0, True, "D", 25.0, True, True, "bicycle", True),
    ("euc", "Electric unicycle (EUC)", 15.0, True, "A", 25.0, True, True, "bicycle", False),
    ("ebike_c1", "Class 1 e-bike", 20.0, True, "A", None, True, False, "bicycle", False),
    ("ebike_c2", "Class 2 e-bike", 20.0, True, "A", None, True, False, "bicycle", False),
    ("ebike_c3", "Class 3 e-bike", 28.0, True, "B", None, True, False, "bicycle", False),
    ("moped", "Moped", 30.0, True, "C", None, True, False, "motorcycle", False),
    ("emoto", "E-moto (Sur-Ron, Talaria, etc.)", None, False, None, None, True, False, "bicycle", False),
)
DEFAULT_VEHICLE = "scooter"

# Parking kinds a vehicle may use, and pins it is shown.
PARKING_KINDS = {"default": ("charger", "locker", "rack"), "moped": ("charger", "moto"), "emoto": ("charger", "moto")}
PIN_KINDS = {"default": ("charger", "locker", "rack", "moto"), "moped": ("charger", "moto"), "emoto": ("charger", "moto")}
PARKING_MAX_M = 1609.0

# Snapping.
SNAP_M = 200.0
POCKET_NODES = 30
SNAP_TRIES = 40
SNAP_CORNER_M = 3.0
SIDEWALK_SLACK_M = 15.0
SNAP_NEAR_NODES = 64
SAME_STREET_M = 0.5

# Address labels.
NEAR_M = 150.0
AT_M = 25.0

# Bikeway matching.
MATCH_M = 12.0
MATCH_DEG = 30.0
SHORT_LINE_M = 30.0
PATHLIKE_CLASSES = ("cycleway", "path", "track", "pedestrian", "footway")
EXEMPT_RADIUS_M = 15.0

# Step wording.
STRAIGHT_DEG = 25.0
SLIGHT_DEG = 60.0
UTURN_DEG = 150.0
SHORT_STEP_M = 40.0
SHORT_UNNAMED_M = 60.0

LOCKER_TYPES = ("eLocker", "eRack", "Group Parking", "Bike Hangar")

OUTSIDE_NAMES = (
    "Oakland", "Berkeley", "Alameda", "Emeryville", "Richmond", "Sausalito", "Saucalito", "Marin", "Tiburon",
    "Mill Valley", "Daly City", "Pacifica", "Brisbane", "San Mateo", "Burlingame", "Millbrae", "SFO",
    "Palo Alto", "San Jose", "Walnut Creek", "Lake Merritt",
)

# Misplaced records by name and category (None: any category).
BAD_PLACES = (
    ("Ferry Building, Embarcadero", "historic_site"),
    ("Oakland Coliseum", None),
    ("Oakland Colesium", None),
    ("Oakland Oracle Arena", "stadium_arena"),
    ("SFO Int'l Airport", "airport"),
    ("Lake Merritt Oakland", "lake"),
    ("University Of California Berkeley", "college_university"),
    ("Coyote Point Park, San Mateo", "park"),
    ("Vista Point Marin County", "mountain"),
    ("Saucalito City, Marin County", "community_center"),
    ("Sutro Baths and Cliff House", "historic_site"),
    ("Lands End/Sutro Baths", "national_park"),
    ("Terra Nova High School (Pacifica)", "high_school"),
    ("Sharp Park Beach, Pacifica, California", "beach"),
    ("Nike Missile Site- Marin Headlands", "sports_and_recreation"),
    ("Marin Headlands, California", "mountain"),
    ("Fish Restaurant, Sausalito", "restaurant"),
    ("Fort Mason", "historic_site"),
    ("Yerba Buena Gardens", "historic_site"),
    ("SFO International Airport", None),
)
ADDED_PLACES = (
    ("added-union-square", "Union Square", "plaza", None, -122.40752, 37.78799),
    ("added-city-hall", "City Hall", "landmark_and_historical_building", "1 Dr Carlton B Goodlett Pl", -122.41924, 37.77927),
    ("added-portsmouth-square", "Portsmouth Square", "park", None, -122.40567, 37.79486),
    ("added-fort-mason", "Fort Mason", "park", "2 Marina Blvd", -122.43150, 37.80610),
    ("added-painted-ladies", "Painted Ladies", "landmark_and_historical_building", "710 Steiner St", -122.43275, 37.77617),
)
NAME_FIXES = (("Oakland-San Francico Bay Bridge", "Oakland-San Francisco Bay Bridge"),)

# Ride mode.
RIDE = {
    "off_route_m": 40.0, "off_route_fixes": 3, "off_route_s": 5.0, "timer_s": 5.05, "vague_m": 50.0,
    "passed_m": 8.0, "arrive_m": 20.0, "arrive_clear_s": 10.0, "far_prompt_m": 152.0, "near_prompt_m": 30.0,
    "course_mps": 1.5, "rotate_s": 0.5, "rotate_deg": 6.0, "back_m": 50.0,
}
RIDE_M_PER_DEG = 111_320.0

VEHICLE_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType()), T.StructField("vehicle", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("cap_mph", T.DoubleType()),
    T.StructField("routable", T.BooleanType()), T.StructField("profile", T.StringType()),
    T.StructField("road_max", T.DoubleType()), T.StructField("max_included", T.BooleanType()),
    T.StructField("lane_exempt", T.BooleanType()), T.StructField("mode", T.StringType()),
    T.StructField("avoids_traffic", T.BooleanType()), T.StructField("rides_as", T.StringType()),
])


def rides_as(row: tuple) -> str | None:
    """Vehicles that agree on cost and access share one routing class, named
    after the first of them: their best routes are the same."""
    if not row[3]:
        return None
    return next(v[0] for v in VEHICLES if v[4:9] == row[4:9])


def vehicles(spark: SparkSession) -> DataFrame:
    rows = [(i, *v, rides_as(v)) for i, v in enumerate(VEHICLES)]
    return spark.createDataFrame(rows, VEHICLE_SCHEMA)
