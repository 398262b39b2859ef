"""Landed map layers: explicit schemas, cheap filters first, geometry last."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params
from ..functions import geo, text

LINE = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
BBOX = "struct<xmin:double,xmax:double,ymin:double,ymax:double>"
WHEN = "struct<heading:string,mode:array<string>,vehicle:array<struct<dimension:string,comparison:string,value:double,unit:string>>>"
SEGMENT_SCHEMA = f"""id string, subtype string, class string, names struct<primary:string>, bbox {BBOX}, geometry binary,
    connectors array<struct<connector_id:string,at:double>>,
    access_restrictions array<struct<access_type:string,between:array<double>,when:{WHEN}>>,
    speed_limits array<struct<max_speed:struct<value:double,unit:string>,between:array<double>,when:{WHEN}>>,
    prohibited_transitions array<struct<sequence:array<struct<connector_id:string,segment_id:string>>,when:{WHEN}>>,
    destinations array<struct<to_segment_id:string,to_connector_id:string,labels:array<struct<value:string>>,when:{WHEN}>>"""
CONNECTOR_SCHEMA = f"id string, bbox {BBOX}, geometry binary"
PLACE_SCHEMA = f"""id string, basic_category string, names struct<primary:string>, brand struct<names:struct<primary:string>>,
    addresses array<struct<freeform:string>>, phones array<string>, websites array<string>, confidence double, bbox {BBOX}, geometry binary"""
ADDRESS_SCHEMA = f"street string, number string, unit string, postcode string, bbox {BBOX}, geometry binary"


def _coords(blob, want: int):
    """Coordinates of a well-known-binary geometry of type `want` (1 point,
    2 line); None for other types and damaged bytes."""
    try:
        order = "<" if blob[0] == 1 else ">"
        kind = struct.unpack_from(order + "I", blob, 1)[0]
        dims = 2 + kind // 1000 % 4 if kind < 10_000 else 2
        if kind % 1000 != want or dims > 3:
            return None
        if want == 1:
            n, at = 1, 5
        else:
            n, at = struct.unpack_from(order + "I", blob, 5)[0], 9
        flat = struct.unpack_from(f"{order}{n * dims}d", blob, at)
    except (struct.error, IndexError, TypeError):
        return None
    return [{"lon": flat[i], "lat": flat[i + 1]} for i in range(0, n * dims, dims)]


@F.pandas_udf(LINE)
def wkb_line(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: _coords(b, 2))


@F.pandas_udf(LINE)
def _wkb_point(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: _coords(b, 1))


def wkb_point(blob: Column) -> Column:
    return F.get(_wkb_point(blob), 0)


def overlaps(box: tuple[float, float, float, float]) -> Column:
    """Bounding-box test on plain columns, which reaches the parquet scan."""
    west, south, east, north = box
    return (F.col("bbox.xmax") >= west) & (F.col("bbox.xmin") <= east) & (F.col("bbox.ymax") >= south) & (F.col("bbox.ymin") <= north)


def segments(spark: SparkSession, path: str, box=params.EXTRACT_BOX) -> DataFrame:
    raw = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    return segments_from(raw.where(overlaps(box)))


def segments_from(raw: DataFrame) -> DataFrame:
    kept = raw.where((F.col("subtype") == "road") & (F.size("connectors") >= 2) & F.col("geometry").isNotNull())
    return kept.withColumn("geometry", wkb_line("geometry")).where("geometry is not null")


def connectors(spark: SparkSession, path: str, box=params.EXTRACT_BOX) -> DataFrame:
    raw = spark.read.schema(CONNECTOR_SCHEMA).parquet(path).where(overlaps(box))
    return connectors_from(raw)


def connectors_from(raw: DataFrame) -> DataFrame:
    """Junctions; ids are unique in a release. Of a repeated id the last record counts: the one whose
    point comes last in order, since rows of a table have no place of their own."""
    pts = raw.where("id is not null and geometry is not null").select(F.col("id").alias("node_id"), wkb_point(F.col("geometry")).alias("p")).where("p is not null")
    return pts.groupBy("node_id").agg(F.max("p").alias("p")).select("node_id", geo.rounded_to("p.lon", 5).alias("lon"), geo.rounded_to("p.lat", 5).alias("lat"))


def stations(places: DataFrame) -> DataFrame:
    """Charging stations out of place records."""
    return (
        places.where("basic_category = 'ev_charging_station' and p is not null")
        .select("id", F.col("names.primary").alias("name"), F.col("brand.names.primary").alias("brand"), F.get("addresses", 0)["freeform"].alias("address"),
                F.get("phones", 0).alias("phone"), F.get("websites", 0).alias("website"), "confidence",
                geo.rounded_to("p.lon", 5).alias("lon"), geo.rounded_to("p.lat", 5).alias("lat"))
    )


def named_places(places: DataFrame, order: str = "row_id") -> DataFrame:
    """Named places that are not stations, one per (name, point): the first in
    `order`. Folding duplicates is a minimum per key, combined before the
    shuffle, so a name that repeats very often is no burden."""
    rows = (
        places.where("coalesce(basic_category, '') <> 'ev_charging_station' and coalesce(names.primary, '') <> '' and p is not null")
        .select(F.col(order), "id", F.col("names.primary").alias("name"), F.col("basic_category").alias("category"),
                F.get("addresses", 0)["freeform"].alias("address"), geo.rounded_to("p.lon", 5).alias("lon"), geo.rounded_to("p.lat", 5).alias("lat"))
    )
    key = F.lower("name").alias("key")
    first = rows.groupBy(key, "lon", "lat").agg(F.min(F.struct(order, "id", "name", "category", "address")).alias("r"))
    return first.select(f"r.{order}", "r.id", "r.name", "r.category", "r.address", "lon", "lat")


def place_records(spark: SparkSession, path: str, box=params.EXTRACT_BOX) -> DataFrame:
    """Place records with their point decoded; shared by stations and places,
    which the scan serves in one pass when it is cached or written."""
    raw = spark.read.schema(PLACE_SCHEMA).parquet(path).where(overlaps(box) & F.col("geometry").isNotNull())
    return raw.withColumn("p", wkb_point(F.col("geometry"))).withColumn("row_id", F.col("id"))


def addresses(spark: SparkSession, path: str, box=params.EXTRACT_BOX) -> DataFrame:
    raw = spark.read.schema(ADDRESS_SCHEMA).parquet(path).where(overlaps(box) & F.col("geometry").isNotNull() & (F.coalesce("street", F.lit("")) != ""))
    return clean_addresses(raw.withColumn("p", wkb_point(F.col("geometry"))))


def clean_addresses(raw: DataFrame) -> DataFrame:
    keep = [c for c in raw.columns if c not in ("street", "bbox", "geometry", "p")]
    return raw.where("coalesce(street, '') <> '' and p is not null").select(
        F.upper("street").alias("street"), *keep, geo.rounded_to("p.lon", 6).alias("lon"), geo.rounded_to("p.lat", 6).alias("lat"))


def address_table(spark: SparkSession, path: str) -> DataFrame:
    """The address layer as written, cut to the six columns search uses."""
    return spark.read.schema("street string, number string, unit string, postcode string, lon double, lat double").parquet(path)


LOCKER_JSON = ("array<struct<url_id:string,human_name:string,street_address:string,city:string,longitude:double,latitude:double,"
               "location_friendly_type:string,coming_soon:boolean,num_spaces:int,access_device_types:array<struct<key:string,name:string>>>>")
LOCATIONS_ATTRIBUTE = 'data-maps--map-locations-value="([^"]+)"'


def page_locations(pages: DataFrame, html: str = "html") -> DataFrame:
    """Location records out of the JSON a page carries in an attribute."""
    payload = text.unescape(F.regexp_extract(F.col(html), LOCATIONS_ATTRIBUTE, 1))
    return pages.select(F.explode(F.from_json(payload, LOCKER_JSON)).alias("r")).select("r.*")


def lockers(locations: DataFrame, box=params.EXTRACT_BOX) -> DataFrame:
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return (
        locations.where(~F.coalesce("coming_soon", F.lit(False)) & F.col("location_friendly_type").isin(*params.LOCKER_TYPES) & geo.inside("longitude", "latitude", box))
        .select(F.concat(F.lit("bl-"), F.col("url_id").cast("string")).alias("id"), F.coalesce(F.trim("human_name"), F.lit("")).alias("name"),
                F.col("location_friendly_type").alias("facility_type"), blank("street_address").alias("address"), blank("city").alias("city"), "num_spaces",
                F.transform(F.coalesce("access_device_types", F.array().cast("array<struct<key:string,name:string>>")), lambda d: d["name"]).alias("access_devices"),
                geo.rounded_to("longitude", 5).alias("lon"), geo.rounded_to("latitude", 5).alias("lat"))
    )


POINT_JSON = "struct<type:string,coordinates:array<double>>"


def racks(rows: DataFrame, box=params.EXTRACT_BOX) -> DataFrame:
    """Rack records (all text). Where they lie is told by `shape`, a point with its coordinates
    (a struct, or its JSON text), or by columns `lon` and `lat`; records without two coordinates are left out."""
    if "shape" in rows.columns:
        spot = F.from_json("shape", POINT_JSON) if isinstance(rows.schema["shape"].dataType, T.StringType) else F.col("shape")
        at = spot["coordinates"]
        rows = rows.where(F.coalesce(F.size(at) == 2, F.lit(False))).withColumns({"lon": F.get(at, 0).cast("double"), "lat": F.get(at, 1).cast("double")})
    tidy = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    whole = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).cast("int"))
    street = F.when(tidy("street") != "", F.concat(text.title(tidy("street")), F.lit(" Street")))
    return rows.where(geo.inside("lon", "lat", box)).select(
        F.concat(F.lit("rack-"), F.col("objectid").cast("string")).alias("id"),
        F.coalesce(F.nullif(tidy("address"), F.lit("")), street, F.lit("Bike rack")).alias("name"), F.nullif(tidy("location"), F.lit("")).alias("landmark"),
        F.nullif(text.title(F.coalesce("placement", F.lit(""))), F.lit("")).alias("placement"),
        whole("racks").alias("racks"), whole("spaces").alias("spaces"), whole("install_yr").alias("install_yr"),
        geo.rounded_to("lon", 5).alias("lon"), geo.rounded_to("lat", 5).alias("lat"))


ELEMENT_JSON = "struct<elements:array<struct<type:string,id:bigint,tags:map<string,string>,members:array<struct<type:string,ref:bigint,role:string>>,lon:double,lat:double>>>"


def turn_rules(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Turn restrictions that exempt bicycles, from payloads whose elements
    are relations, ways and nodes: the three are split and joined by id."""
    parts = payloads.select(F.explode(F.from_json(column, ELEMENT_JSON)["elements"]).alias("e")).select("e.*")
    way_names = parts.where("type = 'way'").groupBy(F.col("id").alias("ref")).agg(F.max(F.try_element_at("tags", F.lit("name"))).alias("name"))
    points = parts.where("type = 'node'").groupBy(F.col("id").alias("ref")).agg(F.max(F.struct("lon", "lat")).alias("at"))
    rules = parts.where("type = 'relation'").where(F.array_contains(F.split(F.coalesce(F.try_element_at("tags", F.lit("except")), F.lit("")), ";"), "bicycle"))
    members = rules.select("id", F.explode("members").alias("m")).select("id", "m.*")
    via = (
        members.where("role = 'via' and type = 'node'").join(points, "ref").groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
        .where("n = 1").select("id", F.col("at.lon").alias("via_lon"), F.col("at.lat").alias("via_lat"))
    )
    named = members.where("role in ('from', 'to')").join(way_names, "ref").where("name is not null")
    sides = named.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("role") == "from", F.col("name")))).alias("from_names"),
                                    F.array_sort(F.collect_set(F.when(F.col("role") == "to", F.col("name")))).alias("to_names"))
    none = F.array().cast("array<string>")
    return (
        rules.select(F.col("id"), F.coalesce(F.try_element_at("tags", F.lit("restriction")), F.lit("")).alias("restriction"))
        .join(via, "id").join(sides, "id", "left")
        .select(F.col("id").alias("rule_id"), "restriction", "via_lon", "via_lat", F.coalesce("from_names", none).alias("from_names"), F.coalesce("to_names", none).alias("to_names"))
    )


def features(spark: SparkSession, path: str, properties: str, geometry: str = "array<double>") -> DataFrame:
    """Features of a written layer: one feature a line, or a whole collection
    in one document."""
    one = f"struct<type:string,id:string,properties:struct<{properties}>,geometry:struct<type:string,coordinates:{geometry}>>"
    doc = F.from_json("value", f"struct<type:string,id:string,properties:struct<{properties}>,geometry:struct<type:string,coordinates:{geometry}>,features:array<{one}>>")
    lines = spark.read.text(path).where("value <> ''").select(doc.alias("d"))
    each = lines.select(F.explode(F.coalesce("d.features", F.array(F.struct("d.type", "d.id", "d.properties", "d.geometry")))).alias("f"))
    return each.select("f.id", "f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def point_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    rows = features(spark, path, properties)
    return rows.withColumn("lon", F.get("coordinates", 0)).withColumn("lat", F.get("coordinates", 1)).drop("coordinates", "geometry_type")


def fixes(spark: SparkSession, path: str, schema: str = "rider string, route string, ts timestamp, lon double, lat double, accuracy double, speed double, heading double, compass double", files_at_once: int | None = None) -> DataFrame:
    """The stream of position fixes, or of raw rows that they are derived from, from a folder of part files or a pattern."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)
