"""Place records: corrections and the two audits of misplaced ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import geo
from ..functions.text import fold


def _bad(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame(list(params.BAD_PLACES), "bad_name string, bad_category string").select(fold("bad_name").alias("bad_key"), "bad_category")


def without_bad(places: DataFrame) -> DataFrame:
    """Drops records listed as misplaced, by folded name and category (or any
    category). The list is a fixed table, so it is broadcast."""
    keyed = places.withColumn("fold_key", fold("name"))
    hit = (F.col("fold_key") == F.col("bad_key")) & (F.col("bad_category").isNull() | (F.col("category") == F.col("bad_category")))
    return keyed.join(F.broadcast(_bad(places)), hit, "left_anti")


def fixed(places: DataFrame) -> DataFrame:
    """Records as search should see them: hand-added ones first (source 0, so
    they lead a tie), misplaced ones gone, misspelled names corrected."""
    spark = places.sparkSession
    added = spark.createDataFrame([(i, *r) for i, r in enumerate(params.ADDED_PLACES)],
                                  "row_id bigint, id string, name string, category string, address string, lon double, lat double")
    names = F.create_map(*[F.lit(x) for pair in params.NAME_FIXES for x in pair])
    kept = without_bad(places).drop("fold_key").withColumn("name", F.coalesce(F.try_element_at(names, F.col("name")), F.col("name")))
    cols = ["row_id", "id", "name", "category", "address", "lon", "lat"]
    return added.select(F.lit(0).alias("source"), *cols).unionByName(kept.select(F.lit(1).alias("source"), *cols))


def suspects(places: DataFrame) -> DataFrame:
    """No address, inside the city, named after somewhere outside it."""
    outside = r"(?i)\b(" + "|".join(params.OUTSIDE_NAMES) + r")\b"
    seen = places.where((F.coalesce("address", F.lit("")) == "") & geo.in_service_area("lon", "lat") & F.col("name").rlike(outside))
    return without_bad(seen).drop("fold_key")


NAMESAKES = 3
CLUSTER_M = 400.0
FAR_M = 1000.0


def far_from_namesakes(places: DataFrame) -> DataFrame:
    """Address-less city records far from the tight cluster of records named
    after them: (place columns, dist_m).

    A record named "X y z" is a namesake of "X" and of "X y": each name is
    looked up by its prefixes, so this is an equality join, made against
    names and not records. Medians are over coordinates kept to five places,
    a bounded set of values; the spread needs no median, only how many lie
    within the limit and the two distances next to it.
    """
    keyed = places.withColumn("fold_key", fold("name"))
    asked = without_bad(places.where((F.coalesce("address", F.lit("")) == "") & (F.coalesce("name", F.lit("")) != "") & geo.in_service_area("lon", "lat")))
    names = asked.select(F.col("fold_key").alias("prefix")).distinct()
    n_words = F.size(F.split("fold_key", " "))
    prefixes = keyed.select("lon", "lat", "fold_key", F.explode(F.sequence(F.lit(1), F.greatest(n_words - 1, F.lit(1)))).alias("k"), n_words.alias("n")).where("n > 1")
    prefixes = prefixes.select("lon", "lat", F.expr("substring_index(fold_key, ' ', k)").alias("prefix"))
    sakes = prefixes.join(names, "prefix")
    middle = sakes.groupBy("prefix").agg(F.median("lon").alias("clon"), F.median("lat").alias("clat"), F.count("*").alias("n")).where(F.col("n") >= NAMESAKES)
    d = geo.haversine("lon", "lat", "clon", "clat")
    within = sakes.join(middle, "prefix").withColumn("d", d).groupBy("prefix", "clon", "clat", "n").agg(
        F.count_if(F.col("d") <= CLUSTER_M).alias("inside"), F.max(F.when(F.col("d") <= CLUSTER_M, F.col("d"))).alias("below"),
        F.min(F.when(F.col("d") > CLUSTER_M, F.col("d"))).alias("above"))
    tight = within.where((F.col("inside") * 2 > F.col("n")) | ((F.col("inside") * 2 == F.col("n")) & ((F.col("below") + F.col("above")) / 2 <= CLUSTER_M)))
    return (
        asked.join(tight.select(F.col("prefix").alias("fold_key"), "clon", "clat"), "fold_key")
        .withColumn("dist_m", geo.haversine("lon", "lat", "clon", "clat")).where(F.col("dist_m") >= FAR_M).drop("fold_key", "clon", "clat")
    )
