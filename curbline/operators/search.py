"""Address search, place search, their union, and labels for points."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params
from ..functions import geo, text
from ..functions.text import fold
from ..session import Workspace
from .spatial import nearest_within


PARTS_AT_ONCE = 1_000  # partitions whose counts are added up together


def positions(ordered: DataFrame, ws: Workspace) -> DataFrame:
    """Numbers the rows of a sorted DataFrame (pos from 1) without gathering
    them: rows are counted per partition, and the counts, added up in blocks
    and then over the blocks, shift each one."""
    parts = ws.write(ordered.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "sorted")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("nth").alias("first")).withColumn("block", F.floor(F.col("part") / PARTS_AT_ONCE))
    earlier = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("whole"))
    # a thousandth of the partitions, in one window
    blocks = blocks.select("block", F.coalesce(F.sum("whole").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = sizes.withColumn("inner", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(blocks, "block").select("part", "first", (F.col("base") + F.col("inner")).alias("shift"))
    return parts.join(before, "part").withColumn("pos", F.col("nth") - F.col("first") + F.col("shift") + 1).drop("part", "nth", "first", "shift")


# -- labels for points -------------------------------------------------------

def reverse(points: DataFrame, addresses: DataFrame, ws: Workspace, radius_m: float = params.NEAR_M) -> DataFrame:
    """Points with the nearest address within a radius (NULLs if none)."""
    sites = addresses.select("row_id", text.unpadded_street("street").alias("street"), "number", "unit", "lon", "lat")
    found = nearest_within(points, sites, radius_m, ws)
    found = found.select(F.col("plon").alias("lon"), F.col("plat").alias("lat"), "dist_m", "site.street", "site.number", "site.unit")
    return points.join(found, ["lon", "lat"], "left")


def point_labels(found: DataFrame) -> DataFrame:
    shown = F.when(F.col("dist_m").isNotNull(), text.display_address("number", "street"))
    label = F.when(F.col("dist_m").isNull(), "Dropped pin").when(F.col("dist_m") <= params.AT_M, shown).otherwise(F.concat(F.lit("Near "), shown))
    return found.withColumn("address", shown).withColumn("label", label)


# -- addresses ---------------------------------------------------------------

def _grams(col: str):
    c = F.col(col)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, 2)))


def _chars(col: str):
    c = F.col(col)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, 1)))


CLOSE = 0.75


@F.pandas_udf(T.DoubleType())
def _likeness(typed: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, n, t).ratio() for t, n in zip(typed, names)], dtype="float64")


def close_streets(typed: DataFrame, streets: DataFrame, keep: int) -> DataFrame:
    """(q, street, rank): streets at least 0.75 alike, best first.

    Two strings that alike and longer than eight letters together share two
    neighbouring letters (were every matched run one letter long, the
    unmatched ones between the runs would already push the ratio under 0.75);
    shorter ones share a letter. So pairs meet on letter pairs, or single
    letters, and on length, and only those are scored.
    """
    q = typed.withColumn("lq", F.length("q"))
    s = streets.withColumn("ls", F.length("street"))
    able = (F.least("lq", "ls") * 2 >= CLOSE * (F.col("lq") + F.col("ls")))
    long = (q.withColumn("g", F.explode(_grams("q"))).join(s.withColumn("g", F.explode(_grams("street"))), "g").where(able & (F.col("lq") + F.col("ls") > 8)))
    short = (q.where("lq <= 5").withColumn("g", F.explode(_chars("q"))).join(s.where("ls <= 5").withColumn("g", F.explode(_chars("street"))), "g")
             .where(able & (F.col("lq") + F.col("ls") <= 8)))
    pairs = long.select("q", "street").unionByName(short.select("q", "street")).distinct()
    scored = pairs.withColumn("ratio", _likeness("q", "street")).where(F.col("ratio") >= CLOSE)
    best = Window.partitionBy("q").orderBy(F.desc("ratio"), F.desc("street"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).select("q", "street", "rank")


def candidate_streets(typed: DataFrame, streets: DataFrame, keep: int) -> DataFrame:
    """(q, street, rank) for distinct street texts: the street itself; else
    the first `keep` that start with it; else the closest. `streets` needs
    street and first (its order of appearance)."""
    exact = typed.join(streets, F.col("q") == F.col("street"), "left_semi").select("q", F.col("q").alias("street"), F.lit(1).alias("rank"))
    rest = typed.join(exact, "q", "left_anti")
    # a street is found by its beginnings, at the lengths that were typed
    sizes = rest.select(F.length("q").alias("n")).distinct()
    starts = streets.join(F.broadcast(sizes), F.length("street") >= F.col("n")).select(F.substring("street", F.lit(1), F.col("n")).alias("q"), "street", "first")
    order = Window.partitionBy("q").orderBy("first")
    begun = rest.join(starts, "q").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("q", "street", "rank")
    close = close_streets(rest.join(begun, "q", "left_anti"), streets.select("street"), keep)
    return exact.unionByName(begun).unionByName(close)


def address_book(addresses: DataFrame, per_street: int, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(streets, numbered, heads) from address rows.

    streets: street, first. numbered: one row per (street, number), for
    queries that name a number. heads: the first `per_street` numbers of each
    street, for queries that do not. A record without a unit stands for its
    address; several records drop the unit. `heads` stops reading a spelling
    of a street at its first further number, so later records do not count.
    """
    rows = addresses.withColumn("spelled", F.col("street")).withColumn("street", text.unpadded_street("street"))
    spelled = rows.groupBy("spelled").agg(F.min("row_id").alias("bucket"))
    rows = ws.write(rows.join(spelled, "spelled").withColumn("ord", F.struct("bucket", "row_id")), "book-rows")
    streets = rows.groupBy("street").agg(F.min("row_id").alias("first"))
    bare = F.coalesce(F.col("unit"), F.lit("")) == ""
    record = F.struct("number", "unit", "postcode", "lon", "lat")

    def fold_rows(df):
        return df.groupBy("street", "number").agg(F.count("*").alias("n"), F.min_by(record, F.struct((~bare).alias("has_unit"), "ord")).alias("r"), F.min("ord").alias("at"))

    numbered = fold_rows(rows.where("number is not null"))
    # number NULL is one of the numbers of a street here
    firsts = rows.groupBy("street", "number").agg(F.min("ord").alias("at"))
    nth = Window.partitionBy("street").orderBy("at")
    shown = firsts.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= per_street).select("street", "number", "nth")
    shown = ws.write(shown, "book-heads")
    same = rows["street"].eqNullSafe(F.col("h.street")) & rows["number"].eqNullSafe(F.col("h.number"))
    over = rows.join(shown.alias("h"), same, "left_anti").groupBy("street", "bucket").agg(F.min("row_id").alias("stop"))
    read = rows.join(over.select(F.col("street").alias("s2"), F.col("bucket").alias("b2"), "stop"), (F.col("street") == F.col("s2")) & (F.col("bucket") == F.col("b2")), "left")
    read = read.where("stop is null or row_id < stop").select(*rows.columns)
    read = read.join(shown.select(F.col("street").alias("s3"), F.col("number").alias("n3")), (F.col("street") == F.col("s3")) & F.col("number").eqNullSafe(F.col("n3")), "left_semi")
    heads = fold_rows(read)
    return streets, numbered, heads


MAX_RESULTS = 10


def search_addresses(queries: DataFrame, addresses: DataFrame, ws: Workspace, limit: int = MAX_RESULTS) -> DataFrame:
    """Per query (query_id, query): ranked addresses (query_id, rank, text,
    street, number, unit, postcode, lon, lat, score)."""
    streets, numbered, heads = address_book(addresses, max(1, limit // 3), ws)
    asked = queries.select("query_id", text.house_number("query").alias("num"), text.unpadded_street(F.upper(text.street_words("query"))).alias("q")).where("q <> ''")
    typed = ws.write(asked.select("q", "num").distinct(), "search-typed")
    found = ws.write(candidate_streets(typed.select("q").distinct(), streets, 3 * MAX_RESULTS), "search-streets")
    hits = typed.join(found, "q")
    by_number = hits.where("num is not null").join(numbered.withColumnRenamed("number", "num"), ["street", "num"]).select("q", "num", "rank", "street", "n", "r", "at", F.lit(100).alias("score"))
    by_street = hits.where("num is null").join(heads.drop("number"), "street").select("q", "num", "rank", "street", "n", "r", "at", F.lit(60).alias("score"))
    rows = by_number.unionByName(by_street)
    # streets are read in order until there are twice as many results as asked
    per = rows.groupBy("q", "num", "rank").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("q", "num").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = per.withColumn("before", F.coalesce(F.sum("k").over(upto), F.lit(0))).where(F.col("before") < 2 * limit).select(
        F.col("q").alias("q2"), F.col("num").alias("num2"), F.col("rank").alias("rank2"))
    rows = rows.join(used, (F.col("q") == F.col("q2")) & F.col("num").eqNullSafe(F.col("num2")) & (F.col("rank") == F.col("rank2")), "left_semi")
    many = (F.col("n") > 1) & (F.coalesce(F.col("r.unit"), F.lit("")) != "")
    rows = rows.select("q", "num", "street", "rank", "at", "score", "r.number", F.when(~many, F.col("r.unit")).alias("unit"), "r.postcode", "r.lon", "r.lat")
    rows = rows.withColumn("text", text.address_label("number", "street", "unit"))
    order = Window.partitionBy("q", "num").orderBy(F.desc("score"), F.lower("street"), F.coalesce("number", F.lit("")), "rank", "at")
    top = rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    top = top.select(F.col("q").alias("q2"), F.col("num").alias("num2"), F.col("pos").alias("rank"), "text", "street", "number", "unit", "postcode", "lon", "lat", "score")
    return asked.join(top, (F.col("q") == F.col("q2")) & F.col("num").eqNullSafe(F.col("num2"))).select(
        "query_id", "rank", "text", "street", "number", "unit", "postcode", "lon", "lat", "score")


# -- places ------------------------------------------------------------------

def match_names(typed: DataFrame, names: DataFrame, ws: Workspace) -> DataFrame:
    """(q, key, score) for distinct texts and distinct names: 100 equal, 80
    begins, 60 contains (three letters or more).

    Beginnings meet by equality at the typed lengths. For the rest a text is
    looked up by its rarest run of three letters, so a common one does not
    bring half the names along.
    """
    exact = typed.join(names, F.col("q") == F.col("key"), "left_semi").select("q", F.col("q").alias("key"), F.lit(100).alias("score"))
    sizes = typed.select(F.length("q").alias("n")).distinct()
    starts = names.join(F.broadcast(sizes), F.length("key") > F.col("n")).select(F.substring("key", F.lit(1), F.col("n")).alias("q"), "key")
    begins = typed.join(starts, "q").select("q", "key", F.lit(80).alias("score"))

    def trigrams(col):
        c = F.col(col)
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3))))

    grams = ws.write(names.where(F.length("key") >= 3).select("key", trigrams("key").alias("g")), "name-grams")
    often = grams.groupBy("g").agg(F.count("*").alias("names"))
    rarest = (
        typed.where(F.length("q") >= 3).select("q", trigrams("q").alias("g")).join(often, "g", "left")
        .groupBy("q").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "g")).alias("m")).where("m.names > 0").select("q", F.col("m.g").alias("g"))
    )
    inside = rarest.join(grams, "g").where(F.col("key").contains(F.col("q")) & ~F.col("key").startswith(F.col("q"))).select("q", "key", F.lit(60).alias("score"))
    return exact.unionByName(begins).unionByName(inside)


def search_places(queries: DataFrame, places: DataFrame, ws: Workspace, limit: int = 10) -> DataFrame:
    """Per query (query_id, query): ranked places (query_id, rank, name,
    category, address, lon, lat, score). `places` comes from places.fixed.

    Matching is between distinct texts and distinct names. Of one name, no
    query can show more than `limit` records, and their order among
    themselves is the same for all queries; only those are carried along.
    """
    rows = places.withColumn("key", fold("name"))
    within = Window.partitionBy("key").orderBy("size", "low", "source", "row_id")
    rows = rows.withColumn("size", F.length("name")).withColumn("low", F.lower("name"))
    lead = ws.write(rows.withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= limit).drop("nth"), "place-leads")
    counts = ws.write(rows.groupBy("key").agg(F.count("*").alias("n")), "place-names")
    asked = queries.select("query_id", fold(F.trim("query")).alias("q")).where("q <> ''")
    asked = ws.write(asked, "place-asked")
    hits = ws.write(match_names(asked.select("q").distinct(), counts.select("key"), ws).join(counts, "key"), "place-hits")
    tiers = hits.groupBy("q").agg(F.coalesce(F.sum(F.when(F.col("score") == 100, F.col("n"))), F.lit(0)).alias("n100"),
                                  F.coalesce(F.sum(F.when(F.col("score") == 80, F.col("n"))), F.lit(0)).alias("n80"))
    # a lower tier is read only where the higher ones left room
    room = F.when(F.col("score") == 100, True).when(F.col("score") == 80, F.col("n100") < 2 * limit).otherwise(
        (F.col("n100") < 2 * limit) & (F.col("n100") + F.when(F.col("n100") < 2 * limit, F.col("n80")).otherwise(0) < 2 * limit))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "size", "low", "tier_name", "source", "row_id")
    top = (
        hits.join(tiers, "q").where(room).select("q", "key", "score").join(lead, "key")
        .withColumn("tier_name", F.when(F.col("score") == 80, F.col("key")).otherwise(F.lit("")))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        .select("q", "rank", "name", text.category_text("category").alias("category"), "address", "lon", "lat", "score")
    )
    return asked.join(top, "q").drop("q")


# -- everything --------------------------------------------------------------

def first_names(hits: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` records of each text (q), in the order of a list of one kind. They are taken per text and not
    per query, before the queries come in: a list shows no more of one kind, however many have typed the text.
    hits: q, key, score; rows: key, low, name, lon, lat, address, id, row_id."""
    order = F.struct((~geo.in_service_area("lon", "lat")).alias("out"), (-F.col("score")).alias("score"), "low", "row_id")
    first = hits.join(rows, "key").withColumn("k", order).groupBy("q", "low").agg(F.min_by(F.struct("k", "name", "lon", "lat", "address", "id", "row_id", "score"), "k").alias("r"))
    return first.select("q", "r.*").withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("k"))).where(F.col("nth") <= limit).drop("k", "nth")


def unified_search(queries: DataFrame, stations: DataFrame, lockers: DataFrame, places: DataFrame, addresses: DataFrame, ws: Workspace, limit: int = 8) -> DataFrame:
    """Per query: stations, lockers, places and addresses as one ranked list,
    in-city first, one row per (kind, text, category)."""
    limit = min(max(limit, 1), 15)
    tidy = F.trim("query")
    valid = queries.where((F.length("query") <= 100) & (F.length(tidy) >= 2)).select("query_id", tidy.alias("query"))
    asked = ws.write(valid.select("query_id", "query", fold("query").alias("q")), "all-asked")
    typed = asked.select("q").distinct()
    empty = F.lit(None).cast("string")

    def named(df, kind, category):
        rows = df.withColumn("key", fold("name")).where("key <> ''")
        # a list shows one record of a name: the first in the city, if one is
        best = F.struct((~geo.in_service_area("lon", "lat")).alias("out"), "row_id")
        rows = rows.groupBy("key", F.lower("name").alias("low")).agg(F.min_by(F.struct("name", "lon", "lat", "address", "id", "row_id"), best).alias("r")).select("key", "low", "r.*")
        hits = match_names(typed, rows.select("key").distinct(), Workspace(ws.spark, kind))
        ranked = first_names(hits, rows, limit)
        return asked.join(ranked, "q").select(
            "query_id", F.lit(kind).alias("kind"), F.col("name").alias("text"), F.lit(category).alias("category"), "lon", "lat", "address",
            F.col("id").alias("station_id"), "score", F.col("row_id").alias("ord"))

    found = named(stations, "station", "EV Charging").unionByName(named(lockers, "bikelink", "Bike Parking"))
    # fold is idempotent, so the folded text searches places alike
    by_place = search_places(asked.select("query_id", "query"), places, ws, 2 * limit).select(
        "query_id", F.lit("place").alias("kind"), F.col("name").alias("text"), "category", "lon", "lat", "address", empty.alias("station_id"), "score", F.col("rank").cast("bigint").alias("ord"))
    by_address = search_addresses(asked.select("query_id", "query"), addresses, ws, limit).select(
        "query_id", F.lit("address").alias("kind"), "text", F.lit("Address").alias("category"), "lon", "lat", empty.alias("address"), empty.alias("station_id"), "score", F.col("rank").cast("bigint").alias("ord"))
    rows = found.unionByName(by_place).unionByName(by_address).withColumn("in_city", geo.in_service_area("lon", "lat")).withColumn("low", F.lower("text"))
    turn = F.array_position(F.array(*[F.lit(k) for k in ("station", "bikelink", "place", "address")]), F.col("kind"))
    rank_key = F.struct((~F.col("in_city")).alias("out"), (-F.col("score")).alias("score"), F.col("low").alias("low"), turn.alias("turn"), F.col("ord").alias("ord"))
    once = rows.withColumn("k", rank_key).groupBy("query_id", "kind", "low", "category").agg(
        F.min_by(F.struct("k", "text", "lon", "lat", "address", "station_id", "in_city"), "k").alias("r"))
    best = Window.partitionBy("query_id").orderBy("k")
    top = once.select("query_id", "kind", "category", "r.*").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("k")
    top = ws.write(top, "all-top")
    bare = top.where("coalesce(address, '') = '' and kind <> 'address'")
    near = reverse(bare.select("lon", "lat").distinct(), addresses, ws).where("dist_m is not null").select(
        "lon", "lat", F.concat(F.lit("Near "), text.display_address("number", "street")).alias("near"))
    wants = (F.coalesce("address", F.lit("")) == "") & (F.col("kind") != "address")
    return top.join(near, ["lon", "lat"], "left").withColumn("address", F.when(wants, F.coalesce("near", "address")).otherwise(F.col("address"))).select(
        "query_id", "rank", "kind", "text", "category", "lon", "lat", "address", "station_id", "in_city")
