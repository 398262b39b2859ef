"""Fingerprints of route directions that add up: multiset hashes of their paragraphs.

A fingerprint is a vector of sums, so that the order of paragraphs does not
matter, and adding or taking away a paragraph adds or takes away its vector.
- Wide lanes: for each paragraph 8 hashes of 32 bits, summed modulo 2^32. They
  decide equality.
- Sign lanes: for each phrase of each paragraph (eight words at most, cut after
  signs) 120 hash bits, each bit summed in 30 bits, which is more than the
  phrases that a row can hold. With n phrases, 2 * sum - n is a sum of signs; the inner
  product of two such vectors estimates how many phrases two texts share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, numbered

WIDE = 8
# Sums of up to SLICE phrases stand in short lanes, four to a long; those of a text in lanes twice as wide.
SHORT = 15
ONES = sum(1 << (SHORT * i) for i in range(4))
SLICE = (1 << SHORT) - 1
LANE, PER = 2 * SHORT, 2  # bits of a sign lane, lanes of a long
EVEN = SLICE * ((1 << LANE) + 1)
CUT, WORDS = "(?<=[.!?,;:]) ", 8  # phrases end after a sign, and after so many words
HASHES = 2  # of a phrase, 60 sign lanes each
RANGE_ROWS, MOST_RANGES = 5_000, 20_000


def summed(hashes: Column, part, keep: int) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + part(h)).bitwiseAND(F.lit(keep)))


def phrases(clause: Column) -> Column:
    """The clause in parts of WORDS words. Split at spaces first, once, and bound to a name: each step is linear, with spaces or without."""
    def parts(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / WORDS).cast("int"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i * WORDS + 1, F.lit(WORDS)), " "))

    return F.flatten(F.transform(F.array(F.split(clause, " ")), parts))


def with_vector(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds `to`: struct(wide array<long>, signs array<long>, n int) of a text column; null is empty.

    The hashes are columns of their own on the way, so that each is made once.
    """
    kept = df.columns
    df = df.withColumn("_paragraphs", F.split(F.coalesce(text, F.lit("")), "\n"))
    df = df.withColumn("_phrases", F.flatten(F.flatten(F.transform("_paragraphs", lambda p: F.transform(F.split(p, CUT), phrases)))))
    seeded = lambda seed: lambda phrase: F.xxhash64(phrase, F.lit(1000 + seed))
    each = lambda f: lambda xs: F.transform(xs, f)
    df = df.withColumn("_slices", F.transform(F.sequence(F.lit(0), F.floor((F.size("_phrases") - 1) / SLICE).cast("int")), lambda i: F.slice("_phrases", i * SLICE + 1, F.lit(SLICE))))
    df = df.withColumns({f"_bits{seed}": F.transform("_slices", each(seeded(seed))) for seed in range(HASHES)})
    wide = F.array(*(summed(F.col("_paragraphs"), lambda p, k=k: F.xxhash64(p, F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF)), 0xFFFFFFFF) for k in range(WIDE)))
    add = lambda xs, part: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + part(x))
    sum_of = lambda by, keep: lambda xs: add(xs, lambda x: F.shiftrightunsigned(x, by).bitwiseAND(F.lit(keep)))
    sums = []
    for seed in range(HASHES):
        for k in range(SHORT):  # a long takes bits k, k + 15, k + 30 and k + 45
            sums.append(F.transform(f"_bits{seed}", sum_of(k, ONES)))
    df = df.withColumn("_sums", F.array(*sums))
    signs = F.flatten(F.transform("_sums", lambda xs: F.array(*(sum_of(by, EVEN)(xs) for by in (0, SHORT)))))
    return df.select(*kept, F.struct(wide.alias("wide"), signs.alias("signs"), F.size("_phrases").alias("n")).alias(to))


def shown(v: Column) -> Column:
    """The fingerprint as a string of hex digits: wide lanes, sign lanes, phrases."""
    hexes = lambda xs, digits: F.array_join(F.transform(xs, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")
    return F.concat(hexes(v["wide"], 8), hexes(v["signs"], 16), F.lpad(F.lower(F.hex(v["n"])), 8, "0"))


def plus(v: Column, w: Column, sign: int = 1) -> Column:
    """The fingerprint vector of the paragraphs of v with those of w (sign 1), or without them (sign -1)."""
    lane = lambda a, b, i: (F.shiftrightunsigned(a, LANE * i).bitwiseAND(F.lit((1 << LANE) - 1)) + sign * F.shiftrightunsigned(b, LANE * i).bitwiseAND(F.lit((1 << LANE) - 1))).bitwiseAND(F.lit((1 << LANE) - 1))

    def signs(a, b):
        out = lane(a, b, 0)
        for i in range(1, PER):
            out = out.bitwiseOR(F.shiftleft(lane(a, b, i), LANE * i))
        return out

    wide = F.zip_with(v["wide"], w["wide"], lambda a, b: (a + sign * b).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.struct(wide.alias("wide"), F.zip_with(v["signs"], w["signs"], signs).alias("signs"), (v["n"] + sign * w["n"]).alias("n"))


def likeness(v: Column, w: Column) -> Column:
    """0 to 1: about the share of phrases that two texts have in common, 1 for equal fingerprints.

    With sign vectors x and y it is 2 xy / (xx + yy), not under 0; unlike texts
    give 0.2 at most, as a rule, however long they are.
    """

    def signed(a: Column, i: int, n: Column) -> Column:
        return (2 * F.shiftrightunsigned(a, LANE * i).bitwiseAND(F.lit((1 << LANE) - 1)) - n).cast("double")

    def dot(x, nx, y, ny):
        terms = lambda a, b: sum((signed(a, i, nx) * signed(b, i, ny) for i in range(1, PER)), signed(a, 0, nx) * signed(b, 0, ny))
        return F.aggregate(F.zip_with(x, y, terms), F.lit(0.0), lambda a, t: a + t)

    own = dot(v["signs"], v["n"], v["signs"], v["n"]) + dot(w["signs"], w["n"], w["signs"], w["n"])
    share = F.coalesce(F.try_divide(2.0 * dot(v["signs"], v["n"], w["signs"], w["n"]), own), F.lit(0.0))
    same = (v["wide"] == w["wide"]) & (v["signs"] == w["signs"])
    return F.when(same, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def least_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranges(ids: DataFrame) -> tuple[Column, dict[int, int]]:
    """An expression over `key` that numbers ranges of it, a few thousand rows each, and the first key of each range."""
    count = min(MOST_RANGES, max(least_partitions(ids), math.ceil(ids.count() / RANGE_ROWS)))
    cuts = ids.agg(F.percentile_approx("key", [i / count for i in range(1, count)] or [0.5], max(10_000, 4 * count)).alias("c")).head()["c"] or [0]
    cuts = sorted(set(cuts))
    group = math.isqrt(len(cuts))
    many = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    groups = [cuts[i : i + group] for i in range(0, len(cuts), group)]
    heads, nested, key = many([g[0] for g in groups]), F.array(*map(many, groups)), F.col("key")
    coarse = F.size(F.filter(heads, lambda c: c <= key))
    number = F.when(coarse == 0, 0).otherwise((coarse - 1) * group + F.size(F.filter(F.get(nested, coarse - 1), lambda c: c <= key)))
    return number, {r["r"]: r["k"] for r in ids.groupBy(number.alias("r")).agg(F.min("key").alias("k")).collect()}


def with_next(routes: DataFrame) -> DataFrame:
    """Adds next_directions and next_v to rows of (route_id, directions): those of the next route, after the last of the first; and v.

    The rows are dealt by ranges of route_id and sorted there. The first row of
    each range is also a guest in the range before it. What the driver sees is a
    number for each range, and those are MOST_RANGES at most.
    """
    routes = routes.withColumn("key", F.coalesce("route_id", F.lit(-(2**63)).cast("long")))  # null comes first
    number, heads = ranges(routes.select("key"))
    if not heads:
        return with_vector(routes, "directions", "v").withColumns({"next_directions": F.col("directions"), "next_v": F.col("v")}).drop("key")
    present = sorted(heads)
    before = F.create_map(*(F.lit(x) for k, r in enumerate(present) for x in (heads[r], present[k - 1])))
    rows = routes.withColumns({"range": number, "guest": F.lit(False)})
    guests = routes.where(F.col("key").isin(list(heads.values()))).withColumns({"range": before[F.col("key")], "guest": F.lit(True)})
    rows = with_vector(rows.unionByName(guests).repartition(max(len(present), least_partitions(routes)), "range"), "directions", "v")
    order = Window.partitionBy("range").orderBy("guest", "key", "directions")
    return rows.withColumns({"next_directions": F.lead("directions").over(order), "next_v": F.lead("v").over(order)}).where("not guest").drop("guest", "range", "key")


def edited(text: Column, follower: Column) -> Column:
    """The last quarter of the code points, rounded down, replaced by the first as many of the follower."""
    n = F.length(text)
    part = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - part), F.substring(follower, F.lit(1), part))


def compare(routes: DataFrame) -> DataFrame:
    """The fingerprint of every route's directions, of an edited form, and how alike they and the next route's are.

    routes: route_id (of any type with an order), directions (paragraphs of sentences, one a line);
    other columns are left out. Returns route_id, directions, edited, fingerprint,
    edited_fingerprint, near_edited, near_next. Null directions are empty. Equal
    directions have equal fingerprints, in whatever order their paragraphs
    stand. Equal ids follow each other by their text; a null id comes first.
    A single route is its own next one. No rows in, none out.
    """
    routes, names = numbered(routes.select("route_id", "directions"), "route_id")
    rows = routes.select(F.col("route_id").cast("long").alias("route_id"), F.coalesce("directions", F.lit("")).alias("directions"))
    rows = with_next(rows)
    rows = rows.withColumn("edited", edited(F.col("directions"), F.col("next_directions"))).drop("next_directions")
    rows = with_vector(rows, "edited", "edited_v")
    out = rows.select(
        "route_id", "directions", "edited", shown(F.col("v")).alias("fingerprint"), shown(F.col("edited_v")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("edited_v")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"))
    return named(out, names, "route_id")
