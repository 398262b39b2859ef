"""Operators on the library's own places and steps, whose ids are strings."""

import public_tokenizers
from pyspark.sql import functions as F

from curbline.llm import fingerprints, packing, pieces, records, repeats, simhash
from curbline.sources import landed

PLACE = "row_id long, id string, names struct<primary:string>, basic_category string, brand struct<names:struct<primary:string>>, addresses array<struct<freeform:string>>, p struct<lon:double,lat:double>"
STEP = "src long, dst long, vehicle string, index int, instruction string"


def steps_of(spark):
    lines = ["Head north on Alder Avenue and follow it past the station", "Turn left onto 3 Lane", "Arrive at your destination"]
    rows = [(s, d, v, k, t) for s, d, v in ((1, 2, "scooter"), (1, 2, "moped"), (9, 4, "moped"), (10, 4, "moped")) for k, t in reversed(list(enumerate([f"Start {s}"] + lines)))]
    return spark.createDataFrame([*rows, (5, 5, "moped", 0, None)], STEP)


def test_routes_of_steps(spark):
    routes = records.routes(steps_of(spark))
    texts = {r.route_id: r.directions for r in routes.collect()}
    assert set(texts) == {"1/2/scooter", "1/2/moped", "9/4/moped", "10/4/moped", "5/5/moped"} and texts["5/5/moped"] == ""
    assert texts["9/4/moped"].split("\n")[:2] == ["Start 9", "Head north on Alder Avenue and follow it past the station"]
    order = sorted(texts)
    found = {r.route_id: r for r in fingerprints.compare(routes).collect()}
    for k, i in enumerate(order):
        n = len(texts[i]) // 4
        assert found[i].edited == texts[i][: len(texts[i]) - n] + texts[order[(k + 1) % len(order)]][:n]
    cut = {r.route_id: r for r in repeats.drop_repeats(routes).collect()}
    assert set(cut) == set(texts) and bytes(cut["1/2/moped"].kept).decode() == texts["1/2/moped"] and bytes(cut["1/2/scooter"].kept) == b""
    assert bytes(cut["9/4/moped"].kept) == b"Start 9"
    packed = packing.pack(routes, public_tokenizers.path("word_bpe_49k.json")).groupBy("route_id").agg(F.sum("length").alias("n"), F.max("route_tokens").alias("m")).collect()
    assert {r.route_id for r in packed} == set(texts) and all(r.n == r.m for r in packed)


def test_near_copies_of_named_places(spark):
    names = [("b-2", "Cafe of the Old Town Square"), ("a-1", "CAFE of the old town square"), ("c-3", "Some other place altogether here"), ("d-4", None)]
    raw = spark.createDataFrame([(k, i, (n,), "cafe", None, None, (-122.44 + k, 37.75)) for k, (i, n) in enumerate(names)], PLACE)
    places = records.places(raw.select("row_id", "id", F.col("names.primary").alias("name"), "p.lon", "p.lat"))
    found = {r.place_id: r.component_id for r in simhash.near_copies(places).collect()}
    assert found == {"a-1": "a-1", "b-2": "a-1", "c-3": "c-3", "d-4": "d-4"}
    path = public_tokenizers.path("piece_bpe_32k.model")
    told = pieces.decode(pieces.encode(places, path), path)
    assert told.columns == ["row_id", "place_id", "name", "lon", "lat", "piece_ids", "decoded"]
    assert all(r.decoded == (r.name or "") for r in told.collect())


def test_place_records_as_the_reader_gives_them(spark):
    raw = spark.createDataFrame([(1, "x", ("Ferry Plaza",), "market", None, [("1 Embarcadero",)], (-122.39, 37.79)), (2, "y", ("Ferry plaza",), "market", None, None, (-122.39, 37.79))], PLACE)
    places = records.places(landed.named_places(raw))
    assert "place_id" in places.columns and {type(r.component_id) for r in simhash.near_copies(places).collect()} == {str}
