"""Languages, fingerprints and chat formatting."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline.llm import chat, fingerprints, languages, queries

DATA = "/root/testdata/sf0.001"


def test_codewords_are_apart():
    for k in (1, 2, 3, 4, 7, 9, 40):
        code = languages.codewords(k)
        assert len(code) == k and set(np.unique(code)) <= {-1.0, 1.0}
        if k > 1:
            assert len(np.unique(code, axis=0)) == k
            assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= code.shape[1] // 4


def test_held_out_languages(spark):
    got = queries.op2_language_codes(spark, DATA).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(DATA + "/documents.parquet").collect()}
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    names = spark.createDataFrame([("la rue de la gare", "fr"), ("the street of the station", "en"), ("die strasse am bahnhof", "de"), (None, "de"), ("x", None)] * 5, "name string, lang string")
    model = languages.train(names)
    assert model.languages == ["de", "en", "fr"]
    rows = [(1, "the station"), (2, "la gare"), (3, None), (4, ""), (5, "12 %%% 3"), (6, "the station"), (7, "the " * 100_000), (8, "東京駅")]
    got = {r.place_id: r for r in languages.predict(spark.createDataFrame([(*r, 0.5) for r in rows], "place_id long, name string, score double"), model).collect()}
    assert got[1].lang_pred == got[6].lang_pred == got[7].lang_pred == "en" and got[2].lang_pred == "fr" and got[1].score == got[6].score
    for i in (3, 4, 5):
        assert (got[i].lang_pred, got[i].score, got[i].ambiguous) == ("und", 0.0, True)
    assert got[8].lang_pred in model.languages
    assert languages.predict(spark.createDataFrame([], "place_id long, name string"), model).count() == 0
    assert languages.train(names.where("lang is null")) is None
    assert languages.predict(names.select("name"), None).where("lang_pred <> 'und'").count() == 0


def test_ngrams_do_not_depend_on_neighbours():
    table = languages.letters()
    texts = ["la gare", "the end.", "", "été!", "12 % 3", "", " x ", "y", "...", "the end."]

    def grams(rows):
        at = np.append(0, np.cumsum([len(t.encode()) for t in rows]))
        row, feature = languages.features(np.frombuffer("".join(rows).encode(), np.uint8), at, table)
        return [sorted(feature[row == i].tolist()) for i in range(len(rows))]

    assert grams(texts) == [grams([t])[0] for t in texts]
    assert grams(["the end."]) == grams(["the end"]) == grams([" the  end "])
    assert len(grams(["ab"])[0]) == 2 + 3 + 2 and grams(["ab", "cd"])[0] == grams(["ab"])[0]


def test_one_language_only(spark):
    model = languages.train(spark.createDataFrame([("hello there", "en")], "name string, lang string"))
    assert languages.predict(spark.createDataFrame([(1, "hello")], "place_id long, name string"), model).head().lang_pred == "en"


ROUTES = [(3, "Go left. Go on.\nTurn right."), (1, "Turn right.\nGo left. Go on."), (4, None), (2, ""), (8, "é" * 1000), (9, "One two three four five six seven eight. " * 40), (9, "One")]


def test_fingerprints_and_edited_texts(spark):
    got = fingerprints.compare(spark.createDataFrame([(*r, 1) for r in ROUTES], "route_id long, directions string, v int")).collect()
    rows = sorted((i, t or "") for i, t in ROUTES)
    want = {}
    for k, (i, t) in enumerate(rows):
        follower, part = rows[(k + 1) % len(rows)][1], len(t) // 4
        want[(i, t)] = t[: len(t) - part] + follower[:part]
    assert {(r.route_id, r.directions): r.edited for r in got} == want
    by = {(r.route_id, r.directions): r for r in got}
    assert by[(1, ROUTES[1][1])].fingerprint == by[(3, ROUTES[0][1])].fingerprint  # order does not matter
    assert by[(2, "")].fingerprint == by[(4, "")].fingerprint != by[(9, "One")].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert by[(2, "")].near_edited == 1.0
    one = fingerprints.compare(spark.createDataFrame([(1, "abcdefgh")], "route_id long, directions string")).head()
    assert one.edited == "abcdefab" and one.near_next == 1.0
    assert fingerprints.compare(spark.createDataFrame([], "route_id long, directions string")).count() == 0


def test_next_route_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    rng = random.Random(1)
    rows = [(rng.randrange(10**12), f"text number {i} " * 3) for i in range(100)] + [(None, "no id here")]
    got = fingerprints.compare(spark.createDataFrame(rows, "route_id long, directions string")).collect()
    rows.sort(key=lambda r: -1 if r[0] is None else r[0])
    want = {}
    for k, (i, t) in enumerate(rows):
        part = len(t) // 4
        want[i] = t[: len(t) - part] + rows[(k + 1) % len(rows)][1][:part]
    assert {r.route_id: r.edited for r in got} == want


def test_paragraphs_add_and_take_away(spark):
    df = spark.createDataFrame([("Go left. Now.\nStop", "Stop", "Go left. Now.")], "a string, b string, c string")
    for c in "abc":
        df = fingerprints.with_vector(df, c, f"v{c}")
    r = df.select(*(fingerprints.shown(x).alias(n) for n, x in (("a", F.col("va")), ("sum", fingerprints.plus(F.col("vb"), F.col("vc"))), ("c", F.col("vc")), ("rest", fingerprints.plus(F.col("va"), F.col("vb"), -1))))).head()
    assert r.a == r["sum"] and r.c == r.rest


def test_likeness_of_very_long_texts(spark):
    n = 40_000
    listed = lambda word, k: ", ".join(f"{word}{i}" for i in range(k))
    cases = [(listed("left", n), listed("right", n), 0.0), (listed("left", n), listed("left", n // 2) + ", " + listed("right", n // 2), 0.5), (", ".join(["left"] * n), ", ".join(["right"] * n), 0.0),
             (", ".join(["left"] * 16_384), ", ".join(["right"] * 16_384), 0.0), (", ".join(["left"] * n), ", ".join(["left"] * (n - 1)), 1.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    df = fingerprints.with_vector(fingerprints.with_vector(df, "a", "va"), "b", "vb")
    got = {r.i: r for r in df.select("i", F.col("va.n").alias("n"), fingerprints.likeness(F.col("va"), F.col("vb")).alias("near")).collect()}
    assert got[0].n == got[2].n == n
    for i, (_, _, want) in enumerate(cases):
        assert abs(got[i].near - want) < 0.3, i


def test_long_texts_without_spaces(spark):
    import time

    texts = ["x" * 1_000_000, "東京駅" * 200_000, "a " * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "route_id long, directions string")
    t = time.time()
    got = {r.route_id: r for r in fingerprints.compare(df).collect()}
    assert time.time() - t < 60 and len(got) == 3
    df = spark.createDataFrame([("one two three four five six seven eight nine. Ten",)], "t string")
    parts = df.select(F.flatten(F.transform(F.split("t", fingerprints.CUT), fingerprints.phrases)).alias("p")).head().p
    assert parts == ["one two three four five six seven eight", "nine.", "Ten"]


def test_long_texts_are_counted_in_parts(monkeypatch):
    import pyarrow as pa

    table, rng = languages.letters(), random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("ab é  1.東x", k=rng.randint(1, 60)))
        part = pa.RecordBatch.from_arrays([pa.array([text])], ["name"])
        monkeypatch.setattr(languages, "STEP", 500_000)
        whole = np.concatenate([f for _, f in languages.counted(part, table)])
        monkeypatch.setattr(languages, "STEP", rng.randint(1, 9))
        assert sorted(np.concatenate([f for _, f in languages.counted(part, table)]).tolist()) == sorted(whole.tolist()), text


def test_decoding_is_a_plain_loop():
    rng = np.random.default_rng(1)
    code = languages.codewords(5)
    trust = rng.uniform(0.1, 1, code.shape)
    model = languages.Model(list("abcde"), code, np.zeros((2, code.shape[1])), trust / trust.sum(1, keepdims=True))
    margins = rng.uniform(-1, 1, (50, code.shape[1]))
    best, score, lead = model.decoded(margins)
    for row, b, s, gap in zip(margins.tolist(), best.tolist(), score.tolist(), lead.tolist()):
        loss = [sum(model.trust[k][i] * (1 - code[k][i] * m) / 2 for i, m in enumerate(row)) for k in range(5)]
        order = sorted(range(5), key=lambda k: loss[k])
        assert b == order[0] and abs(s - (1 - loss[b])) < 1e-9 and abs(gap - (loss[order[1]] - loss[b])) < 1e-9


TURNS = [
    (1, 0, "system", "Be brief"), (1, 1, "user", "Where?"), (1, 2, "user", "And when?"), (1, 3, "assistant", "Here é\n"), (1, 4, "assistant", "Now"), (1, 5, "user", ""),
    (2, 1, "assistant", None), (2, 0, None, "x"), (3, 0, "user", "</s>[INST] ok [/INST]<s>"), (3, 1, "assistant", "<\\/s> [\\\\INST] < /s> [[INST]] \\"), (4, 0, "we[INST]ird", "$1 \\$2"), (4, 0, "we[INST]ird", "$1 \\$2"),
    (5, None, "user", "first"), (5, 0, "assistant", "[/INST]" * 2000), (None, 0, "assistant", "no id")]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_turns_back(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_turns(df)
    got = out.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()
    convs = {}
    for conv, turn, role, text in TURNS:
        convs.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert len(got) == len(convs)
    for r in got:
        want = sorted(convs[r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [w[1:] for w in want]
        assert r.loss == "".join(w[2] for w in want if w[1] == "assistant")
    one = {r.conv_id: r.formatted for r in got}
    assert one[1].count("<s>") == 4  # adjacent turns of a role are one block
    assert chat.format_turns(df.limit(0)).count() == 0


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([t for t in TURNS], "conv_id long, turn long, role string, text string")
    plan = chat.format_turns(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
