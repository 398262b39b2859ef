"""Conversation repair, SentencePiece ids and centroid tables against plain loops and the library."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from curbline.llm import centroids, pieces, queries, repair

PATH = public_tokenizers.path("piece_bpe_32k.model")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def every_repair(rows):
    """All (cost, audit) with at most two inserted turns in a row, tried one by one; rows are (initial, fault)."""
    out = []

    def go(i, state, cost, audit, added):
        if i == len(rows) and state in ("", "a"):
            out.append((cost, audit))
        for x in NEXT[state]:
            if x in "ua" and added < 2:
                go(i, x, cost + 2, audit + "I", added + 1)
        if i == len(rows):
            return
        initial, fault = rows[i]
        go(i + 1, state, cost + 3, audit + "D", 0)
        if fault not in ("blank", "duplicate"):
            for x in NEXT[state]:
                if x == initial:
                    go(i + 1, x, cost + (fault == "truncated"), audit + "K", 0)
                if x in "ua":
                    go(i + 1, x, cost + 2 + (fault == "truncated"), audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(out)


FAULTS = ("", "blank", "duplicate", "truncated")


def test_lightest_derivation_is_the_least_of_all_repairs():
    rng = random.Random(4)
    cases = [c for n in range(3) for c in itertools.product(itertools.product(" sua", FAULTS), repeat=n)]
    cases += [[(rng.choice(" suuaa"), rng.choice(FAULTS + ("", ""))) for _ in range(rng.randint(3, 5))] for _ in range(150)]
    for rows in cases:
        code = bytes(4 * FAULTS.index(f) + " sua".index(c) for c, f in rows)
        assert repair.lightest(code) == every_repair(rows), rows


def test_a_long_conversation_takes_linear_time():
    cost, audit = repair.lightest(bytes([repair.USER, repair.ASSISTANT, 4 * repair.TRUNCATED + repair.USER]) * 40_000)
    assert len(audit) >= 120_000 and cost > 0


TURNS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Where?"), (1, 2, "assistant", "Here."), (1, 2, "assistant", "Here."), (1, 4, "user", " \t"), (1, 5, "user", "And then"), (1, 6, "assistant", "Nothing! \n"),
    (2, None, "assistant", "first."), (2, 3, "tool", "x."), (2, 3, "user", None), (2, 9, None, "odd."), (2, 9, "user", "first."), (3, 0, "user", None), (None, 7, "user", "no id?"), (None, 8, "assistant", "none."),
    (4, -(2**63), "user", "a."), (4, 2**63 - 1, "assistant", "b."), (5, None, "system", "Only.")]


def plain(rows):
    """What is wrong with one conversation, and its repair."""
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows), key=lambda r: (r[0], r[1], r[2], digest(r[3])))
    seen, judged = set(), []
    for _, _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role[:1], fault))
    cost, audit = every_repair(judged)
    out, at, state = [], 0, ""
    for e in audit:
        if e in "IR":
            state = next(x for x in NEXT[state] if x in "ua")
            out.append({"u": "user", "a": "assistant"}[state] + ":" + (rows[at][3] if e == "R" else ""))
        elif e == "K":
            state = judged[at][0]
            out.append(rows[at][2] + ":" + rows[at][3])
        at += e != "I"
    turns = {t for full, t, _, _ in rows if full}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[0] + b[0] for a, b in zip(judged, judged[1:])]
    return (gaps if gaps < 2**63 else None, *(sum(f == k for _, f in judged) for k in FAULTS[1:]), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, "\n".join(out))


@pytest.mark.parametrize("block", [100_000, 1])
def test_conversations_are_repaired(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "TURN_ROWS", 3)
    rng = random.Random(1)
    more = [(100 + rng.randrange(6), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No", "", "é…", "Why?"])) for _ in range(24)]
    rows = TURNS + more
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    found = repair.audits(df)
    fixed = repair.repaired(df, found)
    texts = {r.conv_id: r.sha256 for r in repair.digests(fixed).collect()}
    got = {r.conv_id: r for r in found.collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, its in by.items():
        *want, body = plain(its)
        r = got[conv]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == want, conv
        assert texts.get(conv, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(body.encode()).hexdigest(), conv
    lines = {}
    for r in sorted(fixed.collect(), key=lambda r: r.position):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert "\n".join(lines[1]) == plain(by[1])[-1]


def test_no_conversation(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = repair.audits(df)
    assert found.count() == 0 and repair.digests(repair.repaired(df, found)).count() == 0


def test_damage_and_conversations_that_vanish(spark, tmp_path):
    import zlib

    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t}.") for c in range(60) for t in range(2)] + [(None, None, None, None)]
    gone = [c for c in range(60) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in range(2))]
    extra = next(c for c in range(100, 10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((extra, 0, "user", "dropped."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in [extra, *gone]:
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


SIGNS = list("   \n\t▁aeiournstlhABZ09-=_/.,'é中日本語ü😀\x01Σ́￿") + ["<s>", "<0x0A>", "   ", "the "]
TEXTS = [None, "", " ", "  ", "▁", " ▁ x", "The Embarcadero", "a" * 5000, "ab" * 3000, " " * 3000, "中文" * 2000, "\x00", "x\x00y", "é", "<unk></s>", "word " * 2000]


def test_pieces_are_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choices(SIGNS, k=rng.randint(0, 40))) for _ in range(1500)] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz+/", k=4000))] + TEXTS[:4]
    df = spark.createDataFrame([(f"p{i}", t, i) for i, t in enumerate(texts)], "id string, name string, decoded long")
    got = pieces.decode(pieces.encode(df, PATH), PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[int(r.id[1:])] or ""
        assert r.piece_ids == library.encode(text), repr(text)
        assert r.decoded == library.decode(r.piece_ids)
    assert pieces.encode(df.limit(0), PATH).count() == 0


def test_decoding_of_any_ids(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    rows = [[rng.randrange(3, 32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))] for _ in range(300)] + [None]
    got = pieces.decode(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, piece_ids array<int>"), PATH).collect()
    for r in got:
        assert r.decoded == library.decode(rows[r.id] or []), rows[r.id]


def test_tokens_side_by_side():
    model = pieces.Pieces(PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(9)
    names = {library.id_to_piece(i): i for i in range(259, 32000)}
    some = rng.choices(list(names), k=3000)
    pairs = [(a, b) for a, b in zip(some, some[1:]) if not b.startswith("▁")] + [(a, a) for a in some[:300] if not a.startswith("▁")]
    left, right = (np.array([names[p[k]] for p in pairs], np.int64) for k in (0, 1))
    mark = names["▁"]
    for (a, b), ok in zip(pairs, model.compatible(left, right).tolist()):
        syms = list(a + b)  # merged from characters, one by one
        while True:
            best = min(((-library.get_score(names[x + y]), i) for i, (x, y) in enumerate(zip(syms, syms[1:])) if x + y in names), default=None)
            if best is None:
                break
            syms[best[1] : best[1] + 2] = [syms[best[1]] + syms[best[1] + 1]]
        assert ok == (syms == [a, b]), (a, b, syms)
    assert mark >= 0


def plain_clusters(rows, dims, k, rounds, scale):
    """rows: (start, position); the clusters of sound ones, in Python's whole numbers."""
    import math

    kept = [(s, [max(-centroids.LIMIT, min(centroids.LIMIT, math.floor(scale * x))) for x in p]) for s, p in rows if p is not None and len(p) == dims and all(x is not None and math.isfinite(x) for x in p)]
    at = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or "", r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            at[c] = [sum(col) // len(mine) for col in zip(*mine)]
    told = [near(v) for _, v in kept]
    inertia = {c: sum(d for d, o in told if o == c) for _, c in told}
    whole = sum(d for d, _ in told)
    long = lambda n: n if n < 2**63 else None
    return sorted((tuple(v), c, d, long(inertia[c]), long(whole), tuple(at[c])) for (_, v), (d, c) in zip(kept, told))


@pytest.mark.parametrize("wide", [1.0, 1e7])
def test_clusters_of_map_sites(spark, wide):
    rng = random.Random(2)
    spots = [(rng.choice([-122.4, -122.45, -122.5]) + rng.random() / 50, 37.7 + rng.random() / 5) for _ in range(120)]
    rows = [(i, f"k{i * 7 % 50}", lon * wide, lat * wide) for i, (lon, lat) in enumerate(spots)] + [(900, "a", -122.4 * wide, 37.7 * wide)] * 4
    rows += [(901, None, 1.0, 2.0), (902, "b", None, 37.7), (903, "c", float("nan"), 37.7), (904, "d", float("inf"), 37.7), (905, "e", 1e300, -1e300)]
    sites = spark.createDataFrame([(*r, "old") for r in rows], "row_id long, mark string, lon double, lat double, cluster string")
    got = centroids.cluster(sites, F.array("lon", "lat"), 2, F.col("mark"), clusters=5, rounds=4, scale=1000.0)
    place = F.transform(F.array("lon", "lat"), lambda x: F.greatest(F.lit(-float(centroids.LIMIT)), F.least(F.lit(float(centroids.LIMIT)), F.floor(1000.0 * x))).cast("long"))
    found = sorted((tuple(r.p), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got.withColumn("p", place).collect())
    assert found == plain_clusters([(m, (lon, lat)) for _, m, lon, lat in rows], 2, 5, 4, 1000.0)


def test_few_or_no_sites(spark):
    sites = spark.createDataFrame([(1, [0.5, 1.5]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [])], "row_id long, position array<double>")
    got = centroids.cluster(sites, F.col("position"), 2, F.col("row_id"), clusters=16, scale=64.0).collect()
    assert [(r.row_id, r.cluster, r.distance, r.inertia, r.centroid) for r in got] == [(1, 0, 0, 0, [32, 96])]
    assert centroids.cluster(sites.limit(0), F.col("position"), 2, F.col("row_id")).count() == 0
