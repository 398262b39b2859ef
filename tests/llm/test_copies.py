"""Near-copies, repeated passages and archives against plain loops."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from curbline.llm import common, embeddings, repeats, simhash, warc
from curbline.session import Workspace


def parts(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_chain_star_and_loops(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (None, 3), (1001, 1000)]
    got = common.components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "t")).collect()
    found = {r.member: r.component for r in got}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert common.components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_names(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 200))) for _ in range(60)]
    near = []
    for t in base[:30]:
        for _ in range(4):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "CHANGED"
            near.append("\t ".join(w))
    names = [None, "", " \n", "One", "ONE", "É É É", *base, *near, *base[:5], "long " * 30_000]
    rows = [(i * 3, n, "x") for i, n in enumerate(names)]
    got = {r.place_id: r for r in simhash.near_copies(spark.createDataFrame(rows, "place_id long, name string, fingerprint string")).collect()}
    fps = [plain_fingerprint(n) for n in names]
    assert [got[i * 3].fingerprint & (2**64 - 1) for i in range(len(names))] == fps
    want = parts(len(names), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [got[i * 3].component_id for i in range(len(names))] == [3 * w for w in want]


def test_pigeonring_finds_every_close_pair():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 2**63, 400, dtype=np.uint64)
    close = fp.copy()
    for i in range(len(close)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            close[i] ^= np.uint64(1) << np.uint64(b)
    every = np.unique(np.concatenate([fp, close]))
    key, value, probe = simhash.keys(every)
    order = np.argsort(key, kind="stable")
    a, b = simhash.linked(key[order], value[order], probe[order])
    index = {int(v): i for i, v in enumerate(every)}
    got = parts(len(every), [(index[int(x)], index[int(y)]) for x, y in zip(a, b)])
    diff = np.bitwise_count(every[:, None] ^ every[None])
    assert got == parts(len(every), list(zip(*np.nonzero(np.triu(diff <= 4, 1)))))


def test_simhash_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(5, "same words in here now"), (5, "same words in here now"), (None, "same words in here now")], "place_id long, name string")
    assert [r.component_id for r in simhash.near_copies(df).collect()] == [5, 5, 5]
    assert simhash.near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1000, 7])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = [b + 0.28 * rng.standard_normal(16) * np.linalg.norm(b) / 4 * rng.random() for b in base for _ in range(6)] + [base[0], base[0], 3 * base[1]]
    vectors = [(10 + 2 * i, [float(x) for x in v], 1) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1e200] * 16, [1.0] * 3]
    vectors += [(9000 + i, v, 1) for i, v in enumerate(odd)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, kept int")).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = np.triu(x @ x.T >= 0.95, 1)
    root = parts(len(rows), list(zip(*np.nonzero(near))))
    assert near.sum() > 100
    for i in range(len(rows)):
        r = got[10 + 2 * i]
        assert (r.n_links, r.component_id, r.kept) == (near[i].sum() + near[:, i].sum(), 10 + 2 * root[i], root[i] == i)
    for i in range(len(odd)):
        assert (got[9000 + i].n_links, got[9000 + i].component_id, got[9000 + i].kept) == (0, 9000 + i, True)


def test_embeddings_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.near_duplicates(df).collect()] == [(1, 1, 1, True)] * 2
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def plain_cut(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], -1 if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (-1 if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        spans = [m.span() for m in re.finditer(b"\1+", gone)]
        out.append((d, bytes(x for x, g in zip(b, gone) if not g), spans))
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeated_passages(spark, hot):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(k)) for k in (9, 12, 30, 60)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 400, "ab" * 100, "x" * 60]
    for _ in range(60):
        body = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(3)]
        body.insert(rng.randint(0, 3), rng.choice(shared))
        texts.append(" ".join(body)[rng.randint(0, 20) :])
    texts += [texts[10] * 3, texts[11], texts[11], "prefix " + texts[12], "é" * 200, " ".join(word() for _ in range(8000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(20, texts[20]), (None, texts[21])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "route_id long, directions string, kept string")
    got = sorted(((-1 if r.route_id is None else r.route_id), bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in repeats.drop_repeats(df, hot=hot).collect())
    assert got == sorted(((-1 if d is None else d), k, s) for d, k, s in plain_cut(rows))
    for r in repeats.drop_repeats(df, hot=hot, whole_characters=True).collect():
        bytes(r.kept).decode()


def test_no_routes_no_passages(spark):
    assert repeats.drop_repeats(spark.createDataFrame([], "route_id long, directions string")).count() == 0


def test_archives(spark, tmp_path):
    long = "<p>" + "é" * 80 + "\r\n\r\nWARC/1.1\r\n</p>"
    pages = [(5, "http://a/1", long), (3, "http://a/2\r\nX: y", long), (9, None, long), (9, None, long), (4, "http://b", None), (6, "http://b", ""), (7, "u", "short"), (8, "u", "short"),
             (None, "http://c", long), (1, "http://d", "x" * 99), (2, "http://d", "x" * 99), (10, "http://e", "y" * 100), (11, "http://e", "y" * 100), (12, "z", "q" * 300_000)]
    folder = str(tmp_path / "archives")
    warc.write(spark.createDataFrame([(*p, i) for i, p in enumerate(pages)], "page_id long, url string, html string, record int"), folder)
    found = warc.read(spark, folder)
    got = sorted(warc.resolved(found).drop("url").collect(), key=str)
    want = []
    for page, _, html in pages:
        body = (html or "").encode()
        first = min((p for p, _, h in pages if p is not None and (h or "").encode() == body), default=None)
        again = len(body) >= 100 and page is not None and page > first
        want.append((page, "revisit" if again else "response", first if again else None, len(body), hashlib.sha256(body).hexdigest()))
    assert sorted((tuple(r[c] for c in ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")) for r in got), key=str) == sorted(want, key=str)
    assert {r.page_id: bytes(r.payload) for r in found.where("record_type = 'response' and page_id is not null").collect()}[3].decode() == long
    assert any(n.endswith(".gz") for n in os.listdir(folder))


def test_archives_without_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.resolved(warc.read(spark, str(tmp_path / "none"))).count() == 0


def test_unlike_texts_under_one_id(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    whole, passage = text(40), text(20)
    rows = [(3, whole), (7, whole), (7, text(30)), (7, "short"), (4, text(9) + passage), (8, text(60) + passage), (8, text(10)), (8, "tiny"), (9, passage), (9, passage + text(5)), (None, text(12)), (None, text(13))]
    got = sorted(((-1 if r.route_id is None else r.route_id), bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in repeats.drop_repeats(spark.createDataFrame(rows, "route_id long, directions string")).collect())
    assert got == sorted(((-1 if d is None else d), k, s) for d, k, s in plain_cut(rows))

    pages = [(i, "u", t) for i, t in rows] + [(3, "u", text(50))]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "twins"))
    found = warc.read(spark, str(tmp_path / "twins"))
    kinds = sorted((r.payload_digest, r.page_id or -1, r.record_type, r.payload_bytes) for r in warc.resolved(found).collect())
    assert kinds == sorted((hashlib.sha256(t.encode()).hexdigest(), i or -1, "revisit" if i == 7 and t == whole else "response", len(t)) for i, _, t in pages)


def test_fingerprints_need_little_memory():
    import tracemalloc

    text = " ".join(f"word{i % 9973} and{i}" for i in range(60_000)).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    simhash.hashed(data[:100], np.array([0, 100]))
    tracemalloc.start()
    simhash.hashed(data, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
