"""Repeated passages of route directions, by depth-limited radix sorting.

A string of DEPTH bytes that also stands in a route with a smaller id is
removed. Suffixes are ordered through their first DEPTH bytes only, by passes of
most significant digits (8 bytes each); what is still together after the last
pass is one repeated string.

To sort only what can repeat, each string is filed under its least hashed run of
GRAM bytes: equal strings have equal marks, and a run of strings with one mark
is stored once, as one stretch of text. Marks that one route alone holds are
never sorted. A mark that very many routes hold (the border of a common passage)
is filed by whole strings instead, so that it is many groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import named, numbered, per_batch, runs, shares, steps, utf8

DEPTH = 50
GRAM = 24
PASSES = (0, 8, 16, 24, 32, 40, 42)  # where the digits of the passes begin; the last two overlap
STEP = 2_000_000  # bytes of text at once
BUCKET_BYTES = 7_000_000  # of all texts for each bucket, about
HOT = 4_096  # routes that hold a mark, from which it is filed by whole strings
ROUTE_ROWS = 5_000
SLICES = 4
MOST_PARTS = 1 << 16  # partitions; beyond, each takes several buckets in turn
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def beside(bits: int) -> tuple[np.uint64, np.uint64]:
    """Where a mark's bucket stands in it, and the bits below, 48 at most; the last one says hot."""
    at = 64 - max(16, bits)
    return np.uint64(at), np.uint64((1 << at) - 2)


def words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from each byte on, as a number."""
    return np.ndarray((len(data) - 7,), kind, np.ascontiguousarray(data), strides=(1,))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * D
    return x ^ (x >> np.uint64(29))


def minima(data: np.ndarray) -> np.ndarray:
    """For each string of DEPTH bytes, the least hash of its runs of GRAM bytes."""
    w = words(data).astype(np.uint64)
    h = mixed(w[:-16] * A + w[8:-8] * B + w[16:] * C)
    width, k = DEPTH - GRAM + 1, 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if width > k else h


def stretches(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one mark: (text number, start in data, strings, mark, bucket)."""
    none = np.zeros(0, np.int64)
    many = np.maximum(0, np.diff(at) - DEPTH + 1)
    if not many.any():
        return none, none, none, none.astype(np.uint64), none
    start = runs(at[:-1], many)
    value = minima(data)[start]
    text = np.repeat(np.arange(len(many)), many)
    head = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])))
    v = mixed(value[head] * A)  # the least of many hashes is small; marks are spread again
    bucket = (v >> np.uint64(64 - bits)).astype(np.int64)
    shift, low = beside(bits)
    return text[head], start[head], np.diff(np.append(head, len(start))), (bucket.astype(np.uint64) << shift) | (v & low), bucket


def grouped(sorted_by: np.ndarray) -> np.ndarray:
    """Where the groups of equal values begin."""
    return np.flatnonzero(np.append(True, sorted_by[1:] != sorted_by[:-1])) if len(sorted_by) else np.zeros(0, np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    return b"".join(np.array([len(a) for a in arrays], "<u4").tobytes() if i < 0 else arrays[i].tobytes() for i in range(-1, len(arrays)))


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, "<u4", len(kinds)), 4 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


MARKS = ("<i8", "<u4", "<u4", "<u2", "<u4", "<u2", "<u4", "<i8", "<u4", "<u8")


def marks_of(batch: pa.RecordBatch, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, blob): the marks of each text. A mark that several texts of a step hold goes on
    once with their number, and the blob says to which of them it comes back."""
    for part in steps(batch, "directions", STEP):
        data, at = utf8(part.column("directions"))
        ids = part.column("key").to_numpy()
        text, _, _, mark, bucket = stretches(data, at, bits)
        if not len(text):
            continue
        order = np.lexsort((text, mark))
        text, mark, bucket = text[order], mark[order], bucket[order]
        once = np.append(True, (mark[1:] != mark[:-1]) | (text[1:] != text[:-1]))
        text, mark, bucket = text[once], mark[once], bucket[once]
        head = grouped(mark)
        size = np.diff(np.append(head, len(mark)))
        shared = np.repeat(size > 1, size)
        lone = np.flatnonzero(~shared)
        lone = lone[np.lexsort((text[lone], bucket[lone]))]
        many = np.flatnonzero(shared)
        many = many[np.lexsort((text[many], bucket[many]))]
        rep = head[size > 1]
        filled, bits_low = np.unique(bucket), beside(bits)[1]
        cut = [np.append(np.searchsorted(bucket[x], filled), len(x)) for x in (lone, rep, many)]
        out_bucket, blobs = [], []
        for i, b in enumerate(filled.tolist()):
            l, r, m = (x[c[i] : c[i + 1]] for x, c in zip((lone, rep, many), cut))
            lh, mh = grouped(text[l]), grouped(text[m])
            low, rlow = mark[l] & bits_low, mark[r] & bits_low
            split = lambda v: ((v & np.uint64(0xFFFFFFFF)).astype("<u4"), (v >> np.uint64(32)).astype("<u2"))
            out_bucket.append(b)
            blobs.append(packed(ids[text[l]][lh].astype("<i8"), np.diff(np.append(lh, len(l))).astype("<u4"), *split(low), *split(rlow), size[np.searchsorted(head, r)].astype("<u4"), ids[text[m]][mh].astype("<i8"), np.diff(np.append(mh, len(m))).astype("<u4"), mark[m].astype("<u8")))
        yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each bucket; rows come sorted by it."""
    at, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
            if b != at:
                if held:
                    yield at, held
                at, held = b, []
            held.append(blob.as_py())
    if held:
        yield at, held


def texts_with(key: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, marks) of sorted pairs."""
    head = grouped(key)
    for s in range(0, len(head), 20_000):
        h = head[s : s + 20_000]
        end = head[s + 20_000] if s + 20_000 < len(head) else len(key)
        at = (np.append(h, end) - h[0]) * 8
        blob = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(mark[h[0] : end].astype("<u8").tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(key[h].astype(np.int64)), blob], ["key", "marks"])


def held_by_several(batches: Iterator[pa.RecordBatch], hot: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(key, marks) for each text: those of its marks that other texts hold too, the last bit set on hot ones."""
    for bucket, blobs in by_bucket(batches):
        base = np.uint64(bucket) << beside(bits)[0]
        lone_id, lone, rep, weight, many_id, many = [], [], [], [], [], []
        for blob in blobs:
            i, n, a, b, ra, rb, w, mi, mn, m = unpacked(blob, *MARKS)
            lone_id.append(np.repeat(i, n))
            lone.append(base | (b.astype(np.uint64) << np.uint64(32)) | a)
            rep.append(base | (rb.astype(np.uint64) << np.uint64(32)) | ra)
            weight.append(w)
            many_id.append(np.repeat(mi, mn))
            many.append(m)
        lone_id, lone, rep, weight, many_id, many = (np.concatenate(x) for x in (lone_id, lone, rep, weight, many_id, many))
        mark, count = np.concatenate([lone, rep]), np.concatenate([np.ones(len(lone), np.int64), weight])
        order = np.argsort(mark, kind="stable")
        head = grouped(mark[order])
        total = np.add.reduceat(count[order], head) if len(head) else head
        known = mark[order][head]
        at = np.searchsorted(known, lone)
        keep = total[at] > 1
        key, mark = np.concatenate([lone_id[keep], many_id]), np.concatenate([lone[keep], many])
        mark = mark | (total[np.searchsorted(known, mark)] >= hot).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        yield from texts_with(key[order], mark[order])


STRETCHES = ("<i8", "<u4", "<u4", "<i8", "<u1")


def stretches_of(batch: pa.RecordBatch, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, blob, key, twin, first, count): the stretches under marks that several texts hold. Of stretches of a step that are
    equal, the one of the least key goes on; the others are removed, and are told as (key, twin, first, count)."""
    names = ["bucket", "blob", "key", "twin", "first", "count"]
    for part in steps(batch, "directions", STEP):
        data, at = utf8(part.column("directions"))
        ids = part.column("key").to_numpy()
        twins = part.column("twin").to_numpy()
        text, start, many, mark, bucket = stretches(data, at, bits)
        lists_ = [np.concatenate([np.frombuffer(b, "<u8") for b in x]) if x else np.zeros(0, np.uint64) for x in part.column("marks").to_pylist()]
        own = np.repeat(np.arange(len(lists_)), [len(x) for x in lists_])
        theirs = np.concatenate(lists_) if lists_ else np.zeros(0, np.uint64)
        name = lambda t, m: mixed((m & ~np.uint64(1)) + t.astype(np.uint64) * B)  # noqa: E731  a clash costs a sort, no more
        known = name(own, theirs)
        order = np.argsort(known)
        known, warm = known[order], (theirs[order] & np.uint64(1)).astype(bool)
        mine = name(text, mark)
        i = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
        hit = np.flatnonzero(known[i] == mine) if len(known) else np.zeros(0, np.int64)
        text, start, many, bucket, warm = text[hit], start[hit], many[hit], bucket[hit], warm[i[hit]]
        if warm.any():  # one stretch for each string, filed by its own hash
            each = np.where(warm, many, 1)
            inner = runs(np.zeros(len(each), np.int64), each)
            text, start, many, warm = np.repeat(text, each), np.repeat(start, each) + inner, np.repeat(np.where(warm, 1, many), each), np.repeat(warm, each)
            bucket = np.repeat(bucket, each)
            w = words(data)
            at_warm = start[warm]
            h = sum(((w[at_warm + p].astype(np.uint64) + np.uint64(p)) * c for p, c in zip(PASSES, (A, B, C, D, A ^ B, B ^ C, C ^ D))), np.zeros(len(at_warm), np.uint64))
            bucket[warm] = (mixed(mixed(h)) >> np.uint64(64 - bits)).astype(np.int64)
        if not len(text):
            continue
        raw = data.tobytes()
        size = many + DEPTH - 1
        content = [raw[a:b] for a, b in zip(start.tolist(), (start + size).tolist())]
        least: dict[bytes, int] = {}
        keys = ids[text].tolist()
        for c, k in zip(content, keys):
            if least.setdefault(c, k) > k:
                least[c] = k
        first = start - at[text]
        stays = np.ones(len(text), bool)
        seen: set[bytes] = set()
        for j, (c, k) in enumerate(zip(content, keys)):
            if least[c] < k:
                stays[j] = False
            else:
                seen.add(c)
        gone = np.flatnonzero(~stays)
        if len(gone):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(gone), pa.int32()), pa.nulls(len(gone), pa.binary()), *(pa.array(x.astype(np.int64)) for x in (ids[text[gone]], twins[text[gone]], first[gone], many[gone]))], names)
        stay = np.flatnonzero(stays)
        stay = stay[np.argsort(bucket[stay], kind="stable")]
        head = grouped(bucket[stay])
        out_bucket, blobs = [], []
        for a, b in zip(head.tolist(), np.append(head[1:], len(stay)).tolist()):
            rows = stay[a:b]
            joined = np.frombuffer(b"".join([content[j] for j in rows.tolist()]), np.uint8)
            squeezed = np.frombuffer(pa.compress(joined, "zstd").to_pybytes(), np.uint8)
            out_bucket.append(int(bucket[rows[0]]))
            twin = twins[text[rows]].astype("<i8")
            blobs.append(packed(ids[text[rows]].astype("<i8"), first[rows].astype("<u4"), many[rows].astype("<u4"), twin if twin.any() else twin[:0], squeezed))
        n = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(blobs, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(4))], names)


def equal_strings(data: np.ndarray, at: np.ndarray, key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radix passes over the strings of DEPTH bytes that begin at `at`, own[i] saying which key string i has: (string, group)
    of those that a string of another key equals. After each pass, groups of one key are left out. The strings are taken in SLICES parts by
    their first digit, so that the sorts stay small."""
    digit = words(data, ">u8")
    part = (mixed(digit[at].astype(np.uint64)) % np.uint64(SLICES)).astype(np.int8)
    orders, groups, base = [], [], 0
    for k in range(SLICES):
        order = np.flatnonzero(part == k).astype(np.int32)  # a bucket has fewer strings than that holds
        group = np.zeros(len(order), np.int32)
        for p in PASSES:
            if not len(order):
                break
            d = digit[at[order] + p].astype(np.uint64)
            by = np.lexsort((d, group))
            order, group, d = order[by], group[by], d[by]
            head = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (d[1:] != d[:-1])))
            size = np.diff(np.append(head, len(order)))
            k_ = key[own[order]]
            several = np.minimum.reduceat(k_, head) != np.maximum.reduceat(k_, head)
            order, group = order[np.repeat(several, size)], np.repeat(np.arange(int(several.sum()), dtype=np.int32), size[several])
        orders.append(order)
        groups.append(group + base)
        base += int(group[-1]) + 1 if len(group) else 0
    return np.concatenate(orders), np.concatenate(groups)


def removed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, twin, first, count): runs of strings of a text that a text with a smaller key has too."""
    names = ["key", "twin", "first", "count"]

    def passed(batches):
        for batch in batches:
            done = batch.column("key").is_valid()
            yield batch.filter(done).select(names), batch.filter(batch.column("blob").is_valid())

    sorted_rows = []

    def split():
        for done, rest in passed(batches):
            if done.num_rows:
                sorted_rows.append(done)
            if rest.num_rows:
                yield rest

    for _, blobs in by_bucket(split()):
        while sorted_rows:
            yield sorted_rows.pop()
        parts = [unpacked_stretches(b) for b in blobs]
        key, first, many, twin = (np.concatenate(x) for x in zip(*(p[:4] for p in parts)))
        data = np.frombuffer(b"".join(p[4] for p in parts), np.uint8)
        size = many + DEPTH - 1
        offset = np.cumsum(size) - size
        narrow = np.int32 if len(data) < 1 << 31 else np.int64
        at, own = runs(offset, many).astype(narrow), np.repeat(np.arange(len(many), dtype=narrow), many)
        order, group = equal_strings(data, at, key, own)
        if not len(order):
            continue
        k = key[own[order]]
        head = grouped(group)
        late = np.sort(order[k > np.repeat(np.minimum.reduceat(k, head), np.diff(np.append(head, len(group))))])
        if not len(late):
            continue
        s = own[late]
        edge = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (late[1:] != late[:-1] + 1)))
        begin = first[s[edge]] + (at[late[edge]] - offset[s[edge]])
        count = np.diff(np.append(edge, len(late)))
        for i in range(0, len(edge), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000].astype(np.int64)) for x in (key[s[edge]], twin[s[edge]], begin, count)], names)
    while sorted_rows:
        yield sorted_rows.pop()


def unpacked_stretches(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Key, first, strings and twin of each stretch, and their text. A blob whose twins are all 0 leaves them out."""
    key, first, many, twin, squeezed = unpacked(blob, *STRETCHES)
    twin = twin if len(twin) else np.zeros(len(key), np.int64)
    many = many.astype(np.int64)
    size = int((many + DEPTH - 1).sum())
    return key, first.astype(np.int64), many, twin, pa.decompress(squeezed.tobytes(), decompressed_size=size, codec="zstd", asbytes=True)


def cut_out(batch: pa.RecordBatch, whole_characters: bool) -> Iterator[pa.RecordBatch]:
    """(route_id, directions, kept, spans) from a text and its runs."""
    for part in steps(batch, "directions", STEP):
        data, at = utf8(part.column("directions"))
        whole = part.column("whole").to_numpy(zero_copy_only=False)
        found = part.column("runs").combine_chunks() if isinstance(part.column("runs"), pa.ChunkedArray) else part.column("runs")
        many = np.nan_to_num(found.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        flat = found.flatten()
        row = np.repeat(np.arange(part.num_rows), many)
        begin = flat.field("first").to_numpy(zero_copy_only=False).astype(np.int64) + at[row]
        end = begin + flat.field("count").to_numpy(zero_copy_only=False).astype(np.int64) + DEPTH - 1
        full = np.flatnonzero(whole & (np.diff(at) > 0))
        begin, end = np.append(begin, at[full]), np.append(end, at[full + 1])
        depth = np.zeros(len(data) + 1, np.int32)
        np.add.at(depth, begin, 1)
        np.add.at(depth, end, -1)
        gone = np.cumsum(depth[:-1]) > 0
        if whole_characters and len(data):
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            gone = np.repeat(np.logical_or.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
        # maximal runs; a text's border ends one
        before = np.append(False, gone[:-1])
        before[at[:-1][at[:-1] < len(data)]] = False
        after = np.append(gone[1:], False)
        after[at[1:][at[1:] > 0] - 1] = False
        first, last = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        row = np.searchsorted(at, first, side="right") - 1
        spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(first - at[row]), pa.array(last - at[row])], ["start", "end"]))
        left = np.append(0, np.cumsum(~gone))
        kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(left[at].astype(np.int32)), pa.py_buffer(data[~gone].tobytes())])
        yield pa.RecordBatch.from_arrays([part.column("route_id"), part.column("directions"), kept, spans], ["route_id", "directions", "kept", "spans"])


def drop_repeats(routes: DataFrame, hot: int = HOT, whole_characters: bool = False) -> DataFrame:
    """(route_id, directions, kept, spans): every route's directions without the passages that a smaller route_id has.

    routes: route_id (of any type with an order), directions; other columns are left out. Directions
    are taken as UTF-8, null as empty. Each byte covered by a string of 50 bytes
    that also begins in the directions of a smaller route_id goes; overlaps
    count, matches never run from one text into another, and all is judged on
    the input. kept (binary) is what remains; spans are the removed bytes as
    (start, end), maximal and in order. With whole_characters a character of
    which a byte goes is removed as a whole, so that kept is UTF-8. Texts under 50 bytes are kept. Rows with
    the same route_id do not remove each other, and each is judged by its own directions; a null route_id is the smallest.
    No rows in, none out.

    Copies of whole texts are found by their digests, and only the first takes
    part in the search. Where an id has unlike texts, what is found of each comes back by its hash too (twin, 0 elsewhere). The texts are shuffled once, by route_id; marks,
    stretches and runs travel as packed arrays. What several texts of one task
    share travels once.
    """
    ship()
    routes, names = numbered(routes.select("route_id", "directions"), "route_id")
    total = routes.agg(F.sum(F.octet_length("directions"))).head()[0] or 0
    bits = min(30, max(4, math.ceil(math.log2(max(1, total / BUCKET_BYTES)))))
    n = shares(routes, ROUTE_ROWS)
    key = F.coalesce(F.col("route_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("key")
    rows = routes.select(key, F.coalesce("directions", F.lit("")).alias("directions"))
    own = F.xxhash64("directions")
    several = rows.select("key", own.alias("own")).groupBy("key").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("key", F.lit(True).alias("several")).repartition(n, "key")
    texts = rows.repartition(n, "key").join(several.hint("shuffle_hash"), "key", "left").select("key", "directions", F.when(F.col("several"), own).otherwise(F.lit(0).cast("long")).alias("twin"))
    digest = rows.where(F.octet_length("directions") >= DEPTH).select("key", own.alias("own"), F.sha2(F.col("directions").cast("binary"), 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    # whatever meets the texts is dealt as they are, or Spark would deal the texts anew
    copies = digest.join(first, "digest").where("key > first").select("key", "own").repartition(n, "key").groupBy("key").agg(F.collect_set("own").alias("owns"))
    whole = F.coalesce(F.array_contains("owns", own), F.lit(False))
    alone = texts.join(copies.hint("shuffle_hash"), "key", "left").where(~whole).select("key", "directions")

    marks = per_batch(alone, lambda b: marks_of(b, bits), "bucket int, blob binary")
    marks = marks.repartition(max(n, min(1 << bits, MOST_PARTS)), "bucket").sortWithinPartitions("bucket")
    shared = marks.mapInArrow(lambda it: held_by_several(it, hot, bits), "key long, marks binary")
    shared = shared.repartition(n, "key").groupBy("key").agg(F.collect_list("marks").alias("marks"))
    touched = texts.join(shared.hint("shuffle_hash"), "key")
    found = per_batch(touched, lambda b: stretches_of(b, bits), "bucket int, blob binary, key long, twin long, first long, count long")
    place = F.coalesce("bucket", F.xxhash64("key", "twin", "first"))
    found = found.repartition(max(n, min(1 << bits, MOST_PARTS)), place).sortWithinPartitions("bucket")
    gone = found.mapInArrow(removed_runs, "key long, twin long, first long, count long")
    gone = gone.repartition(n, "key").groupBy("key").agg(F.collect_list(F.struct("twin", "first", "count")).alias("runs"))
    runs_ = F.transform(F.filter("runs", lambda r: r["twin"] == F.col("twin")), lambda r: F.struct(r["first"].alias("first"), r["count"].alias("count")))
    out = texts.join(copies.hint("shuffle_hash"), "key", "left").join(gone.hint("shuffle_hash"), "key", "left")
    out = out.select(F.when(F.col("key") != -(2**63), F.col("key")).alias("route_id"), "directions", whole.alias("whole"), F.coalesce(runs_, F.array().cast("array<struct<first:bigint,count:bigint>>")).alias("runs"))
    cut = per_batch(out, lambda b: cut_out(b, whole_characters), "route_id long, directions string, kept binary, spans array<struct<start:bigint,end:bigint>>")
    return named(cut, names, "route_id")
