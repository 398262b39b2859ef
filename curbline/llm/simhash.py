"""SimHash near-copies of place names, with pigeonring filtering.

A 64-bit fingerprint is a ring of five segments. If two fingerprints differ in
at most REACH bits, some segment begins a chain whose first l segments differ in
at most l * REACH / 5 bits together, for every l. So its first segment is equal
and its second differs in one bit at most: these two make the key by which
fingerprints meet. Of those that meet, the longer chains prune before the whole
distance is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Workspace, ship
from .common import components, named, numbered, per_batch, shares, steps, utf8

WORDS = 4
SEED = 42
REACH = 4
WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(sum(WIDTHS[:i]) for i in range(len(WIDTHS)))
AT_ONCE = 20_000  # shingles: their bits, summed as whole numbers, are 10 MB
STEP = 500_000  # bytes of text at once: its words are objects of some 50 bytes each
FP_ROWS = 20_000  # fingerprints whose keys a partition takes
HELD = 1 << 20  # links that a task holds before it reduces them to a forest


def hashed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit."""
    from xxhash import xxh64_intdigest

    rows = len(at) - 1
    raw = data.tobytes().lower()
    split = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    per = np.fromiter(map(len, split), np.int64, rows)
    words = [w for ws in split for w in ws]
    out = np.zeros(rows, np.uint64)
    if not words:
        return out
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    last = np.cumsum(per) - 1
    first = last - per + 1
    many = np.maximum(1, per - WORDS + 1) * (per > 0)  # shingles of each text
    row = np.repeat(np.arange(rows), many)
    head = first[row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
    tail = np.minimum(head + WORDS - 1, last[row])
    has = np.flatnonzero(per)
    ones = np.zeros((rows, 64), np.int64)
    for k in range(0, len(row), AT_ONCE):  # a long text comes in several parts
        a, b, own = start[head[k : k + AT_ONCE]], end[tail[k : k + AT_ONCE]], row[k : k + AT_ONCE]
        h = np.fromiter((xxh64_intdigest(joined[x:y], SEED) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(own))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first_of = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[first_of]] += np.add.reduceat(bits, first_of, axis=0, dtype=np.int64)
    out[has] = np.packbits(2 * ones[has] > many[has, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(places: DataFrame) -> DataFrame:
    """Adds `fingerprint` (long, the 64 bits) to every place by its `name`; other columns are kept.

    A-Z are lower-cased; words are parted by ASCII white space; shingles of four
    words, repeats included, are hashed by XXH64 with seed 42. A bit is 1 if more
    than half of the hashes have it. Fewer words are one shingle; without a word,
    or for null, the fingerprint is zero.
    """
    others = [f for f in places.schema.fields if f.name != "fingerprint"]
    names = [f.name for f in others]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in steps(batch, "name", STEP):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(hashed(*utf8(part.column("name"))).view(np.int64))], [*names, "fingerprint"])

    return per_batch(places.select(*(F.col(f"`{c}`") for c in names)), run, T.StructType([*others, T.StructField("fingerprint", T.LongType())]))


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints, as (key, fingerprint, probe).

    Each has a key for each rotation. To meet those one bit away in the second
    segment, one with an odd number of ones there also has the keys with one bit
    turned: the other's number is even, so one of the two comes to the other.
    """
    out = []
    for i, (at, width) in enumerate(zip(STARTS, WIDTHS)):
        j = (i + 1) % len(WIDTHS)
        one = (fp >> np.uint64(at)) & np.uint64((1 << width) - 1)
        two = (fp >> np.uint64(STARTS[j])) & np.uint64((1 << WIDTHS[j]) - 1)
        base = (np.uint64(i) << np.uint64(26)) | (one << np.uint64(13))
        out.append((base | two, fp, np.zeros(len(fp), bool)))
        odd = (np.bitwise_count(two) & 1) == 1
        for b in range(WIDTHS[j]):
            out.append((base[odd] | (two[odd] ^ np.uint64(1 << b)), fp[odd], np.ones(int(odd.sum()), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def chained(diff: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Whether the chain from each rotation keeps its budgets: l segments, l * REACH / 5 bits."""
    ok = np.ones(len(diff), bool)
    for i in range(len(WIDTHS)):
        at = np.flatnonzero(rotation == i)
        spent = np.zeros(len(at), np.int64)
        for step in range(len(WIDTHS)):
            j = (i + step) % len(WIDTHS)
            spent = spent + np.bitwise_count((diff[at] >> np.uint64(STARTS[j])) & np.uint64((1 << WIDTHS[j]) - 1))
            alive = spent * len(WIDTHS) <= (step + 1) * REACH
            ok[at[~alive]] = False
            at, spent = at[alive], spent[alive]
    return ok


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between each linked value and the least one that links lead to: as many as values at most."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (root[x] == root[y]).all():
            break
    move = root != np.arange(len(names))
    return names[move], names[root[move]]


def linked(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys of sorted rows. Rows at distance d in a run are compared for all d."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count, d = 0, 1
    at = np.flatnonzero(key[1:] == key[:-1]) if len(key) > 1 else np.zeros(0, np.int64)
    while len(at):
        use = at[~(probe[at] & probe[at + d])]
        diff = fp[use] ^ fp[use + d]
        good = chained(diff, (key[use] >> np.uint64(26)).astype(np.int64))
        use, diff = use[good], diff[good]
        use = use[np.bitwise_count(diff) <= REACH]
        held.append((fp[use], fp[use + d]))
        count += len(use)
        if count > HELD:
            held = [forest(*(np.concatenate(x) for x in zip(*held)))]
            count = len(held[0][0])
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
    return forest(*(np.concatenate(x) for x in zip(*held))) if count else (fp[:0], fp[:0])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (column fingerprint) to connect all that differ in REACH bits or fewer.

    A key's rows meet in one task, sorted; a task gives one link for each
    fingerprint at most, so a dense group is not written as pairs. A key is 26 of
    64 bits of distinct fingerprints: copies of a text add no rows.
    """
    ship()

    def spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(0, batch.num_rows, 2_000):
            key, fp, probe = keys(batch.column("fingerprint")[k : k + 2_000].to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(probe)], ["key", "fp", "probe"])

    rows = per_batch(prints.select("fingerprint"), spread, "key long, fp long, probe boolean")
    rows = rows.repartition(shares(prints, FP_ROWS), "key").sortWithinPartitions("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def out(rows):
            a, b = linked(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            new = [batch.column("key").to_numpy().view(np.uint64), batch.column("fp").to_numpy().view(np.uint64), batch.column("probe").to_numpy(zero_copy_only=False)]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            whole = int(np.searchsorted(rest[0], rest[0][-1]))  # the last key may go on
            if whole:
                yield out([x[:whole] for x in rest])
                rest = [x[whole:] for x in rest]
        if rest is not None:
            yield out(rest)

    return rows.mapInArrow(meet, "a long, b long")


def near_copies(places: DataFrame) -> DataFrame:
    """(place_id, fingerprint, component_id): which places have nearly the same name.

    places: place_id (of any type with an order), name; other columns are left out. Fingerprints that
    differ in four bits or fewer are linked; component_id is the smallest
    place_id that links lead to, itself included. Names without a word are alike.
    Equal fingerprints are one vertex, so copies cost a count before the shuffle.
    A repeated row is in its fellow's component; a null place_id is never a
    component's name unless all its members are null. No rows in, none out.
    """
    ws = Workspace(places.sparkSession, "simhash")
    places, names = numbered(places.select("place_id", "name"), "place_id")
    rows = ws.write(fingerprints(places.select(F.col("place_id").cast("long").alias("place_id"), "name")).drop("name"), "rows")
    prints = ws.write(rows.groupBy("fingerprint").agg(F.min("place_id").alias("first")), "prints")
    joined = components(ws.write(links(prints), "links"), ws)
    labelled = prints.join(joined, prints.fingerprint == joined.member, "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    told = labelled.join(least, "component").select("fingerprint", "component_id")
    return named(rows.join(told, "fingerprint").select("place_id", "fingerprint", "component_id"), names, "place_id", "component_id")
