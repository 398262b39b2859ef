"""Near-duplicate embeddings by p-stable hashing with exact checks.

The reference records hold no embeddings, so the operator takes any table of
vectors: vec_id, embedding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace, ship
from .common import components, per_batch, shares
from .simhash import forest

LEAST = 0.95  # cosine
WIDTH = 2.0  # of a quantised projection, for vectors of length 1
RECALL = 0.999  # chance that a pair just at LEAST shares a bucket
CROWD = 50  # unlike vectors that may share a bucket, as a mean
BLOCK = 1_000  # vectors of a bucket compared at once; larger buckets are split into blocks
ROWS = 20_000


def chance(distance: float) -> float:
    """That two vectors at this distance fall into one slot of a Gaussian projection of WIDTH."""
    c = WIDTH / distance
    return 1 - math.erfc(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(vectors: int) -> tuple[int, int]:
    """Projections of a table, and tables: unlike vectors (at a right angle) crowd no bucket, alike ones meet."""
    near, far = chance(math.sqrt(2 - 2 * LEAST)), chance(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(1.0, vectors / CROWD)) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that no square is lost."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def buckets(units: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The bucket of each row in each table, as a 64-bit number. Projections depend on the dimension and on nothing else."""
    random = np.random.default_rng(units.shape[1])
    lines, shift = random.standard_normal((units.shape[1], tables * k)), random.uniform(0, WIDTH, tables * k)
    slot = np.floor((units @ lines + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(-1, tables, k)
    h = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(units.shape[1] << 20), slot.shape[:2]).copy()
    for i in range(k):
        h = (h ^ slot[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def rows_of(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (row numbers, matrix) of a list column without nulls."""
    size = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.cumsum(size) - size
    return {int(d): (i := np.flatnonzero(size == d), flat[at[i][:, None] + np.arange(d)]) for d in np.unique(size)}


def compared(x: np.ndarray, sig: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of left x right with cosine >= LEAST that no earlier table has put into one bucket."""
    near = x[left] @ x[right].T >= LEAST
    if same:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    fresh = np.ones(len(a), bool)
    for t in range(table):
        fresh &= sig[a, t] != sig[b, t]
    return a[fresh], b[fresh]


def near_pairs(vectors: DataFrame, ws: Workspace) -> DataFrame:
    """(a, b, links) of distinct vectors (rep, embedding, copies): rows with b connect alike vectors, rows with links count how many vectors a is linked to."""
    ship()
    k, tables = plan(vectors.count())

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rep = batch.column("rep").to_numpy()
        for i, x in rows_of(batch.column("embedding")).values():
            for s in range(0, len(i), 2_000):
                key = buckets(unit(x[s : s + 2_000]), k, tables)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(key))), pa.array(np.repeat(rep[i[s : s + 2_000]], tables))], ["key", "no", "rep"])

    member = ws.write(per_batch(vectors.select("rep", "embedding"), place, "key long, no int, rep long"), "members")
    full = member.groupBy("key", "no").agg(F.count("*").alias("size")).where("size > 1")
    # A bucket of many blocks meets as pairs of blocks, each a group of its own.
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    crowd = member.join(full, ["key", "no"]).withColumn("parts", parts).withColumn("own", own)
    crowd = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    crowd = crowd.select("rep", "key", "no", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    crowd = crowd.join(vectors, "rep")
    group = ["key", "no", "low", "high"]
    crowd = crowd.repartition(shares(vectors, ROWS), *group).sortWithinPartitions(*group)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of each group, which stand together; a group may go on in the next batch."""
        rest = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            ids = np.stack([rest.column(c).to_numpy() for c in group])
            edge = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            for a, b in zip([0, *edge.tolist()], edge.tolist()):
                yield rest.slice(a, b - a)
            rest = rest.slice(int(edge[-1]) if len(edge) else 0).combine_chunks()
        if rest is not None and rest.num_rows:
            yield rest

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_all, b_all, counts, held = [], [], {}, 0

        def out() -> pa.RecordBatch:
            a, b = forest(np.concatenate(a_all), np.concatenate(b_all))
            ids, n = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
            none = pa.nulls(len(ids), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, ids])), pa.concat_arrays([pa.array(b), none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(n)])], ["a", "b", "links"])

        for rows in groups(batches):
            if rows.num_rows < 2:
                continue
            table, rep, copies, own = rows.column("no")[0].as_py(), rows.column("rep").to_numpy(), rows.column("copies").to_numpy(), rows.column("own").to_numpy()
            low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
            x = unit(next(iter(rows_of(rows.column("embedding").combine_chunks()).values()))[1])
            sig = buckets(x, k, tables)
            left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
            for s in range(0, len(left), BLOCK):
                i, j = compared(x, sig, table, left[s : s + BLOCK], right[s:] if low == high else right, low == high)
                if not len(i):
                    continue
                more = np.bincount(i, weights=copies[j], minlength=len(rep)) + np.bincount(j, weights=copies[i], minlength=len(rep))
                for r in np.flatnonzero(more).tolist():
                    counts[int(rep[r])] = counts.get(int(rep[r]), 0) + int(more[r])
                i, j = forest(rep[i], rep[j])
                a_all.append(i)
                b_all.append(j)
                held += len(i)
            if held > 200_000 or len(counts) > 200_000:
                yield out()
                a_all, b_all, counts, held = [], [], {}, 0
        if a_all:
            yield out()

    return ws.write(crowd.mapInArrow(meet, "a long, b long, links long"), "found")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept): which vectors have a cosine of 0.95 or more.

    vectors: vec_id (long), embedding (array of float or double); other columns
    are left out. Cosines are taken in double precision between vectors of one
    dimension. n_links counts the other vectors linked directly, component_id is
    the smallest vec_id that links lead to, kept marks it. A vector that is null,
    empty or zero, or has a component that is null or not finite, links with
    nothing: 0 links, itself, kept. Rows with the same vec_id are vectors of
    their own. No rows in, none out.

    Equal vectors are one with a number of copies, counted before the shuffle.
    Each of several tables hashes a vector by projections on Gaussian lines; the
    number of projections grows with the logarithm of the vectors, the number of
    tables follows from RECALL. Pairs that share a bucket are checked exactly,
    and counted in the first table in which they meet. No pair is written: a task
    gives sums and a forest of links.
    """
    ws = Workspace(vectors.sparkSession, "embeddings")
    e = F.col("embedding")
    sound = F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, e).alias("embedding"))
    good = rows.where("embedding is not null and vec_id is not null")
    distinct = ws.write(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "embedding", "copies"), "distinct")
    found = near_pairs(distinct, ws)
    counts = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"), ws)
    about = distinct.join(counts, distinct.rep == counts.a, "left").drop("a").join(joined, F.col("rep") == F.col("member"), "left")
    about = about.select(F.col("embedding").alias("like"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(about, rows.embedding == about.like, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
