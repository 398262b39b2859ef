"""What the operators of this folder share: Arrow batches, a worker's caches, components."""

from __future__ import annotations

import ctypes
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Workspace, ship

#: UTF-8 bytes that one step of a task works on. Rows are never cut: a longer
#: text is a step of its own.
STEP_BYTES = 2_000_000


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over every Arrow batch of df; rows keep their partition."""
    ship()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def kept(key: str, build: Callable[[], object]):
    """A value that a Python worker builds once and keeps between tasks.

    Workers live on from one operator to the next. What another operator left
    (another word before the first - or : of the key) is dropped first, so that
    a worker holds the tables of one.
    """
    store = sys.modules.setdefault("_curbline_worker", types.ModuleType("_curbline_worker"))
    if not hasattr(store, key):
        owner = lambda k: re.split("[-:]", k)[0]
        others = [k for k in vars(store) if not k.startswith("__") and owner(k) != owner(key)]
        for other in others:
            delattr(store, other)
        if others:
            given_back()
        setattr(store, key, build())
    return getattr(store, key)


def given_back() -> None:
    """Gives freed memory back to the system: an allocator keeps it, and a worker lives as long as the job."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row's begin. Null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with about `limit` bytes of text."""
    _, at = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + counts[i] - 1, for each i in turn."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + counts, counts) + np.arange(total)


class Codes(dict):
    """Numbers keys as they are first asked for; `new` are those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = code = len(self)
        self.new.append(key)
        return code


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column of int32 whose rows take `counts` values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def numbered(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame | None]:
    """df with whole numbers in `column` in the order of its values, and (number, value) to read them back; df as it is, and None, if it has such numbers.

    The distinct values are sorted by ranges, so their numbers follow from the
    partition and the place in it; they are written, which fixes them. Null stays null.
    """
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return df, None
    values = df.select(F.col(column).alias("_value")).where("_value is not null").distinct().orderBy("_value").withColumn("_number", F.monotonically_increasing_id())
    names = Workspace(df.sparkSession, "ids").write(values.select("_number", "_value"), "names")
    met = df.join(names, F.col(f"`{column}`") == F.col("_value"), "left")
    return met.select(*(F.col("_number").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns)), names


def named(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """df with the values that `numbered` gave numbers to."""
    if names is None:
        return df
    for column in columns:
        order = df.columns
        met = df.join(names.select(F.col("_number").alias("_n"), F.col("_value").alias("_v")), F.col(f"`{column}`") == F.col("_n"), "left")
        df = met.select(*(F.col("_v").alias(c) if c == column else F.col(f"`{c}`") for c in order))
    return df


def shares(df: DataFrame, rows: int) -> int:
    """A partition count that gives each about `rows` rows, and at least the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // rows))


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(member, component): the smallest member that links lead to. Links are columns a and b (longs).

    Each round contracts every vertex into the neighbour that a hash of this
    round puts first, so vertices shrink by a constant share whatever the order
    of their ids: the rounds grow with the logarithm of the longest chain. Each
    round is a written table. A vertex with many links is one row for each task
    before the shuffle. Loops and repeated links change nothing; nulls are dropped.
    """
    a, b = F.col("a"), F.col("b")
    one = edges.select(a.cast("long").alias("a"), b.cast("long").alias("b")).where((a != b) & a.isNotNull() & b.isNotNull())
    pairs = ws.write(one.unionByName(one.select(b.alias("a"), a.alias("b"))).distinct(), "pairs-0")
    labels = pairs.select(a.alias("member"), a.alias("root")).distinct()
    k = 0
    while not pairs.isEmpty():
        order = lambda c, k=k: F.struct(F.xxhash64(c, F.lit(k)), c)
        hop = pairs.groupBy("a").agg(F.min(order(b)).alias("m")).select(a.alias("v"), F.when(F.col("m") < order(a), F.col("m")["b"]).otherwise(a).alias("to"))
        hop = ws.write(hop, f"hop-{k}")
        labels = ws.write(labels.join(hop, labels.root == hop.v, "left").select("member", F.coalesce("to", "root").alias("root")), f"labels-{k}")
        far = hop.select(F.col("v").alias("w"), F.col("to").alias("far"))
        met = pairs.join(hop, pairs.a == hop.v).join(far, pairs.b == far.w)
        pairs = ws.write(met.where("to <> far").select(F.col("to").alias("a"), F.col("far").alias("b")).distinct(), f"pairs-{k + 1}")
        k += 1
    least = labels.groupBy("root").agg(F.min("member").alias("component"))
    return labels.join(least, "root").select("member", "component")
