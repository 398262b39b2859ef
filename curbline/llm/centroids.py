"""Centroid clustering on integer coordinates by scalar lookup tables.

Positions are scaled and floored to integers, so that every sum and distance is
exact and no order of tasks matters. In a round each batch tabulates, for every
dimension, the squared difference of each value that occurs and each centroid;
the distances are then gathered from the table and added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Workspace, ship

LIMIT = 1 << 27  # components are held within it, so that a distance in up to 128 dimensions is a long
ROWS = 8_192  # positions worked on at once


def grid(position: Column, dims: int, scale: float) -> Column:
    """floor(scale * x) of every component, in double precision and within LIMIT; null if the position has another
    number of components, or one that is null or not finite."""
    sound = F.coalesce((F.size(position) == dims) & ~F.exists(position, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    near = lambda x: F.least(F.lit(float(LIMIT)), F.greatest(F.lit(-float(LIMIT)), F.floor(F.lit(float(scale)) * x.cast("double"))))
    return F.when(sound, F.transform(position, lambda x: near(x).cast("long")))


def tabulated(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """table[v, c]: squared difference of an occurring value and centroid c's component, all dimensions below each
    other; and at[row, d]: where the row's value of dimension d stands there."""
    at, parts, base = np.empty(values.shape, np.int64), [], 0
    for d in range(values.shape[1]):
        occurring, code = np.unique(values[:, d], return_inverse=True)
        at[:, d] = code + base
        parts.append(np.square(occurring[:, None] - centroids[None, :, d]))
        base += len(occurring)
    return np.concatenate(parts), at


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, of equals the first, and its squared distance."""
    table, at = tabulated(values, centroids)
    total = np.zeros((len(values), len(centroids)), np.int64)
    for d in range(values.shape[1]):
        total += table[at[:, d]]
    best = total.argmin(1)
    return best, total[np.arange(len(best)), best]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def cluster(sites: DataFrame, position: Column, dims: int, start: Column, clusters: int = 16, rounds: int = 3, scale: float = 1.0) -> DataFrame:
    """Adds cluster, distance, cluster_inertia, inertia and centroid to map sites or other rows with a position.

    sites: rows as the readers give them (say row_id, lon, lat), whose columns are
    kept but for those five. position: an array of dims numbers, such as
    array(lon, lat); each becomes floor(scale * x). Rows whose position is null, of
    another length, or not finite are left out. The first `clusters` rows by start
    (nulls last, ties by position) are the centroids to begin with; fewer rows give
    fewer. A round assigns every row to the nearest centroid (squared Euclidean
    distance, of equals the smaller number), then moves every centroid that has
    rows to the floor of their mean. After the rounds rows are assigned once more.
    cluster_inertia and inertia are sums of distances (null beyond a long). Rows at
    one place are rows of their own. No rows in, none out.

    A round reads the written positions once. A task adds up its rows by
    centroid, and only those sums are shuffled and sent to the driver: clusters x
    dims numbers a round, whatever the rows. A full cluster is one sum a task.
    """
    ship()
    ws = Workspace(sites.sparkSession, "centroids")
    added = ("cluster", "distance", "cluster_inertia", "inertia", "centroid")
    names = [c for c in sites.columns if c not in added]
    inner = [f"_c{i}" for i in range(len(names))]  # no name of the rows can clash with ours
    rows = sites.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)), grid(position, dims, scale).alias("_place"), start.alias("_start"))
    rows = ws.write(rows.where("_place is not null"), "places")
    first = rows.select("_start", "_place").orderBy(F.col("_start").asc_nulls_last(), "_place").limit(clusters).collect()
    at = [list(r["_place"]) for r in first]
    if not at:
        at = [[0] * dims]  # there is no row to assign

    def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                values = matrix(batch.column(0).slice(k, ROWS), dims)
                best, _ = nearest(values, centroids)
                count += np.bincount(best, minlength=len(centroids))
                order = np.argsort(best, kind="stable")
                head = np.flatnonzero(np.append(True, np.diff(best[order]) > 0))
                total[best[order][head]] += np.add.reduceat(values[order], head)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, dims)), pa.array(np.tile(np.arange(dims), len(full))), pa.array(total[full].ravel()), pa.array(np.repeat(count[full], dims))], ["c", "d", "total", "n"])

    for _ in range(rounds):
        now = np.array(at, np.int64)
        added_up = rows.select("_place").mapInArrow(lambda it, now=now: sums(it, now), "c long, d long, total long, n long").groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for r in added_up.collect():
            at[r["c"]][r["d"]] = int(r["total"]) // r["n"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                best, far = nearest(matrix(part.column("_place"), dims), np.array(at, np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in inner), pa.array(best.astype(np.int32)), pa.array(far)], [*inner, "cluster", "distance"])

    schema = T.StructType([*(f for f in rows.schema.fields if f.name in inner), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    told = ws.write(rows.select(*inner, "_place").mapInArrow(assign, schema), "assigned")
    by = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid at most
    long = lambda n: n if n < 1 << 63 else None
    whole = long(sum(int(r["s"]) for r in by))
    facts = sites.sparkSession.createDataFrame([(r["cluster"], long(int(r["s"])), whole, at[r["cluster"]]) for r in by], "_no int, cluster_inertia long, inertia long, centroid array<long>")
    out = told.join(F.broadcast(facts), F.col("cluster") == F.col("_no"))
    return out.select(*(F.col(i).alias(c) for c, i in zip(names, inner)), *added)
