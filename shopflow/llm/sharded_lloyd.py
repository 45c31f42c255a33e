"""Centroid clustering (13): Lloyd's rounds over blocks of columns, in whole numbers.

Vectors become integers once, in blocks of rows; a block's columns are cut
into shards, each a Parquet column of its own, so that a shard's tasks read
nothing but their own dimensions.  A round has two steps:

1. Column-block tasks compute exact partial squared distances between their
   slice of the vectors and their slice of the centroids.  The partial
   matrices of a row block are added by block, and the smallest sum gives each
   vector's centroid (the smaller number of equal ones).
2. The assignments, written to the shared folder, go back to the shards by
   block.  Each shard sums its own columns by centroid, in the tasks first,
   and takes the floor of the mean: its slice of the new centroids.

Every number is an integer, so the result doesn't depend on the order of
additions.  Only centroids pass through the driver: ``k`` times the
dimensions, however many vectors there are.  The step that adds partial
distances moves ``4 * shards * k`` bytes a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_path, staged

#: Components are at most this in size, so that a squared distance over 64 dimensions fits 63 bits.
LARGEST = 1 << 27
#: Sums below this are exact in double precision.
_EXACT = 1 << 52


def on_grid(embedding: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, computed in double precision.

    A component beyond ``LARGEST`` on the grid fails the job with a message:
    distances would not fit the result's type.
    """
    whole = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    too_large = F.raise_error(F.lit("a component is too large for exact distances")).cast("bigint")
    return F.transform(embedding, lambda x: F.when(F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float(LARGEST)), whole(x)).otherwise(too_large))


def usable(embedding: Column, dims: int) -> Column:
    """Vectors of ``dims`` components, none null, infinite or no number."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == dims) & fine, F.lit(False))


def _columns(dims: int, shards: int) -> list[tuple[int, int]]:
    edges = [round(i * dims / shards) for i in range(shards + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _blocks(vectors: DataFrame, dims: int, columns: list[tuple[int, int]], block_rows: int) -> DataFrame:
    """Rows ``block, ids, s0, s1, ...`` in the shared folder: the ids and, per shard, the integers of up to ``block_rows`` vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        known: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            grid = np.concatenate(rows)
            row = [np.concatenate(ids).tobytes(), np.concatenate(known).tobytes(), *[np.ascontiguousarray(grid[:, a:b]).tobytes() for a, b in columns]]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["ids", "known", *[f"s{j}" for j in range(len(columns))]])

        held = 0
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                known.append(np.asarray(part.column(0).is_valid()).astype(np.uint8))
                ids.append(np.asarray(part.column(0).fill_null(0)))
                rows.append(np.asarray(part.column(1).flatten()).astype("<i4").reshape(-1, dims))
                held += part.num_rows
                if held >= block_rows:
                    yield block()
                    ids, known, rows, held = [], [], [], 0
        if held:
            yield block()

    schema = "ids binary, known binary, " + ", ".join(f"s{j} binary" for j in range(len(columns)))
    return staged(vectors.select("vec_id", "grid").mapInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id()))


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids, over these columns only."""
    wide = x.astype(np.int64)
    most = max(int(np.abs(wide).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most * most * x.shape[1] < _EXACT:  # products in double precision are exact
        product = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    else:
        product = wide @ centroids.T
    return (wide * wide).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * product


def _packed(matrix: np.ndarray) -> bytes:
    """32-bit numbers if they fit, else 64-bit ones; the length tells which."""
    return matrix.astype("<i4" if matrix.max(initial=0) < 1 << 31 else "<i8").tobytes()


def _assigned(blocks: DataFrame, columns: list[tuple[int, int]], centroids: np.ndarray) -> DataFrame:
    """``block, cluster, distance``: per row block its vectors' nearest centroids (32-bit) and squared distances (64-bit)."""
    k = len(centroids)
    parts = None
    for j, (a, b) in enumerate(columns):
        own = np.ascontiguousarray(centroids[:, a:b])

        def partial(batches: Iterator[pa.RecordBatch], own: np.ndarray = own) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(data, "<i4").reshape(-1, own.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(x)], pa.int32()), pa.array([_packed(partial_distances(x, own))], pa.binary())], ["block", "n", "part"])

        part = blocks.select("block", F.col(f"s{j}")).mapInArrow(partial, "block long, n int, part binary")
        parts = part if parts is None else parts.unionByName(part)

    def nearest(group: pa.Table) -> pa.Table:
        total = None
        for n, data in zip(group.column("n").to_pylist(), group.column("part").to_pylist(), strict=True):
            part = np.frombuffer(data, "<i4" if len(data) == 4 * n * k else "<i8").reshape(n, k)
            total = part.astype(np.int64) if total is None else total + part
        cluster = total.argmin(1)  # the first of equal ones
        distance = total[np.arange(len(total)), cluster]
        return pa.table({"block": group.column("block").slice(0, 1), "cluster": pa.array([cluster.astype("<i4").tobytes()], pa.binary()), "distance": pa.array([distance.astype("<i8").tobytes()], pa.binary())})

    # One row per shard and row block: what meets in a group is bounded by both parameters.
    return staged(parts.groupBy("block").applyInArrow(nearest, "block long, cluster binary, distance binary"))


def _updated(blocks: DataFrame, assigned: DataFrame, columns: list[tuple[int, int]], centroids: np.ndarray) -> np.ndarray:
    """The centroids after every shard has taken the floors of its own columns' means; empty ones stay."""
    k = len(centroids)
    widest = max(b - a for a, b in columns)
    sums = None
    of = assigned.select(F.col("block").alias("of"), "cluster")
    for j, (a, b) in enumerate(columns):
        width = b - a

        def summed(batches: Iterator[pa.RecordBatch], j: int = j, width: int = width) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                for data, cluster in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    x, c = np.frombuffer(data, "<i4").reshape(-1, width).astype(np.int64), np.frombuffer(cluster, "<i4")
                    order = np.argsort(c, kind="stable")
                    present, first = np.unique(c[order], return_index=True)
                    total[present] += np.add.reduceat(x[order], first)
                    count += np.bincount(c, minlength=k)
            some = np.flatnonzero(count)
            if len(some):
                values = np.zeros((len(some), widest), np.int64)
                values[:, :width] = total[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), j, np.int32)), pa.array(some.astype(np.int32)), pa.array(count[some]), *[pa.array(values[:, i]) for i in range(widest)]],
                    ["shard", "cluster", "n", *[f"v{i}" for i in range(widest)]],
                )

        met = blocks.select("block", F.col(f"s{j}").alias("slice")).join(of, F.col("block") == F.col("of")).select("slice", "cluster")
        part = met.mapInArrow(summed, "shard int, cluster int, n long, " + ", ".join(f"v{i} long" for i in range(widest)))
        sums = part if sums is None else sums.unionByName(part)
    whole = sums.groupBy("shard", "cluster").agg(F.sum("n").alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(widest)])
    floors = [F.expr(f"(v{i} - pmod(v{i}, n)) div n").alias(f"v{i}") for i in range(widest)]
    out = centroids.copy()
    for row in whole.select("shard", "cluster", *floors).collect():  # shards times centroids
        a, b = columns[row["shard"]]
        out[row["cluster"], a:b] = row[2 : 2 + b - a]
    return out


def lloyd(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", shards: int = 4, block_rows: int = 4096, embedding: str = "embedding", vec_id: str = "vec_id"
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` (squared) for every usable row, and the final centroids.

    Vectors of another length, null ones, and those with a null, infinite or
    NaN component take no part.  The first centroids are the ``k`` vectors
    with the smallest SHA-256 of ``seed:vec_id`` (all, if fewer; rows of equal
    id by their components; a null id is written as nothing).  Every round
    assigns each vector to the nearest centroid, the smaller number at ties,
    and moves every centroid that has vectors to the floor of their mean;
    after the last one vectors are assigned once more.  Repeated rows count
    each for themselves.  An empty table gives an empty result and no
    centroids; further columns are not read.
    """
    spark = vectors.sparkSession
    python_path(spark)
    columns = _columns(dims, shards)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    kept = rows.filter(usable(F.col("embedding"), dims)).select("vec_id", on_grid(F.col("embedding"), scale).alias("grid"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r["grid"] for r in kept.orderBy(key, "grid").limit(k).select("grid").collect()], np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    blocks = _blocks(kept, dims, columns, block_rows)
    for _ in range(rounds):
        centroids = _updated(blocks, _assigned(blocks, columns, centroids), columns, centroids)
    last = _assigned(blocks, columns, centroids).withColumnRenamed("block", "of")

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, cluster, distance in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                absent = np.frombuffer(known, np.uint8) == 0
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8"), mask=absent), pa.array(np.frombuffer(cluster, "<i4")), pa.array(np.frombuffer(distance, "<i8"))], ["vec_id", "cluster", "distance"])

    met = blocks.select("block", "ids", "known").join(last, F.col("block") == F.col("of")).select("ids", "known", "cluster", "distance")
    return met.mapInArrow(expanded, "vec_id long, cluster int, distance long"), centroids
