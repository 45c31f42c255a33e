"""Lloyd's rounds by column shards against plain loops over Python integers."""

import hashlib
import math

import numpy as np
import pytest

from shopflow.llm.catalog import QUERIES
from shopflow.llm.sharded_lloyd import LARGEST, lloyd, partial_distances

SF = "/root/testdata/sf0.001"


def _plain(rows, k, rounds, dims, scale=256):
    """Sorted ``(id, cluster, distance)`` and the centroids, in Python integers."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[nearest(v)[0]].append(v)
        centroids = [[sum(c) // len(o) for c in zip(*o)] if o else old for o, old in zip(own, centroids)]
    return sorted(((i, *nearest(v)) for i, v in kept), key=str), centroids


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, block int")


@pytest.mark.parametrize(("dims", "shards", "block", "size"), [(8, 3, 7, 1.0), (5, 5, 4096, 300.0), (4, 9, 16, 500_000.0)])
def test_rounds_match_plain_loops(spark, dims, shards, block, size):
    rng = np.random.default_rng(dims)
    x = (rng.normal(size=(200, dims)) * size / 5).clip(-size, size).astype(np.float32)
    x[50:110] = x[50]  # a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, x[3].tolist()), (None, x[4].tolist()), (300, None), (301, []), (302, [1.0]), (303, [None] * dims), (304, [float("nan")] * dims), (305, [float("-inf")] * dims), (306, [0.0] * dims), (306, [0.0] * dims)]
    got, centroids = lloyd(_frame(spark, rows).repartition(3), k=9, rounds=4, dims=dims, shards=shards, block_rows=block)
    want, plain = _plain(rows, 9, 4, dims)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert centroids.tolist() == plain


def test_few_rows_ties_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])]
    got, centroids = lloyd(_frame(spark, rows), k=40, rounds=2, dims=2)
    assert len(centroids) == 3 and sorted(map(tuple, got.collect()), key=str) == _plain(rows, 40, 2, 2)[0]
    same = [(i, [0.5, 0.5]) for i in range(50)]  # all centroids are equal: the smallest number takes all
    got, _ = lloyd(_frame(spark, same), k=5, rounds=2, dims=2)
    assert {tuple(r)[1:] for r in got.collect()} == {(0, 0)}
    got, centroids = lloyd(_frame(spark, []), dims=2)
    assert got.count() == 0 and len(centroids) == 0 and got.columns == ["vec_id", "cluster", "distance"]


def test_exact_beyond_double_precision(spark):
    x, c = np.array([[LARGEST - 1, -LARGEST + 1, 3]], np.int32), np.array([[-LARGEST + 1, LARGEST - 1, 1], [LARGEST - 2, 5, 7]], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
    assert partial_distances(x, c).tolist() == want
    with pytest.raises(Exception, match="too large"):
        lloyd(_frame(spark, [(1, [1e9, 0.0])]), dims=2)[0].collect()


def test_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, centroids = _plain(rows, 40, 5, 64)
    got = QUERIES["op13_sharded_lloyd"](spark, SF).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    inertia = {}
    for _, c, d in want:
        inertia[c] = inertia.get(c, 0) + d
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
