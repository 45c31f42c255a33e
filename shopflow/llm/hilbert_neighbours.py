"""Approximate nearest neighbours (1): several Hilbert orderings of projected vectors.

Each ordering projects the vectors to a few random orthogonal directions,
shifts the grid, and sorts all rows by their place on a Hilbert curve: Spark
range-partitions the keys, and running counts give every row its rank.
Ranks are cut into blocks of ``block`` rows; a query meets the rows of its
own block and of the two beside it, so at least ``block`` neighbours on
either side along the curve.  The blocks' best are merged over all orderings
and scored again on the original vectors.

How far a query has to look depends on the table.  The true neighbours of a
bounded sample of queries are found by comparing these with every row, and
their ranks tell which windows hold enough of them: larger blocks, then more
blocks on either side.  Where windows that do would meet as many places as
the table has rows, every query is compared with every row instead.

For the orderings, largest inner product is turned into nearest point by one
more coordinate, sqrt(m^2 - |x|^2) with the largest norm m.  A query is a row
of the table and has its place in the orderings by the same rule, so for
vectors of unequal norms a neighbour's place says less; the measured recall
then asks for wider windows.  The windows and their recall go to the log.

Equal vectors are one row in the search, however many there are, and come
apart again at the end.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_path, staged
from .ranks import hashed, row_number

#: Tells the windows chosen and the recall measured for them.
_LOG = logging.getLogger(__name__)

#: Blocks grow up to this many times their first size; beyond, more of them are met.
LARGEST = 8


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of ``cells`` (n x d, 0 <= cell < 2**bits, d * bits <= 62) on the Hilbert curve.

    Skilling's transformation ("Programming the Hilbert curve", 2004), for all rows at once.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0.0))])


def _directions(seed: int, dim: int, curves: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Per ordering ``dims`` orthonormal directions in dim + 1 coordinates, and its shift in parts of the range."""
    rng = np.random.default_rng(seed)
    return (
        np.stack([np.linalg.qr(rng.normal(size=(dim + 1, dims)))[0] for _ in range(curves)]),
        rng.uniform(0.0, 1.0, size=(curves, dims)),
    )


def valid(vector: Column) -> Column:
    """Not null, not empty or all zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def true_neighbours(classes: DataFrame, asked: list, dim: int, top: int) -> DataFrame:
    """``q, rep``: the ``top`` rows of largest inner product for each row of ``asked`` (rep, v), by its number, from all rows."""
    reps, x = np.array([r["rep"] for r in asked], np.int64), np.array([r["v"] for r in asked], np.float64).reshape(-1, dim)

    def best(batches):
        ids, scores = np.zeros((len(reps), 0), np.int64), np.zeros((len(reps), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.asarray(batch.column("rep"))
            found = x @ _matrix(batch.column("v"), dim).T
            found[reps[:, None] == own[None, :]] = -np.inf
            ids, scores = np.hstack([ids, np.broadcast_to(own, found.shape)]), np.hstack([scores, found])
            if scores.shape[1] > top:
                at = np.argpartition(-scores, top - 1, axis=1)[:, :top]
                ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
        who = np.broadcast_to(np.arange(len(reps))[:, None], ids.shape)
        fine = scores > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(who[fine].astype(np.int32)), pa.array(ids[fine]), pa.array(scores[fine])], ["q", "rep", "score"])

    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    found = classes.select("rep", "v").mapInArrow(best, "q int, rep long, score double")
    return found.withColumn("_place", F.row_number().over(by_score)).filter(F.col("_place") <= top).select("q", "rep")


def windows_for(classes: DataFrame, ranked: DataFrame, n: int, dim: int, top: int, curves: int, block: int, sample: int, least_recall: float) -> tuple[int, int, float] | None:
    """Block size, blocks on either side, and measured recall of the narrowest windows that reach ``least_recall``, or None for none narrower than the table.

    Reached means that the sample's mean less two standard errors is.
    """
    if n <= 2 * block:
        return block, 1, 1.0  # all blocks are neighbours
    asked = classes.filter("q").orderBy(hashed(F.col("rep"), seed=11), "rep").limit(sample).select("rep", "v").collect()
    if not asked:
        return block, 1, 1.0
    truth = true_neighbours(classes, asked, dim, top).collect()
    # At most sample * (top + 1) rows are looked up, in every ordering.
    wanted = sorted({r["rep"] for r in truth} | {r["rep"] for r in asked})
    looked_up = classes.sparkSession.createDataFrame([(int(i),) for i in wanted], "wanted long")
    place = np.zeros((len(wanted), curves), np.int64)
    for r in ranked.join(F.broadcast(looked_up), F.col("crep") == F.col("wanted")).select("curve", "crep", "place").collect():
        place[np.searchsorted(wanted, r["crep"]), r["curve"]] = r["place"]
    of = np.array([r["q"] for r in truth])
    a = place[np.searchsorted(wanted, [asked[q]["rep"] for q in of])]
    b = place[np.searchsorted(wanted, [r["rep"] for r in truth])]
    size, reach = block, 1
    while (size, reach) == (block, 1) or curves * (2 * reach + 1) * size < n:
        held = (np.abs(a // size - b // size) <= reach).any(1)
        recall = np.bincount(of, held, len(asked)) / np.maximum(np.bincount(of, minlength=len(asked)), 1)
        if recall.mean() - 2 * recall.std() / np.sqrt(len(asked)) >= least_recall:
            _LOG.info("recall %.3f of %d queries against brute force: %d rows, blocks of %d, %d on either side", recall.mean(), len(asked), n, size, reach)
            return size, reach, float(recall.mean())
        size, reach = (2 * size, 1) if size < LARGEST * block else (size, 2 * reach)
    _LOG.info("no windows narrower than the table reach recall %.2f of %d queries: all %d rows are compared", least_recall, len(asked), n)
    return None


def nearest(
    vectors: DataFrame,
    is_query: Column,
    top: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    curves: int = 16,
    dims: int = 8,
    bits: int = 6,
    block: int = 2048,
    seed: int = 1,
    sample: int = 128,
    least_recall: float = 0.9,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` rows of largest inner product found for each query.

    ``is_query`` marks the query rows; every row but the query's own is a
    candidate.  ``curves`` orderings and ``block`` ranks are where the windows
    begin; they widen until a ``sample`` of queries finds ``least_recall`` of
    its true neighbours, at the latest when all rows are compared.  Ties go to the smaller id.  Null ids and vectors that are
    null, empty, zero or hold null or non-finite components take no part;
    nor do vectors of another length than the most frequent one (the longest
    of these at a tie).  Rows of one id are one row: of
    different vectors the smallest in the order of arrays stands for it.  An empty table gives an
    empty result; further columns are not read.
    """
    spark = vectors.sparkSession
    python_path(spark)
    id_type = "long"
    rows = (
        vectors.select(F.col(vec_id).cast(id_type).alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
        .filter(F.col("id").isNotNull() & valid(F.col("v")))
    )
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    result = f"query_id {id_type}, rank int, vec_id {id_type}, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    dim = int(sizes["dim"])
    rows = rows.filter(F.size("v") == dim)
    # Rows of one id are one row.  Only the vectors of such ids are moved for it.
    twice = staged(rows.groupBy(F.col("id").alias("twice")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("twice"))
    met = F.col("id") == F.col("twice")
    several = rows.join(twice, met, "left_semi").groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = rows.join(twice, met, "left_anti").unionByName(several)

    # Equal vectors are one class, named by its smallest id.
    classes = staged(rows.groupBy("v").agg(F.min("id").alias("rep"), F.max("q").alias("q"), F.count_distinct("id").alias("n")))
    n, most = classes.agg(F.count(F.lit(1)), F.max(dot(F.col("v"), F.col("v")))).first()
    # Of a class only the top + 1 smallest ids can be among the top of any query.
    shared = classes.filter("n > 1").select(F.col("v").alias("cv"), F.col("rep").alias("class"))
    own = rows.join(shared, F.col("v") == F.col("cv")).select("class", "id", "q").distinct()
    members = own.select("class", "id").withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("id"))).filter(F.col("place") <= top + 1)
    single = classes.filter("n = 1").select(F.col("rep").alias("class"), F.col("rep").alias("id"))
    members = staged(members.select("class", "id").unionByName(single))
    askers = staged(own.filter("q").select("class", "id").unionByName(classes.filter("n = 1 AND q").select(F.col("rep").alias("class"), F.col("rep").alias("id"))))

    dims = min(dims, dim + 1)
    directions, shifts = _directions(seed, dim, curves, dims)

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        return np.einsum("nd,cdp->cnp", _lifted(_matrix(batch.column("v"), dim), most), directions)

    def spread(batches):
        total = np.zeros((2, curves, dims))
        for batch in batches:
            y = projected(batch)
            total += np.stack([y.sum(1), (y * y).sum(1)])
        flat = total.reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(flat.shape[1]), pa.int32()), pa.array(flat[0]), pa.array(flat[1])], ["at", "s", "ss"])

    # One row per ordering and direction comes to the driver.
    sums = sorted(classes.select("v").mapInArrow(spread, "at int, s double, ss double").groupBy("at").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect())
    mean = np.array([r["s"] / n for r in sums]).reshape(curves, 1, dims)
    scale = np.sqrt(np.maximum(np.array([r["ss"] / n for r in sums]).reshape(curves, 1, dims) - mean**2, 1e-300))

    def keyed(batches):
        for batch in batches:
            # Four standard deviations either way are the grid, moved by up to one more.
            unit = ((projected(batch) - mean) / scale + 4.0 + shifts[:, None, :]) / 9.0
            cells = np.clip((unit * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
            for c in range(curves):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells[c]), c, np.int32)), pa.array(hilbert_keys(cells[c], bits)), batch.column("rep")], ["curve", "key", "rep"]
                )

    keys = classes.select("v", "rep").mapInArrow(keyed, f"curve int, key long, rep {id_type}")
    # Every ordering has n rows, so the rank within it follows from the rank over all.
    ranked = staged(
        row_number(keys, ["curve", "key", "rep"], "at").select("curve", (F.col("at") - F.col("curve").cast("long") * n).alias("place"), F.col("rep").alias("crep"))
    )
    windows = windows_for(classes, ranked, n, dim, top, curves, block, sample, least_recall)
    steps = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    if windows:
        size, reach, _ = windows
        # A block's queries come in shares of those of three blocks, so that no group grows with the reach.
        sides = (2 * reach + 3) // 3
        placed = ranked.join(classes, F.col("crep") == F.col("rep")).select("curve", F.floor(F.col("place") / size).alias("block"), "rep", "v", "q")
        beside = placed.filter("q").withColumn("off", F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))))
        beside = beside.withColumn("block", F.col("block") + F.col("off")).withColumn("side", F.floor((F.col("off") + reach) / 3)).drop("off")
    else:
        # Every query meets every row once.
        blocks, sides = -(-n // (LARGEST * block)), -(-classes.filter("q").count() // (LARGEST * block))
        placed = classes.select(F.lit(0).alias("curve"), F.pmod(hashed(F.col("rep"), seed=12), F.lit(blocks)).alias("block"), "rep", "v", "q")
        beside = placed.filter("q").withColumn("side", F.pmod(hashed(F.col("rep"), seed=13), F.lit(sides))).withColumn("block", steps(blocks))
    placed = placed.withColumn("side", steps(sides))
    dealt = placed.withColumn("asks", F.lit(False)).unionByName(beside.withColumn("asks", F.lit(True))).drop("q")
    keep = top + 12  # some more than asked for: the order among them is made anew in double precision

    def best(group: pa.Table) -> pa.Table:
        asks = np.asarray(group.column("asks"))
        reps, x = np.asarray(group.column("rep")), _matrix(group.column("v"), dim)
        candidates, queries = x[~asks], x[asks]
        ids, who = reps[~asks], reps[asks]
        out_q, out_c = [], []
        for i in range(0, len(queries) if len(candidates) else 0, 256):
            scores = queries[i : i + 256] @ candidates.T
            scores[who[i : i + 256, None] == ids[None, :]] = -np.inf
            k = min(keep, scores.shape[1])
            at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            fine = np.take_along_axis(scores, at, 1) > -np.inf
            out_q.append(np.repeat(who[i : i + 256], k).reshape(-1, k)[fine])
            out_c.append(ids[at][fine])
            # Where more rows tie with the last kept score, up to rounding, those of the smallest ids are kept too.
            last = np.take_along_axis(scores, at, 1).min(1, keepdims=True)
            full = last > -np.inf  # else all candidates are kept
            last = np.where(full, last, 0.0)
            slack = 1e-12 * (1.0 + np.abs(last))
            near = (scores >= last - slack) & (scores <= last + slack) & full
            for q in np.flatnonzero(near.sum(1) > np.take_along_axis(near, at, 1).sum(1)):
                tied = np.sort(ids[near[q]])[:keep]
                out_q.append(np.full(len(tied), who[i + q]))
                out_c.append(tied)
        cat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"qrep": cat(out_q), "crep": cat(out_c)})

    found = dealt.groupBy("curve", "block", "side").applyInArrow(best, "qrep long, crep long").distinct()
    left = classes.select(F.col("rep").alias("qr"), F.col("v").alias("qv"))
    right = classes.select(F.col("rep").alias("cr"), F.col("v").alias("cv"))
    scored = found.join(left, F.col("qrep") == F.col("qr")).join(right, F.col("crep") == F.col("cr")).select("qrep", "crep", dot(F.col("qv"), F.col("cv")).alias("score"))
    per_class = Window.partitionBy("qrep").orderBy(F.desc("score"), "crep")
    hits = scored.withColumn("place", F.row_number().over(per_class)).filter(F.col("place") <= top).select("qrep", "crep", "score")
    # The query's own class: its other members.
    selves = classes.filter("q AND n > 1").select(F.col("rep").alias("qrep"), F.col("rep").alias("crep"), dot(F.col("v"), F.col("v")).alias("score"))
    options = hits.unionByName(selves).join(members, F.col("crep") == F.col("class")).select("qrep", "score", "id")
    of_class = Window.partitionBy("qrep").orderBy(F.desc("score"), "id")
    # For the members of one class the same top + 1 rows serve, less each one's own.
    lists = staged(options.withColumn("place", F.row_number().over(of_class)).filter(F.col("place") <= top + 1))
    answers = askers.select("class", F.col("id").alias("query_id")).join(
        lists.groupBy("qrep").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("all")), F.col("class") == F.col("qrep")
    )
    others = F.slice(F.filter("all", lambda x: x["id"] != F.col("query_id")), 1, top)
    return answers.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score")
    )
