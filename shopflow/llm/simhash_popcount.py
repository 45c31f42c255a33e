"""SimHash near-dedup (6): fingerprints linked through their segment popcounts.

A 64-bit fingerprint is embedded as the number of set bits in each of its 32
two-bit segments.  The Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints, so a range join of the embeddings finds
every link, and the exact distance is checked after it.

The grid: a distance of at most 3 over both halves of the embedding leaves
one half with a distance of at most 1.  A grid cell is one half's 16 counts;
each fingerprint looks into its own cell and into the 16 cells that have one
count more.  The counts are held in unary (00, 01, 11), so that a half is a
32-bit cell number and Manhattan distance is a bit count.

Equal fingerprints meet as one row before the join, however many documents
share them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, lower_ascii, python_path, staged, words
from .graph import components

_LOW = 0x5555555555555555
_HALF = 0xFFFFFFFF


def majority_bits(hashes: np.ndarray) -> int:
    """The signed 64-bit word whose bits are those set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)], dtype="<i8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def shingle_hashes(w: Column, n: int) -> Column:
    """XXH64 (seed 42) of every ``n`` of the words ``w``, repeats included; fewer words make one shingle.

    ``w`` is a column of the frame: an expression would be evaluated again for every shingle.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1)))
    return F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i, n))))
    )


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` (longs): null, empty and blank texts have fingerprint 0."""
    python_path(docs.sparkSession)

    @F.pandas_udf("long")
    def majority(lists: pd.Series) -> pd.Series:
        return pd.Series([majority_bits(np.asarray(x)) for x in lists], dtype="int64")

    split = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), words(lower_ascii(F.col(text))).alias("w"))
    return split.select("doc_id", "text_hash", majority(shingle_hashes(F.col("w"), shingle)).alias("fp"))


def unary_counts(fp: Column) -> Column:
    """The embedding: each two-bit segment with its set bits moved to the low end."""
    upper = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(upper).bitwiseAND(F.lit(_LOW))
    both = fp.bitwiseAND(upper).bitwiseAND(F.lit(_LOW))
    return either.bitwiseOR(F.shiftleft(both, 1))


def manhattan(a: Column, b: Column) -> Column:
    """The Manhattan distance of two embeddings."""
    return F.bit_count(a.bitwiseXOR(b))


def _cells(fps: DataFrame, raised: bool) -> DataFrame:
    """``fp, counts, half, cell``: the two own cells, or the cells with one count more."""
    both = F.array(
        F.struct(F.lit(0).alias("half"), F.col("counts").bitwiseAND(F.lit(_HALF)).alias("cell")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("counts", 32).alias("cell")),
    )
    own = fps.select("fp", "counts", F.explode(both).alias("c")).select("fp", "counts", "c.half", "c.cell")
    if not raised:
        return own
    # 00 -> 01 sets a segment's low bit, 01 -> 11 its high bit, 11 stays out.
    more = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(30), F.lit(2)),
            lambda i: F.expr("cell").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i + F.call_function("shiftright", F.col("cell"), i).bitwiseAND(F.lit(1)).cast("int"))),
        ),
        lambda x: x != F.col("cell"),
    )
    return own.select("fp", "counts", "half", F.explode(F.concat(F.array("cell"), more)).alias("cell"))


def links(fps: DataFrame, most_bits: int = 3) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints with at most ``most_bits`` (up to 3) differing bits."""
    if not 0 <= most_bits <= 3:
        raise ValueError("the grid holds for at most 3 differing bits")
    embedded = fps.select("fp").distinct().withColumn("counts", unary_counts(F.col("fp")))
    left = _cells(embedded, raised=True)
    right = _cells(embedded, raised=False).select(F.col("fp").alias("fp2"), F.col("counts").alias("counts2"), F.col("half").alias("half2"), F.col("cell").alias("cell2"))
    near = (F.col("half") == F.col("half2")) & (F.col("cell") == F.col("cell2")) & (F.col("fp") != F.col("fp2"))
    within = manhattan(F.col("counts"), F.col("counts2")) <= most_bits
    exact = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= most_bits
    pairs = left.join(right, near & within & exact)
    return pairs.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct()


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, most_bits: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` per row: the smallest doc_id reachable over links.

    ``root`` names the group by its smallest fingerprint.

    Null and blank texts share fingerprint 0 and are linked like any other;
    repeated rows are in one group; an empty table gives an empty result;
    further columns are not read.
    """
    marked = staged(fingerprints(docs, text, doc_id, shingle))
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct, most_bits))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = staged(rooted.join(smallest, "root").select(F.col("fp").alias("_fp"), "root", "component_id"))
    # Both sides are plain scans, so Spark can split a fingerprint that very many documents share.
    return marked.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest doc_id, null last.

    Among rows of equal id the text's hash decides; rows equal in both are
    one document and stay once.
    """
    groups = near_groups(docs.select(text, doc_id), text, doc_id, **options)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kept = staged(groups.groupBy("root").agg(F.min(place).alias("kept")).select("kept.doc_id", "kept.text_hash").withColumnsRenamed({"doc_id": "_kept_id", "text_hash": "_kept_hash"}))
    docs, back = aside(docs, text, doc_id)
    keyed = docs.withColumn("_hash", F.xxhash64(F.col(text)))
    same = (F.col("_hash") == F.col("_kept_hash")) & F.col(doc_id).cast("long").eqNullSafe(F.col("_kept_id"))
    return back(keyed.join(kept, same, "left_semi").dropDuplicates([doc_id, "_hash"]))


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
