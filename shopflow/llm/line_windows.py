"""Line dedup (10): windows of three consecutive lines that occur before are removed.

Every window of three consecutive non-blank lines is hashed; windows are
counted over all documents with map-side combining, which leaves the first
place of each repeated one.  The windows that meet it in a join are later
occurrences; the positions they cover are merged per document, and the
document is put together again without them.

Only DataFrame functions; one line, window or document may be as common as it
likes: counts are combined before the shuffle and the join's sides are plain
scans, whose large keys Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, staged

#: White space around a line that makes no difference (the line break itself never occurs in one).
_BLANK = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(doc_id: Column, text: Column) -> list[Column]:
    """What makes a document: its id and its text (repeated rows are one document)."""
    return [doc_id.alias("_id"), F.xxhash64(text).alias("_text")]


def line_windows(docs: DataFrame, text: str, doc_id: str, window: int = 3) -> DataFrame:
    """``_id, _text, k, h1, h2``: each window of non-blank lines, from line ``k`` of these, as a 128-bit hash."""
    lines = docs.select(*_key(F.col(doc_id), F.col(text)), F.filter(F.transform(_lines(F.col(text)), lambda x: F.btrim(x, F.lit(_BLANK))), lambda x: x != "").alias("l"))
    hashes = lines.select("_id", "_text", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("p"), F.xxhash64(F.lit(1), x).alias("q"))).alias("h"))
    starts = F.sequence(F.lit(0), F.size("h") - window)
    of = lambda i, half: [F.element_at("h", i + 1 + j)[half] for j in range(window)]
    windows = F.transform(starts, lambda i: F.struct(i.alias("k"), F.xxhash64(*of(i, "p")).alias("h1"), F.xxhash64(F.lit(1), *of(i, "q")).alias("h2")))
    return hashes.filter(F.size("h") >= window).dropDuplicates(["_id", "_text"]).select("_id", "_text", F.explode(windows).alias("w")).select("_id", "_text", "w.*")


def later_lines(docs: DataFrame, text: str, doc_id: str, window: int = 3) -> DataFrame:
    """``_id, _text, removed``: per document with removed lines, their numbers among its non-blank lines."""
    windows = staged(line_windows(docs, text, doc_id, window))
    place = F.struct("_id", "_text", "k")
    firsts = staged(
        windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
        .select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    )
    later = windows.join(firsts, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter(~place.eqNullSafe(F.col("first")))
    same = F.struct("_id", "_text").eqNullSafe(F.struct(F.col("first._id").alias("_id"), F.col("first._text").alias("_text")))
    # What the first occurrence itself holds stays, also where a later one overlaps it.
    start = F.when(same, F.greatest(F.col("k"), F.col("first.k") + window)).otherwise(F.col("k"))
    covered = later.select("_id", "_text", F.explode(F.sequence(start, F.col("k") + (window - 1))).alias("line"))
    return covered.groupBy("_id", "_text").agg(F.collect_set("line").alias("removed"))


def drop_later_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 3) -> DataFrame:
    """``docs`` with the text's later occurrences removed, and ``n_lines, n_removed`` (non-blank lines).

    The first occurrence, by doc_id (null first) and then by position, stays.
    Texts of fewer than ``window`` non-blank lines stay as they are, also
    null and empty ones (a null text stays null); blank lines are in no
    window and stay.  Rows equal in id and text are one document and get the
    same result; an empty table gives an empty result.
    """
    removed = later_lines(docs, text, doc_id, window).withColumnsRenamed({"_id": "_rid", "_text": "_rtext"})
    docs, back = aside(docs, text, doc_id)
    keyed = docs.withColumns({"_id": F.col(doc_id), "_text": F.xxhash64(F.col(text))})
    joined = keyed.join(removed, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_text") == F.col("_rtext")), "left")
    lines = _lines(F.col(text))
    full = joined.withColumn("_l", lines).withColumn(
        "_at", F.filter(F.transform("_l", lambda x, i: F.when(F.btrim(x, F.lit(_BLANK)) != "", i)), lambda i: i.isNotNull())
    )
    gone = F.transform("removed", lambda j: F.element_at("_at", j + 1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), gone)
    out = full.withColumn(
        text, F.when(F.col("removed").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("_l", i + 1)), "\n"))
    ).withColumns({
        "n_lines": F.size("_at").cast("long"), "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("long"),
    })
    return back(out, "n_lines", "n_removed")
