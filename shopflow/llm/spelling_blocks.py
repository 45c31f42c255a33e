"""Spelling variants (12): Gram matrices of letter counts find words one edit apart.

Two words that differ by one inserted or deleted letter have letter counts at
squared distance one, by one replaced letter at two.  With the letter counts
of a block of words as rows, a matrix product gives all squared distances
between two blocks at once; the few pairs at most two apart are verified
letter by letter.

Not every block meets every other.  Letters are put into groups of about
equal frequency, and words of equal length with equal counts per group are a
cell: one edit adds one to one group, or moves one from a group to another, so
a cell meets only the cells so reached, of its own length and of the next.
The number of groups follows the number of words, by which the cells keep
about the same size.  A cell of many words is several blocks, dealt by hash.

Words are counted over all texts, with map-side sums; blocks, links and forms
are Spark joins and aggregates; a task holds two blocks at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, python_path, staged

#: Words are of these letters: A-Z and a-z, and the second half of Latin-1.
RUN = r"[^A-Za-zÀ-ÿ]+"
#: Columns of a letter-count matrix: a-z, then U+00C0 to U+00FF.
_COLUMN = np.full(256, 90, np.int64)
_COLUMN[97:123] = np.arange(26)
_COLUMN[192:256] = 26 + np.arange(64)


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """``word, n``: the distinct words of at least ``least_length`` letters that occur at least ``least_count`` times.

    A run of letters loses the letter at ``h % length`` if ``every`` divides
    ``h``, the CRC-32 of ``<doc_id>:<run>``.  A null id is written as nothing.
    """
    ids = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = docs.select(ids.alias("id"), F.explode(F.split(lower_ascii(F.col(text).cast("string")), RUN)).alias("run"))
    # Only runs that are long enough can give words that are.
    long = runs.withColumn("size", F.length("run")).filter(F.col("size") >= least_length).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.col("size")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("size")))
    spelt = long.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = spelt.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The letters of all words in ``groups`` strings of about equal frequency (at most 90 letters pass through the driver)."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''")
    counts = {r["letter"]: r["n"] for r in letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, load = [""] * groups, [0] * groups
    for letter, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        i = load.index(min(load))
        out[i] += letter
        load[i] += n
    return [g for g in out if g]


def _neighbours(cell: Column, groups: int) -> Column:
    """The cells that one edit of a word of ``cell`` can lead to, each pair of cells from one side only, and the cell itself."""

    def moved(add: int, take: int | None) -> Column:
        return F.array(*[cell[i] + ((i == add) - (i == take)) for i in range(groups)])

    longer = [moved(i, None) for i in range(groups)]
    # Moves between groups are seen from the smaller cell: its first change is an increase.
    same = [F.when(cell[take] > 0, moved(add, take)) for add in range(groups) for take in range(add + 1, groups)]
    return F.filter(F.array(cell, *longer, *same), lambda c: c.isNotNull())


def _letters(block: bytes, length: int) -> np.ndarray:
    return np.frombuffer(block, np.uint8).reshape(-1, length)


def _counts(letters: np.ndarray) -> np.ndarray:
    rows = np.arange(len(letters))[:, None] * 91
    return np.bincount((rows + _COLUMN[letters]).ravel(), minlength=len(letters) * 91).reshape(len(letters), 91)


def near_pairs(a: np.ndarray, b: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks (letters as bytes; ``b`` as long as ``a`` or one longer) that are one edit apart."""
    x, y = _counts(a), _counts(b)
    used = np.flatnonzero(x.any(0) | y.any(0))
    kind = np.float32 if b.shape[1] < 2048 else np.float64  # whole numbers stay exact
    x, y = x[:, used].astype(kind), y[:, used].astype(kind)
    near_a, near_b = np.nonzero((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T) <= 2)
    step = max(1, most // b.shape[1])  # candidates whose letters are compared at once
    found = [_one_edit(a[near_a[i : i + step]], b[near_b[i : i + step]]) for i in range(0, len(near_a), step)]
    keep = np.concatenate(found) if found else np.zeros(0, bool)
    return near_a[keep], near_b[keep]


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows differ by exactly one replaced letter, or one letter that ``b`` has more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    before = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    after = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return before + after >= a.shape[1]


def _best(rows: np.ndarray, others: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``rows`` with the number of links of each and its other with the largest ``n``, the first in order of equal ones."""
    order = np.lexsort((others, -n[others], rows))
    row, first, times = np.unique(rows[order], return_index=True, return_counts=True)
    return row, times, others[order][first]


def _linked(words: DataFrame, block_words: int, words_a_cell: int) -> DataFrame:
    """``word, n_near, best_n, best``: every word that has near words, their number and the one with the largest count."""
    groups = letter_groups(words, max(1, round(math.log(max(words.count(), 1) / words_a_cell, 3))) if words_a_cell else 1)
    if not groups:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.col("n").alias("best_n"), F.col("word").alias("best")).limit(0)
    sizes = [F.length("word") - F.length(F.translate("word", g, "")) for g in groups]
    placed = words.select("word", "n", F.array(*sizes).alias("cell"))
    length = F.aggregate("cell", F.lit(0), lambda x, y: x + y)
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    # Long words make smaller blocks, so that a block's bytes are bounded too.
    cells = staged(cells.withColumn("length", length).withColumn("blocks", F.ceil(F.col("size") * F.greatest(F.lit(1.0), F.col("length") / 32) / block_words).cast("int")))
    dealt = placed.join(cells.select(F.col("cell").alias("of"), "length", "blocks"), F.col("cell") == F.col("of"))
    block = F.pmod(F.xxhash64("word"), F.col("blocks").cast("long")).cast("int")
    blocks = dealt.select("cell", "length", block.alias("block"), F.struct("word", "n").alias("w")).groupBy("cell", "block", "length").agg(F.array_sort(F.collect_list("w")).alias("w"))
    # All letters are Latin-1: a block of words of one length is a matrix of bytes.
    blocks = staged(blocks.select("cell", "block", "length", F.encode(F.array_join("w.word", ""), "ISO-8859-1").alias("letters"), F.col("w.n").alias("n")))

    one, other = cells.select(F.col("cell").alias("cell_a"), F.col("blocks").alias("blocks_a")), cells.select(F.col("cell").alias("cell_b"), F.col("blocks").alias("blocks_b"))
    met = one.withColumn("next", F.explode(_neighbours(F.col("cell_a"), len(groups)))).join(other, F.col("next") == F.col("cell_b")).drop("next")
    met = met.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)))
    # A cell with itself: each pair of its blocks once.
    start = F.when(F.col("cell_a") == F.col("cell_b"), F.col("block_a")).otherwise(F.lit(0))
    pairs = met.select("cell_a", "block_a", "cell_b", F.explode(F.sequence(start, F.col("blocks_b") - 1)).alias("block_b"))

    def side(s: str) -> DataFrame:
        return blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns])

    full = pairs.join(side("a"), ["cell_a", "block_a"]).join(side("b"), ["cell_b", "block_b"])
    full = full.select("length_a", "letters_a", "n_a", "length_b", "letters_b", "n_b", ((F.col("cell_a") == F.col("cell_b")) & (F.col("block_a") == F.col("block_b"))).alias("same"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            n_a, n_b = batch.column(2), batch.column(5)
            rows = zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4, 6)], strict=True)
            for i, (size_a, text_a, size_b, text_b, same) in enumerate(rows):
                a, b = near_pairs(_letters(text_a, size_a), _letters(text_b, size_b))
                if not len(a):
                    continue
                words_a, words_b = text_a.decode("latin-1"), text_b.decode("latin-1")
                count_a, count_b = np.asarray(n_a[i].values), np.asarray(n_b[i].values)
                turns = [(a, b, words_a, size_a, words_b, size_b, count_b)]
                if not same:  # the block with itself gives both directions at once
                    turns.append((b, a, words_b, size_b, words_a, size_a, count_a))
                for x, y, own, m, others, k, n in turns:
                    row, times, best = _best(x, y, n)
                    out[0].extend(own[j * m : (j + 1) * m] for j in row.tolist())
                    out[1].extend(times.tolist())
                    out[2].extend(n[best].tolist())
                    out[3].extend(others[j * k : (j + 1) * k] for j in best.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["word", "n_near", "best_n", "best"])

    found = full.mapInArrow(links, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best"))).alias("top")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select("word", "n_near", (-F.col("top.order")).alias("best_n"), F.col("top.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: the end of the chain of forms.

    Every step's count is at least twice the last one's, so chains are
    shorter than 64 and a few doublings reach every end.
    """
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("from"), F.col("root").alias("to"))
        now = staged(now.join(ahead, F.col("root") == F.col("from"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_forms(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 5, least_count: int = 3, every: int = 97, ratio: int = 2, block_words: int = 512, words_a_cell: int = 1500
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``docs`` (see :func:`word_counts`).

    Words one inserted, deleted or replaced letter apart are near.  A word's
    ``form`` is its near word with the largest count, the first in code-point
    order of equal ones, if that is at least ``ratio`` times its own; ``root``
    is where following forms ends, the word itself if it has none.

    Null texts have no words; a null id is written as nothing; repeated rows
    count each for themselves; an empty table gives an empty result; further
    columns are not read.  Very long runs of letters are words like others.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or chains of forms need not end")
    python_path(docs.sparkSession)
    words = staged(word_counts(docs, text, doc_id, least_length, least_count, every))
    linked = _linked(words, block_words, words_a_cell)
    known = words.join(linked.withColumnRenamed("word", "near"), F.col("word") == F.col("near"), "left")
    named = F.col("best_n") >= ratio * F.col("n")
    known = staged(known.select("word", F.when(named, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(named, F.col("best_n")).alias("form_n")))
    roots = _roots(known.filter("form is not null").select("word", "form"))
    out = known.join(roots.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
