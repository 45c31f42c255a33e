"""Substring dedup (4): paragraphs linked by MinHash bands, checked exactly, clustered by components.

A paragraph here is a sentence of a line: a line is cut at sentence ends, so
that a passage pasted into the middle of another line still has paragraphs
of its own.  Paragraphs are compared as sets of five-word shingles.

Sentences of fewer than five words (lists, verse, code) are joined with those
after them, and with those before them, until they have five: these passages
overlap, so that a copy is met wherever it begins, and are compared by equal
words only.  A text that is shorter as a whole is one passage.  A sign of a
script without blanks is a word.

1. Every paragraph becomes a 64-bit number of its lower-case words; equal
   ones are one node from here on, however many there are.
2. Each node has ``bands`` keys of ``rows`` MinHashes.  With 6 x 2 a pair of
   similarity 0.8 meets with probability 0.998, one of 0.3 with 0.43.
3. Nodes with a common key are compared: each with the following ones of its
   bucket, where a bucket holds at most ``bucket`` nodes.  Larger buckets come
   from what many paragraphs share, such as an opening, and most of their
   nodes are not similar.  Two sets of similarity 0.8 share one of the rarest
   fifth of their shingles, so the nodes of large buckets meet again by each
   of these: a common opening then brings nothing together.  Groups that are
   large even so hold copies with small changes: they are compared block
   against block, which gives the links that join a block's nodes, not all
   pairs.  The exact Jaccard similarity decides.
4. Components of the links are the classes; the first paragraph of a class,
   by doc_id and position, stays and the later ones are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import python_path, staged
from .graph import components
from .ranks import hashed

SHINGLE = 5
#: Numbers of nodes or documents that are broadcast: up to 60 bytes each as measured, 30 MB.
BROADCAST_ROWS = 500_000
_SPACES: list[np.ndarray] = []
#: Scripts without blanks between words: Thai, Lao, Burmese, Khmer, kana, Han (first and last code point).
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _is_space(code: np.ndarray) -> np.ndarray:
    if not _SPACES:
        _SPACES.append(np.array([chr(c).isspace() for c in range(0x110000)]))
    return _SPACES[0][code]


def _is_unspaced(code: np.ndarray) -> np.ndarray:
    out = np.zeros(len(code), bool)
    for low, high in _UNSPACED if len(code) and code.max() >= _UNSPACED[0][0] else ():
        out |= (code >= low) & (code <= high)
    return out


def _lower(text: str) -> str:
    """Lower case, character by character where that would change the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _nodes(h: np.ndarray, inside: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The number of each run of words, from the words' hashes and their places in it."""
    mixed = _scrambled(h + inside.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return _scrambled(np.add.reduceat(mixed, begins) if len(begins) else np.zeros(0, np.uint64)).view(np.int64)


class Paragraphs:
    """The paragraphs of some texts: owner, place, span, node and shingles.

    A paragraph ends after . ! or ? before white space, after their wide
    forms, and at a line's end.
    All texts are cut into paragraphs and words, and these hashed, at once.
    """

    def __init__(self, texts: list[str], least: int = SHINGLE):
        sizes = np.array([len(t) for t in texts], np.int64) + 1
        begins = np.cumsum(sizes) - sizes
        code = np.frombuffer(_lower("\n".join([*texts, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
        space = _is_space(code)
        mark = (code == 46) | (code == 33) | (code == 63)
        line = np.flatnonzero(code == 10)
        wide = (code == 0x3002) | (code == 0xFF01) | (code == 0xFF1F)
        ends = np.unique(np.concatenate([np.flatnonzero((mark[:-1] & space[1:]) | (wide[:-1] & (code[1:] != 10))) + 1, line]))
        starts = np.concatenate([[0], ends[:-1] + (code[ends[:-1]] == 10)])[: len(ends)]
        solid = np.flatnonzero(~space)
        alone = _is_unspaced(code[solid])
        begun = np.diff(solid, prepend=-2) > 1
        begun[1:] |= alone[1:] | alone[:-1]
        if wide.any():
            cut = np.zeros(len(code), bool)
            cut[ends] = True
            begun |= cut[solid]
        first = np.flatnonzero(begun)  # of each word, among the solid ones
        of = np.searchsorted(ends, solid[first], side="right")
        counts = np.bincount(of, minlength=len(ends))
        kept = counts >= least
        letters = code[solid].astype(np.uint64)
        letters *= np.uint64(0xD6E8FEB86659FD93)
        lengths = np.diff(np.append(first, len(solid)))
        letters += (solid - np.repeat(solid[first], lengths)).astype(np.uint64) * np.uint64(0x27D4EB2F165667C5)
        h = _scrambled(np.add.reduceat(_scrambled(letters), first)) if len(first) else np.zeros(0, np.uint64)
        owner = np.searchsorted(begins, starts, side="right") - 1
        full = np.flatnonzero(counts)
        number = np.cumsum(counts > 0) - 1
        self._all = h, counts[full], owner[full], starts[full] - begins[owner[full]], ends[full] - begins[owner[full]]
        h = h[kept[of]]

        self.start, self.end = starts[kept], ends[kept]
        self.owner = np.searchsorted(begins, self.start, side="right") - 1
        self.start, self.end = self.start - begins[self.owner], self.end - begins[self.owner]
        self.place = number[kept] - np.searchsorted(owner[full], self.owner, side="left")
        size = counts[kept]
        at_word = np.cumsum(size) - size
        inside = np.arange(len(h)) - np.repeat(at_word, size)
        self.node = _nodes(h, inside, at_word)
        at = np.flatnonzero(np.repeat(size, size) - inside >= SHINGLE)
        s = np.zeros(len(at), np.uint64)
        for j in range(SHINGLE):
            s = _scrambled(s * np.uint64(0x165667B19E3779F9) + h[at + j])
        self.shingles = s
        self.counts = size - (SHINGLE - 1)
        self.begin = np.cumsum(self.counts) - self.counts

    def passages(self, least: int) -> tuple[np.ndarray, ...]:
        """owner, place, start, end, node of the passages that short sentences are joined to."""
        h, counts, owner, start, end = self._all
        m = len(counts)
        words = np.concatenate([[0], np.cumsum(counts)])
        low, high = np.searchsorted(owner, owner, side="left"), np.searchsorted(owner, owner, side="right")  # the text's sentences
        i = np.flatnonzero(counts < least)
        after = np.searchsorted(words, words[i] + least, side="left")
        before = np.searchsorted(words, words[i + 1] - least, side="right") - 1
        ahead, back = after <= high[i], before >= low[i]
        small = np.flatnonzero((low == np.arange(m)) & (words[high] - words[low] < least))
        begin = np.concatenate([i[ahead], before[back], small])
        until = np.concatenate([after[ahead], i[back] + 1, high[small]])
        begin, until = np.unique(np.stack([begin, until]), axis=1) if len(begin) else (begin, until)
        size = words[until] - words[begin]
        at_word = np.cumsum(size) - size
        inside = np.arange(size.sum()) - np.repeat(at_word, size)
        node = _nodes(h[np.repeat(words[begin], size) + inside], inside, at_word)
        return owner[begin], begin - low[begin], start[begin], end[until - 1], node

    def __len__(self) -> int:
        return len(self.owner)

    def band_keys(self, bands: int, rows: int) -> np.ndarray:
        """paragraphs x bands: a key per band, of ``rows`` MinHashes and the band's number."""
        out = np.zeros((len(self), bands), np.uint64)
        for b in range(bands if len(self) else 0):
            key = np.full(len(self), b + 1, np.uint64)
            for r in range(rows):
                salt = np.uint64((b * rows + r + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
                key = _scrambled(key * np.uint64(0x27D4EB2F165667C5) + np.minimum.reduceat(_scrambled(self.shingles ^ salt), self.begin))
            out[:, b] = key
        return out.view(np.int64)


def _groups(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def occurrences(docs: DataFrame, text: str, doc_id: str, least: int = SHINGLE) -> DataFrame:
    """``doc, place, start, end, node``: every paragraph of at least ``least`` words and every passage, its span in code points."""

    def found(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in _groups(texts):
                p = Paragraphs(texts[i:j], least)
                for owner, place, start, end, node in ((p.owner, p.place, p.start, p.end, p.node), p.passages(least)):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner + i)), *[pa.array(x.astype(np.int32)) for x in (place, start, end)], pa.array(node)],
                        ["doc", "place", "start", "end", "node"],
                    )

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(found, "doc long, place int, start int, end int, node long")


def band_rows(docs: DataFrame, text: str, bands: int, rows: int, least: int = SHINGLE) -> DataFrame:
    """``key, node``: the band keys of the distinct paragraphs of each batch."""

    def found(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for i, j in _groups(texts):
                p = Paragraphs(texts[i:j], least)
                node, at = np.unique(p.node, return_index=True)
                keys = p.band_keys(bands, rows)[at]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(node, bands))], ["key", "node"])

    return docs.select(F.col(text).alias("text")).mapInArrow(found, "key long, node long")


def node_table(every: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, n, first, asked`` of the nodes that occur more than once or are in ``wanted`` (column ``node``).

    ``n`` counts the occurrences, ``first`` (doc, place, end) is the first of
    them, ``asked`` says that ``wanted`` has the node.  What comes later joins
    these rows, not one per occurrence: most paragraphs occur once and are
    like no other.
    """
    each = every.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place", "end")).alias("first"))
    asked = wanted.select(F.col("node").alias("of"))
    return each.join(asked, F.col("node") == F.col("of"), "left").select("node", "n", "first", F.col("of").isNotNull().alias("asked")).filter("n > 1 or asked")


def shingle_sets(docs: DataFrame, text: str, doc_id: str, nodes: DataFrame, least: int = SHINGLE) -> DataFrame:
    """``node, shingles`` of the nodes that are ``asked`` for (see :func:`node_table`).

    Only the first document of each node is cut again, as long as their ids
    can be broadcast; beyond that, all are.
    """

    def found(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for i, j in _groups(texts):
                p = Paragraphs(texts[i:j], least)
                node, at = np.unique(p.node, return_index=True)
                sets = [np.unique(p.shingles[p.begin[k] : p.begin[k] + p.counts[k]]).view(np.int64) for k in at]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node), lists], ["node", "shingles"])

    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc"))
    wanted = nodes.filter("asked").select("node")
    holders = staged(nodes.filter("asked").select("first.doc").distinct())
    if holders.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(holders.withColumnRenamed("doc", "of")), F.col("doc").eqNullSafe(F.col("of")), "left_semi")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    cut = rows.select("text").mapInArrow(found, "node long, shingles array<long>")
    return cut.join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("shingles").alias("shingles"))


def _rare_shingles(sets: DataFrame, least_similarity: float) -> DataFrame:
    """``key, node``: for each node its rarest shingles, one of which it shares with every node as similar as that.

    Of ``n`` shingles two such nodes share ``least_similarity * n`` at least,
    so that leaving out one fewer than that many leaves one in common; which
    ones are left out is the same for all nodes if they go by rarity.  Those
    that no other node has bring nothing together.
    """
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    times = each.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("times"))
    ranked = each.join(times, F.col("key") == F.col("of")).withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("times", "key")))
    shared = F.ceil(F.lit(least_similarity) * F.col("n") - F.lit(1e-9))
    return ranked.filter((F.col("rank") <= F.col("n") - shared + 1) & (F.col("times") > 1)).select("key", "node")


def _met(rows: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """From ``key, node``: the pairs ``a, b`` of keys with at most ``bucket`` nodes, and ``key, node, n`` of the others."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One shuffle serves the distinct rows and the windows of a bucket.
    dealt = rows.repartition(n, "key").dropDuplicates(["key", "node"])
    ordered = Window.partitionBy("key").orderBy("node")
    counted = dealt.withColumn("n", F.count(F.lit(1)).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn(
        "next", F.collect_list("node").over(ordered.rowsBetween(1, bucket - 1))
    )
    met = staged(counted.filter("n > 1").select("key", "node", "n", F.when(F.col("n") <= bucket, F.col("next")).alias("next")))
    return met.filter(f"n <= {bucket}").select(F.col("node").alias("a"), F.explode("next").alias("b")), met.filter(f"n > {bucket}").select("key", "node", "n")


def _similar(a, b, least: float):
    common = F.size(F.array_intersect(a, b))
    return common >= F.lit(least) * (F.size(a) + F.size(b) - common)


def links(
    docs: DataFrame, every: DataFrame, text: str, doc_id: str, least_similarity: float = 0.8, bands: int = 6, rows: int = 2, bucket: int = 32, block: int = 512, least: int = SHINGLE
) -> tuple[DataFrame, DataFrame]:
    """``a, b``: nodes of similar paragraphs; ``every`` are the occurrences in ``docs``.  Beside them, the :func:`node_table` that has all these nodes."""
    pairs, large = _met(band_rows(docs, text, bands, rows, least), bucket)
    pairs = staged(pairs.distinct())
    crowd = staged(large.select("node").distinct())
    wanted = staged(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowd).distinct())
    nodes = staged(node_table(every, wanted))
    sets = staged(shingle_sets(docs, text, doc_id, nodes, least))
    more, large = _met(_rare_shingles(sets.join(crowd, "node", "left_semi"), least_similarity), bucket)
    pairs = pairs.unionByName(more).distinct()
    left, right = (sets.select(F.col("node").alias(f"n{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")
    close = pairs.join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb")).filter(_similar(F.col("sa"), F.col("sb"), least_similarity)).select("a", "b")

    # Groups of more nodes: block against block, each block of about ``block`` nodes.
    blocks = F.ceil(F.col("n") / block)
    placed = large.withColumn("blocks", blocks).withColumn("i", F.pmod(hashed(F.col("node"), seed=4), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    dealt_blocks = placed.withColumn("pair", F.explode(others)).select("key", "pair.lo", "pair.hi", "i", "node").join(sets, "node")

    def joined(group: pa.Table) -> pa.Table:
        """A forest of links between similar nodes: enough for the same components."""
        nodes = np.asarray(group.column("node"))
        sets_of = [frozenset(x) for x in group.column("shingles").to_pylist()]
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x in range(len(nodes)):
            for y in range(x):
                if root(x) != root(y) and (c := len(sets_of[x] & sets_of[y])) >= least_similarity * (len(sets_of[x]) + len(sets_of[y]) - c):
                    parent[root(x)] = root(y)
                    out.append((nodes[x], nodes[y]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    far = dealt_blocks.groupBy("key", "lo", "hi").applyInArrow(joined, "a long, b long")
    return close.unionByName(far), nodes


def later_paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = SHINGLE, **options) -> DataFrame:
    """``doc, place, start, end, first_doc, first_place``: the paragraphs that repeat an earlier one."""
    python_path(docs.sparkSession)
    every = staged(occurrences(docs, text, doc_id, least))
    linked, nodes = links(docs, every, text, doc_id, least=least, **options)
    roots = staged(components(linked).withColumnRenamed("node", "of"))
    classed = staged(nodes.join(roots, F.col("node") == F.col("of"), "left").select("node", "n", "first", F.coalesce("root", "node").alias("class")))
    firsts = classed.groupBy("class").agg(F.sum("n").alias("all"), F.min("first").alias("first")).filter("all > 1").select(F.col("class").alias("c"), "first")
    repeated = staged(classed.select(F.col("node").alias("of"), "class").join(firsts, F.col("class") == F.col("c")).select("of", "first"))
    later = every.join(repeated, F.col("node") == F.col("of")).filter(~F.struct("doc", "place").eqNullSafe(F.struct("first.doc", "first.place")))
    # A passage that overlaps the first one keeps what both have.
    begin = F.when(F.col("doc").eqNullSafe(F.col("first.doc")), F.greatest("start", "first.end")).otherwise(F.col("start"))
    later = later.withColumn("start", begin).filter(F.col("start") < F.col("end"))
    return later.select("doc", "place", "start", "end", F.col("first.doc").alias("first_doc"), F.col("first.place").alias("first_place"))


def paragraph_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``doc_id, spans, first_docs`` per row of ``docs``: removed spans in code points, and the documents that keep a copy.

    Spans that overlap are one span.  Sentences of fewer than five words go
    with the passages they are joined to; null and empty texts have none.  The first paragraph of a class, by doc_id (null first)
    and place, stays.  Rows that share a doc_id count as one document, and
    those equal in place too are one paragraph; an empty table gives an empty
    result; further columns are not read.
    """
    later = later_paragraphs(docs, text, doc_id, **options)
    ordered = Window.partitionBy("doc").orderBy("start", "end")
    reached = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = later.withColumn("apart", F.coalesce((F.col("start") >= reached).cast("int"), F.lit(1)))
    merged = apart.withColumn("island", F.sum("apart").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc", "island").agg(
        F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("span"), F.collect_set("first_doc").alias("firsts")
    )
    lists = merged.groupBy(F.col("doc").alias("_doc")).agg(
        F.sort_array(F.collect_list("span")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("first_docs")
    )
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    none = "cast(array() as array<struct<start:int,end:int>>)", "cast(array() as array<bigint>)"
    return ids.join(lists, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select(
        "doc_id", F.coalesce("spans", F.expr(none[0])).alias("spans"), F.coalesce("first_docs", F.expr(none[1])).alias("first_docs")
    )
