"""Suffix-array dedup (7): longest previous factors remove later copies of byte strings.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  Whether it does is read off the suffixes in
their order: going from a suffix to the nearest ones before and after it that
belong to a smaller document, the common prefix that is left on the way is
its longest previous factor, and the string repeats if that is at least
``length``.

Only suffixes that can match are ordered together.  The smallest hash of all
16-byte strings within ``length`` bytes is the same in every copy, so such
anchors meet in Spark by their hash:

1. Documents are packed into blocks, compressed, with the places of their
   anchors, in a table bucketed by block, which each later step reads by
   bucket instead of shuffling texts.
2. Each block sends its distinct anchors once; a window over each hash tells
   the blocks which of theirs occur in more than one document.
3. Of those anchors' contexts, all the strings they stand for, a block sends
   a hash.  Where all contexts of an anchor are the same text, that text's
   smallest document is all there is to know.
4. The others go to the task of their anchor as text, once per block.  There
   the suffixes are ordered and the previous factors found.  An anchor with
   very many occurrences sends each of its strings by the string's own hash
   instead, so what meets in a task is one row per block, however common a
   passage is.
5. The answers come back by block, and the documents are put together.

Memory is bounded by a block and by a run of contexts with one hash.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import python_path, shared_path, staged

SEED_BYTES = 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 17
#: Low bits of a packed minimum: the position in a chunk.
_PLACE = np.uint64((1 << 18) - 1)
_SMALLEST = np.iinfo(np.int64).min


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as a number."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view("<u8").reshape(-1)


def _words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))[at]).view("<u8").reshape(-1)


def _seeds(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of sixteen bytes given as two words."""
    x = first * _A
    x ^= second * _B
    x ^= x >> np.uint64(32)
    x *= _B
    return x


class Block:
    """Some documents' bytes, one after another, with their anchors.

    For anchor i: ``key[i]``, and the strings of ``length`` bytes that it
    stands for start at ``low[i]`` to ``high[i]``, in document ``doc[i]``.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, length: int, anchors: bytes | None = None):
        self.ids, self.sizes, self.data, self.length = ids, sizes, data, length
        self.ends = np.cumsum(sizes)
        n, width = len(data) - length + 1, length - SEED_BYTES + 1
        none = np.zeros(0, np.int64)
        self.low = self.high = self.first = self.doc = none
        self.key = np.zeros(0, np.uint64)
        if n <= 0:
            return
        if anchors is not None:
            self._place(*self._unpacked(anchors))
            return
        at = np.empty(n, np.int32)
        for i in range(0, n, _CHUNK):  # pieces that a core's cache holds
            part = data[i : i + _CHUNK + length - 1]
            at[i : i + _CHUNK] = self._smallest(part, width)
            at[i : i + _CHUNK] += i
        inside = np.zeros(n, bool)
        for end, size in zip(self.ends, sizes, strict=True):
            if size >= length:
                inside[end - size : end - length + 1] = True
        p = np.flatnonzero(inside)
        if not len(p):
            return
        a = at[p]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
        self._place(p[new], p[np.append(new[1:], len(p)) - 1], a[new].astype(np.int64))

    def _place(self, low: np.ndarray, high: np.ndarray, first: np.ndarray) -> None:
        self.low, self.high, self.first = low, high, first
        if not len(low):
            return
        self.key = _seeds(_words_at(self.data, first), _words_at(self.data, first + 8))
        self.doc = np.searchsorted(self.ends, self.low, side="right")

    def packed(self) -> bytes:
        """The anchors' places, as distances that are mostly zero or small."""
        if not len(self.low):
            return b""
        skipped = self.low - np.concatenate([[0], self.high[:-1] + 1])
        parts = [skipped.astype("<u4"), (self.high - self.low).astype(np.uint8), (self.first - self.low).astype(np.uint8)]
        return b"".join(p.tobytes() for p in parts)

    @staticmethod
    def _unpacked(anchors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(anchors) // 6
        skipped = np.frombuffer(anchors, "<u4", n).astype(np.int64)
        wide, inner = np.frombuffer(anchors, np.uint8, n, 4 * n).astype(np.int64), np.frombuffer(anchors, np.uint8, n, 5 * n).astype(np.int64)
        high = np.cumsum(skipped + wide + 1) - 1
        return high - wide, high, high - wide + inner

    @staticmethod
    def _smallest(data: np.ndarray, width: int) -> np.ndarray:
        """For each string the place of its seed with the smallest hash, the first of equal ones."""
        w = _words(data)
        least = _seeds(w[:-8], w[8:])
        other = np.empty_like(least)
        least &= ~_PLACE
        least |= np.arange(len(least), dtype=np.uint64)
        span, left = 1, len(least)
        while span < width:  # two buffers in turn
            step = min(span, width - span)
            left -= step
            np.minimum(least[:left], least[step : step + left], out=other[:left])
            least, other = other, least
            span += step
        return (least[:left] & _PLACE).astype(np.int32)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, each anchor's place among them, and per key its documents (2 for more) and occurrences."""
        keys, place, times = np.unique(self.key, return_inverse=True, return_counts=True)
        place = place.reshape(-1)
        lowest = np.full(len(keys), np.iinfo(np.int64).max)
        highest = np.full(len(keys), _SMALLEST)
        ids = self.ids[self.doc]
        np.minimum.at(lowest, place, ids)
        np.maximum.at(highest, place, ids)
        return keys, place, 1 + (lowest < highest), times

    def contexts(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The contexts of the repeated keys (their places times two, plus one for heavy ones).

        Per occurrence its start, its number of strings, its document and the
        distinct context it shows; per distinct context an occurrence of it,
        the hash by which it meets others, and the hash of its text.
        """
        keys, place, _, _ = self.distinct()
        state = np.zeros(len(keys), np.int8)
        state[repeated >> 1] = 1 + (repeated & 1)
        light, heavy = np.flatnonzero(state[place] == 1), np.flatnonzero(state[place] == 2)
        counts = self.high[heavy] - self.low[heavy] + 1
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.concatenate([self.low[light], np.repeat(self.low[heavy], counts) + inner])
        strings = np.concatenate([self.high[light] - self.low[light] + 1, np.ones(len(inner), np.int64)])
        doc = np.concatenate([self.doc[light], np.repeat(self.doc[heavy], counts)])
        key, shown = self._hashes(start, strings + (self.length - 1))
        key[: len(light)] = self.key[light]  # heavy ones meet by their string's own hash
        order = np.lexsort((shown, key))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (shown[order][1:] != shown[order][:-1])]) if len(order) else np.zeros(0, bool)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        return start, strings, doc, which, first, key[first], shown[first]

    def _hashes(self, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the bytes at ``start``, of ``sizes`` (at least eight) bytes each."""
        one, two = sizes.astype(np.uint64) * _A, sizes.astype(np.uint64) * _B
        for j in range(0, int(sizes.max(initial=0)), 8):  # the last word may overlap the one before
            on = np.flatnonzero(sizes > j)  # contexts that reach so far
            word = _words_at(self.data, start[on] + np.minimum(j, sizes[on] - 8))
            one[on], two[on] = _mixed(one[on] ^ word), _mixed((two[on] + word) * _B)
        return one, two

    def texts(self, start: np.ndarray, strings: np.ndarray) -> list[bytes]:
        """The contexts' bytes."""
        raw = self.data.tobytes()
        return [raw[i:j] for i, j in zip(start.tolist(), (start + strings + (self.length - 1)).tolist(), strict=True)]


def previous_factors(contexts: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """For distinct contexts with the smallest document of each: bit j says that string j is in a smaller document.

    The suffixes at every string of every context are put in the order of
    their first ``length`` bytes, with the common prefix of each and the one
    before.  From each suffix, jumps lead to the previous and to the next one
    of a smaller document: from a neighbour that is not smaller to that one's
    own answer, the common prefix shrinking to the least one on the way.  The
    larger of the two is the longest previous factor, as far as ``length``
    bytes; a way ends where it falls below.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    counts = sizes - (length - 1)
    owner = np.repeat(np.arange(len(contexts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(sizes) - sizes)[owner] + inner
    masks = np.zeros(len(contexts), np.uint64)
    # Suffixes whose first, middle and last words are alone have no previous factor of that length: they need no place in the order.
    w = _words(data)
    look = _mixed(w[start] ^ _mixed(w[start + (length // 2 - 4)] ^ _mixed(w[start + length - 8])))
    sorted_ = np.argsort(look)
    equal = look[sorted_][1:] == look[sorted_][:-1]
    some = np.sort(sorted_[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]) if len(look) else sorted_
    if not len(some):
        return masks
    windows = np.lib.stride_tricks.as_strided(data, (len(data) - length + 1, length), (1, 1))
    text = np.ascontiguousarray(windows[start[some]]).reshape(len(some), length)
    pads = np.zeros((len(some), -length % 8), np.uint8)
    columns = np.concatenate([text, pads], 1).view(">u8").astype(np.uint64)
    order = np.lexsort(columns.T[::-1])
    value, text = docs[owner[some]][order], text[order]
    n = len(order)
    common = np.zeros(n + 1, np.int64)  # of each suffix and the one before; none at the ends
    for i in range(0, n - 1, 1 << 16):
        apart = text[i + 1 : i + 1 + (1 << 16)] != text[i : i + (1 << 16)][: n - 1 - i]
        common[i + 1 : i + 1 + len(apart)] = np.where(apart.any(1), apart.argmax(1), length)
    factor = np.zeros(n, np.int64)
    for step in (-1, 1):
        at = np.arange(n) + step
        prefix = (common[:-1] if step < 0 else common[1:]).copy()
        while True:  # prefix is the least one on the way to ``at``
            open_ = np.flatnonzero(prefix >= length)
            open_ = open_[value[at[open_]] >= value[open_]]
            if not len(open_):
                break
            prefix[open_] = np.minimum(prefix[open_], prefix[at[open_]])
            at[open_] = at[at[open_]]
        factor = np.maximum(factor, prefix)
    hit = some[order[factor >= length]]
    np.bitwise_or.at(masks, owner[hit], np.uint64(1) << inner[hit].astype(np.uint64))
    return masks


def _packed(docs: DataFrame, text: str, doc_id: str, block_bytes: int, length: int) -> DataFrame:
    """Rows ``ids, sizes, data, anchors``: documents in blocks of about ``block_bytes``."""

    def pack(batches):
        ids: list[int] = []
        parts: list[bytes] = []
        size = 0
        codec = pa.Codec("zstd", compression_level=7)

        def block() -> pa.RecordBatch:
            raw = b"".join(parts)
            numbers, sizes = np.array(ids, np.int64), np.array([len(p) for p in parts], np.int64)
            anchors = Block(numbers, sizes, np.frombuffer(raw, np.uint8), length).packed()
            row = [numbers.tobytes(), sizes.tobytes(), codec.compress(raw, asbytes=True), codec.compress(anchors, asbytes=True)]
            values = [*[pa.array([x], pa.binary()) for x in row], pa.array([len(anchors)], pa.int64())]
            return pa.RecordBatch.from_arrays(values, ["ids", "sizes", "data", "anchors", "n_anchors"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(_SMALLEST if i is None else i)
                parts.append((t or "").encode("utf-8", "surrogatepass"))
                size += len(parts[-1])
                if size >= block_bytes:
                    yield block()
                    ids, parts, size = [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(pack, "ids binary, sizes binary, data binary, anchors binary, n_anchors long")


def _unpacked(row: dict, length: int) -> Block:
    sizes = np.frombuffer(row["sizes"], np.int64)
    data = pa.decompress(row["data"], decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True) if sizes.sum() else b""
    anchors = pa.decompress(row["anchors"], decompressed_size=row["n_anchors"], codec="zstd", asbytes=True) if row["n_anchors"] else b""
    return Block(np.frombuffer(row["ids"], np.int64), sizes, np.frombuffer(data, np.uint8), length, anchors)


#: Columns that a block is unpacked from.
_BLOCK = ("block", "ids", "sizes", "data", "anchors", "n_anchors")


def _blocks(docs: DataFrame, text: str, doc_id: str, block_bytes: int, buckets: int, length: int) -> DataFrame:
    """The blocks in a table bucketed by ``block``: joins by block don't shuffle the texts.

    The table has a name only until its files are known; they stay in the
    shared folder, as all that is staged.
    """
    spark = docs.sparkSession
    name = f"llm_blocks_{uuid.uuid4().hex}"
    packed = _packed(docs, text, doc_id, block_bytes, length).withColumn("block", F.monotonically_increasing_id())
    packed.write.bucketBy(buckets, "block").format("parquet").option("path", shared_path(spark)).saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return blocks


def _least(b: Block, doc: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """The smallest id of each of a block's ``n`` distinct contexts."""
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, which, b.ids[doc])
    return least


def _runs(batches, rows: int = 40_000):
    """Tables of about ``rows`` rows from batches sorted by ``key``, none of which ends within a key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            keys = np.asarray(table.column("key"))
            cut = int(np.searchsorted(keys, keys[-1], side="left"))  # the last key may go on
            if cut:
                yield table.slice(0, cut)
                held, n = table.slice(cut).to_batches(), len(keys) - cut
    if n:
        yield pa.Table.from_batches(held)


def remove_repeated(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 50, block_bytes: int = 2 << 20, heavy: int = 5000, buckets: int | None = None, texts: bool = True
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept`` per row of ``docs``.

    ``spans`` are the removed runs (byte offsets, end exclusive), ``kept`` the
    remaining bytes; both are null unless ``texts``.  Null texts are empty; a null id is smaller than all
    others.  Strings that occur within one document, or in rows of equal id
    only, stay; texts shorter than ``length`` bytes stay whole; an empty
    table gives an empty result; further columns are not read.
    ``length`` is 24 to 72 bytes, so that a context's strings fit 64 bits.
    """
    if not 24 <= length <= 72:
        raise ValueError("length must be 24 to 72 bytes")
    spark = docs.sparkSession
    python_path(spark)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(docs, text, doc_id, block_bytes, buckets or shuffle, length)

    def anchors(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, _, in_docs, times = _unpacked(row, length).distinct()
                n = len(keys)
                # Place, documents and occurrences (up to 255 are told apart) in one number: 2 + 8 bits below the place.
                about = (np.arange(n, dtype=np.int64) << 10) | (np.minimum(times, 255) << 2) | in_docs
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(n, row["block"], np.int64)), pa.array(about)], ["key", "block", "about"])

    seen = blocks.select(*_BLOCK).mapInArrow(anchors, "key long, block long, about long")
    by_key = Window.partitionBy("key")
    # One row per block and key: two rows, or one with two documents, make it a repeated one.
    # (Two blocks may hold the same id twice; such contexts simply find no smaller document.)
    counted = seen.withColumn("docs", F.sum(F.col("about").bitwiseAND(3)).over(by_key)).withColumn("times", F.sum(F.shiftright("about", 2).bitwiseAND(255)).over(by_key))
    told = counted.filter("docs > 1").select("block", (F.shiftright("about", 10) * 2 + F.when(F.col("times") > heavy, 1).otherwise(0)).cast("int").alias("place"))
    told = staged(told.groupBy("block").agg(F.collect_list("place").alias("places")).withColumnRenamed("block", "of"))

    held_by = blocks.join(told, F.col("block") == F.col("of"))

    def contexts(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _unpacked(row, length)
                _, _, doc, which, first, keys, shown = b.contexts(np.array(row["places"], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(shown.view(np.int64)), pa.array(np.full(len(keys), row["block"], np.int64)), pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(_least(b, doc, which, len(keys)))],
                    ["key", "shown", "block", "place", "doc"],
                )

    sent = held_by.select(*_BLOCK, "places").mapInArrow(contexts, "key long, shown long, block long, place int, doc long")

    def compared(batches):
        for table in _runs(batches):
            key, shown, doc = (np.asarray(table.column(c)) for c in ("key", "shown", "doc"))
            order = np.lexsort((doc, shown, key))
            new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (shown[order][1:] != shown[order][:-1])])
            text = np.empty(len(order), np.int64)  # number of the context's text
            text[order] = np.cumsum(new) - 1
            least = doc[order[new]]
            _, same, texts = np.unique(key[order[new]], return_inverse=True, return_counts=True)
            several = texts[same.reshape(-1)] > 1
            # A block knows its own smallest document: it hears of smaller ones, and of contexts that differ.
            news = np.flatnonzero((least[text] < doc) | several[text])
            yield pa.RecordBatch.from_arrays(
                [*[table.column(c).combine_chunks().take(pa.array(news)) for c in ("block", "place")], pa.array(least[text[news]]), pa.array(several[text[news]])], ["block", "place", "first", "differs"]
            )

    met = sent.repartition(shuffle, "key").sortWithinPartitions("key")
    equal = met.mapInArrow(compared, "block long, place int, first long, differs boolean")
    equal = equal.groupBy("block").agg(F.collect_list(F.struct("place", "first", "differs")).alias("equal"))
    equal = staged(equal.withColumnRenamed("block", "equal_of"))

    differing = held_by.join(equal.filter(F.exists("equal", lambda x: x["differs"])), F.col("block") == F.col("equal_of"))

    def bodies(batches):
        for batch in batches:
            answered = batch.column("equal")
            for i, row in enumerate(batch.select([*_BLOCK, "places"]).to_pylist()):
                b = _unpacked(row, length)
                start, strings, doc, which, first, keys, _ = b.contexts(np.array(row["places"], np.int64))
                own = answered[i].values
                place = np.asarray(own.field("place"))[np.asarray(own.field("differs"))]
                least = _least(b, doc, which, len(keys))[place]
                texts = b.texts(start[first[place]], strings[first[place]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[place].view(np.int64)), pa.array(texts, pa.binary()), pa.array(np.full(len(place), row["block"], np.int64)), pa.array(place.astype(np.int32)), pa.array(least)],
                    ["key", "context", "block", "place", "doc"],
                )

    sent = differing.select(*_BLOCK, "places", "equal").mapInArrow(bodies, "key long, context binary, block long, place int, doc long")
    met = sent.repartition(shuffle, "key").sortWithinPartitions("key")

    def factors(batches):
        for table in _runs(batches):
            bodies = table.column("context").to_pylist()
            place: dict[bytes, int] = {}
            which = np.fromiter((place.setdefault(c, len(place)) for c in bodies), np.int64, len(bodies))
            least = np.full(len(place), np.iinfo(np.int64).max)
            np.minimum.at(least, which, np.asarray(table.column("doc")))
            masks = previous_factors(list(place), least, length)
            news = np.flatnonzero(masks[which] != 0)
            yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks().take(pa.array(news)) for c in ("block", "place")], pa.array(masks[which[news]].view(np.int64))], ["block", "place", "mask"])

    found = met.mapInArrow(factors, "block long, place int, mask long")
    found = staged(found.groupBy("block").agg(F.collect_list(F.struct("place", "mask")).alias("factors")).withColumnRenamed("block", "factors_of"))
    final = blocks.join(told, F.col("block") == F.col("of"), "left").join(equal, F.col("block") == F.col("equal_of"), "left").join(found, F.col("block") == F.col("factors_of"), "left")

    def assembled(batches):
        for batch in batches:
            answered, matched = batch.column("equal"), batch.column("factors")
            for i, row in enumerate(batch.select([*_BLOCK, "places"]).to_pylist()):
                b = _unpacked(row, length)
                edge = np.zeros(len(b.data) + 1, np.int32)
                if row["places"]:
                    start, strings, doc, which, _, keys, _ = b.contexts(np.array(row["places"], np.int64))
                    first, mask = _least(b, doc, which, len(keys)), np.zeros(len(keys), np.uint64)
                    if answered[i].is_valid:
                        own = answered[i].values
                        first[np.asarray(own.field("place"))] = np.asarray(own.field("first"))
                    if matched[i].is_valid:
                        own = matched[i].values
                        mask[np.asarray(own.field("place"))] = np.asarray(own.field("mask")).view(np.uint64)
                    bits = np.where(b.ids[doc] > first[which], np.uint64(0xFFFFFFFFFFFFFFFF), mask[which])
                    for j in range(int(strings.max(initial=0))):
                        hit = (strings > j) & ((bits >> np.uint64(j)) & np.uint64(1)).astype(bool)
                        np.add.at(edge, start[hit] + j, 1)
                        np.add.at(edge, start[hit] + j + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                raw = b.data.tobytes()
                out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
                for doc_id_, end, size in zip(b.ids.tolist(), b.ends.tolist(), b.sizes.tolist(), strict=True):
                    own = gone[end - size : end]
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    cuts = [0, *turns.tolist(), size]
                    kept = b"".join(raw[end - size + cuts[k] : end - size + cuts[k + 1]] for k in range(0, len(cuts), 2))
                    out["doc_id"].append(None if doc_id_ == _SMALLEST else doc_id_)
                    out["n_bytes"].append(size)
                    out["n_removed"].append(size - len(kept))
                    out["n_spans"].append(len(turns) // 2)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["spans"].append([{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()] if texts else None)
                    out["kept"].append(kept if texts else None)
                yield pa.RecordBatch.from_pydict(out, schema=_RESULT)

    return final.select(*_BLOCK, "places", "equal", "factors").mapInArrow(assembled, _RESULT_SQL)


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
])
_RESULT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary"
