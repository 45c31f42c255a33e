"""BPE encoding and decoding (11): texts cut where no token can reach across.

A pair of bytes that stands inside no token of the vocabulary marks a certain
cut: no merge ever joins across it, so the two sides can be encoded by
themselves and their ids put one after another.  In a byte-level vocabulary
that holds between a word and the blank that follows it, between a letter and
most signs, and for many pairs inside words.

The pre-tokenizer must see no difference either.  Its runs of letters, of
digits and of signs give the same tokens whole or cut; two places are left
out because what follows changes the match there: after white space (a run
of it gives up its last sign if something follows) and before an apostrophe
after a sign (which would then begin a contraction).

So a text falls into short fragments, most of which a worker has met before:
each distinct one is encoded once by the vocabulary's library, and remembered
up to a bound in bytes.  Texts are handled in windows that end at certain
cuts, so memory is bounded by a window, the text and its ids.  Nothing is
shuffled.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_path

#: Last bytes (ASCII apart) that a white-space or invisible sign may end with: no cut after them.
_BLANK_ENDS = [*range(0x80, 0x8C), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, 0xBF]
#: ASCII signs that some library takes for white space.
_BLANKS = [*range(0x09, 0x0E), *range(0x1C, 0x21)]


def byte_alphabet() -> dict[str, int]:
    """The signs that stand for bytes in a byte-level vocabulary: printable Latin ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> tuple[dict[int, bytes], list[bytes]]:
    """The bytes of every id of a byte-level vocabulary file, and the added tokens' strings.

    A token with a sign outside the byte alphabet stands for that string's
    own bytes.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("forced cuts need a byte-level vocabulary that leaves texts as they are")
    alphabet = byte_alphabet()
    added = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens that look at their neighbours can't be cut around")
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | added
    known = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for i, t in tokens.items()}
    return known, [t.encode() for t in added.values()]


def forced_cuts(tokens: list[bytes]) -> np.ndarray:
    """For every pair of bytes (first times 256 plus second) whether a text is cut between them."""
    inside = np.zeros((256, 256), bool)
    joined = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    first = np.ones(max(len(joined) - 1, 0), bool)
    first[ends[(ends > 0) & (ends < len(joined))] - 1] = False  # pairs of two tokens
    inside[joined[:-1][first], joined[1:][first]] = True
    cut = ~inside
    cut[[*_BLANKS, *_BLANK_ENDS], :] = False
    cut[:, 0x80:0xC0] = False  # inside a sign
    sign = np.array([not (chr(b).isascii() and chr(b).isalnum()) for b in range(256)])
    cut[sign, ord("'")] = False
    return cut.reshape(-1)


class FragmentEncoder:
    """Encodes bytes of UTF-8 text to ids by fragments; ``remembered`` bounds the bytes of known ones."""

    def __init__(self, path: str, remembered: int = 128 << 20, window: int = 1 << 20, longest: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        known, added = token_bytes(path)
        self.cut = forced_cuts([*known.values(), *added])
        self.remembered, self.window, self.longest = remembered, window, longest
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def _library(self, fragments: list[bytes]) -> list[bytes]:
        texts = [f.decode("utf-8") for f in fragments]
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def windows(self, raw: bytes) -> Iterator[list[bytes]]:
        """The fragments of ``raw``, a list for each window; a window without a cut grows until it has one."""
        start, reach = 0, self.window
        data = np.frombuffer(raw, np.uint8)
        while start < len(raw):
            part = data[start : start + reach + 1]
            pairs = part[:-1].astype(np.uint16)
            pairs <<= 8
            pairs |= part[1:]
            cuts = np.flatnonzero(self.cut[pairs])
            if start + reach >= len(raw):
                ends = [*(cuts + (start + 1)).tolist(), len(raw)]
            elif len(cuts):
                ends = (cuts + (start + 1)).tolist()
            else:
                reach *= 2
                continue
            yield [raw[i:j] for i, j in zip([start, *ends[:-1]], ends, strict=True)]
            start, reach = ends[-1], self.window

    def encode(self, raw: bytes) -> bytes:
        """The ids of ``raw`` as little-endian 32-bit numbers."""
        out = []
        for fragments in self.windows(raw):
            if self.size > self.remembered:
                self.known.clear()
                self.size = 0
            new = set(fragments).difference(self.known)
            long = [f for f in new if len(f) > self.longest]
            short = list(new.difference(long)) if long else list(new)
            if short:
                self.known.update(zip(short, self._library(short), strict=True))
                self.size += sum(map(len, short)) + 200 * len(short)  # two objects and a place
            if long:
                own = dict(zip(long, self._library(long), strict=True))
                out.extend(own[f] if len(f) > self.longest else self.known[f] for f in fragments)
            else:
                out.extend(map(self.known.__getitem__, fragments))
        return b"".join(out)


#: Per Python worker: encoders and token tables by path.
_ENCODERS: dict[str, FragmentEncoder] = {}
_TABLES: dict[str, list[bytes]] = {}


def _encoder(path: str) -> FragmentEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = FragmentEncoder(path)
    return _ENCODERS[path]


def _table(path: str) -> list[bytes]:
    if path not in _TABLES:
        known, _ = token_bytes(path)
        _TABLES[path] = [known.get(i, b"") for i in range(max(known) + 1)]
    return _TABLES[path]


def _by_bytes(rows: Iterator, most: int) -> Iterator[list]:
    """Groups of rows ``(id, value, size)`` of about ``most`` bytes, so that an Arrow batch of long values stays small."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row[-1]
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", batch_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_tokens, ids`` for every row of ``docs``; ``ids`` are little-endian unsigned 32-bit numbers.

    ``vocabulary`` names a byte-level vocabulary file that every executor has.
    No tokens are added at the ends; the vocabulary's special strings are
    single tokens inside texts, as its library has them by default.

    Null and empty texts have no ids; repeated rows are encoded each for
    themselves; an empty table gives an empty result; further columns are not
    read.  A text without a certain cut is one fragment.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, value in zip(batch.column(0), batch.column(1), strict=True):
                    ids = encoder.encode((value.as_py() or "").encode())
                    yield i.as_py(), ids, len(ids)

        for held in _by_bytes(rows(), batch_bytes):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in held], pa.int64()), pa.array([r[2] // 4 for r in held], pa.int64()), pa.array([r[1] for r in held], pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    python_path(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, n_tokens long, ids binary")


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", doc_id: str = "doc_id", batch_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_tokens, ids, text`` for every row: the tokens' bytes put together and read as UTF-8.

    Special tokens are kept as their strings, ids outside the vocabulary give
    nothing, and bytes that are not UTF-8 become replacement signs, as the
    library has it.  Null ids give an empty text; an empty table gives an
    empty result; further columns are not read.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(vocabulary)

        def values() -> Iterator[tuple]:
            for batch in batches:
                for i, value in zip(batch.column(0), batch.column(1), strict=True):
                    raw = value.as_py() or b""
                    numbers = np.frombuffer(raw, "<u4")
                    if len(numbers) and numbers.max() >= len(table):
                        numbers = numbers[numbers < len(table)]
                    text = b"".join(map(table.__getitem__, numbers.tolist())).decode("utf-8", "replace")
                    yield i.as_py(), raw, text, len(raw) + len(text)

        for held in _by_bytes(values(), batch_bytes):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in held], pa.int64()), pa.array([len(r[1]) // 4 for r in held], pa.int64()), pa.array([r[1] for r in held], pa.binary()), pa.array([r[2] for r in held], pa.string())],
                ["doc_id", "n_tokens", "ids", "text"],
            )

    python_path(rows.sparkSession)
    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(decoded, "doc_id long, n_tokens long, ids binary, text string")
