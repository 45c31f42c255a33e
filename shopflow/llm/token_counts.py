"""Token counts (9): batch encoding in Arrow functions that return lengths only.

Each task reads its rows as Arrow batches and regroups the texts to batches
of about ``batch_bytes`` bytes, so that a batch of very long texts is as
large as one of many short ones.  A text over ``piece_bytes`` is split at
safe boundaries.  Only the lengths leave the task; nothing is shuffled.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_path

#: A blank between two ASCII letters or digits: no token of the vocabulary, no
#: special string and no Unicode composition spans it, in vocabularies that drop white space.
_SAFE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")

#: Per Python worker: encoders by (kind, path), and lengths of words already seen.
_ENCODERS: dict[tuple[str, bool], Callable[[list[str]], list[int]]] = {}


def pieces(text: str, size: int) -> list[str]:
    """``text`` cut at safe boundaries, each piece about ``size`` characters.

    The blank at a cut belongs to neither piece.  A text without a safe
    boundary stays whole.
    """
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size - 1)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.end()
    out.append(text[start:])
    return out


def _by_word(encode: Callable[[list[str]], list[int]], most: int) -> Callable[[list[str]], list[int]]:
    """Encodes each distinct word once: right where white space ends every token and is dropped.

    ``most`` bounds the remembered words, which start over beyond it.
    """
    known: dict[bytes, int] = {}

    def lengths(texts: list[str]) -> list[int]:
        split = [t.encode().split() for t in texts]  # of bytes: at ASCII white space only
        if len(known) > most:
            known.clear()
        new = list(set().union(*split).difference(known))
        known.update(zip(new, encode([w.decode() for w in new]), strict=True))
        return [sum(map(known.__getitem__, w)) for w in split]

    return lengths


def encoder(path: str, by_word: bool = False, remembered: int = 500_000) -> Callable[[list[str]], list[int]]:
    """Texts to token counts by the vocabulary file's library; one per worker."""
    if (path, by_word) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        _ENCODERS[path, by_word] = _by_word(encode, remembered) if by_word else encode
    return _ENCODERS[path, by_word]


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    drops_space: bool,
    limit: int = 2048,
    text: str = "text",
    doc_id: str = "doc_id",
    batch_bytes: int = 1 << 20,
    piece_bytes: int = 1 << 16,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``vocabulary`` names a file that every executor has.  ``drops_space``
    says that its tokens end at white space and leave it out; only then are
    long texts split and words counted once per worker.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
    each for themselves; an empty table gives an empty result; further
    columns of ``docs`` are not read.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, by_word=drops_space)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n_bytes, n_tokens = [], [0] * len(texts)
            held: list[tuple[int, str]] = []
            size = 0

            def flush() -> None:
                nonlocal size
                for (i, _), n in zip(held, encode([t for _, t in held]), strict=True):
                    n_tokens[i] += n
                held.clear()
                size = 0

            for i, value in enumerate(texts):
                whole = value.as_py() or ""
                n_bytes.append(len(whole.encode()))
                for piece in pieces(whole, piece_bytes) if drops_space else [whole]:
                    held.append((i, piece))
                    size += len(piece)
                    if size >= batch_bytes:
                        flush()
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    python_path(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
