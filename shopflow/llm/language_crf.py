"""Language ID (3): a linear-chain conditional random field labels every word.

A word's features are itself (the lexicon), its affixes of one to three
letters and its letter n-grams, hashed into a table of weights per language.
Together with learned transitions they give each word a distribution over
languages by forward-backward along its chain, so the words of a
code-switched text are labelled one by one.  A document's language is the one
with the largest sum of word probabilities.

The field is fitted in the driver on a bounded sample of labelled rows:
``sample_rows`` per language, ``sample_words`` words of each.  Chains that
switch between languages are made of pieces of sampled texts, so transitions
are learned from switches, too.  The fitted table is bounded by its
parameters and goes to the tasks with the function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import aside, python_path
from .ranks import hashed

UNKNOWN = "und"
#: A word is a run of letters.
_WORD = re.compile(r"[^\W\d_]+")
#: Longest chain; a longer line is cut into chains of this many words.
CHAIN = 128
#: Characters of the texts that are labelled together.
GROUP = 4_000_000
#: Words whose scores a worker remembers.
REMEMBERED = 300_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, concatenated, and where each word's begin.

    With the marks around it a word of m letters has m + 2 characters: its
    2- and 3-grams (the outer ones are affixes), the prefix and suffix of
    three letters with their mark, and the whole word.
    """
    marked = ["\x02" + w + "\x03" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(code))  # characters up to the word's end

    def grams(n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64) * _MIX[3]
        for j in range(n):
            h = (h ^ code[at + j]) * _MIX[j % 3]
            h ^= h >> np.uint64(29)
        return owner[at], h

    parts = [grams(2), grams(3)]
    long = np.flatnonzero(sizes >= 5)
    for first in (starts[long], ends[long] - 4):  # prefix and suffix of three letters, with their mark
        h = np.full(len(long), 7, np.uint64) * _MIX[3]
        for j in range(4):
            h = (h ^ code[first + j]) * _MIX[(j + 1) % 3]
            h ^= h >> np.uint64(31)
        parts.append((long, h))
    whole = np.arange(len(words))
    rolled = code * _MIX[1] + (np.arange(len(code)) - starts[owner]).astype(np.uint64) * _MIX[2]
    rolled = (rolled ^ (rolled >> np.uint64(33))) * _MIX[0]
    total = np.add.reduceat(rolled, starts) if len(words) else np.zeros(0, np.uint64)
    parts.append((whole, (total ^ (total >> np.uint64(27))) * _MIX[2]))

    who = np.concatenate([p[0] for p in parts])
    order = np.argsort(who, kind="stable")
    ids = (np.concatenate([p[1] for p in parts])[order] >> np.uint64(20)) % np.uint64(buckets)
    counts = np.bincount(who, minlength=len(words))
    return ids.astype(np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(words) else np.zeros(0, np.int64)


def forward_backward(scores: np.ndarray, jumps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals (as ``scores``) of all chains, and (if ``counted``) the expected number of each transition.

    ``scores``: words x languages; chain i is the words starts[i] .. + sizes[i].
    Chains advance together, longest first, one step of all chains at a time.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    e = np.exp(scores - scores.max(1, keepdims=True))
    p = np.exp(jumps - jumps.max())
    a, b = np.empty_like(e), np.ones_like(e)
    expected = np.zeros_like(p)
    steps = int(sizes[0]) if len(sizes) else 0
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]  # chains longer than t
    for t in range(steps):
        at = starts[: alive[t]] + t
        now = e[at] if t == 0 else (a[at - 1] @ p) * e[at]
        a[at] = now / now.sum(1, keepdims=True)
    for t in range(steps - 1, 0, -1):
        at = starts[: alive[t]] + t
        ahead = e[at] * b[at]
        if counted:
            pair = a[at - 1][:, :, None] * p[None] * ahead[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        back = ahead @ p.T
        b[at - 1] = back / back.sum(1, keepdims=True)
    m = a * b
    return m / m.sum(1, keepdims=True), expected


@dataclass
class Field:
    """A fitted field: languages in code point order, feature weights, transitions."""

    languages: list[str]
    weights: np.ndarray
    jumps: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "weights": self.weights, "jumps": self.jumps, "known": {}, "table": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The mean weight of a word's features per language, times eight."""
        ids, starts = word_features(words, len(self.weights))
        if not len(words):
            return np.zeros((0, len(self.languages)), np.float32)
        counts = np.diff(np.append(starts, len(ids)))
        return 8 * np.add.reduceat(self.weights[ids], starts, axis=0) / counts[:, None]

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The rows of ``table`` for words, scoring those not seen before."""
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, None
        new = list(set(words).difference(self.known))
        if new:
            scores = self.word_scores(new).astype(np.float32)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = scores if self.table is None else np.concatenate([self.table, scores])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def chains_of(text: str) -> list[list[str]]:
    """The words of a text, line by line, in chains of at most CHAIN words."""
    out = []
    for line in text.lower().split("\n"):
        words = _WORD.findall(line)
        out += [words[i : i + CHAIN] for i in range(0, len(words), CHAIN)]
    return out


def label_words(model: Field, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts, their distributions (words x languages), and per chain its text and its size."""
    words: list[str] = []
    sizes: list[int] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        for chain in chains_of(text):
            words += chain
            sizes.append(len(chain))
            owner.append(i)
    size, of = np.array(sizes, np.int64), np.array(owner, np.int64)
    if not words:
        return words, np.zeros((0, len(model.languages))), of, size
    rows = model.rows_of(words)
    marginals, _ = forward_backward(model.table[rows].astype(np.float64), model.jumps, np.cumsum(size) - size, size, counted=False)
    return words, marginals, of, size


def label_documents(model: Field, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its words' distributions, and its number of words."""
    words, marginals, of, size = label_words(model, texts)
    sums = np.zeros((len(texts), len(model.languages)))
    if words:
        np.add.at(sums, of, np.add.reduceat(marginals, np.cumsum(size) - size, axis=0))
    return sums, np.bincount(of, weights=size, minlength=len(texts))


def fit_field(sample: list[tuple[str, str]], words: int = 300, buckets: int = 1 << 17, epochs: int = 4, seed: int = 3, rate: float = 0.5) -> Field:
    """A field from (text, language) rows, by stochastic gradient ascent on the chains' likelihood."""
    languages = sorted({lang for _, lang in sample})
    rng = np.random.default_rng(seed)
    by_lang: list[list[list[str]]] = [[] for _ in languages]
    for text, lang in sample:
        flat = [w for chain in chains_of(text) for w in chain][:words]
        by_lang[languages.index(lang)] += [flat[i : i + 12] for i in range(0, len(flat), 12)]
    pieces = [(p, i) for i, ps in enumerate(by_lang) for p in ps]
    model = Field(languages, np.zeros((buckets, len(languages)), np.float32), np.zeros((len(languages), len(languages))))
    if len(languages) < 2 or not pieces:
        return model
    # Chains of four pieces: of one language, or of any as they come.
    order = [pieces[j] for j in rng.permutation(len(pieces))]
    same = [p for i in range(len(languages)) for p in (x for x in order if x[1] == i)]
    chains = [order[i : i + 4] for i in range(0, len(order), 4)] + [same[i : i + 4] for i in range(0, len(same), 4)]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for p, _ in pieces for w in p))}
    ids, starts = word_features(list(vocabulary), buckets)
    counts = np.diff(np.append(starts, len(ids)))
    square = np.full((buckets, len(languages)), 1e-6, np.float32)
    square_jumps = np.full_like(model.jumps, 1e-6)
    for _ in range(epochs):
        turn = rng.permutation(len(chains))
        for i in range(0, len(turn), 128):
            batch = [chains[j] for j in turn[i : i + 128]]
            flat = np.array([vocabulary[w] for c in batch for p, _ in c for w in p], np.int64)
            truth = np.array([lang for c in batch for p, lang in c for _ in p], np.int64)
            sizes = np.array([sum(len(p) for p, _ in c) for c in batch], np.int64)
            begin = np.cumsum(sizes) - sizes
            types, place = np.unique(flat, return_inverse=True)
            features = np.concatenate([ids[starts[t] : starts[t] + counts[t]] for t in types])
            per = np.repeat(np.arange(len(types)), counts[types])
            score = 8 * np.add.reduceat(model.weights[features], np.cumsum(counts[types]) - counts[types], axis=0) / counts[types, None]
            marginals, expected = forward_backward(score[place].astype(np.float64), model.jumps, begin, sizes)
            gap = -marginals
            gap[np.arange(len(flat)), truth] += 1
            by_type = np.stack([np.bincount(place, gap[:, k], len(types)) for k in range(len(languages))], 1) * 8 / counts[types, None]
            touched, where = np.unique(features, return_inverse=True)
            grad = np.stack([np.bincount(where, by_type[per, k], len(touched)) for k in range(len(languages))], 1).astype(np.float32)
            square[touched] += grad**2
            model.weights[touched] += rate * grad / np.sqrt(square[touched])
            inner = np.setdiff1d(np.arange(1, len(flat)), begin)
            seen = np.zeros_like(model.jumps)
            np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
            jump = seen - expected
            square_jumps += jump**2
            model.jumps += rate * jump / np.sqrt(square_jumps)
    return model


def learn(docs: DataFrame, known: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = 300, sample_words: int = 300, seed: int = 3) -> Field:
    """A field fitted on at most ``sample_rows`` rows of each language, a seeded choice among those where ``known``.

    The rows of a language whose hashes are smallest are taken: a first cut,
    set by the language's number of rows, leaves few more than are wanted to
    be ranked.  Only ids are ranked; the texts of the chosen rows, at most
    ``40 * sample_words`` characters of each, come to the driver.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(known & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # One row per language, as the fitted table has one column per language.
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "of")
    wanted = sample_rows + 6 * sample_rows**0.5 + 20
    draw = hashed(F.col("id"), seed=seed)
    low = F.pmod(draw, F.lit(1 << 30)) * F.col("n") <= F.lit(wanted * (1 << 30))
    order = Window.partitionBy("lang").orderBy("draw", "id")
    near = rows.join(F.broadcast(sizes), F.col("lang") == F.col("of")).filter(low).select("id", "lang", F.pmod(draw, F.lit(1 << 30)).alias("draw")).distinct()
    chosen = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample_rows).select(F.col("id").alias("chosen")).distinct()
    # One text for each id and language, however often they repeat.
    sample = rows.join(F.broadcast(chosen), F.col("id") == F.col("chosen")).groupBy("id", "lang").agg(F.min(F.substring("text", 1, 40 * sample_words)).alias("text"))
    return fit_field([(r["text"], r["lang"]) for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["id"], r["text"]))], sample_words, seed=seed)


def predict(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the winning language's share of all words.

    Texts that are null, empty or without a letter are ``und`` with score 0,
    and so are all texts if nothing was learned; at a tie the first language
    in code point order wins.  Every word of a text counts, however long it
    is; repeated rows get equal answers; further columns stay.
    """
    python_path(docs.sparkSession)
    docs, back = aside(docs, text)
    given = [f.name for f in docs.schema.fields]
    schema = docs.schema
    out = StructType([*schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = given.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = [t or "" for t in whole.column(at).to_pylist()]
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < GROUP and i + 1 < len(texts):
                    continue
                part = texts[begin : i + 1]
                sums, counts = label_documents(model, part) if model.languages else (np.zeros((len(part), 0)), np.zeros(len(part)))
                fine = np.array([n > 0 and bool(model.languages) and any(map(str.isalpha, t)) for n, t in zip(counts, part, strict=True)], bool)
                best = sums.argmax(1) if model.languages else np.zeros(len(part), int)
                names = pa.array([model.languages[k] if ok else UNKNOWN for k, ok in zip(best, fine, strict=True)], pa.string())
                share = np.where(fine, sums.max(1) / np.maximum(counts, 1), 0.0) if model.languages else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([*whole.slice(begin, len(part)).columns, names, pa.array(np.clip(share, 0.0, 1.0))], [*given, "lang_pred", "score"])
                begin, size = i + 1, 0

    return back(docs.mapInArrow(label, out), "lang_pred", "score")


def word_languages(docs: DataFrame, model: Field, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, place, word, lang, p``: the most probable language of every word of every text.

    For code-switched texts.  Words are in lower case, ``place`` counts them
    from 0 in each row; texts without words give no rows, and so does a model
    without languages.
    """
    python_path(docs.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = [t or "" for t in whole.column(1).to_pylist()]
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < GROUP and i + 1 < len(texts):
                    continue
                words, marginals, of, sizes = label_words(model, texts[begin : i + 1] if model.languages else [])
                owner = np.repeat(of, sizes)
                place = np.arange(len(words)) - np.searchsorted(owner, owner, side="left")
                best = marginals.argmax(1) if words else np.zeros(0, np.int64)
                names = pa.array([model.languages[k] for k in best], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(begin).take(pa.array(owner)), pa.array(place, pa.int64()), pa.array(words, pa.string()), names, pa.array(marginals.max(1) if words else np.zeros(0))],
                    ["doc_id", "place", "word", "lang", "p"],
                )
                begin, size = i + 1, 0

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(label, "doc_id long, place long, word string, lang string, p double")
