"""Words one edit apart by Gram matrices against plain comparison."""

import random
import re
import zlib

import numpy as np
import pytest

from shopflow.llm.catalog import QUERIES
from shopflow.llm.spelling_blocks import near_pairs, spelling_forms

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(rows, least=3):
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if n >= least}


def _near(words):
    """Near words by what is left when one letter is taken out or blanked."""
    out = {w: set() for w in words}
    blank = {}
    for w in words:
        for i in range(len(w)):
            if (v := w[:i] + w[i + 1 :]) in out:
                out[w].add(v)
                out[v].add(w)
            blank.setdefault((w[:i], w[i + 1 :]), []).append(w)
    for same in blank.values():
        for w in same:
            out[w].update(v for v in same if v != w)
    return out


def _forms(rows, least=3):
    n = _words(rows, least)
    near = _near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def _result(frame):
    rows = frame.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("block", "cell"), [(512, 1500), (7, 20), (3, 1), (1, 0)])
def test_random_words_match_plain_comparison(spark, documents, block, cell):
    rng = random.Random(block)
    stems = ["".join(rng.choices("abcdeéÿ÷", k=rng.randrange(4, 9))) for _ in range(60)]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i + 1 :]])
        return rng.choice([w, w.upper()]) if w.isascii() else w

    rows = [(i, " ".join(word() for _ in range(60)) + ", x1y", "en", "a") for i in range(60)]
    got = _result(spelling_forms(documents(rows), block_words=block, words_a_cell=cell))
    want = _forms([r[:2] for r in rows])
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20


def test_edges(spark, documents, edges):
    long = "y" * 5000
    odd = [(60 + i, f"{long} {long}z {long[:-1]}", "en", "a") for i in range(3)] + [(70, (long + " ") * 9, "en", "a"), (80, "straße " * 4 + "strasse " * 4 + "STRAßE Ärger ärger", "de", "b")]
    rows = edges + odd
    assert _result(spelling_forms(documents(rows))) == _forms([r[:2] for r in rows])
    got = spelling_forms(documents([]))
    assert got.count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling_forms(documents([(1, None, "en", "a"), (2, "one two", "en", "a")])).count() == 0


def test_chain_of_forms_ends_at_its_root(spark, documents):
    chain = ["abcdefgh"[:i] + "x" * (8 - i) for i in range(9)]  # each one replaced letter from the next
    rows = [(i, " ".join([w] * 3 * 2**i), "en", "a") for i, w in enumerate(chain)]
    got = _result(spelling_forms(documents(rows), every=10**12))
    assert {w: v[1] for w, v in got.items()} == {w: chain[-1] for w in chain}
    assert [got[w][0] for w in chain] == [*chain[1:], None]


def test_near_pairs_of_blocks():
    rng = np.random.default_rng(1)
    a, b = rng.integers(97, 100, (200, 5)).astype(np.uint8), rng.integers(97, 100, (150, 6)).astype(np.uint8)
    for x, y in ((a, a), (a, b)):
        got = set(zip(*[v.tolist() for v in near_pairs(x, y, most=64)]))
        plain = lambda s, t: len(s) == len(t) and sum(c != d for c, d in zip(s, t)) == 1 or len(t) == len(s) + 1 and any(t[:k] + t[k + 1 :] == s for k in range(len(t)))
        assert got == {(i, j) for i, s in enumerate(x.tolist()) for j, t in enumerate(y.tolist()) if plain(s, t)}


def test_the_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert _result(QUERIES["op12_spelling_blocks"](spark, SF)) == _forms(rows)
