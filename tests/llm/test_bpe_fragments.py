"""BPE by forced cuts against the vocabulary's library."""

import hashlib
import random

import numpy as np
import pytest

from shopflow.llm import bpe_fragments
from shopflow.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
#: Signs that pre-tokenizers treat specially, and pieces of contractions and special strings.
SIGNS = [*"abstrlmvde'’\" \t\n\r\x0b\x1c\x85\xa0　 ​﻿᠎!?.,<|>1234é ßñ中文字😀́ـ٣²½ſK", "<|endoftext|>", "'ll", "'s", "  ", "\n\n", " the"]


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def _ids(model, text):
    return np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("window", [4, 33, 1 << 20])
def test_random_texts_match_the_library(window):
    encoder, model = bpe_fragments.FragmentEncoder(PATH, window=window, remembered=20_000, longest=9), _library()
    rng = random.Random(window)
    for _ in range(15_000):
        text = "".join(rng.choices(SIGNS, k=rng.randrange(14)))
        assert encoder.encode(text.encode()) == _ids(model, text), repr(text)
    assert encoder.size <= 2 * 20_000


def test_no_token_reaches_across_a_cut_and_fragments_are_the_text():
    known, added = bpe_fragments.token_bytes(PATH)
    cut = bpe_fragments.forced_cuts([*known.values(), *added])
    assert not any(cut[a * 256 + b] for t in known.values() for a, b in zip(t, t[1:]))
    encoder = bpe_fragments.FragmentEncoder(PATH, window=64)
    text = ("word, and “more” words; x=1\n\n" * 50 + "é" * 500).encode()
    pieces = [f for w in encoder.windows(text) for f in w]
    assert b"".join(pieces) == text and len(pieces) > 300


def test_edges_and_round_trip(spark, documents, edges):
    odd = [(50, "<|startoftext|> it's 'll <|endoftext|>x\x1cy \x85 é́", "en", "a"), (51, " " * 3000 + "x" * 3000 + "中" * 3000, "en", "a"), (52, "a" * 2_000_000, "en", "a")]
    rows, model = edges + odd, _library()
    encoded = bpe_fragments.encode(documents(rows), PATH, batch_bytes=1000)
    got = bpe_fragments.decode(encoded, PATH, batch_bytes=1000).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, bytes(r[2]))
    want = [(i, len(x := _ids(model, t or "")) // 4, x, t or "") for i, t, _, _ in rows]
    assert [(r[0], r[1], bytes(r[2]), r[3]) for r in sorted(got, key=key)] == sorted(want, key=key)
    assert bpe_fragments.decode(bpe_fragments.encode(documents([]), PATH), PATH).count() == 0


def test_decoding_any_ids_as_the_library_does(spark):
    rng, model = random.Random(5), _library()
    rows = [(i, [rng.randrange(50_257) for _ in range(rng.randrange(30))]) for i in range(200)]
    frame = spark.createDataFrame([(i, np.array(x, "<u4").tobytes()) for i, x in rows] + [(300, None), (301, np.array([262, 60_000], "<u4").tobytes())], "doc_id long, ids binary")
    got = {r["doc_id"]: r["text"] for r in bpe_fragments.decode(frame, PATH).collect()}
    assert got == {i: model.decode(x, skip_special_tokens=False) for i, x in rows} | {300: "", 301: " the"}


def test_the_query(spark):
    model = _library()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op11_bpe_fragments"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = _ids(model, r["text"] or "")
        assert got.pop(r["doc_id"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(model.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()).hexdigest())
    assert not got
