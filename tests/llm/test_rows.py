"""Operators on single rows and whole-corpus counts: vectors, decontamination, language ID, secrets, mixing, token counts."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopflow.llm.catalog import held_out
from shopflow.llm.common import table
from shopflow.llm.decontaminate import decontaminate
from shopflow.llm.hilbert_neighbours import hilbert_keys, nearest
from shopflow.llm.language_crf import Field, fit_field, forward_backward, label_documents, learn, predict, word_languages
from shopflow.llm.mixing import mix, sainte_lague
from shopflow.llm.ranks import row_number
from shopflow.llm.secret_ownership import KINDS, scan_secrets, span_text
from shopflow.llm.token_counts import pieces, token_counts

SF = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

# Nearest neighbours ----------------------------------------------------------


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, id string")


def test_hilbert_keys_are_a_curve():
    """All cells once, and consecutive keys are neighbouring cells."""
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij")
        cells = np.stack([a.ravel() for a in axes], 1)
        order = np.argsort(hilbert_keys(cells, bits))
        assert (np.sort(hilbert_keys(cells, bits)) == np.arange(len(cells))).all()
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_nearest_matches_brute_force_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32) * rng.uniform(0.2, 3, size=(300, 1)).astype(np.float32)
    x[40:100] = x[40]  # one very common vector
    x[200] = x[201]
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    bad = [(1000, None, 0, "x"), (1020, [0.0] * 8, 0, "x"), (1040, [float("nan")] + [1.0] * 7, 0, "x"), (1060, [float("inf")] + [1.0] * 7, 0, "x"), (1080, [None] + [1.0] * 7, 0, "x"), (1100, [], 0, "x"), (1120, [1.0], 0, "x"), (None, [1.0] * 8, 0, "x")]
    got = nearest(_vectors(spark, rows + bad + rows[:3]), F.col("vec_id") % 20 == 0, top=20, block=64).collect()
    e = x.astype(np.float64)
    want = {}
    for q in range(0, 300, 20):
        s = e @ e[q]
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        want[q] = [(i, s[i]) for i in order]
    by_query = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by_query.keys() == want.keys()
    for q, hits in by_query.items():
        assert [i for i, _ in hits] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in hits], [s for _, s in want[q]], rtol=0, atol=1e-12)
        assert sorted(r["rank"] for r in got if r["query_id"] == q) == list(range(1, 21))


def test_rows_of_one_id_are_one_row(spark):
    rows = [(20, [1.0, 0.0], 0, ""), (20, [0.5, 2.0], 0, ""), (3, [1.0, 1.0], 0, ""), (3, [1.0, -5.0], 0, ""), (5, [2.0, 0.0], 0, ""), (5, [2.0, 0.0], 0, "")]
    got = nearest(_vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    # The smaller vectors stand for 20 and 3: (0.5, 2) and (1, -5).
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(20, 1, 5, 1.0), (20, 2, 3, -9.5)]


def test_nearest_of_few_or_none(spark):
    assert nearest(_vectors(spark, []), F.lit(True)).count() == 0
    assert nearest(_vectors(spark, [(1, None, 0, "")]), F.lit(True)).count() == 0
    got = nearest(_vectors(spark, [(20, [1.0, 0.0], 0, ""), (3, [1.0, 1.0], 0, ""), (5, [2.0, 0.0], 0, "")]), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 5, 2.0), (20, 2, 3, 1.0)]


def test_nearest_recall_on_the_table(spark):
    vectors = table(spark, SF_CHECK.replace("0.01", "0.1"), "embeddings", "vec_id", "embedding")
    got = {(r["query_id"], r["vec_id"]) for r in nearest(vectors, F.col("vec_id") % 20 == 0, block=256).collect()}
    rows = vectors.collect()
    ids, e = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = e @ e[q]
        s[q] = -np.inf
        found += sum((ids[q], ids[i]) in got for i in np.argsort(-s)[:20])
        total += 20
    assert found >= 0.9 * total


@pytest.mark.parametrize(("dim", "block", "curves"), [(64, 32, 4), (3, 4, 2)])
def test_nearest_recall_follows_the_row_count(spark, dim, block, curves):
    """Windows far narrower than the table: 64 dimensions without structure need all rows, three only wider windows."""
    x = np.random.default_rng(2).normal(size=(6000, dim))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors = _vectors(spark, [(i, v.tolist(), 0, "x") for i, v in enumerate(x)])
    got = {(r["query_id"], r["vec_id"]) for r in nearest(vectors, F.col("vec_id") % 20 == 0, block=block, curves=curves, dims=min(dim, 8)).collect()}
    e = x.astype(np.float64)
    found = total = 0
    for q in range(0, 6000, 20):
        s = e @ e[q]
        s[q] = -np.inf
        found += sum((q, int(i)) in got for i in np.argsort(-s)[:20])
        total += 20
    assert found >= 0.9 * total


def test_ties_of_many_vectors_go_to_the_smaller_ids(spark):
    """Binary vectors: hundreds of different ones tie at every score."""
    bits = np.random.default_rng(3).permutation(np.arange(1, 1024))
    x = ((bits[:, None] >> np.arange(10)) & 1).astype(np.float64)
    got = nearest(_vectors(spark, [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, 1023, 20):
        s = x @ x[q]
        assert by_query[q] == sorted((i for i in range(1023) if i != q), key=lambda i: (-s[i], i))[:20]


def test_row_number_over_partitions(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(500)]
    got = sorted(row_number(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], "at").collect(), key=lambda r: r["at"])
    assert [(r["a"], r["b"]) for r in got] == sorted(rows) and [r["at"] for r in got] == list(range(500))


# Decontamination -------------------------------------------------------------

ITEM = "Alice has 12 apples and Bob gives her 5 km of rope for 12 days, so how many are left in the big red basket"


def _items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "item_id long, text string")


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("Before it. " + ITEM + ". And after.", True),
        (ITEM.upper(), True),
        (ITEM.replace(" ", "%%% ").replace("5%%% km", "5 km"), True),
        ("Now Carol has 17 apples and Dave gives her 9 miles of rope for 17 days, so how many are left in the big red basket", True),
        (ITEM[: len(ITEM) // 2], False),
        ("apples and rope are left in the big red basket", False),
        ("1 2 3 4 5 6 7 8 9 10 11 12", False),
        (None, False),
        ("", False),
    ],
)
def test_decontamination_cases(spark, documents, text, hit):
    got = decontaminate(documents([(1, text, "en", "a")]), _items(spark, [ITEM, "too short", None, ""])).collect()
    assert [r["items"] for r in got] == [[1] if hit else None]


def test_short_items_and_scripts_without_blanks(spark, documents):
    items = ["to be or not", "白日依山尽黄河入海流欲穷千里目更上一层楼", "Is 7 prime?", "Yes", "你好", "42"]
    hits = {
        1: ("to be or not", [1]), 2: ("Before it.\n  To be, or not?\nafter it", [1]), 3: ("some say to be or not to be is the question here", None),
        4: ("他说白日依山尽黄河入海流欲穷千里目更上一层楼是名句", [2]), 5: ("白日依山尽，黄河入海流。", None), 6: ("Is 11 prime?", [3]), 7: ("is it prime", None),
        8: ("yes\nno", [4]), 9: ("yes and no", None), 10: ("你好", [5]), 11: ("你好吗", None), 12: ("42", [6]), 13: ("43", None), 14: ("", None), 15: (None, None),
    }
    got = {r["doc_id"]: r["items"] for r in decontaminate(documents([(i, t, "zh", "a") for i, (t, _) in hits.items()]), _items(spark, items)).collect()}
    assert got == {i: want for i, (_, want) in hits.items()}


def test_numbers_in_words_are_numbers(spark, documents):
    item = "Tom has seven red apples and gives five of them to Mary, who eats twenty-one green pears a week. How many are left?"
    texts = [item.replace("seven", "four").replace("five", "three"), item.replace("seven", "12").replace("five", "9").replace("twenty-one", "30"), item.replace("red apples and gives", "dogs but never sells")]
    got = [r["items"] for r in sorted(decontaminate(documents([(i, t, "en", "a") for i, t in enumerate(texts)]), _items(spark, [item])).collect(), key=lambda r: r["doc_id"])]
    assert got == [[1], [1], None]


def test_slots_that_disagree_dont_count(spark, documents):
    item = "it takes 3 men 4 days to dig 3 holes with 3 spades and 4 carts while 3 women need 4 days for 4 walls"
    same = "it takes 8 men 9 days to dig 8 holes with 8 spades and 9 carts while 8 women need 9 days for 9 walls"
    mixed = "it takes 1 men 2 days to dig 5 holes with 6 spades and 7 carts while 8 women need 9 days for 10 walls"
    got = {r["doc_id"]: r["items"] for r in decontaminate(documents([(1, same, "en", "a"), (2, mixed, "en", "a")]), _items(spark, [item])).collect()}
    assert got == {1: [1], 2: None}


def test_each_copy_has_its_own_reading(spark, documents):
    item = "She has 3 apples and 4 pears, eats 1 apples and 2 pears, and buys 5 apples and 6 pears more. How many are left?"
    rng = random.Random(10)

    def sheet(n, words=lambda: ""):
        return "\n".join(words() + re.sub("[0-9]", lambda m: str(rng.randrange(10, 1000)), item) for _ in range(n))

    longer = "on the way home from the market of the old town she has 3 apples and 4 pears in a blue bag that her kind brother gave her last year and eats 1 apples"
    shifted = longer.replace("kind brother", "kind older brother")
    other = "She has 3 apples and 4 pears, eats no plums at all and buys nothing more."
    rows = [(n, sheet(n), "en", "a") for n in (1, 2, 5, 30)]
    rows += [(100 + n, sheet(n, lambda: " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(9))) + " "), "en", "a") for n in (2, 5, 30)]
    rows += [(200, item + "\n" + sheet(9), "en", "a"), (201, "\n".join([other] * 9), "en", "a")]
    rows += [(300, " ".join(shifted.replace("3", str(k)).replace("4", str(2 * k)).replace("1", str(3 * k)) + "." for k in (11, 15, 17)), "en", "a")]
    got = {r["doc_id"]: r["items"] for r in decontaminate(documents(rows), _items(spark, [item, longer])).collect()}
    assert got == {**{i: [1] for i, *_ in rows}, 201: None, 300: [2]}


def test_decontamination_matches_window_coverage(spark):
    """Without placeholders the rule is: 0.8 of an item's five-word windows."""
    docs, items = table(spark, SF, "documents", "doc_id", "text"), table(spark, SF, "benchmark", "item_id", "text")
    clean = lambda t: re.sub(r"[^\w\s]|_", "", (t or "").lower()).split()
    windows = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {}
    bench = [(r["item_id"], clean(r["text"])) for r in items.collect()]
    for r in docs.collect():
        own = windows(clean(r["text"]))
        hits = [i for i, w in bench if len(w) >= 5 and sum(tuple(w[k : k + 5]) in own for k in range(len(w) - 4)) >= 0.8 * (len(w) - 4)]
        if hits:
            want[r["doc_id"]] = hits
    got = {r["doc_id"]: r["items"] for r in decontaminate(docs, items).filter("items IS NOT NULL").collect()}
    assert got == want and want


def test_decontamination_edges(spark, documents, edges):
    docs = documents(edges)
    got = decontaminate(docs, _items(spark, [ITEM, "the same text twice, of more than five words. second line"]))
    assert got.columns == [c for c in docs.columns if c != "items"] + ["items"]
    assert sorted(r["doc_id"] for r in got.filter("items IS NOT NULL").collect()) == [6, 6, 7]
    assert got.count() == len(edges)
    assert decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).filter("items IS NOT NULL").count() == 0
    assert decontaminate(documents([]), _items(spark, [ITEM])).count() == 0


# Language ID -----------------------------------------------------------------


def test_forward_backward_matches_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    sizes = np.array([1, 4, 3])
    scores, jumps = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    starts = np.cumsum(sizes) - sizes
    got, expected = forward_backward(scores, jumps, starts, sizes)
    want, pairs = np.zeros((8, 3)), np.zeros((3, 3))
    for s, n in zip(starts, sizes, strict=True):
        paths = list(itertools.product(range(3), repeat=int(n)))
        p = np.exp([sum(scores[s + t, k] for t, k in enumerate(path)) + sum(jumps[a, b] for a, b in itertools.pairwise(path)) for path in paths])
        p /= p.sum()
        for path, w in zip(paths, p, strict=True):
            for t, k in enumerate(path):
                want[s + t, k] += w
            for a, b in itertools.pairwise(path):
                pairs[a, b] += w
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_words_of_switched_text_are_labelled():
    en, de = "the cat sat on the mat and looked at the moon ", "die katze lag auf der matte und sah den mond an "
    model = fit_field([(en * 20, "en"), (de * 20, "de")], epochs=8)
    sums, counts = label_documents(model, [en + de, en, de, "", "123"])
    assert model.languages == ["de", "en"]
    assert abs(sums[0, 0] - 11) < 2.5 and counts.tolist()[:3] == [22, 11, 11] and counts[3] == counts[4] == 0
    assert sums[1].argmax() == 1 and sums[2].argmax() == 0


def test_word_languages_of_a_switched_text(spark, documents):
    en, de = "the cat sat on the mat and looked at the moon", "die katze lag auf der matte und sah den mond an"
    model = fit_field([(f"{en} " * 20, "en"), (f"{de} " * 20, "de")], epochs=8)
    rows = word_languages(documents([(1, f"{en}\n{de}", "en", "a"), (2, None, "en", "a"), (3, "7", "en", "a"), (4, "the moon", "en", "a")]), model).collect()
    first = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["place"])
    assert [r["word"] for r in first] == f"{en} {de}".split() and [r["place"] for r in first] == list(range(22))
    assert [r["lang"] for r in first] == ["en"] * 11 + ["de"] * 11 and all(0.5 <= r["p"] <= 1 for r in first)
    assert [r["word"] for r in sorted((r for r in rows if r["doc_id"] == 4), key=lambda r: r["place"])] == ["the", "moon"]
    assert {r["doc_id"] for r in rows} == {1, 4}


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF_CHECK, "documents", "doc_id", "text", "lang")
    model = learn(docs, ~held_out(F.col("doc_id")))
    rows = predict(docs, model).withColumn("held", held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r["held"]]
    assert len(rows) == 1000 and 200 < len(held) < 300
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, documents, edges):
    docs = documents(edges)
    model = learn(docs, F.lit(True))
    assert model.languages == ["de", "en"]
    got = predict(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert all(by_id[i] == ("und", 0.0) for i in (1, 2, 3, 5))
    assert by_id[4][0] in ("de", "en") and len(got.collect()) == len(edges)
    nothing = learn(documents([]), F.lit(True))
    assert nothing.languages == [] and {r["lang_pred"] for r in predict(docs, nothing).collect()} == {"und"}
    assert predict(documents([]), model).count() == 0
    one = Field(["en"], np.zeros((8, 1), np.float32), np.zeros((1, 1)))
    assert {r["lang_pred"] for r in predict(docs, one).collect()} == {"en", "und"}


# Secrets ---------------------------------------------------------------------

_BASE = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def _base(text):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted((m.start(), k, m.end()) for k, (_, p, fits) in enumerate(_BASE) for m in p.finditer(text or "") if fits(m)))


def test_secret_spans_match_patterns(spark, documents, edges):
    rng = random.Random(10)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " = ", "'", '"', " ", "AKIA", "ABCDEFGH123456", "0123456789abcdef", "deadbeef", "zz", "é😀", "\n", "==", "hunter2hunter2", "AKIAAKIA", "ſecret"]
    rows = [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(25))), "en", "a") for i in range(300)]
    docs = documents(rows + edges)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["b"]) for r in scan_secrets(docs).select("doc_id", span_text(F.col("base")).alias("b")).collect())
    assert got == sorted((-1 if i is None else i, _base(t)) for i, t, _, _ in rows + edges)
    assert any(b for _, b in got)
    assert scan_secrets(documents([])).count() == 0


def test_secrets_of_very_long_texts(spark, documents):
    """Hundreds of thousands of matches in one text, of all kinds and overlapping: the same spans, in seconds."""
    rng = random.Random(2)
    runs = "\n".join(f"{rng.getrandbits(96):024x}" for _ in range(120_000))
    mixed = " ".join(rng.choice([f"token={rng.getrandbits(80):020x}", f"AKIA{rng.getrandbits(70)}", f"key_{rng.getrandbits(90):X}aZ", "plain words"]) for _ in range(60_000))
    began = time.time()
    got = scan_secrets(documents([(1, runs, "en", "a"), (2, mixed, "en", "b"), (3, runs[:100], "en", "c")]))
    got = {r["doc_id"]: r["b"] for r in got.select("doc_id", span_text(F.col("base")).alias("b")).collect()}
    assert time.time() - began < 400  # by pairs of matches it would be hours
    assert got == {1: _base(runs), 2: _base(mixed), 3: _base(runs[:100])}


def test_generic_spans_give_way_to_base_ones(spark, documents):
    generic = "Zx9Kq2Lm4Np6Rs8Tv0Wy1Ab3"
    texts = {1: generic, 2: f"secret={generic}", 3: f"{generic} token: 0123456789abcd", 4: f"0123456789abcdef {generic} 0123456789abcdef", 5: f"Zq_{'0123456789abcdef'}_X9{generic}"}
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in scan_secrets(documents([(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert got == {1: [3], 2: [0], 3: [3, 0], 4: [2, 3, 2], 5: [2]}


def test_ownership_separates_examples_from_live_values(spark, documents):
    live, copied = "Zx9Kq2Lm4Np6Rs8Tv0Wy1Ab3", "EXAMPLEexample0123456789key"
    rows = [(1, f"use {live} here", "en", "a"), (2, f"again {live}", "en", "a"), *((10 + i, f"see {copied}", "en", f"s{i}") for i in range(4)), (20, f"token = {live}", "en", None)]
    got = {r["doc_id"]: r["spans"] for r in scan_secrets(documents(rows[:-1])).collect()}
    assert [(s["kind"], s["n_owners"], s["n_repositories"], s["live"]) for s in got[1]] == [(3, 1, 2, True)]
    assert all(got[10 + i] == [] for i in range(4))
    got = {r["doc_id"]: r["spans"] for r in scan_secrets(documents(rows)).collect()}
    assert got[1] == [] and [(s["kind"], s["n_owners"], s["live"]) for s in got[20]] == [(0, 2, False)]


# Mixing ----------------------------------------------------------------------


def _targets(sizes):
    """Water filling by repeated resharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 3.0 * sizes[s] for s in over})


def test_mix_reaches_its_targets(spark, documents):
    rng = random.Random(11)
    sources = ["a", "Z", "é", "b", None, "c", "tiny", ""]
    rows = [(i, " ".join(["w"] * rng.randrange(60)) if rng.random() < 0.95 else None, "en", rng.choice(sources[:6] if i > 20 else sources)) for i in range(900)]
    rows += [(1000 + i, " ".join(["w"] * 40), "en", "a") for i in range(500)]
    sizes, by_id = {}, {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        by_id[i] = s
    want = _targets(sizes)
    first = mix(documents(rows), shard_rows=100).collect()
    taken = {}
    for r in first:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(first) == len(rows)
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 16 * (1 + len(sizes))
    for s, w in want.items():
        assert abs(taken[s] - w) <= 40 + 0.02 * w
    again = mix(documents(rows).repartition(7), shard_rows=100).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_seats_go_to_the_highest_quotients(spark, seats):
    """Against a plain loop that gives one seat after another."""
    rng = random.Random(seats)
    shares = {(f"s{i % 4}", i): rng.choice([0.0, 1.0, 1.0, 2.0, 5.5, 40.0, 900.0]) for i in range(40)}
    won = dict.fromkeys(shares, 0)
    for _ in range(seats):
        best = min(shares, key=lambda k: (-shares[k] / (2 * won[k] + 1), k, won[k]))
        won[best] += 1
    frame = spark.createDataFrame([(*k, v) for k, v in shares.items()], "source string, shard long, share double").repartition(3)
    got = sainte_lague(frame, seats, "share", ["source", "shard"], "blocks").collect()
    assert {(r["source"], r["shard"]): r["blocks"] for r in got} == won


def test_mix_edges(spark, documents, edges):
    got = mix(documents(edges)).collect()
    assert len(got) == len(edges)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mix(documents([])).count() == 0
    empty = mix(documents([(1, None, "en", None), (2, "", "en", "a")])).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in empty) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# Token counts ----------------------------------------------------------------


def test_pieces_are_whole():
    text = "a b" * 50 + "é 1 x" * 30
    assert " ".join(pieces(text, 10)) == text
    assert pieces("x" * 100, 10) == ["x" * 100] and pieces("", 10) == [""]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False), ("piece_bpe_32k.model", False)])
def test_token_counts_match_the_library(spark, documents, edges, name, drops):
    P = pytest.importorskip("public_tokenizers")
    odd = [(50, "<|startoftext|> it's 'll <|endoftext|>x\x1cy \x85 é ́a Å", "en", "a"), (51, "words " * 30_000 + "end　of it", "en", "a")]
    rows = edges + odd
    got = token_counts(documents(rows), P.path(name), drops_space=drops, piece_bytes=1000, batch_bytes=5000).collect()
    if name.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode
        want = [len(encode(t or "")) for _, t, _, _ in rows]
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(P.path(name))
        want = [len(model.encode(t or "", add_special_tokens=False)) for _, t, _, _ in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    expected = [(i, len((t or "").encode()), n, n > 2048) for (i, t, _, _), n in zip(rows, want, strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert token_counts(documents([]), P.path(name), drops_space=drops).count() == 0


def test_base_digest_is_of_the_text(spark):
    from shopflow.llm.catalog import QUERIES

    rows = QUERIES["op5_secret_ownership"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents", "doc_id", "text").collect()}
    assert {r["doc_id"]: r["base_sha256"] for r in rows} == {i: hashlib.sha256(_base(t).encode()).hexdigest() for i, t in texts.items()}
