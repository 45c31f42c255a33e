"""Operators on pairs and groups of documents: SimHash, MinHash paragraphs, line windows, byte strings, components."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash

from shopflow.llm import paragraph_minhash
from shopflow.llm.graph import components
from shopflow.llm.line_windows import drop_later_lines
from shopflow.llm.lpf_dedup import previous_factors, remove_repeated
from shopflow.llm.paragraph_minhash import SHINGLE, _rare_shingles, paragraph_duplicates
from shopflow.llm.simhash_popcount import links, majority_bits, near_groups, one_of_each_group


def _union(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2040)]
    frame = spark.createDataFrame([*pairs, (7, 7), pairs[0]], "a long, b long")
    got = {r["node"]: r["root"] for r in components(frame).collect()}
    want = _union([p for p in pairs if p[0] != p[1]])
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash -------------------------------------------------------------------


def _fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))], np.uint64)
    bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
    return sum(1 << i for i in range(64) if 2 * int(bits[i]) > len(h))


def test_simhash_groups_match_brute_force(spark, documents, edges):
    base = " ".join(f"w{i}" for i in range(400))
    near = [(100 + i, base.replace(f"w{50 * i}", f"v{i}"), "en", "a") for i in range(6)]
    rows = edges + near + [(90, base, "en", "a")]
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["fp"] & 0xFFFFFFFFFFFFFFFF, r["component_id"]) for r in near_groups(documents(rows)).collect())
    fps = [_fingerprint(t) for _, t, _, _ in rows]
    group = _union([(i, j) for i in range(len(rows)) for j in range(i + 1) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    first = {}
    for i, (doc, _, _, _) in enumerate(rows):
        if doc is not None:
            first[group[i]] = min(first.get(group[i], doc), doc)
    want = sorted((-1 if doc is None else doc, fps[i], first.get(group[i])) for i, (doc, *_) in enumerate(rows))
    assert [x for x in got if x[0] != -1] == [x for x in want if x[0] != -1]
    assert len({c for d, _, c in got if 90 <= d}) < 7  # near copies do meet


def test_links_match_all_pairs(spark):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for k in (1, 2, 3, 4):
            g = f
            for bit in rng.sample(range(64), k):
                g ^= 1 << bit
            fps.append(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    got = {(r["a"], r["b"]) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & 0xFFFFFFFFFFFFFFFF).count("1") <= 3}
    assert got == want


def test_majority_is_over_half():
    assert majority_bits(np.array([1, 1, 2, 2], np.int64)) == 0
    assert majority_bits(np.array([1, 1, 2], np.int64)) == 1
    assert majority_bits(np.array([], np.int64)) == 0
    assert majority_bits(np.array([-1] * 70_000 + [0] * 69_999, np.int64)) == -1


def test_one_document_of_each_group_stays(spark, documents, edges):
    docs = documents(edges)
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    groups = near_groups(docs).select("root").distinct().count()
    assert len(ids) == groups
    texts = [t for _, _, t in ids]
    assert sum(t.startswith("the same text twice") for t in texts) == 1
    assert one_of_each_group(docs.limit(0)).count() == 0


# Line windows ---------------------------------------------------------------


def _lines_brute(rows):
    out = []
    first = {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [x.strip(" \t\x0b\x0c\r") for x in (text or "").split("\n")]
        body = [x for x in lines if x]
        gone = set()
        for k in range(len(body) - 2):
            f = first.setdefault(tuple(body[k : k + 3]), (doc, text, k))
            if f != (doc, text, k):
                gone.update(range(max(k, f[2] + 3) if f[:2] == (doc, text) else k, k + 3))
        kept, k = [], 0
        for raw, x in zip((text or "").split("\n"), lines, strict=True):
            if not x or k not in gone:
                kept.append(raw)
            k += bool(x)
        out.append((doc, None if text is None else "\n".join(kept), len(body), len(gone)))
    return out


def test_line_windows_match_brute_force(spark, documents):
    rng = random.Random(7)
    lines = [f"line {i}" for i in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12))), "en", "a") for i in range(60)]
    rows += [(70, None, "en", "a"), (71, "a\na\na\na\na\na\na", "en", "a"), (72, " a\na\t\na", "en", "a")]
    docs = documents(rows)
    got = drop_later_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect())
    assert got == sorted(_lines_brute([(i, t) for i, t, _, _ in rows]))


def test_line_windows_edges(spark, documents, edges):
    got = drop_later_lines(documents(edges)).select("doc_id", "text", "n_removed").collect()
    assert len(got) == len(edges)
    gone = {(r["doc_id"], r["n_removed"]) for r in got if r["n_removed"]}
    assert gone == {(7, 4)}  # rows equal in id and text are one document
    assert [r["text"] for r in got if r["doc_id"] == 1] == [None]
    assert drop_later_lines(documents([])).count() == 0


# Byte strings ---------------------------------------------------------------


def _bytes_brute(rows, length=50):
    first = {}
    order = sorted((-1 if i is None else i, (t or "").encode()) for i, t in rows)
    for i, t in order:
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    out = []
    for i, t in order:
        until, spans, kept, was = 0, 0, bytearray(), False
        for p in range(len(t)):
            if p + length <= len(t) and first[t[p : p + length]] < i:
                until = p + length
            if p < until:
                spans += not was
            else:
                kept.append(t[p])
            was = p < until
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(bytes(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("heavy", [3, 1000])
def test_repeated_bytes_match_brute_force(spark, documents, heavy):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)] + ["ab" * 60, "a" * 130]
    rows = []
    for i in range(80):
        parts = [rng.choice(passages)[rng.randrange(30) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(20))) for _ in range(4)]
        rows.append((i * 3, "|".join(parts), "en", "a"))
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, passages[0], "en", "a"), (1002, passages[0], "en", "a"), (None, passages[1], "en", "a")]
    got = remove_repeated(documents(rows).repartition(5), block_bytes=2000, heavy=heavy)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.drop("kept", "spans").collect())
    assert got == _bytes_brute([(i, t) for i, t, _, _ in rows])


def test_repeated_bytes_edges(spark, documents, edges):
    got = remove_repeated(documents(edges))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.drop("kept", "spans").collect())
    assert got == _bytes_brute([(i, t) for i, t, _, _ in edges])
    assert remove_repeated(documents([])).count() == 0


def test_dedup_leaves_no_table_behind(spark, documents):
    before = {t.name for t in spark.catalog.listTables()}
    text = "a passage that two documents share, and that is longer than fifty bytes of text. "
    got = remove_repeated(documents([(1, text, "en", "a"), (2, "x" + text, "en", "a")]))
    assert {t.name for t in spark.catalog.listTables()} == before
    assert {r["doc_id"]: (r["n_removed"], r["kept"]) for r in got.collect()} == {1: (0, bytearray(text.encode())), 2: (len(text), bytearray(b"x"))}


def test_longest_previous_factors_decide():
    """Random contexts over few letters against a plain search in smaller documents."""
    rng = random.Random(4)
    for _ in range(30):
        base = bytes(rng.choice(b"ab") for _ in range(90))
        contexts = list({base[(s := rng.randrange(20)) : s + rng.randrange(30, 60)] if rng.random() < 0.8 else bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(12)})
        docs = np.array([rng.randrange(6) for _ in contexts])
        got = previous_factors(contexts, docs, 30)
        for c, doc, mask in zip(contexts, docs, got):
            for j in range(len(c) - 29):
                earlier = any(c[j : j + 30] in o for o, d in zip(contexts, docs) if d < doc)
                assert bool(int(mask) >> j & 1) == earlier


def test_previous_factors_of_small_contexts():
    text = b"0123456789" * 8
    masks = previous_factors([text[:50], text[:60], text[5:60]], np.array([5, 3, 9]), 50)
    assert [bin(int(m)).count("1") for m in masks] == [1, 0, 6]


# Paragraphs -----------------------------------------------------------------


def _paragraphs(rows, least=SHINGLE):
    for doc, text in rows:
        place = start = 0
        text = text or ""
        for i in range(len(text) + 1):
            if i < len(text) and text[i] != "\n" and not (i and text[i - 1] in ".!?" and text[i].isspace()):
                continue
            w = text[start:i].lower().split()
            if len(w) >= least:
                yield doc, place, (start, i), tuple(w)
                place += 1
            start = i + (i < len(text) and text[i] == "\n")


def test_paragraphs_match_brute_force(spark, documents):
    rng = random.Random(9)
    sentence = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    shared = [sentence(rng.randrange(6, 60)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(5):
            s = rng.choice(shared).split() if rng.random() < 0.4 else sentence(9).split()
            if rng.random() < 0.5:
                s[-1] = f"e{rng.randrange(10)}"
            parts.append(" ".join(s) + rng.choice([". ", ".\n", "! "]))
        rows.append((i, "".join(parts), "en", "a"))
    rows += [(100, None, "en", "a"), (101, "", "en", "a"), (102, "too short here.", "en", "a")]
    every = list(_paragraphs([(i, t) for i, t, _, _ in rows]))
    sets = [{w[k : k + 5] for k in range(len(w) - 4)} for *_, w in every]
    near = [(i, j) for i in range(len(every)) for j in range(i + 1) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = _union(near)
    first = {}
    for i, (doc, place, _, _) in enumerate(every):
        first[group[i]] = min(first.get(group[i], (doc, place)), (doc, place))
    want = {doc: [] for doc, *_ in rows}
    for i, (doc, place, span, _) in enumerate(every):
        if first[group[i]] != (doc, place):
            want[doc].append(span)
    for options in ({}, {"bucket": 2, "block": 2}):
        got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in paragraph_duplicates(documents(rows), **options).collect()}
        assert got == want


def _openings(rng, n, copies):
    """Texts of one opening and own words after it; every ``copies``-th is followed by a copy with one word changed."""
    opening = " ".join(f"open{i}" for i in range(14))
    out = []
    for i in range(n):
        own = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        out.append(f"{opening} {' '.join(own)}")
        if i % copies == 0:
            out.append(f"{opening} {' '.join([*own[:-1], 'changed'])}")
    return out


def test_a_shared_opening_brings_nothing_together(spark, documents):
    """Work grows with the number of texts, not with its square, and the near copies among them are found."""
    rng = random.Random(12)
    took = []
    for n in (1500, 6000):
        texts = _openings(rng, n, 50)
        began = time.time()
        found = {r["doc_id"] for r in paragraph_duplicates(documents([(i, t, "en", "a") for i, t in enumerate(texts)])).collect() if r["spans"]}
        took.append(time.time() - began)
        assert found == {i for i, t in enumerate(texts) if t.endswith("changed")}
    assert took[1] < 5 * took[0]


def test_similar_sets_share_a_rare_shingle(spark):
    rng = random.Random(13)
    sets = {}
    for i in range(120):
        base = sets[rng.choice(list(sets))] if sets and rng.random() < 0.6 else [rng.randrange(300) for _ in range(rng.randrange(1, 25))]
        sets[i] = sorted(set(base[: len(base) - rng.randrange(3)] + [rng.randrange(300) for _ in range(rng.randrange(2))])) or [1]
    rare = {}
    for r in _rare_shingles(spark.createDataFrame([(i, x) for i, x in sets.items()], "node long, shingles array<long>"), 0.8).collect():
        rare.setdefault(r["node"], set()).add(r["key"])
    near = [(a, b) for a in sets for b in range(a) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))]
    assert len(near) > 20 and all(rare[a] & rare[b] for a, b in near)


def test_paragraph_edges(spark, documents, edges):
    got = paragraph_duplicates(documents(edges))
    assert got.count() == len(edges)
    by_id = {r["doc_id"]: (len(r["spans"]), r["first_docs"]) for r in got.collect()}
    assert by_id[7] == (1, [6]) and by_id[1] == (0, [])
    assert paragraph_duplicates(documents([])).count() == 0


def test_occurrences_are_written_once(spark, documents, monkeypatch):
    """What is written after them is a row per node that repeats or is like another, not one per occurrence."""
    rng = random.Random(14)
    rows = [(i, " ".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + "." for _ in range(6)), "en", "a") for i in range(150)]
    rows += [(200, rows[3][1], "en", "a"), (201, " ".join([*rows[5][1].split()[:29], "changed."]), "en", "a")]
    sizes, staged = [], paragraph_minhash.staged

    def counted(frame):
        out = staged(frame)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(paragraph_minhash, "staged", counted)
    got = {r["doc_id"]: (len(r["spans"]), r["first_docs"]) for r in paragraph_duplicates(documents(rows)).collect() if r["spans"]}
    assert got == {200: (6, [3]), 201: (1, [5])}
    assert sizes[0] == 150 * 6 + 7 and sum(n > 100 for n in sizes) == 1


def test_a_passage_inside_other_text_is_found(spark, documents):
    passage = " ".join(" ".join(f"p{j}x{i}" for i in range(9)) + "." for j in range(7))
    rows = [(1, passage, "en", "a"), (2, "some words before it " + passage + " and some after it", "en", "b"), (3, "clean text of its own that nothing else has in common.", "en", "b")]
    got = {r["doc_id"]: len(r["spans"]) for r in paragraph_duplicates(documents(rows)).collect()}
    assert got[2] >= 6 and got[1] == got[3] == 0


def test_copies_of_short_sentences_are_found(spark, documents):
    rng = random.Random(11)
    junk = " ".join("".join(rng.choice("ABCDEFGH") for _ in range(6)) + rng.choice(["!!", ".!!", "?"]) for _ in range(150))
    verse = "\n".join(" ".join(f"v{j}x{i}" for i in range(1 + j % 4)) for j in range(20))
    lines = ["春眠不觉晓处处闻啼鸟", "夜来风雨声花落知多少", "白日依山尽黄河入海流"]
    texts = {
        1: junk, 2: junk, 3: "one word. " + junk.lower() + " Two.",
        4: verse, 5: "Something\nelse\n" + verse + "\nafter it", 6: "Hello you", 7: "hello  you", 8: "Hello them",
        9: "\n".join(lines), 10: "新的文字在这里。" + lines[1] + "。另外的文字也在这里", 11: "la. " * 12, 12: "Yes.\nNo.\nA sentence of its own, with ten words.",
    }
    found = paragraph_duplicates(documents([(i, t, "en", "a") for i, t in texts.items()]))
    got = {r["doc_id"]: "".join(texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]).split() for r in found.collect()}
    want = {i: [] for i in texts} | {2: junk.split(), 3: junk.lower().split(), 5: verse.split(), 7: ["hello", "you"], 11: ["la."] * 7}
    assert {i: x for i, x in got.items() if i != 10} == {i: x for i, x in want.items() if i != 10}
    assert "".join(got[10]).strip("。") == lines[1]
