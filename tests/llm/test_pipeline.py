"""The pipeline's stages, alone and in order, and the registered SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shopflow.llm.catalog import ORACLE_SQL, QUERIES
from oracle_compare import compare
from test_pairs import _fingerprint, _lines_brute, _union
from test_rows import _targets

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_all_edges(spark, documents, edges):
    docs = documents(edges)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= len(edges), name
        assert stage(spark, documents([]), SF).count() == 0, name
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert set(docs.columns) <= set(mixed.columns) and {"size", "target", "taken"} <= set(mixed.columns)
    assert mixed.filter("taken <= 0").count() == 0
    assert corpus_pipeline.mix_sources(spark, documents([]), SF).count() == 0


def test_each_stage_decides_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for _name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= given and kept
        given = kept
    rows = sorted((r["doc_id"], r["taken"], r["text"]) for r in docs.collect())
    assert rows == sorted((r["doc_id"], r["taken"], r["text"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_planted_rows_against_plain_stages(spark, tmp_path):
    """Copies, near copies, shared lines and benchmark items among clean documents: run()'s rows follow from plain Python stages."""
    rng = random.Random(21)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "de", "fo", "gu", "ki") for b in ("ra", "lo", "mi", "tu") for c in ("n", "s", "l", "")]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    text = lambda lines=8: "\n".join(line(rng.randrange(9, 30)) for _ in range(lines))
    items = [line(25) for _ in range(4)]
    passage = "\n".join(line(12) for _ in range(4))
    rows, clean = [], set()

    def add(t, kind=None):
        rows.append((len(rows), t, "en", rng.choice(["a", "b", "c", None])))
        if kind == "clean":
            clean.add(rows[-1][0])
        return rows[-1][1]

    for i in range(60):
        own = add(text(), "clean")
        if i % 6 == 0:
            add(own)  # an exact copy: line dedup leaves nothing of it
            words = own.split(" ")
            add(" ".join([*words[:40], "changed", *words[41:]]))
        if i % 7 == 0:
            add(f"{text(3)}\n{passage}\n{text(3)}")
        if i % 10 == 0:
            add(f"{text(2)} {items[i // 10 % 4]} {text(2)}", "leak")
        if i % 9 == 0:
            base = line(400)
            add(base, "clean")
            add(base.replace(" ", "  ", 5))  # one line each: no window of lines, so that near-dedup meets them
    for t in (None, "", "12 34", "...", "!"):
        add(t)
    leaks = {i for i, t, *_ in rows if t and any(x in t for x in items)}
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # The first stage is a fitted model: here one language, so whatever has letters stays.
    now = {r["doc_id"]: r["text"] for r in corpus_pipeline.identify_language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert now == {i: t for i, t, *_ in rows if t and re.search("[a-z]", t)}
    now = {i: t for i, t, n, gone in _lines_brute(list(now.items())) if gone == 0 or gone < n}
    fps = {i: _fingerprint(t) for i, t in now.items()}
    group = _union([(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3])
    now = {i: t for i, t in now.items() if group.get(i, i) == i}
    windows = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)}
    held = [windows(x) for x in items]
    now = {i: t for i, t in now.items() if not any(len(windows(t) & w) >= 0.8 * len(w) for w in held)}
    assert leaks and not leaks & set(now) and clean <= set(now) and len(now) < len(rows) - 25

    source = {i: s for i, _, _, s in rows}
    size = {i: len(t.split()) for i, t in now.items()}
    sizes = {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r["doc_id"] for r in got}) == len(got) and {r["doc_id"]: r["text"] for r in got}.items() <= now.items()
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 < r["taken"] <= 3 * r["size"] and r["n_chars"] == len(r["text"])
        assert abs(r["target"] - _targets(sizes)[r["source"]]) < 1e-6 * r["target"]
        taken[r["source"]] += r["taken"]
    for s, want in _targets(sizes).items():
        assert abs(taken[s] - want) <= 40 + 0.02 * want


def test_clean_documents_pass_the_language_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.count() >= 0.98 * docs.filter(F.col("text").rlike(r"\p{L}")).count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_registered_sql(spark, name):
    assert compare(spark, name, SF, QUERIES, ORACLE_SQL) == []
