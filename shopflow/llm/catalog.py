"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_fragments
from .common import staged, table
from .decontaminate import decontaminate
from .hilbert_neighbours import nearest
from .language_crf import learn, predict
from .line_windows import drop_later_lines
from .lpf_dedup import remove_repeated
from .mixing import mix
from .oracle import LINE_WINDOWS, SECRETS, SPELLING
from .oracle import lloyd as lloyd_sql
from .paragraph_minhash import paragraph_duplicates
from .secret_ownership import scan_secrets, span_text
from .sharded_lloyd import lloyd
from .simhash_popcount import fingerprint_text, near_groups
from .spelling_blocks import spelling_forms
from .token_counts import token_counts


def op1_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0, top=20)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate(docs, benchmark)
    items = F.coalesce("items", F.expr("cast(array() as array<bigint>)"))
    return found.select("doc_id", (F.size(items) > 0).alias("contaminated"), F.array_join(items.cast("array<string>"), ",").alias("items"))


def held_out(doc_id: Column) -> Column:
    """Rows that languages are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = learn(docs, ~held_out(F.col("doc_id")))
    labelled = predict(docs.select("doc_id", "text"), model)
    return labelled.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraph_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_removed"), spans.alias("spans"), "first_docs")


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op6_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select("doc_id", fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op7_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated(table(spark, sf_dir, "documents", "doc_id", "text"), length=50, texts=False)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), drops_space=True)


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_later_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_bpe_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe_fragments.encode(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary)
    decoded = bpe_fragments.decode(encoded, vocabulary)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_spelling_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = lloyd(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=40, rounds=5, dims=64, scale=256, seed="2")
    found = staged(found)
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # one row per centroid
    total = sum(inertia.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(c, inertia[c], total, digest(centroids[c].tolist())) for c in sorted(inertia)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_neighbours": op1_hilbert_neighbours,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_crf": op3_language_crf,
    "op4_paragraph_minhash": op4_paragraph_minhash,
    "op5_secret_ownership": op5_secret_ownership,
    "op6_simhash_popcount": op6_simhash_popcount,
    "op7_lpf_dedup": op7_lpf_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_token_counts": op9_token_counts,
    "op10_line_windows": op10_line_windows,
    "op11_bpe_fragments": op11_bpe_fragments,
    "op12_spelling_blocks": op12_spelling_blocks,
    "op13_sharded_lloyd": op13_sharded_lloyd,
    "pipeline": pipeline,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_secret_ownership": SECRETS,
    "op10_line_windows": LINE_WINDOWS,
    "op12_spelling_blocks": SPELLING,
    "op13_sharded_lloyd": lloyd_sql(),
}
