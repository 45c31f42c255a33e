"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of ``documents``; the last adds
``size, target, taken`` and leaves out what the mix takes nothing of.

Every stage keeps further columns, and defines what becomes of nulls, empty
texts, ties and repeated rows in its operator's docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.catalog import held_out
from shopflow.llm.common import aside, staged, table
from shopflow.llm.decontaminate import decontaminate
from shopflow.llm.language_crf import UNKNOWN, learn, predict
from shopflow.llm.line_windows import drop_later_lines
from shopflow.llm.mixing import mix
from shopflow.llm.simhash_popcount import one_of_each_group

#: A text whose best language has a smaller share of its words than this is of no language.
LEAST_SHARE = 0.3


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` again what the text has, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter or without a language that leads; all others stay as they are."""
    model = learn(docs, ~held_out(F.col("doc_id")))
    if not model.languages:  # nothing to learn from: only texts without a letter are rejected
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rest, back = aside(docs, "text")
    labelled = predict(rest, model)
    return back(labelled.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows; a document of which nothing is left goes."""
    rest, back = aside(docs, "text", "doc_id")
    kept = drop_later_lines(rest).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return _with_length(back(kept))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-copies stays."""
    return one_of_each_group(docs, shingle=3, most_bits=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rest, back = aside(docs, "text", "doc_id")
    return back(decontaminate(rest, table(spark, sf_dir, "benchmark", "item_id", "text")).filter(F.col("items").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with ``size, target, taken``.

    Rows equal in id and text count as one document, and each of them is
    given its share.
    """
    key = lambda: F.struct(F.col("doc_id"), F.xxhash64("text").alias("hash"))
    rows = docs.select(key().alias("doc_id"), "source", "text").dropDuplicates(["doc_id"])
    taken = staged(mix(rows).filter("taken > 0").select(F.col("doc_id").alias("_key"), "size", "target", "taken"))
    rest, back = aside(docs, "doc_id", "text")
    return back(rest.join(taken, key().eqNullSafe(F.col("_key"))), "size", "target", "taken")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
]

#: The language stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
