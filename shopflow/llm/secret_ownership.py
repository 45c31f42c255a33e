"""Secret scans (5): candidates, and how widely each value is owned over the corpus.

Three base kinds come from fixed patterns.  The method adds a fourth kind,
``owned``: values of a generic credential shape that only one owner holds.
Every candidate's hash is counted over distinct repositories and owners in
the whole corpus: a value that many owners copied is an example, one that
stays with its owner looks live.

Only DataFrame functions: a text is split at a pattern's matches, and running
sums of the lengths of the pieces and of the matches give the spans in code
points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

# Fixed patterns.  (?i:...) is ASCII only, as the letters of the contract are.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: The value of an assign match: what follows the separator.  A keyword holds neither : nor =.
ASSIGN_VALUE = r"""^[^:=]+[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Maximal runs: a run is a match of the open pattern, and the least length is a part of it here.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: The generic shape behind the added kind: a long run with a digit, a small and a capital letter.
GENERIC = r"[A-Za-z0-9_-]{20,}"

KINDS = ["assign", "access", "hex", "owned"]


_FOUND = "array<struct<kind:int,gap:int,match:string>>"


def matches_of(kind: int, text: Column, pattern: str) -> Column:
    """Structs ``kind, gap, match`` of the leftmost non-overlapping matches; ``gap`` is the code points since the one before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)), 1, F.size(matches))
    typed = F.transform(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda x: F.struct(F.lit(kind).alias("kind"), x["g"].alias("gap"), x["m"].alias("match")))
    return F.when(text.rlike(pattern), typed).otherwise(F.expr(f"cast(array() as {_FOUND})"))


def spans_of(found: DataFrame) -> DataFrame:
    """One row per span of ``found`` (``row``, ``matches`` and others): ``kind, start, end, value``.

    Places are running sums over the matches of a row and kind, in windows:
    the work grows with the number of matches, also of one text that has
    millions.  Matches whose value is too short, or not of the mixed shape,
    count in the sums and go then.  Spans of the generic kind go where a base
    span overlaps them: one that begins before reaches into them, or the
    next one begins before their end.
    """
    others = [c for c in found.columns if c != "matches"]
    each = found.select(*others, F.posexplode("matches").alias("pos", "m")).select(*others, "pos", "m.kind", "m.gap", "m.match")
    so_far = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far).cast("int"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN_VALUE, 1)).otherwise(F.col("match"))
    spans = placed.select(*others, "kind", (F.col("end") - F.length("match")).alias("start"), "end", value.alias("value"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    spans = spans.filter(F.when(F.col("kind") == 0, F.length("value") >= 12).when(F.col("kind") == 3, mixed).otherwise(True))
    base = F.col("kind") < 3
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = spans.withColumn("reached", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(after))
    covered = (F.coalesce(F.col("reached"), F.lit(0)) > F.col("start")) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return met.filter(base | ~covered).drop("reached", "next")


def ownership(found: DataFrame, most_owners: int = 1) -> DataFrame:
    """``value_hash, n_repositories, n_owners, live`` per candidate value of ``found`` (value_hash, repository, owner).

    The rows of a value are combined per owner and repository before any
    shuffle, so a value that everyone copied is counted as cheaply as others.
    A null owner is one owner.
    """
    per_owner = found.groupBy("value_hash", "repository", "owner").agg(F.lit(1).alias("one"))
    per_repo = per_owner.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    counted = per_repo.groupBy("value_hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    return counted.withColumn("live", F.col("n_owners") <= most_owners)


def scan_secrets(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    repository: str = "doc_id",
    owner: str = "source",
    most_owners: int = 1,
) -> DataFrame:
    """``doc_id, base, spans`` per row: arrays of ``start, end, kind, n_repositories, n_owners, live``.

    ``base`` has the spans of the three fixed kinds, ``spans`` also those of
    the generic shape whose value at most ``most_owners`` owners hold, and
    that no base span overlaps.  Null texts are empty and have no spans;
    repeated rows each keep their spans and count as one repository.  The
    work grows in proportion to a text's length and its matches: a text of
    millions of matches is one row whose spans are sorted like others.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(repository).alias("repository"), F.col(owner).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    patterns = (ASSIGN, ACCESS, HEX, GENERIC)
    matches = F.concat(*[matches_of(kind, F.col("text"), pattern) for kind, pattern in enumerate(patterns)])
    found = staged(rows.select("doc_id", "repository", "owner", matches.alias("matches")).withColumn("row", F.expr("uuid()")))
    each = spans_of(found.select("row", "repository", "owner", "matches"))
    each = staged(each.select("row", "repository", "owner", "kind", "start", "end", F.sha2("value", 256).alias("value_hash")))
    known = staged(ownership(each.select("value_hash", "repository", "owner"), most_owners).withColumnRenamed("value_hash", "hash"))
    rated = each.join(known, F.col("value_hash") == F.col("hash")).filter((F.col("kind") < 3) | F.col("live"))
    per_row = rated.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_repositories", "n_owners", "live"))).alias("spans"))
    joined = found.select("doc_id", "row").join(per_row.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,n_repositories:bigint,n_owners:bigint,live:boolean>>)"))
    return joined.select("doc_id", spans.alias("spans")).withColumn("base", F.filter("spans", lambda s: s["kind"] < 3))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined, in the order of the array."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
