"""Benchmark decontamination (2): template windows with typed placeholders.

A text becomes a sequence of template tokens: numbers, in digits or words,
units after digits and capitalised words inside a sentence are placeholders,
other words their lower-case letters and digits.  A sign of a script without
blanks is a word.  Windows of template tokens of the benchmark
are hash-joined with those of the documents, so a question whose numbers,
units or names were changed still meets its original.  A window with a name
is looked up twice, with the name as a word and with its placeholder.

What a placeholder replaced is its slot.  Within a document and an item,
each original slot value stands for the value it most often meets; windows
that disagree with that reading don't count.  A document is contaminated by
an item if windows at ``least`` of the item's positions agree.

A document that holds an item more than once, each time with other values,
has a reading per copy.  A copy's windows lie about as far from the item's
everywhere, so where the reading of the whole document disagrees, that of
each band of such shifts counts too, in bands of one shift and of twice as
many and so on, so that words may be put in or left out within a copy.

An item can only get there if one of its rarest windows meets, because all
but ``least`` of them may be missing.  Pairs of document and item start from
those, so a phrase that very many items share makes no pairs by itself, and
nothing is lost.

An item shorter than a window has its whole template instead.  A phrase so
short says little inside a text, so it is found where a line of a document
is that template, with slots that agree; if it has fewer than two words
beside its slots, with the same values in them.

Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, aside, staged

# Units that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms oz lb lbs pound pounds "
    "ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes min hour hours h day days week weeks month months "
    "year years dollar dollars euro euros cent cents usd eur percent mph kmh kph hz khz mhz w kw volt volts degree degrees celsius fahrenheit"
).split()

_ONES = "one two three four five six seven eight nine".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
# Numbers in words, as they are without punctuation ("twenty-one" is "twentyone").
NUMBER_WORDS = [
    *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion dozen".split(),
    *_ONES, *_TENS, *[t + o for t in _TENS for o in _ONES],
]

#: Thai, Lao, Burmese, Khmer, kana, Han: scripts without blanks between words.
_UNSPACED = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}]"

#: Placeholders: private-use characters, put before the word they stand for.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
_MARKS = NUMBER + UNIT + NAME

#: Signs that are no sentence punctuation; they go first, so that they part no number from its unit.
_SYMBOLS = "#$%&*+<=>@[\\]^_`{|}~"

_NAME = r"(?<=[\p{L}\p{N},] )(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])"
_NUMBER = r"(?<![\p{L}\p{N}.,])([0-9]+(?:[.,:/][0-9]+)*)(?:\x20?((?i:" + "|".join(UNITS) + r")))?(?![\p{L}\p{N}])"
_OTHER = r"[^\p{L}\p{N}\p{M}\x20\x09-\x0D" + _MARKS + "]+"

#: Distinct windows of the benchmark up to which they are broadcast: about 60 bytes each, so at most about 60 MB.
BROADCAST_ROWS = 1_000_000


def template_text(text: Column) -> Column:
    """The lower-case text with placeholders before the words they stand for, without punctuation."""
    free = F.translate(F.coalesce(text, F.lit("")), _MARKS + _SYMBOLS, "")
    named = F.regexp_replace(free, _NAME, NAME + "$1")
    numbered = F.when(named.rlike("[0-9]"), F.regexp_replace(named, _NUMBER, f"{NUMBER}$1 {UNIT}$2 ")).otherwise(named)
    plain = F.regexp_replace(numbered, _OTHER, "")
    # These signs have three bytes and more; most texts need no look at their signs.
    unspaced = (F.octet_length(plain) > F.length(plain) + 1) & plain.rlike(_UNSPACED)
    return F.lower(F.when(unspaced, F.regexp_replace(plain, f"({_UNSPACED})", " $1 ")).otherwise(plain))


def with_tokens(rows: DataFrame, key: list[str], text: Column) -> DataFrame:
    """``key, _w, _marked``: the template tokens, placeholders put before what they stand for, and whether there are any."""
    words = F.filter(F.split("_t", SPACE), lambda x: (x != "") & (x != UNIT))
    split = rows.select(*key, template_text(text).alias("_t")).select(*key, F.col("_t").rlike(f"[{_MARKS}]").alias("_m"), words.alias("_s"))
    numbers = split.withColumn("_n", F.arrays_overlap("_s", F.array(*[F.lit(w) for w in NUMBER_WORDS])))
    marked = F.transform("_s", lambda x: F.when(x.isin(*NUMBER_WORDS), F.concat(F.lit(NUMBER), x)).otherwise(x))
    return numbers.select(*key, F.when(F.col("_n"), marked).otherwise(F.col("_s")).alias("_w"), (F.col("_m") | F.col("_n")).alias("_marked"))


def _mark(token: Column) -> Column:
    return F.substring(token, 1, 1)


def _value(token: Column) -> Column:
    return F.substring(token, 2, 1 << 30)


def template_windows(rows: DataFrame, key: list[str], text: str, window: int) -> DataFrame:
    """``key, pos, h, slots``: each row's windows of ``window`` template tokens, with the values in their slots.

    Windows of fewer than two literal words say too little and are left out.
    Every token is hashed once, and a window's hash is that of its tokens'
    hashes; only the windows around placeholders are looked at more closely.
    """
    tokens = with_tokens(rows, key, F.col(text))
    first = _mark
    no_slots = F.expr("cast(array() as array<string>)")
    no_starts = F.expr("cast(array() as array<int>)")

    def around(marks: str) -> Column:
        """The starts of the windows that hold a token with one of the marks."""
        at = F.transform("_w", lambda x, i: F.when(first(x).isin(*marks), i))
        near = F.flatten(F.transform(F.filter(at, lambda i: i.isNotNull()), lambda i: F.sequence(F.greatest(i - (window - 1), F.lit(0)), i)))
        return F.when(F.col("_marked"), F.array_distinct(F.filter(near, lambda i: i <= F.size("_w") - window))).otherwise(no_starts)

    hashed = tokens.select(
        *key, "_w", around(_MARKS).alias("_near"), around(NAME).alias("_named"),
        F.when(F.size("_w") >= window, F.sequence(F.lit(0), F.size("_w") - window)).otherwise(no_starts).alias("_starts"),
        # With names as words, and with all placeholders.
        F.transform("_w", lambda x: F.xxhash64(F.when(first(x).isin(NUMBER, UNIT), first(x)).otherwise(F.ltrim(x, F.lit(NAME))))).alias("_p"),
        F.when(F.col("_marked"), F.transform("_w", lambda x: F.xxhash64(F.when(first(x).isin(*_MARKS), first(x)).otherwise(x)))).alias("_n"),
    )

    def whole(i: Column, of: str, slots: Column) -> Column:
        return F.struct(i.alias("pos"), F.xxhash64(*[F.get(F.col(of), i + j) for j in range(window)]).alias("h"), slots.alias("slots"))

    def filled(starts: Column, of: str, marks: str) -> Column:
        held = lambda i: F.transform(F.filter(F.slice("_w", i + 1, window), lambda x: first(x).isin(*marks)), _value)
        return F.filter(F.transform(starts, lambda i: whole(i, of, held(i))), lambda w: F.size(w["slots"]) <= window - 2)

    free = F.when(F.size("_near") == 0, F.col("_starts")).otherwise(F.array_except("_starts", "_near"))
    every = F.concat(
        F.transform(free, lambda i: whole(i, "_p", no_slots)),
        F.when(F.size("_near") == 0, F.expr("cast(array() as array<struct<pos:int,h:bigint,slots:array<string>>>)")).otherwise(
            F.concat(filled(F.col("_near"), "_p", NUMBER + UNIT), filled(F.col("_named"), "_n", _MARKS))
        ),
    )
    return hashed.select(*key, F.explode(every).alias("_x")).select(*key, "_x.pos", "_x.h", "_x.slots")


def agreeing(meeting: DataFrame, by: list[str]) -> DataFrame:
    """``by, found``: the number of item positions whose windows agree with the reading of their group."""
    slots = meeting.filter(F.size("slots") > 0).withColumn("s", F.explode(F.arrays_zip("original", "slots"))).withColumn("o", F.col("s.original"))
    reading = slots.groupBy(*by, "o").agg(F.mode("s.slots", True).alias("v"))
    agree = (
        slots.join(reading, [*by, "o"]).groupBy(*by, "pos", "original", "slots").agg(F.min(F.col("s.slots") == F.col("v")).alias("agrees")).filter("agrees").select(*by, "pos")
    )
    return meeting.filter(F.size("slots") == 0).select(*by, "pos").unionByName(agree).groupBy(*by).agg(F.count_distinct("pos").alias("found"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = 5,
    least: float = 0.8,
) -> DataFrame:
    """``_key, items``: documents that hold benchmark items, with the sorted distinct item ids.

    ``_key`` is ``document_key``.  Items of fewer than ``window`` template
    words are found as lines; null and empty ones, and those of punctuation
    alone, identify nothing.  Repeated items and repeated documents are each
    found.
    """
    items = staged(template_windows(benchmark, [item_id], item_text, window).select(F.col(item_id).alias("item"), "pos", "h", F.col("slots").alias("original")).distinct())
    frequency = staged(items.groupBy("h").agg(F.count_distinct("item").alias("n")).select(F.col("h").alias("bh"), "n"))
    known = frequency.select("bh")
    if frequency.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)

    keyed = docs.select(document_key(F.col(doc_id), F.col(text)).alias("doc"), F.col(text).alias("text"))
    windows = template_windows(keyed, ["doc"], "text", window)
    met = staged(windows.join(known, F.col("h") == F.col("bh")).select("doc", F.col("pos").alias("at"), "h", "slots").distinct())

    # At least ceil(least * n) of an item's n positions must meet: one of its n - ceil(least * n) + 1 rarest does.
    position = items.join(frequency, F.col("h") == F.col("bh")).groupBy("item", "pos").agg(F.min("n").alias("n"))
    ranked = position.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("n", "pos"))).alias("by_rarity"))
    needed = F.ceil(F.size("by_rarity") * F.lit(least)).cast("int")
    sized = staged(ranked.select("item", F.size("by_rarity").alias("positions"), needed.alias("needed"), F.slice("by_rarity", 1, F.size("by_rarity") - needed + 1)["pos"].alias("rare")))
    first = items.join(sized.select("item", F.explode("rare").alias("pos")), ["item", "pos"]).select("item", F.col("h").alias("rh")).distinct()
    pairs = staged(met.select("doc", "h").distinct().join(first, F.col("h") == F.col("rh")).select("doc", "item").distinct())

    def meetings(of: DataFrame, windows: DataFrame, *more: Column) -> DataFrame:
        return of.join(items, "item").join(windows.withColumnsRenamed({"doc": "mdoc", "h": "mh"}), (F.col("doc") == F.col("mdoc")) & (F.col("h") == F.col("mh"))).select(
            "doc", "item", "pos", "original", "slots", *more
        )

    whole = ["doc", "item"]
    meeting = staged(meetings(pairs, met.select("doc", "h", "slots").distinct()))
    enough = sized.select("item", "needed")
    at_once = staged(agreeing(meeting, whole).join(enough, "item").filter("found >= needed").select(*whole))
    # Only where enough positions meet at all can those of one copy be enough.
    rest = meeting.groupBy(*whole).agg(F.count_distinct("pos").alias("found")).join(enough, "item").filter("found >= needed").select(*whole)
    rest = staged(rest.join(at_once, whole, "left_anti"))
    shifted = staged(meetings(rest, met, (F.col("at") - F.col("pos")).alias("shift")))
    reach = shifted.groupBy(*whole).agg((F.max("shift") - F.min("shift") + 1).alias("reach"))
    scales = F.sequence(F.lit(0), F.ceil(F.log2("reach")).cast("int"))
    # Bands of 2^scale shifts, and as many half a band further.
    width = F.expr("shiftleft(1, scale)")
    banded = shifted.join(reach, whole).withColumn("scale", F.explode(scales)).withColumn("half", F.explode(F.when(F.col("scale") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    banded = banded.withColumn("band", F.floor((F.col("shift") + F.col("half") * width / 2) / width)).drop("reach", "shift").distinct()
    copies = agreeing(banded, [*whole, "scale", "half", "band"]).join(enough, "item").filter("found >= needed").select(*whole).distinct()
    held = at_once.unionByName(copies)
    short = short_items(benchmark, item_text, item_id, window)
    if not short.isEmpty():
        held = held.unionByName(_lines_of(keyed, short))
    return held.groupBy(F.col("doc").alias("_key")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _short_forms(tokens: DataFrame, key: str) -> DataFrame:
    """``key, h, slots`` of whole templates ``_w``: with names as words and as placeholders; slot values count in ``h`` where little else does."""

    def form(marks: str) -> Column:
        slots = F.transform(F.filter("_w", lambda x: _mark(x).isin(*marks)), _value)
        template = F.transform("_w", lambda x: F.when(_mark(x).isin(*marks), _mark(x)).otherwise(F.ltrim(x, F.lit(NAME))))
        telling = F.size("_w") - F.size(slots) >= 2
        return F.struct(F.xxhash64(template, F.when(~telling, slots)).alias("h"), slots.alias("slots"))

    return tokens.select(key, F.explode(F.array_distinct(F.array(form(NUMBER + UNIT), form(_MARKS)))).alias("f")).select(key, "f.h", "f.slots")


def short_items(benchmark: DataFrame, item_text: str, item_id: str, window: int) -> DataFrame:
    """``item, h, original``: the forms of the items that are shorter than a window."""
    tokens = with_tokens(benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("line")), ["item"], F.col("line"))
    forms = _short_forms(tokens.filter((F.size("_w") > 0) & (F.size("_w") < window)), "item")
    return staged(forms.withColumnRenamed("slots", "original").distinct())


def _lines_of(keyed: DataFrame, short: DataFrame) -> DataFrame:
    """``doc, item``: documents with a line that is a short item's template with slots that agree."""
    lines = keyed.select("doc", F.explode(F.split("text", "\n")).alias("line")).distinct()
    longest = short.agg(F.max(F.size("original"))).first()[0]  # no more slots than a window has words
    tokens = with_tokens(lines, ["doc"], F.col("line"))
    forms = _short_forms(tokens.filter(F.size("_w") > 0), "doc").filter(F.size("slots") <= longest)
    if short.count() <= BROADCAST_ROWS:
        short = F.broadcast(short)
    met = forms.join(short.withColumnRenamed("h", "sh"), F.col("h") == F.col("sh")).withColumn("s", F.arrays_zip("original", "slots"))
    agree = F.forall("s", lambda x: F.forall("s", lambda y: (x["original"] != y["original"]) | (x["slots"] == y["slots"])))
    return met.filter(agree).select("doc", "item").distinct()


def document_key(doc_id: Column, text: Column) -> Column:
    """A document's id and the hash of its text, so that rows which share an id keep their own findings."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("hash"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with ``items``: the ids of the benchmark items each row holds, null for none.

    Null and empty texts hold none; an empty benchmark or table finds
    nothing; further columns stay and their names don't matter.
    """
    found = staged(contaminated(docs, benchmark, text, doc_id, **options))
    docs, back = aside(docs, text, doc_id)
    return back(docs.join(found, document_key(F.col(doc_id), F.col(text)) == F.col("_key"), "left"), "items")
