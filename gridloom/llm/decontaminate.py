"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, quantities, units and names become typed placeholders; the remaining words are lower-cased and
stripped of outer punctuation. A capital that starts a sentence may be a name, and a number word a number: a
window that holds one has a second form with placeholders for them, and each form of an item's window meets each
form of a document's. Windows of five template words of every benchmark item are joined by their hash of 64 bits
to those of all documents. For each alignment the slots must be consistent: the
same value in the item always stands for the same value in the document. A document is contaminated by
an item if consistent alignments cover at least 0.8 of the item's windows: exact quotes and questions with
new parameters alike.

The benchmark's windows are broadcast if they are few. Of a larger benchmark only the windows' hashes are, in blocks
of a fixed number, each of them one pass over the documents; what they find is then joined to the windows. What is
broadcast is bounded however large the benchmark is; document windows are never shuffled, only matches are.

Items with fewer than five words, or none of three plain words in a window, have no windows that count: they are
found where a whole line of a document is the item, but for case, spacing and outer punctuation.

Defined cases: null texts have no windows; a text of any length takes time in proportion to it; items without words
can't be matched; repeated rows give one pair; a null doc_id is reported as null; an empty table gives no pairs; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 5
COVERAGE = 0.8
#: Plain words that a benchmark window must have to count.
LEAST_PLAIN = 3
#: And its other form, where capitals that start sentences are names and number words numbers.
LEAST_PLAIN_OTHER = 2
_ONES = "one two three four five six seven eight nine".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = [*_ONES, *"ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen dozen hundred thousand million billion".split(), *_TENS, *(f"{t}-{o}" for t in _TENS for o in _ONES)]
#: Stands before a capitalised token that is no name by its place.
_MARK = "\x01"
#: Benchmark windows that are broadcast whole (about 200 bytes each); of more, the hashes are, so many at a time.
BLOCK_WINDOWS = 100_000
BLOCK_HASHES = 1_000_000
SPACE = "[\\x20\\x09-\\x0D]"
#: Units of measure that may follow a number.
UNITS = "km kg cm mm mg ml m g l s h hz khz mhz ghz kb mb gb tb min sec hr hrs ft lb lbs oz mi mph kmh percent dollars euros cents pounds hours minutes seconds days weeks months years miles meters metres grams litres liters degrees".split()
_NUMBER = "[+-]?[0-9][0-9.,:/]*"


_EDGE = "[.,;:!?)\\]\"'%]*(?![^\\x20\\x09-\\x0D])"
_START = "(?<![^\\x20\\x09-\\x0D])[(\\[\"'$]*"


def names(text):
    """Capitalised tokens that do not start a sentence become <name>. The letter is tried before what stands in
    front of it, which few places then need."""
    return F.regexp_replace(text, f"\\p{{Lu}}(?<=[^.!?:\\x20\\x09-\\x0D]{SPACE}{{1,8}}\\p{{Lu}})[^\\x20\\x09-\\x0D]*", "<name>")


def marked(text):
    """Capitalised tokens that are left, those that start a sentence, get a mark."""
    return F.regexp_replace(text, "\\p{Lu}(?<![^\\x20\\x09-\\x0D]\\p{Lu})", f"{_MARK}$0")


def numbers(text):
    """Numbers, numbers with a unit, and units after a number become <number>, <quantity> and <unit>."""
    units = "|".join(UNITS)
    out = F.regexp_replace(text, f"{_START}{_NUMBER}(?i:{units}){_EDGE}", "<quantity>")
    out = F.regexp_replace(out, f"{_START}{_NUMBER}{_EDGE}", "<number>")
    return F.regexp_replace(out, f"(?<=<number>{SPACE}{{1,8}})(?i:{units}){_EDGE}", "<unit>")


def tokens(text):
    return F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))


def _hash(word: str) -> int:
    """xxhash64 of a string as Spark has it."""
    h = xxhash.xxh64_intdigest(word.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


_EDGES = ".,;:!?\"'()[]"


def _trimmed(words):
    return F.transform(words, lambda w: F.btrim(w, F.lit(_EDGES + _MARK)))


def windows(texts: DataFrame, key: str, text: str, words: bool = False) -> DataFrame:
    """One row a window of a text, and for each form of it that there is: id, pos, other (the second form), h (hash of the
    template words), v (hashes of the words as written). words: with the template words, t. A text without windows has
    one row without h. Rows are narrow: none holds more of its text than the window."""
    one = texts.select(texts[key].alias("id"), F.coalesce(texts[text], F.lit("")).alias("t"))
    one = one.select("id", "t", marked(names(F.col("t"))).alias("named"))
    # a text without digits has nothing else to replace
    one = one.select("id", "t", F.lower(F.when(F.col("named").rlike("[0-9]"), numbers(F.col("named"))).otherwise(F.col("named"))).alias("low"))
    one = one.select("id", F.transform(tokens(F.col("t")), lambda w: F.xxhash64(F.btrim(w, F.lit(_EDGES)))).alias("v"), tokens(F.col("low")).alias("marks"))
    one = one.select("id", "v", "marks", _trimmed("marks").alias("canon"))
    one = one.select("id", "v", "marks", "canon", F.transform("canon", lambda w: F.xxhash64(w)).alias("h"))
    # the other form by hashes alone: a number word is a number, else a capital that starts a sentence a name
    g = F.transform("h", lambda x, i: F.when(x.isin([_hash(w) for w in NUMBER_WORDS]), F.lit(_hash("<number>"))).when(F.get("marks", i).startswith(_MARK), F.lit(_hash("<name>"))).otherwise(x))
    one = one.select("id", "v", "marks", "canon", "h", g.alias("g"))
    win = lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(c, i + k) for k in range(1, WINDOW)]))
    beside = lambda c, name: [F.slice(c, k + 1, 1 << 30).alias(f"{name}{k}") for k in range(WINDOW)]
    sides = ["v", *(("canon", "marks") if words else ())]
    one = one.select("id", win("h").alias("first"), win("g").alias("second"), *[x for c in sides for x in beside(c, c)])
    zipped = F.slice(F.arrays_zip("first", "second", *[f"{c}{k}" for c in sides for k in range(WINDOW)]), 1, F.size("first"))
    # outer: the filter that Spark derives for an inner explode would be pushed down and compute all windows anew
    each = one.select("id", F.posexplode_outer(zipped).alias("pos", "w")).select("id", "pos", "w.*")
    forms = F.array(F.struct(F.col("first").alias("h"), F.lit(False).alias("other")), F.struct(F.when(F.col("second") != F.col("first"), F.col("second")).alias("h"), F.lit(True).alias("other")))
    each = each.withColumn("form", F.explode(forms)).select("*", "form.*")
    row = lambda c: F.array(*[F.col(f"{c}{k}") for k in range(WINDOW)])
    if not words:
        return each.select("id", "pos", "other", "h", row("v").alias("v"))
    named = lambda w, i: F.when(w.isin(NUMBER_WORDS), F.lit("<number>")).when(F.get(row("marks"), i).startswith(_MARK), F.lit("<name>")).otherwise(w)
    return each.select("id", "pos", "other", "h", row("v").alias("v"), F.when(F.col("other"), F.transform(row("canon"), named)).otherwise(row("canon")).alias("t"))


def _line(text: Column) -> Column:
    """Hash of a line but for case, spacing and outer punctuation; null if it has no words."""
    words = F.filter(_trimmed(tokens(F.lower(text))), lambda w: w != "")
    return F.when(F.size(words) > 0, F.xxhash64(F.array_join(words, " ")))


def matches(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, verbatim) of every contaminated pair; n_windows is 0 for an item
    that was found as a line."""
    plain = F.size(F.filter("t", lambda w: ~w.startswith("<") & (w != "")))
    bench = windows(benchmark, item, item_text, words=True).filter("h is not null").filter(plain >= F.when(F.col("other"), LEAST_PLAIN_OTHER).otherwise(LEAST_PLAIN))
    bench = bench.select(F.col("id").alias("item_id"), "h", F.col("pos").alias("item_pos"), F.col("other").alias("item_other"), F.col("v").alias("item_v"), F.transform("t", lambda w: w.startswith("<")).alias("slot")).dropDuplicates(["item_id", "item_pos", "item_other"])
    bench = written(bench, "windows")
    # the first form tells which windows count
    counted = bench.filter(~F.col("item_other")).select(F.col("item_id").alias("i"), F.col("item_pos").alias("p"))
    bench = bench.join(counted, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_pos") == F.col("p")), "left_semi")
    sizes = bench.filter(~F.col("item_other")).groupBy("item_id").agg(F.count("*").alias("n_windows"))
    total = bench.count()
    small = total <= BLOCK_WINDOWS

    each = windows(docs, key, text)
    if small:
        hits = each.join(F.broadcast(bench), "h")
    else:
        blocks = -(-total // BLOCK_HASHES)
        hashes = bench.select("h").distinct()
        found = [each.join(F.broadcast(hashes.filter(F.pmod("h", F.lit(blocks)) == k) if blocks > 1 else hashes), "h", "left_semi") for k in range(blocks)]
        hits = reduce(DataFrame.unionByName, found).join(bench, "h")
    slots = F.filter(F.transform("slot", lambda s, i: F.when(s, F.struct(F.get("item_v", i).alias("was"), F.get("v", i).alias("is")))), lambda x: x.isNotNull())
    hits = hits.select(F.col("id").alias("doc_id"), "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), (F.col("item_other") | F.col("other")).alias("by_other"), slots.alias("slots"))
    first = lambda c: F.when(~F.col("by_other"), F.col(c))
    lined = hits.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
        F.collect_set(first("item_pos")).alias("first_places"), F.array_distinct(F.flatten(F.collect_set(first("slots")))).alias("first_slots"),
    )
    consistent = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["was"]))) == F.size(c)
    # where the other form's slots do not fit, the first form's stand alone
    lined = lined.withColumn("all_fit", consistent("slots")).filter(F.col("all_fit") | (consistent("first_slots") & (F.size("first_places") > 0)))
    lined = lined.select("doc_id", "item_id", *[F.when(F.col("all_fit"), F.col(c)).otherwise(F.col(f"first_{c}")).alias(c) for c in ("places", "slots")])
    same = F.forall("slots", lambda x: x["was"] == x["is"])
    pairs = lined.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"), F.min(same).alias("verbatim"))
    out = pairs.join(F.broadcast(sizes) if small else sizes, "item_id").withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    out = out.filter(F.col("coverage") >= COVERAGE).select("doc_id", "item_id", "n_windows", "n_matched", "coverage", "verbatim")

    # items without windows that count
    short = benchmark.select(benchmark[item].alias("item_id"), _line(benchmark[item_text]).alias("line")).filter("line is not null")
    short = written(short.join(sizes.select(F.col("item_id").alias("has")), F.col("item_id").eqNullSafe(F.col("has")), "left_anti").distinct(), "short")
    n = short.count()
    if not n:
        return out
    lines = docs.select(docs[key].alias("doc_id"), F.explode_outer(F.array_distinct(F.transform(F.split(F.coalesce(docs[text], F.lit("")), "\n", -1), _line))).alias("line"))
    whole = lines.join(F.broadcast(short) if n <= BLOCK_WINDOWS else short, "line").select("doc_id", "item_id").distinct()
    zero = F.lit(0).cast("long")
    return out.unionByName(whole.select("doc_id", "item_id", zero.alias("n_windows"), zero.alias("n_matched"), F.lit(1.0).alias("coverage"), F.lit(True).alias("verbatim")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
