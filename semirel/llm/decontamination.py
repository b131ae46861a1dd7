"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question asked again
with other values keeps its template. Windows of template tokens are hash-joined with
those of the benchmark. A document that holds enough of an item's windows is then
checked slot by slot: the values behind the placeholders must correspond, each value
of the item to one value of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semirel.llm import blocks as B

WINDOW, MIN_COVERAGE, MIN_CONSISTENT, MAX_SLOTS, MIN_LITERALS = 8, 0.5, 0.75, 4, 3
#: The benchmark's windows, or contaminated ids, are broadcast up to so many rows, each of a few numbers; beyond, joins shuffle.
BROADCAST_ROWS = 200_000
_NUMBER, _NAME, _UNIT = "\uE000", "\uE001", "\uE002"
_SPACE = r"[\x20\x09-\x0D]+"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + _NUMBER + _NAME + _UNIT
#: Units that follow a number.
UNITS = "kg|mg|g|lb|lbs|oz|km|cm|mm|m|mi|ft|in|inches|miles|meters|metres|l|ml|liters|litres|gallons|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|usd|eur|dollars|euros|cents|percent|mph|kmh|w|kw|kwh|v|hz|gb|mb|kb"


def _bare(text: Column) -> Column:
    """Without ASCII punctuation, which no word then consists of."""
    return F.translate(F.coalesce(text, F.lit("")), _MARKS, "")


def _words(bare: Column) -> Column:
    return F.array_remove(F.split(bare, _SPACE), "")


def raw_words(text: Column) -> Column:
    return _words(F.lower(_bare(text)))


def template(text: Column, names: bool = True) -> Column:
    """The words of ``raw_words`` with placeholders for numbers, for names (any capitalised word, so that
    the first word of a sentence reads alike wherever the sentence stands) and for units after a number."""
    t = F.regexp_replace(_bare(text), "[0-9]+", _NUMBER)
    if names:
        t = F.regexp_replace(t, rf"(?<!\p{{L}})\p{{Lu}}\p{{Ll}}+(?!\p{{L}})", _NAME)
    t = F.regexp_replace(t, rf"({_NUMBER} ?)(?:{UNITS})(?![\p{{L}}\p{{N}}])", f"$1{_UNIT}")
    return _words(F.lower(t))


def _is_slot(word: Column) -> Column:
    return word.rlike(f"[{_NUMBER}{_NAME}{_UNIT}]")


def _forms(rows: DataFrame, folded: bool, *keep: str | Column) -> DataFrame:
    """``keep, form, words``: each text's template and, with ``folded``, also that of the text in lower case, where names are literal words."""
    if not folded:
        return rows.select(*keep, F.lit(0).alias("form"), template(F.col("text")).alias("words"))
    return rows.select(*keep, F.posexplode(F.array(template(F.col("text")), template(F.lower("text"), names=False))).alias("form", "words"))


def _windows(rows: DataFrame, key: tuple[str, ...], width: int) -> DataFrame:
    """``key, form, at, window`` for each window of ``words``."""
    hashed = rows.select(*key, "form", F.transform("words", lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") >= width)
    each = F.transform(F.sequence(F.lit(0), F.size("h") - width), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(width))))
    return hashed.select(*key, "form", F.posexplode(each).alias("at", "window"))


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (saved) to be broadcast where its counted rows allow it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _occurrences(pairs: DataFrame, min_coverage: float) -> DataFrame:
    """``pairs`` with the places of one occurrence of the item in each row, of those that reach the coverage: all places
    of the document, those at one distance from the item's, and each stretch in which the item's places rise."""
    key = ("doc_id", "row", "item_id", "form", "item_windows")
    order = Window.partitionBy(*key).orderBy("at", "item_at")
    each = pairs.select(*key, F.inline("places")).withColumn("back", (F.col("item_at") <= F.lag("item_at").over(order)).cast("int"))
    each = each.withColumn("stretch", F.coalesce(F.sum("back").over(order), F.lit(0)).cast("int"))
    marks = F.array(*(F.struct(F.lit(kind).alias("kind"), which.alias("which")) for kind, which in enumerate((F.lit(0), F.col("at") - F.col("item_at"), F.col("stretch")))))
    apart = each.withColumn("occurrence", F.explode(marks)).groupBy(*key, "occurrence").agg(F.collect_list(F.struct("at", "item_at")).alias("places"))
    apart = apart.withColumn("matched", F.size(F.array_distinct(F.col("places.item_at"))))
    return apart.where(F.col("matched") >= min_coverage * F.col("item_windows")).drop("occurrence")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_coverage: float = MIN_COVERAGE, min_consistent: float = MIN_CONSISTENT, folded: bool = False, apart: bool = False) -> DataFrame:
    """``doc_id, item_id, matched, item_windows, coverage, slots, consistent, verbatim`` for each contaminated pair.

    ``coverage`` is the share of the item's usable windows found in the document. Windows
    with more than half placeholders, or fewer than three distinct literal words, are not
    used. ``slots`` counts the item's distinct slot values within matched windows,
    ``consistent`` those that have one value in the document; ``verbatim`` says that all
    values are the same.

    With ``folded`` a pair is also reported if it passes in lower case, whatever the case of either
    text; its numbers are then those of the form with more consistent values. With ``apart`` the slots are also judged for each
    occurrence of the item in the document by itself, and a pair is reported if any of them passes.

    Null or empty texts and texts under ``window`` words have no windows; null ids are
    never reported. Rows of one ``doc_id`` are read apart and the best pair of them is reported
    (most consistent values, then verbatim, then most windows, then most slots); rows that repeat an ``item_id`` count as
    one item. Very long texts and repeats within them take time in proportion. Extra columns never matter. Empty tables: no rows.
    """
    pick = lambda df, key: B.numbered(df).select(F.col(f"c{df.columns.index(key)}").cast("long").alias(key), F.col(f"c{df.columns.index('text')}").cast("string").alias("text")).where(F.col(key).isNotNull())
    items, texts = pick(benchmark, "item_id"), pick(docs, "doc_id")
    item_words = _forms(items, folded, "item_id")
    span = lambda at: F.slice("words", at + 1, window)
    usable = item_words.where(F.size("words") >= window).select("item_id", "form", "words", F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("item_at"))
    literal = F.filter(span(F.col("item_at")), lambda w: ~_is_slot(w))
    usable = usable.where((F.size(literal) >= window - MAX_SLOTS) & (F.size(F.array_distinct(literal)) >= MIN_LITERALS))
    usable = usable.select("item_id", "form", "item_at", F.xxhash64(*(F.xxhash64(F.get("words", F.col("item_at") + k)) for k in range(window))).alias("window"))
    item_windows = B.saved(usable.distinct())
    total = item_windows.groupBy("item_id", "form").agg(F.countDistinct("item_at").alias("item_windows"))

    texts = texts.withColumn("row", F.xxhash64("text"))
    found = _windows(_forms(texts, folded, "doc_id", "row"), ("doc_id", "row"), window)
    hits = found.join(bounded(item_windows), ["form", "window"]).select("doc_id", "row", "item_id", "form", "at", "item_at")
    pairs = hits.groupBy("doc_id", "row", "item_id", "form").agg(F.collect_set(F.struct("at", "item_at")).alias("places"))
    pairs = pairs.withColumn("matched", F.size(F.array_distinct(F.col("places.item_at"))))
    pairs = B.saved(pairs.join(total, ["item_id", "form"]).where(F.col("matched") >= min_coverage * F.col("item_windows")))

    if apart:
        pairs = _occurrences(pairs, min_coverage)
    pairs = B.saved(pairs.withColumn("place", F.monotonically_increasing_id()))

    # slots: only the documents of a pair are read again; each slot's values are counted as rows, in proportion to the places
    wanted = bounded(B.saved(pairs.select("doc_id", "row").distinct()))
    doc_raw = texts.join(wanted, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"]).select("doc_id", "row", raw_words(F.col("text")).alias("doc_words"))
    item_raw = _forms(items.distinct(), folded, "item_id", raw_words(F.col("text")).alias("item_words"))
    both = pairs.join(doc_raw, ["doc_id", "row"]).join(item_raw, ["item_id", "form"])
    places = F.flatten(F.transform("places", lambda p: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.struct((p["item_at"] + k).alias("i"), (p["at"] + k).alias("d")))))
    slots = F.filter(places, lambda p: _is_slot(F.get("words", p["i"])))
    values = F.transform(slots, lambda p: F.struct(F.get("item_words", p["i"]).alias("asked"), F.get("doc_words", p["d"]).alias("given")))
    each = both.select("place", F.inline(values)).distinct()
    each = each.groupBy("place", "asked").agg(F.count("*").alias("n"), F.bool_and(F.col("asked") == F.col("given")).alias("same"))
    judged = each.groupBy("place").agg(F.count("*").cast("int").alias("slots"), F.count_if(F.col("n") == 1).cast("int").alias("consistent"), F.bool_and("same").alias("verbatim"))
    none = lambda name, value: F.coalesce(name, F.lit(value)).alias(name)
    out = pairs.join(judged, "place", "left").select(
        "doc_id", "item_id", "matched", "item_windows", (F.col("matched") / F.col("item_windows")).alias("coverage"), none("slots", 0), none("consistent", 0), none("verbatim", True),
    )
    best = out.where(F.col("consistent") >= min_consistent * F.col("slots"))
    return best.groupBy("doc_id", "item_id").agg(*(F.max_by(c, F.struct("consistent", "verbatim", "matched", "slots")).alias(c) for c in ("matched", "item_windows", "coverage", "slots", "consistent", "verbatim")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how: float) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose ``doc_id`` no contaminated pair names, in either case form and by any occurrence."""
    bad = B.saved(contaminated(docs, benchmark, folded=True, apart=True, **how).select("doc_id").distinct())
    rows, key = B.numbered(docs), f"c{docs.columns.index('doc_id')}"
    kept = rows.join(bounded(bad), rows[key].cast("long") == bad["doc_id"], "left_anti")
    return kept.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))
