"""Sanitisation of personal data by what terms disclose, in DataFrame functions only.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers.
How strongly a term reveals one of them is then estimated from the corpus: of the
documents that hold the term, how many hold the entity near it, against how many hold
the entity at all. A term over the disclosure thresholds gives the entity away even
where the entity itself is masked, so its occurrences become spans as well. Spans are
generalised to their kind or removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semirel.llm import blocks as B
from semirel.llm.decontamination import bounded

#: Documents (of different texts) that must hold term and entity together; the least share of the term's documents; the least information in bits.
MIN_TEXTS, MIN_SHARE, MIN_BITS, NEAR_CHARS, NEAR_WORDS, MIN_LETTERS = 4, 0.5, 5.0, 120, 4, 3
#: An entity in many documents gives few bits at most: a term that hardly stands without it discloses it from so many bits on.
CERTAIN_SHARE, CERTAIN_BITS = 0.95, 1.0
GROUP, CUT = 256, 128
_MARK, _INSTEAD = "\uE003", "\u0002"
#: The patterns by kind, in the order of the spans. A match begins where the last one ended or where
#: nothing of its first class comes before, which are the only places a leftmost match can begin; possessive
#: repeats take what greedy ones take there. So time stays in proportion to the text.
PATTERNS: dict[str, str] = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
SPAN = "struct<kind:int,start:int,end:int,value:string>"
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def _luhn(digits: Column) -> Column:
    figures = F.transform(F.reverse(F.split(digits, "")), lambda c: c.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda span: _passes(kind, span["value"])


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, which must be an array, with ``value`` computed once: a lambda over one element names it."""
    return F.flatten(F.transform(F.array(value), use))


def _found(text: Column, pattern: Column | str, kind: int) -> Column:
    """All matches as spans. They are marked, which cuts the text into pieces that lie by turns outside and inside a match.
    Spans are placed within groups of ``GROUP`` pieces and then moved by the lengths of the groups before: an array that
    grows by one element is copied each time, so only short ones may grow, and time stays in proportion to the text."""
    marked = F.regexp_replace(F.translate(text, _MARK, _INSTEAD), pattern, f"{_MARK}$0{_MARK}")
    none = F.array().cast(f"array<{SPAN}>")
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), none.alias("out"))

    def add(a: Column, x: Column) -> Column:
        span = F.struct(F.lit(kind).alias("kind"), a["at"].alias("start"), (a["at"] + F.length(x)).alias("end"), x.alias("value"))
        return F.struct((a["at"] + F.length(x)).alias("at"), (a["n"] + 1).alias("n"), F.when(a["n"] % 2 == 1, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    def moved(groups: Column, offsets: Column) -> Column:
        by = lambda j: lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + F.get(offsets, j)).alias("start"), (s["end"] + F.get(offsets, j)).alias("end"), s["value"].alias("value"))
        return F.flatten(F.transform(groups, lambda g, j: F.transform(g["out"], by(j))))

    def placed(groups: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add_up = lambda a, g: F.struct((a["at"] + g["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return _with(F.aggregate(groups, start, add_up, lambda a: a["out"]), lambda offsets: moved(groups, offsets))

    def cut(parts: Column) -> Column:
        each = F.sequence(F.lit(0), ((F.size(parts) - 1) / GROUP).cast("int"))
        return _with(F.transform(each, lambda g: F.aggregate(F.slice(parts, g * GROUP + 1, F.lit(GROUP)), empty, add)), placed)

    return F.when(F.instr(marked, _MARK) > 0, _with(F.split(marked, _MARK, -1), cut)).otherwise(none)


def base_spans(text: Column) -> Column:
    """The protected entities of a text: leftmost, not overlapping within a kind, without those that fail their kind's test."""
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        possible = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9][ -]?[0-9]")
        spans = F.filter(_found(text, pattern, i), _test(kind))
        parts.append(F.when(possible, spans).otherwise(none))
    return F.concat(*parts)


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), " "), lambda w: F.length(w) >= MIN_LETTERS)


def _entities(found: DataFrame) -> DataFrame:
    """``doc_id, text_hash, entity, near`` for each span. A span's surroundings come from the two of the text's cuts of ``CUT``
    code points that hold them, so that neither the text is copied nor its beginning passed again for each span."""

    def entity(s: Column) -> Column:
        value = F.when(s["kind"] == 0, F.lower(s["value"])).when(s["kind"] == 1, s["value"]).otherwise(F.regexp_replace(s["value"], "[^0-9]", ""))
        return F.concat_ws(":", s["kind"], value)

    def near(cuts: Column, s: Column) -> Column:
        first, last = F.greatest(F.floor(s["start"] / CUT).cast("int") - 1, F.lit(0)), F.floor(s["end"] / CUT).cast("int")
        two = lambda i: F.array_join(F.slice(cuts, i + 1, F.lit(2)), "")
        before = F.substring(two(first), F.greatest(s["start"] - NEAR_CHARS, F.lit(0)) - first * CUT + 1, F.least(s["start"], F.lit(NEAR_CHARS)))
        after = F.substring(two(last), s["end"] - last * CUT + 1, F.lit(NEAR_CHARS))
        return F.array_distinct(F.concat(F.slice(F.reverse(_terms(before)), 1, NEAR_WORDS), F.slice(_terms(after), 1, NEAR_WORDS)))

    cuts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    each = _with(cuts, lambda c: F.transform("spans", lambda s: F.struct(entity(s).alias("entity"), near(c, s).alias("near"))))
    return found.select("doc_id", "text_hash", F.inline(each))


def disclosing_terms(texts: DataFrame, near: DataFrame, *, min_texts: int = MIN_TEXTS, min_share: float = MIN_SHARE, min_bits: float = MIN_BITS) -> DataFrame:
    """``term, bits`` of the terms over the thresholds. ``near`` holds ``doc_id, text_hash, entity, near`` of all entities.

    With n documents in all: a term's share is P(entity near | term), its information
    log2(P(entity near | term) / P(entity)), over all documents of the corpus. A share of ``CERTAIN_SHARE`` needs ``CERTAIN_BITS`` only.
    """
    holds = near.groupBy("entity").agg(F.countDistinct("doc_id", "text_hash").alias("n_entity"))
    each = near.select("doc_id", "text_hash", "entity", F.explode("near").alias("term"))
    pairs = each.groupBy("entity", "term").agg(F.countDistinct("doc_id", "text_hash").alias("n_both"), F.countDistinct("text_hash").alias("n_texts")).where(F.col("n_texts") >= min_texts)
    # a term is in at least as many documents as it is near any entity: what that rules out need not be counted over the corpus
    least = each.groupBy("term").agg(F.countDistinct("doc_id", "text_hash").alias("n_near"))
    pairs = B.saved(pairs.join(least, "term").where(F.col("n_both") >= min_share * F.col("n_near")).join(holds, "entity"))
    candidates = bounded(B.saved(pairs.select("term").distinct()))
    if pairs.isEmpty():
        return candidates.withColumn("bits", F.lit(0.0))
    words = texts.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    n_term = words.join(candidates, "term").groupBy("term").agg(F.count("*").alias("n_term"))
    n = texts.count()
    share = F.col("n_both") / F.col("n_term")
    weighed = pairs.join(n_term, "term").withColumn("share", share).withColumn("bits", F.log2(share * n / F.col("n_entity")))
    certain = (F.col("share") >= CERTAIN_SHARE) & (F.col("bits") >= CERTAIN_BITS)
    return weighed.where((F.col("share") >= min_share) & ((F.col("bits") >= min_bits) | certain)).groupBy("term").agg(F.max("bits").alias("bits"))


def find_personal_data(docs: DataFrame, **thresholds: float) -> DataFrame:
    """``doc_id, text, spans`` for each row; ``spans`` holds ``kind`` (place in ``KINDS``), ``start``, ``end`` (code points, end exclusive) and ``value``.

    Base spans come from ``PATTERNS``; spans of kind ``term`` cover the words that
    ``disclosing_terms`` gives, wherever they stand. Null text: empty. Null ``doc_id``: base
    spans only. Repeated rows have equal spans and count once in the statistics. Extra
    columns never matter. Empty table: no rows.
    """
    rows = B.numbered(docs)
    texts = rows.select(F.col(f"c{docs.columns.index('doc_id')}").cast("long").alias("doc_id"), F.coalesce(F.col(f"c{docs.columns.index('text')}").cast("string"), F.lit("")).alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    found = hashed.withColumn("spans", base_spans(F.col("text")))
    near = B.saved(_entities(found.where(F.size("spans") > 0)))
    terms = B.saved(disclosing_terms(texts, near, **thresholds))
    if terms.isEmpty():
        return found.select("doc_id", "text", "spans")
    # which documents hold which of the terms; then all of their places at once
    held = hashed.select("doc_id", "text_hash", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).where(F.col("doc_id").isNotNull()).join(bounded(terms), "term")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join(F.reverse(F.array_sort(F.collect_set("term"))), "|"), F.lit(r")(?!\p{L})"))
    wanted = B.saved(held.groupBy("doc_id", "text_hash").agg(pattern.alias("pattern")))
    whole = found.join(bounded(wanted), ["doc_id", "text_hash"], "left")
    more = F.when(F.col("pattern").isNotNull(), _found(F.col("text"), F.col("pattern"), KINDS.index("term"))).otherwise(F.array().cast(f"array<{SPAN}>"))
    return whole.select("doc_id", "text", F.concat("spans", more).alias("spans"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def sanitise(found: DataFrame, *, remove: bool = False) -> DataFrame:
    """``doc_id, text`` with every span generalised to ``<kind>`` or removed; where spans overlap, the first one counts
    and what others reach beyond it is removed.

    What stays is taken from the text's cuts, so that time stays in proportion to text and spans. Rows without spans and
    null ids stay as they are, repeated rows are repeated. Null text: null. Empty table: no rows.
    """
    rows = B.saved(found.select("doc_id", "text", "spans").withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.inline("spans")).select("row", "start", "end", "kind")
    order = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("done", F.coalesce(F.max("end").over(order), F.lit(0)))
    placed = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "done"))).alias("placed"), F.max("end").alias("last"))
    kinds = F.array(*map(F.lit, KINDS))

    def between(cuts: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CUT).cast("int")
        held = F.slice(cuts, first + 1, F.floor(F.greatest(start, end) / CUT).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), start - first * CUT + 1, F.greatest(end - start, F.lit(0)))

    def instead(s: Column) -> Column:
        return F.lit("") if remove else F.concat(F.lit("<"), F.get(kinds, s["kind"]), F.lit(">"))

    def clean(cuts: Column) -> Column:
        put = lambda s: F.when(s["start"] >= s["done"], F.concat(between(cuts, s["done"], s["start"]), instead(s))).otherwise("")
        return F.array(F.concat(F.array_join(F.transform("placed", put), ""), between(cuts, F.col("last"), F.length("text"))))

    cuts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    new = F.when(F.col("placed").isNull(), F.col("text")).otherwise(F.get(_with(cuts, clean), 0))
    return rows.join(placed, "row", "left").select("doc_id", new.alias("text"))
