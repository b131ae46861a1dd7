"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirel.llm import decontamination as D
from semirel.llm import pii as P

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from semirel.llm.topk_search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_unigram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from semirel.llm.unigram_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from semirel.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from semirel.llm.packing import pack, token_pieces

    pieces = token_pieces(_table(spark, sf_dir, "documents"))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digest)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from semirel.llm.substring_dedup import substring_dedup

    kept = substring_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from semirel.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from semirel.llm.line_dedup import line_dedup

    kept = line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from semirel.llm.decontamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), folded=True, apart=True)


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from semirel.llm.sentence_spans import span_dedup

    kept = span_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_information_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from semirel.llm.pii import KINDS, as_text, find_personal_data

    found = find_personal_data(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("term"))
    return found.select("doc_id", *(of(kind).alias(f"n_{kind}") for kind in KINDS[:4]), F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


QUERIES: dict[str, Query] = {"op10_information_sanitisation": op10_information_sanitisation, "op1_topk_search": op1_topk_search, "op8_template_decontamination": op8_template_decontamination, "op9_sentence_spans": op9_sentence_spans, "op2_unigram_lm": op2_unigram_lm, "op3_toxicity": op3_toxicity, "op4_packing": op4_packing, "op5_suffix_array": op5_suffix_array, "op6_simhash": op6_simhash, "op7_line_dedup": op7_line_dedup}

def _op8_sql() -> str:
    """Word by word, as DuckDB's patterns cannot look around; names twice, for those that share a separator."""
    n, p, u, marks = D._NUMBER, D._NAME, D._UNIT, D._MARKS.replace("'", "''")
    letters, tail = r"\p{L}", r"($|[^\p{L}\p{N}])"
    figures = f"regexp_replace(x, '[0-9]+', '{n}', 'g')"
    name = lambda x: f"regexp_replace({x}, '(^|[^{letters}])\\p{{Lu}}\\p{{Ll}}+($|[^{letters}])', '\\1{p}\\2', 'g')"
    return f"""
WITH given AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION SELECT 'i', item_id, text FROM benchmark WHERE item_id IS NOT NULL
), texts AS (
  SELECT *, row_number() OVER () AS row FROM given
), forms AS (
  SELECT kind, id, row, 0 AS form, text FROM texts UNION ALL SELECT kind, id, row, 1, lower(text) FROM texts
), bare AS (SELECT kind, id, row, form, translate(coalesce(text, ''), '{marks}', '') AS bare FROM forms),
words AS (
  SELECT kind, id, row, form, list_transform(w, lambda x: lower(x)) AS raw,
    list_transform(w, lambda x: regexp_replace(CASE WHEN form = 0 THEN {name(name(figures))} ELSE {figures} END, '{n}({D.UNITS}){tail}', '{n}{u}\\2', 'g')) AS half
  FROM (SELECT kind, id, row, form, list_filter(regexp_split_to_array(bare, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM bare)
), templates AS (
  SELECT kind, id, row, form, raw, list_transform(half, lambda x, i: lower(CASE WHEN i > 1 AND ends_with(half[i - 1], '{n}') THEN regexp_replace(x, '^({D.UNITS}){tail}', '{u}\\2') ELSE x END)) AS words FROM words
), cut AS (
  SELECT kind, id, row, form, words, unnest(range(0, greatest(len(words) - {D.WINDOW - 1}, 0))) AS pos FROM templates
), windows AS (SELECT kind, id, row, form, pos, words[pos + 1 : pos + {D.WINDOW}] AS w FROM cut),
items AS (
  SELECT DISTINCT id AS item_id, form, pos AS item_at, array_to_string(w, ' ') AS frame FROM windows
  WHERE kind = 'i' AND len(list_filter(w, lambda x: NOT regexp_matches(x, '[{n}{p}{u}]'))) >= {D.WINDOW - D.MAX_SLOTS}
    AND len(list_distinct(list_filter(w, lambda x: NOT regexp_matches(x, '[{n}{p}{u}]')))) >= {D.MIN_LITERALS}
), total AS (SELECT item_id, form, count(DISTINCT item_at) AS item_windows FROM items GROUP BY 1, 2),
hits AS (SELECT DISTINCT d.id AS doc_id, d.row, form, i.item_id, d.pos, i.item_at FROM (SELECT id, row, form, pos, array_to_string(w, ' ') AS frame FROM windows WHERE kind = 'd') d JOIN items i USING (form, frame)),
backs AS (
  SELECT *, item_at <= lag(item_at) OVER (PARTITION BY row, form, item_id ORDER BY pos, item_at) AS back FROM hits
), marked AS (
  SELECT *, coalesce(sum(back::INTEGER) OVER (PARTITION BY row, form, item_id ORDER BY pos, item_at ROWS UNBOUNDED PRECEDING), 0) AS stretch FROM backs
), held AS (
  SELECT *, unnest(['all', 'shift ' || (pos - item_at), 'stretch ' || stretch]) AS occurrence FROM marked
), pairs AS (
  SELECT doc_id, row, form, item_id, occurrence, count(DISTINCT item_at) AS matched, any_value(item_windows) AS item_windows FROM held JOIN total USING (item_id, form) GROUP BY ALL
  HAVING count(DISTINCT item_at) >= {D.MIN_COVERAGE} * any_value(item_windows)
), slots AS (
  SELECT DISTINCT p.row, p.form, p.item_id, p.occurrence, i.raw[h.item_at + k + 1] AS asked, d.raw[h.pos + k + 1] AS given
  FROM pairs p JOIN held h USING (row, form, item_id, occurrence) JOIN templates i ON i.kind = 'i' AND i.id = p.item_id AND i.form = p.form JOIN templates d ON d.kind = 'd' AND d.row = p.row AND d.form = p.form, (SELECT unnest(range(0, {D.WINDOW})) AS k)
  WHERE regexp_matches(i.words[h.item_at + k + 1], '[{n}{p}{u}]')
), values_ AS (SELECT row, form, item_id, occurrence, asked, count(*) AS n, bool_and(asked = given) AS same FROM slots GROUP BY 1, 2, 3, 4, 5),
judged AS (SELECT row, form, item_id, occurrence, count(*) AS slots, count(*) FILTER (n = 1) AS consistent, bool_and(same) AS verbatim FROM values_ GROUP BY 1, 2, 3, 4),
passed AS (
  SELECT doc_id, item_id, matched, item_windows, coalesce(slots, 0) AS slots, coalesce(consistent, 0) AS consistent, coalesce(verbatim, true) AS verbatim
  FROM pairs LEFT JOIN judged USING (row, form, item_id, occurrence) WHERE coalesce(consistent, 0) >= {D.MIN_CONSISTENT} * coalesce(slots, 0)
)
SELECT doc_id, item_id, CAST(matched AS INTEGER) AS matched, item_windows, matched / item_windows AS coverage, CAST(slots AS INTEGER) AS slots, CAST(consistent AS INTEGER) AS consistent, verbatim
FROM passed QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY consistent DESC, verbatim DESC, matched DESC, slots DESC, item_windows DESC) = 1"""


def _op10_sql() -> str:
    mark, terms = "chr(57347)", lambda x: f"list_filter(string_split(lower(regexp_replace({x}, '[^\\p{{L}}]+', ' ', 'g')), ' '), lambda w: length(w) >= {P.MIN_LETTERS})"
    plain = ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "[0-9]([\\x20-]?[0-9])+", "\\+[0-9][\\x20().0-9-]+[0-9]", "\\p{L}+")
    marked = " UNION ALL ".join(f"SELECT row, doc_id, text, {k} AS kind, string_split(regexp_replace(translate(text, {mark}, chr(2)), '{x}', {mark} || '\\0' || {mark}, 'g'), {mark}) AS parts FROM docs" for k, x in enumerate(plain))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT row, doc_id, text, kind, unnest(parts) AS value, generate_subscripts(parts, 1) AS i FROM ({marked})),
placed AS (
  SELECT *, CAST(coalesce(sum(length(value)) OVER (PARTITION BY row, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM parts
), spans AS (
  SELECT row, doc_id, text, kind, value, digits, start, start + length(value) AS stop FROM placed WHERE i % 2 = 0 AND CASE kind
    WHEN 1 THEN len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 2 THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda x, j: CASE WHEN j % 2 = 1 THEN TRY_CAST(x AS INTEGER) WHEN x > '4' THEN 2 * TRY_CAST(x AS INTEGER) - 9 ELSE 2 * TRY_CAST(x AS INTEGER) END)) % 10 = 0
    WHEN 3 THEN length(digits) BETWEEN 8 AND 15 ELSE true END
), near AS (
  SELECT doc_id, text, kind || ':' || CASE kind WHEN 0 THEN lower(value) WHEN 1 THEN value ELSE digits END AS entity,
    list_distinct(list_concat(list_reverse({terms(f"substring(text, CAST(greatest(start - {P.NEAR_CHARS}, 0) + 1 AS BIGINT), CAST(least(start, {P.NEAR_CHARS}) AS BIGINT))")})[1:{P.NEAR_WORDS}],
      {terms(f"substring(text, CAST(stop + 1 AS BIGINT), {P.NEAR_CHARS})")}[1:{P.NEAR_WORDS}])) AS near
  FROM spans WHERE kind < 4
), holds AS (SELECT entity, count(DISTINCT (doc_id, text)) FILTER (doc_id IS NOT NULL) AS n_entity FROM near GROUP BY 1),
each AS (SELECT doc_id, text, entity, unnest(near) AS term FROM near),
pairs AS (SELECT entity, term, count(DISTINCT (doc_id, text)) FILTER (doc_id IS NOT NULL) AS n_both, count(DISTINCT text) AS n_texts FROM each GROUP BY 1, 2),
n_term AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct({terms("text")})) AS term FROM docs) GROUP BY 1),
terms AS (
  SELECT DISTINCT term FROM pairs JOIN holds USING (entity) JOIN n_term USING (term)
  WHERE n_texts >= {P.MIN_TEXTS} AND n_both / n_term >= {P.MIN_SHARE} AND log2(n_both / n_term * (SELECT count(*) FROM docs) / n_entity) >= CASE WHEN n_both / n_term >= {P.CERTAIN_SHARE} THEN {min(P.CERTAIN_BITS, P.MIN_BITS)} ELSE {P.MIN_BITS} END
), kept AS (SELECT row, kind, start, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop AS said FROM spans WHERE kind < 4 OR doc_id IS NOT NULL AND lower(value) IN (FROM terms))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
  sha256(coalesce(string_agg(said, ',' ORDER BY kind, start) FILTER (kind < 4), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY kind, start), '') AS spans
FROM docs LEFT JOIN kept USING (row) GROUP BY row"""


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op8_template_decontamination": _op8_sql(),
    "op10_information_sanitisation": _op10_sql(),
    "op7_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (SELECT *, {_ASCII_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM lines),
kept AS (SELECT doc_id, i, line, length(key) < 10 OR doc_id = min(doc_id) OVER (PARTITION BY key) AS stays FROM keyed)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (NOT stays) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id""",
    "op9_sentence_spans": f"""
WITH parts AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?]+[ \\t\\n\\x0b\\f\\r]+|\\n[ \\t\\n\\x0b\\f\\r]*)', '\\1' || chr(1), 'g'), chr(1) || '$', ''), chr(1)) AS p FROM documents
), sentences AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM parts),
worded AS (
  SELECT *, regexp_replace({_ASCII_LOWER.format(f"trim(s, {_BLANK})")}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') AS key FROM sentences
), held AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, len(string_split(key, ' ')) AS n FROM worded WHERE key <> ''
), runs_from AS (
  SELECT doc_id, r, list(key) OVER w AS keys, list(n) OVER w AS sizes FROM held WINDOW w AS (PARTITION BY doc_id ORDER BY r ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)
), spans AS (
  SELECT doc_id, r, d, array_to_string(keys[1:d], chr(10)) AS span FROM runs_from, (SELECT unnest(range(2, 13)) AS d)
  WHERE len(keys) >= d AND list_sum(sizes[1:d]) >= 12 AND (d = 2 OR list_sum(sizes[1:d - 1]) < 12 OR list_sum(sizes[2:d]) < 12)
), repeated AS (
  SELECT doc_id, r, d FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, r) AS place FROM spans) WHERE place > 1
), gone AS (SELECT DISTINCT doc_id, r + unnest(range(0, d)) AS r FROM repeated),
marked AS (SELECT h.doc_id, h.i, h.r, g.r IS NOT NULL AS removed FROM held h LEFT JOIN gone g USING (doc_id, r)),
runs AS (SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY r), false) AS begins FROM marked)
SELECT s.doc_id, count(m.i) AS n_sentences, CAST(count(*) FILTER (m.removed) AS BIGINT) AS n_removed, CAST(count(*) FILTER (m.begins) AS BIGINT) AS n_spans,
  sha256(coalesce(string_agg(s.s, '' ORDER BY s.i) FILTER (NOT coalesce(m.removed, false)), '')) AS kept_sha256
FROM sentences s LEFT JOIN runs m ON m.doc_id = s.doc_id AND m.i = s.i GROUP BY s.doc_id""",
    "op1_topk_search": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
