"""Registered queries of the text operators, and the DuckDB text that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelake.llm import classifier, conversations, divergence, fingerprints, language, licenses, line_dedup, mixing, near_dedup, packing, quality, substring_dedup, toxicity
from voicelake.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


WORD = r"[^\x20\x09-\x0D]+"

#: Later copies of line runs of 10 words and more, from a table (doc_id, text); `kept_lines` has each text without them.
LINES_SQL = rf"""ld AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS k, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM {{docs}})),
ll AS (SELECT k, o, line, len(regexp_extract_all(line, '{WORD}')) AS w FROM (SELECT k, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS o FROM ld)),
ls AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS l FROM ll WHERE w > 0),
la AS (SELECT k, list(line ORDER BY l) AS lines, list(w ORDER BY l) AS ws, max(l) AS m FROM ls GROUP BY k),
lr AS (SELECT k, l, n, array_to_string(lines[l:l + n - 1], chr(10)) AS s, list_sum(ws[l:l + n - 1]) AS words FROM
  (SELECT *, unnest(range(1, least(10, m - l + 1) + 1)) AS n FROM (SELECT *, unnest(range(1, m + 1)) AS l FROM la))),
lc AS (SELECT k, l, n FROM (SELECT k, l, n, min(struct_pack(k := k, l := l)) OVER (PARTITION BY s) AS first FROM lr WHERE words >= 10) WHERE first < struct_pack(k := k, l := l)),
lg AS (SELECT DISTINCT k, unnest(range(l, l + n)) AS l FROM lc),
lx AS (SELECT ll.k, string_agg(ll.line, chr(10) ORDER BY o) FILTER (g.l IS NULL) AS kept, count(*) AS n_lines, count(g.l) AS removed_lines, coalesce(sum(ll.w) FILTER (g.l IS NOT NULL), 0)::BIGINT AS removed_words
  FROM ll LEFT JOIN ls USING (k, o) LEFT JOIN lg g ON g.k = ll.k AND g.l = ls.l GROUP BY ll.k),
kept_lines AS (SELECT doc_id, text AS old, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, n_lines, removed_lines, removed_words FROM lx JOIN ld USING (k))"""


@query("op1_line_dedup", "WITH " + LINES_SQL.format(docs="documents") + """ SELECT d.doc_id, x.text, n_lines, removed_lines, removed_words
FROM documents d JOIN kept_lines x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text IS NOT DISTINCT FROM x.old""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir), report=True).select("doc_id", "text", "n_lines", "removed_lines", "removed_words")


MIX_SQL = rf"""WITH RECURSIVE s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM t),
u AS (SELECT *, sum(source_size) OVER o::BIGINT AS s_upto, sum(weight) OVER o::BIGINT AS w_upto, sum(source_size) OVER ()::BIGINT AS s_all, sum(weight) OVER ()::BIGINT AS w_all
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, 2.0::DOUBLE * source_size <= (1.5::DOUBLE * s_all - 2.0::DOUBLE * (s_upto - source_size)) / (w_all - w_upto + weight) * weight AS capped FROM u),
l AS (SELECT *, (1.5::DOUBLE * s_all - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (capped) OVER (), 0)::BIGINT) / nullif(w_all - coalesce(sum(weight) FILTER (capped) OVER (), 0)::BIGINT, 0) AS level FROM c),
g AS (SELECT source, source_size, CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE level * weight END AS target FROM l),
k AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(concat('mix:', doc_id)), 1, 15))::BIGINT, doc_id NULLS FIRST, size
  ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before FROM s),
j AS (SELECT k.*, g.source_size, g.target, floor(g.target)::BIGINT AS budget, CASE WHEN g.source_size > 0 THEN floor(g.target)::BIGINT // g.source_size ELSE 0 END AS epochs
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target, epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS taken FROM j"""


@query("op2_mixing", MIX_SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


#: CTEs up to `q`: a row per document with every measurement and `fail_bits`, from a table of (doc_id, text).
LEDGER_SQL = rf"""d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
f AS (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM (SELECT k, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d))),
r AS (SELECT k, sum(least(5, coalesce(later - i, 5)))::BIGINT AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS later FROM f WHERE c > 1) GROUP BY k),
m AS (SELECT k, doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_capitals, len(regexp_replace(t, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) AS n_letters,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
q AS (SELECT m.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r USING (k)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (word_chars < 2 * n_words)::BIGINT
  + 16 * (word_chars > 15 * n_words)::BIGINT + 32 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT
  + 64 * (n_letters >= 50 AND 10 * n_capitals > 6 * n_letters)::BIGINT AS fail_bits FROM q)"""


@query("op5_quality_rules", f"""WITH {LEDGER_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
(fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b""")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(documents(spark, sf_dir), keep=("doc_id",))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"), quality.passes().alias("kept"), "fail_bits",
    )


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), special=True)


@query("op9_fingerprints")
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.learn(docs))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir))


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def _step(state: str, cost: str, letter: str, line: str = "NULL") -> str:
    """A state of the search after one more edit."""
    said = f"list_append({state}.said, {line})" if line != "NULL" else f"{state}.said"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'said': {said}}} END"


def _least(*states: str) -> str:
    return f"list_sort(list_filter([{', '.join(states)}], lambda x: x IS NOT NULL))[1]"


_KEPT, _USER, _ASSISTANT = "role || ':' || text", "'user:' || text", "'assistant:' || text"
#: States 0 to 3: nothing, system, user, assistant. `i*` are those with turns inserted, `s*` those behind a row.
_INSERTED = f"""SELECT *, s0 AS i0, s1 AS i1, {_least("s2", _step("s0", "2", "I", "'user:'"), _step("s1", "2", "I", "'user:'"), _step("s3", "2", "I", "'user:'"))} AS i2,
{_least("s3", _step("s2", "2", "I", "'assistant:'"), _step("(" + _step("s0", "2", "I", "'user:'") + ")", "2", "I", "'assistant:'"), _step("(" + _step("s1", "2", "I", "'user:'") + ")", "2", "I", "'assistant:'"))} AS i3"""


def _row(state: int) -> str:
    options = [_step(f"i{state}", "3", "D")]
    kept = {1: [(0, "s")], 2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")]}.get(state, [])
    for source, initial in kept:
        options.append(f"CASE WHEN NOT forced AND left(role, 1) = '{initial}' THEN {_step(f'i{source}', 'extra', 'K', _KEPT)} END")
    for source in {2: (0, 1, 3), 3: (2,)}.get(state, ()):
        options.append(f"CASE WHEN NOT forced THEN {_step(f'i{source}', '2 + extra', 'R', _USER if state == 2 else _ASSISTANT)} END")
    return _least(*options)


_NONE = "CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[]))"
CONVERSATIONS_SQL = rf"""WITH RECURSIVE bytes AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab FROM range(256) t(b)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % 20 AS fault FROM keyed k, bytes),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE fault <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
marked AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS unended, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM numbered),
rows_ AS (SELECT *, blank OR again AS forced, CASE WHEN unended THEN 1 ELSE 0 END AS extra FROM marked),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (unended AND NOT forced) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rows_ GROUP BY conv_id),
search AS (SELECT conv_id, 0::BIGINT AS i, {{'cost': 0::BIGINT, 'audit': '', 'said': CAST([] AS VARCHAR[])}} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3 FROM facts
  UNION ALL SELECT conv_id, i, {_row(0)} AS s0, {_row(1)} AS s1, {_row(2)} AS s2, {_row(3)} AS s3
  FROM ({_INSERTED} FROM (SELECT r.conv_id, r.i, r.role, r.text, r.forced, r.extra, s0, s1, s2, s3 FROM search JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM search.conv_id AND r.i = search.i + 1))),
ended AS (SELECT conv_id, {_least("s0", "i3")} AS best FROM ({_INSERTED} FROM (SELECT search.* FROM search JOIN facts f ON f.conv_id IS NOT DISTINCT FROM search.conv_id AND f.n = search.i)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op12_conversation_repair", CONVERSATIONS_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _share(count: str, total: str) -> str:
    return f"(1 + 1000000000::HUGEINT * ({count} + 2) // ({total} + 2 * v))"


DIVERGENCE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
y AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_own FROM x),
z AS (SELECT lang, source, term, n, {_share("n", "own")} AS p, {_share("lang_n", "lang_own")} AS q FROM y JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM z a JOIN z b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM z WHERE n > 0 AND p > q),
o AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


@query("op13_quality_classifier")
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classifier.score(docs, classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
