"""DuckDB SQL for the results of queries that SQL can express."""

from __future__ import annotations

from taxolyte.llm.quality_rules import ALPHA, BINS, DELTA, GUARD, RULES

_ESCAPE = r"regexp_replace(replace({x}, '\', '\\'), '([<\[])(/?(?:s>|INST\]|PART\]))', '\1\\\2', 'g')"

CHAT_FORMAT = f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_ESCAPE.format(x='role')} AS er, {_ESCAPE.format(x='text')} AS et FROM c),
b AS (SELECT *, er IS DISTINCT FROM lag(er) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, er, et) AS starts FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, er, et)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, er, et) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(et) + CASE WHEN starts THEN length(er) + length('<s>[INST][/INST]</s>') ELSE length('[PART]') END)::BIGINT AS formatted_chars
FROM b GROUP BY conv_id"""

_RULES = len(RULES)
_PART = f"least(CASE WHEN {{of}} > 0 THEN {{scale}} * {{x}} // {{of}} ELSE 0 END, {BINS})"
_BINS = ", ".join(
    _PART.format(scale=s, x=x, of=of)
    for s, x, of in ((50, "n_symbols", "n_words"), (100, "n_dup_lines", "n_lines"), (100, "n_repeat_words", "n_words"), (5, "word_chars", "n_words"), (100, "n_capitals", "word_chars"))
)
_SPACE = r"[\x20\x09-\x0D]+"
#: The chance of at most x rejections among ng good texts, if the rate were all that a rule may reject.
_TAIL = f"""CASE WHEN x >= ng * {ALPHA / _RULES!r}::DOUBLE THEN 1 ELSE
  (SELECT sum(exp(lgamma(ng + 1) - lgamma(j + 1) - lgamma(ng - j + 1) + j * ln({ALPHA / _RULES!r}::DOUBLE) + (ng - j) * ln(1 - {ALPHA / _RULES!r}::DOUBLE))) FROM range(0, 1000) z(j) WHERE j <= x AND j <= ng) END"""
_LEVEL = f"{DELTA!r}::DOUBLE / ((SELECT count(DISTINCT stratum) FROM k) * {_RULES})"

QUALITY_RULES = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, [x for x in regexp_split_to_array(text, '{_SPACE}') if x <> ''] AS w, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
t AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 3)),
p AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM t),
n AS (SELECT r, sum(least(3, i - coalesce(last, i - 3))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS last FROM p WHERE c > 1) GROUP BY r),
m AS (SELECT r, doc_id, lang, len(w) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals, coalesce(n, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN n USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{_BINS}] AS bins FROM m),
l AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
x AS (SELECT unnest(list_distinct([lang, '*'])) AS stratum, quality, bins FROM f JOIN l USING (doc_id) WHERE NOT base_failed),
k AS (SELECT stratum, rule, bins[rule] AS cutoff, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad FROM x, range(1, {_RULES + 1}) y(rule) GROUP BY ALL),
u AS (SELECT stratum, rule, cutoff, sum(good) OVER w AS x, sum(bad) OVER w AS y, sum(good) OVER (PARTITION BY stratum, rule) AS ng, sum(bad) OVER (PARTITION BY stratum, rule) AS nb FROM k WINDOW w AS (PARTITION BY stratum, rule ORDER BY cutoff DESC)),
g AS (SELECT *, y * ng - {GUARD} * x * nb AS gain FROM u WHERE cutoff > 0),
c AS (SELECT stratum, rule, gain, cutoff, {_TAIL} AS p FROM g WHERE gain > 0),
b AS (SELECT stratum, rule, cutoff FROM c WHERE p <= {_LEVEL} QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1),
h AS (SELECT k.stratum, k.rule, b.cutoff, sum(good) FILTER (k.cutoff >= b.cutoff) AS x, sum(good) AS ng FROM k JOIN b ON b.stratum = '*' AND b.rule = k.rule WHERE k.stratum <> '*' GROUP BY ALL),
i AS (SELECT stratum, rule, cutoff FROM (SELECT stratum, rule, cutoff, {_TAIL} AS p FROM (SELECT * REPLACE (coalesce(x, 0) AS x) FROM h)) WHERE p <= {_LEVEL}),
v AS (SELECT r, bool_or(bins[y.rule] >= coalesce(b.cutoff, i.cutoff)) AS rejected FROM f CROSS JOIN range(1, {_RULES + 1}) y(rule) LEFT JOIN b ON b.stratum = lang AND b.stratum <> '*' AND b.rule = y.rule LEFT JOIN i ON i.stratum = lang AND i.rule = y.rule GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM f JOIN v USING (r)"""
