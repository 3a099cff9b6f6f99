"""Queries on text: a job is a source in one language, its major the language; surfaces are tokens of its
documents, keys their letters and digits in lower case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.functions import text as X
from taxolyte.operators import fragment
from taxolyte.session import table

_NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct job, major, surface, key, of tokens of all documents; keys may be empty."""
    t = table(spark, d, "documents").select("lang", "source", F.explode(F.split("text", r"\s+")).alias("surface")).filter("surface <> ''")
    return t.distinct().select(
        F.concat_ws("|", "lang", "source").alias("job"), F.col("lang").alias("major"), "surface", F.lower(F.regexp_replace("surface", _NOT_WORD, "")).alias("key")
    )


TOK_SQL = r"""tok AS (SELECT DISTINCT lang || '|' || source AS job, lang AS major, surface, lower(regexp_replace(surface, '[^\p{L}\p{N}]+', '', 'g')) AS key
  FROM (SELECT lang, source, unnest(regexp_split_to_array(text, '\s+')) AS surface FROM documents) WHERE surface <> '')"""


def template_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of documents that end in a full stop, and of others by how they end."""
    t = table(spark, d, "documents")
    end = F.col("text").rlike(r"\.\s*\z")
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(end.cast("int")), 6).alias("template_rate"), F.count_if(~end).alias("n_dev"), F.round(F.avg(F.length("text")), 6).alias("mean_len"))


TEMPLATE_RATE = r"SELECT lang, count(*) AS n, round(avg(regexp_matches(text, '\.\s*$')::INT), 6) AS template_rate, count(*) FILTER (WHERE NOT regexp_matches(text, '\.\s*$')) AS n_dev, round(avg(length(text)), 6) AS mean_len FROM documents GROUP BY lang"


def deviant_typing(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents off the template, by type."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    line = F.col("line")
    kind = (
        F.when(line == "", "empty").when(line.rlike(r"\.\z"), "sentence").when(line.rlike(r"[!?]\z"), "exclaimed").when(line.rlike(r"[0-9]"), "number").when(line.rlike(r"^\p{Lu}"), "capital").otherwise("other")
    )
    return lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


DEVIANT = r"""SELECT CASE WHEN line = '' THEN 'empty' WHEN regexp_matches(line, '\.$') THEN 'sentence' WHEN regexp_matches(line, '[!?]$') THEN 'exclaimed' WHEN regexp_matches(line, '[0-9]') THEN 'number'
  WHEN regexp_matches(line, '^\p{Lu}') THEN 'capital' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1"""


def token_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys with their surfaces and jobs."""
    return tokens(spark, d).filter("key <> ''").groupBy("key").agg(F.count_distinct("surface").alias("n_surfaces"), F.count_distinct("job").alias("n_jobs"))


TOKEN_KEYS = "WITH " + TOK_SQL + " SELECT key, count(DISTINCT surface) AS n_surfaces, count(DISTINCT job) AS n_jobs FROM tok WHERE key <> '' GROUP BY key"


def fragmentation_index(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces, keys, index and merged share over all tokens."""
    return fragment.index(tokens(spark, d)).withColumns({c: F.round(c, 6) for c in ("frag_index", "merged_share", "type_mismatch")})


_INDEX = """k AS (SELECT key, count(DISTINCT surface) AS s, count(DISTINCT major) AS m FROM tok WHERE key <> '' GROUP BY key)"""
FRAGMENTATION = "WITH " + TOK_SQL + ", " + _INDEX + """ SELECT (SELECT count(DISTINCT surface) FROM tok) AS n_surfaces, count(*) AS n_keys, round((SELECT count(DISTINCT surface) FROM tok) / count(*), 6) AS frag_index,
  sum(s - 1)::BIGINT AS n_merged, round(sum(s - 1) / (SELECT count(DISTINCT surface) FROM tok), 6) AS merged_share, round(avg((m > 1)::INT), 6) AS type_mismatch FROM k"""


def type_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur in several languages, by their number."""
    n = tokens(spark, d).filter("key <> ''").groupBy("key").agg(F.count_distinct("major").alias("n_types"))
    return n.groupBy("n_types").agg(F.count("*").alias("n_keys"))


TYPE_MISMATCH = "WITH " + TOK_SQL + " SELECT n_types, count(*) AS n_keys FROM (SELECT key, count(DISTINCT major) AS n_types FROM tok WHERE key <> '' GROUP BY key) GROUP BY 1"


def fragmentation_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces, keys and index of each job."""
    return fragment.by_group(tokens(spark, d), "job").withColumn("frag_index", F.round("frag_index", 6))


FRAG_GROUP = "WITH " + TOK_SQL + " SELECT job, count(DISTINCT surface) AS n_surfaces, count(DISTINCT key) AS n_keys, round(count(DISTINCT surface) / count(DISTINCT key), 6) AS frag_index FROM tok WHERE key <> '' GROUP BY job"


def alias_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Keys with several surfaces, with their surfaces and types as lists."""
    return fragment.aliases(tokens(spark, d))


ALIAS = "WITH " + TOK_SQL + """ SELECT key, count(DISTINCT surface) AS n_surfaces, count(DISTINCT job) AS n_jobs, string_agg(DISTINCT major, '|' ORDER BY major) AS types, count(DISTINCT major) > 1 AS type_mismatch,
  string_agg(DISTINCT surface, '|' ORDER BY surface) AS surfaces FROM tok WHERE key <> '' GROUP BY key HAVING count(DISTINCT surface) >= 2"""

_PATTERNS = {"none": (), "plural": (r"s$",), "endings": (r"s$", r"(?:ing|tion|ed|er)$")}


def suffix_variant_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Keys under variants of the suffix rules: keys, merged surfaces, and keys that join several base keys."""
    surfaces = tokens(spark, d).select("surface", "key").distinct().filter("key <> ''")
    return fragment.variants(surfaces, _PATTERNS).withColumn("merged_share", F.round("merged_share", 6))


def _strip_sql(x: str, p: str) -> str:
    return f"CASE WHEN regexp_replace({x}, '{p}', '') <> '' THEN regexp_replace({x}, '{p}', '') ELSE {x} END"


SUFFIX = "WITH " + TOK_SQL + f""", s AS (SELECT DISTINCT surface, key FROM tok WHERE key <> ''),
p AS (SELECT *, {_strip_sql('key', 's$')} AS p1 FROM s), e AS (SELECT *, {_strip_sql('p1', '(?:ing|tion|ed|er)$')} AS p2 FROM p),
v AS (SELECT 'none' AS variant, key AS k, key, surface FROM e UNION ALL SELECT 'plural', p1, key, surface FROM e UNION ALL SELECT 'endings', p2, key, surface FROM e),
g AS (SELECT variant, k, count(DISTINCT surface) AS n, count(DISTINCT key) AS b FROM v GROUP BY 1, 2)
SELECT variant, count(*) AS n_keys, sum(n - 1)::BIGINT AS n_merged, round(sum(n - 1) / sum(n), 6) AS merged_share, count(*) FILTER (WHERE b > 1) AS n_joined FROM g GROUP BY 1"""


def inflection_keys(spark: SparkSession, d: str) -> DataFrame:
    """English tokens by their key without an inflection."""
    t = tokens(spark, d).filter("major = 'en' AND key <> ''").select("key").distinct()
    return t.select("key", X.strip_inflection(F.col("key")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n_keys")).filter("n_keys > 1")


INFLECTION = "WITH " + TOK_SQL + """, k AS (SELECT DISTINCT key AS w FROM tok WHERE major = 'en' AND key <> ''),
s AS (SELECT CASE WHEN length(w) >= 5 AND ends_with(w, 'ies') THEN w[:-4] || 'y' WHEN length(w) >= 7 AND ends_with(w, 'ing') THEN w[:-4] WHEN length(w) >= 6 AND ends_with(w, 'ed') THEN w[:-3]
  WHEN length(w) >= 6 AND ends_with(w, 'es') THEN w[:-3] WHEN length(w) >= 5 AND ends_with(w, 's') THEN w[:-2] ELSE w END AS stem FROM k)
SELECT stem, count(*) AS n_keys FROM s GROUP BY stem HAVING count(*) > 1"""


QUERIES = {
    "template_rate": (template_rate, TEMPLATE_RATE),
    "deviant_typing": (deviant_typing, DEVIANT),
    "token_keys": (token_keys, TOKEN_KEYS),
    "fragmentation_index": (fragmentation_index, FRAGMENTATION),
    "type_mismatch": (type_mismatch, TYPE_MISMATCH),
    "fragmentation_by_group": (fragmentation_by_group, FRAG_GROUP),
    "alias_dictionary": (alias_dictionary, ALIAS),
    "suffix_variant_sensitivity": (suffix_variant_sensitivity, SUFFIX),
    "inflection_keys": (inflection_keys, INFLECTION),
}
