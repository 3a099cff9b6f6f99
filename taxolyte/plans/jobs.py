"""Queries on jobs: a job is a market segment within a nation, its major the region, its units orders, its
items line items with their part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolyte.functions import text as X
from taxolyte.operators import stats
from taxolyte.session import table

ITEM_TERMS_A = ("steel", "bolt", "gear")
ITEM_TERMS_B = (*ITEM_TERMS_A, "widget", "hot")
LEVEL5 = 250_000.0


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """cust, job, job_name, major, middle of each customer."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return (
        c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
        .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 5 regions
        .select(
            F.col("c_custkey").alias("cust"),
            F.concat_ws("-", F.col("n_nationkey").cast("string"), "c_mktsegment").alias("job"),
            F.concat_ws(" ", "n_name", "c_mktsegment").alias("job_name"),
            F.col("r_name").alias("major"),
            F.col("n_name").alias("middle"),
        )
    )


def units(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return jobs(spark, d).join(o, F.col("cust") == o.o_custkey).select("job", "major", "middle", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")


def items(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    li = li.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    p = p.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return units(spark, d).select("job", "major", "middle", "o_orderkey").join(li, F.col("o_orderkey") == li.l_orderkey).join(p, F.col("l_partkey") == p.p_partkey)


JOBS_SQL = """jobs AS (
  SELECT c_custkey AS cust, n_nationkey::VARCHAR || '-' || c_mktsegment AS job, n_name || ' ' || c_mktsegment AS job_name, r_name AS major, n_name AS middle
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
units AS (SELECT job, major, middle, orders.* FROM jobs JOIN orders ON cust = o_custkey),
items AS (SELECT units.*, lineitem.*, part.* FROM units JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    spine = jobs(spark, d).select("job", "job_name", "major", "middle").distinct()
    u = units(spark, d).groupBy("job").agg(
        F.count("*").alias("n_units"),
        # From whole cents, so that no order of summation shows.
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*") / F.lit(100.0)).alias("mean_level"),
        F.avg((F.col("o_totalprice") >= LEVEL5).cast("int")).alias("rate_l5plus"),
        F.avg(F.year("o_orderdate")).alias("mean_rev_year"),
        F.avg((F.year("o_orderdate") >= 1998).cast("int")).alias("rate_rev"),
        F.count_if(~F.col("o_orderstatus").rlike("^[FO]$")).alias("n_units_nocode"),
    )
    i = items(spark, d)
    c = i.groupBy("job").agg(F.count("*").alias("n_pc"), F.avg((F.col("l_returnflag") == "N").cast("int")).alias("template_rate"), F.avg(F.length("p_name")).alias("mean_pc_len"))
    k = i.groupBy("job").agg(
        F.count("*").alias("n_ksa"),
        F.count_distinct("p_type", "p_name").alias("n_ksa_unique"),
        F.avg(X.matches_any(F.col("p_name"), ITEM_TERMS_A).cast("int")).alias("digital_a"),
        F.avg(X.matches_any(F.col("p_name"), ITEM_TERMS_B).cast("int")).alias("digital_b"),
    )
    out = spine.join(u, "job", "left").join(c, "job", "left").join(k, "job", "left")
    return out.withColumn("unique_rate", F.try_divide("n_ksa_unique", "n_ksa"))


METRICS_SQL = (
    "WITH "
    + JOBS_SQL
    + """,
spine AS (SELECT DISTINCT job, job_name, major, middle FROM jobs),
u AS (SELECT job, count(*) AS n_units, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / count(*) / 100::DOUBLE AS mean_level, avg((o_totalprice >= 250000)::INT) AS rate_l5plus, avg(year(o_orderdate)) AS mean_rev_year,
  avg((year(o_orderdate) >= 1998)::INT) AS rate_rev, count(*) FILTER (WHERE NOT regexp_matches(o_orderstatus, '^[FO]$')) AS n_units_nocode FROM units GROUP BY job),
c AS (SELECT job, count(*) AS n_pc, avg((l_returnflag = 'N')::INT) AS template_rate, avg(length(p_name)) AS mean_pc_len FROM items GROUP BY job),
k AS (SELECT job, count(*) AS n_ksa, count(DISTINCT p_type || '#' || p_name) AS n_ksa_unique, avg(regexp_matches(p_name, 'steel|bolt|gear')::INT) AS digital_a,
  avg(regexp_matches(p_name, 'steel|bolt|gear|widget|hot')::INT) AS digital_b FROM items GROUP BY job),
metrics AS (SELECT spine.*, u.* EXCLUDE (job), c.* EXCLUDE (job), k.* EXCLUDE (job), n_ksa_unique / n_ksa AS unique_rate
  FROM spine LEFT JOIN u USING (job) LEFT JOIN c USING (job) LEFT JOIN k USING (job))
"""
)
_RATES = ("rate_l5plus", "mean_rev_year", "rate_rev", "template_rate", "mean_pc_len", "digital_a", "digital_b", "unique_rate")


def unit_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metric table: one row per job from three aggregates that are joined to the jobs."""
    return _metrics(spark, d).withColumns({c: F.round(c, 6) for c in _RATES})


UNIT_METRICS = METRICS_SQL + "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _RATES) + ") FROM metrics"


def classification_paths(spark: SparkSession, d: str) -> DataFrame:
    """One row per job with its ancestors."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    details = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("detail")).distinct()
    return (
        details.join(F.broadcast(n), "n_nationkey")
        .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
        .select(
            F.col("r_regionkey").cast("string").alias("major_code"),
            F.col("r_name").alias("major_name"),
            F.concat(F.col("r_regionkey").cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("middle_code"),
            F.col("n_name").alias("middle_name"),
            F.concat(F.col("r_regionkey").cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), "detail").alias("full_code"),
        )
    )


CLASSIFICATION_PATHS = """SELECT r_regionkey::VARCHAR AS major_code, r_name AS major_name, r_regionkey::VARCHAR || lpad(n_nationkey::VARCHAR, 2, '0') AS middle_code, n_name AS middle_name,
  r_regionkey::VARCHAR || lpad(n_nationkey::VARCHAR, 2, '0') || c_mktsegment AS full_code
FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def ontology_edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph as triples, a branch for each relation."""
    n, c, o, li = (table(spark, d, t) for t in ("nation", "customer", "orders", "lineitem"))
    tag = lambda prefix, x: F.concat(F.lit(prefix), F.col(x).cast("string"))
    job = F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment")
    branches = [
        (n, tag("R", "n_regionkey"), "hasMiddleCategory", tag("N", "n_nationkey")),
        (c.select("c_nationkey", "c_mktsegment").distinct(), tag("N", "c_nationkey"), "hasDetailCategory", job),
        (c, job, "hasCompetencyUnit", tag("C", "c_custkey")),
        (o, tag("C", "o_custkey"), "hasElement", tag("O", "o_orderkey")),
        (li, tag("O", "l_orderkey"), "hasItem", tag("P", "l_partkey")),
    ]
    out = None
    for df, s, p, x in branches:
        one = df.select(s.alias("subject"), F.lit(p).alias("predicate"), x.alias("object"))
        out = one if out is None else out.unionByName(one)
    return out


ONTOLOGY_EDGES = """SELECT 'R' || n_regionkey AS subject, 'hasMiddleCategory' AS predicate, 'N' || n_nationkey AS object FROM nation
UNION ALL SELECT DISTINCT 'N' || c_nationkey, 'hasDetailCategory', c_nationkey || '-' || c_mktsegment FROM customer
UNION ALL SELECT c_nationkey || '-' || c_mktsegment, 'hasCompetencyUnit', 'C' || c_custkey FROM customer
UNION ALL SELECT 'C' || o_custkey, 'hasElement', 'O' || o_orderkey FROM orders
UNION ALL SELECT 'O' || l_orderkey, 'hasItem', 'P' || l_partkey FROM lineitem"""


def code_suffix_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number suffix of brands: items, without suffix, mean and range by product type."""
    p = table(spark, d, "part").withColumn("v", F.nullif(F.regexp_extract("p_brand", r"#(\d+)\z", 1), F.lit("")).cast("int"))
    return p.groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_nocode"), F.round(F.avg("v"), 6).alias("mean_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))


CODE_SUFFIX_STATS = r"""SELECT p_type, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS n_nocode, round(avg(v), 6) AS mean_v, min(v) AS min_v, max(v) AS max_v
FROM (SELECT p_type, nullif(regexp_extract(p_brand, '#(\d+)$', 1), '')::INT AS v FROM part) GROUP BY p_type"""


def level_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Size levels of parts: items, share, mean price and cumulated share."""
    p = table(spark, d, "part").groupBy(F.floor((F.col("p_size") - 1) / 10).cast("int").alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"))
    whole, upto = Window.partitionBy(), Window.orderBy("level")  # a row per level
    return p.select("level", "n", "mean_price", F.round(F.col("n") / F.sum("n").over(whole), 6).alias("share"), F.round(F.sum("n").over(upto) / F.sum("n").over(whole), 6).alias("cum_share"))


LEVEL_LADDER = """SELECT level, n, mean_price, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY level) / sum(n) OVER (), 6) AS cum_share
FROM (SELECT floor((p_size - 1) / 10)::INT AS level, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY 1)"""


def unique_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Items and distinct item texts by major."""
    return items(spark, d).groupBy("major").agg(F.count("*").alias("n"), F.count_distinct("p_name", "p_brand").alias("n_unique")).withColumn("ratio", F.round(F.col("n_unique") / F.col("n"), 6))


UNIQUE_RATIO = "WITH " + JOBS_SQL + " SELECT major, count(*) AS n, count(DISTINCT p_name || '#' || p_brand) AS n_unique, round(count(DISTINCT p_name || '#' || p_brand) / count(*), 6) AS ratio FROM items GROUP BY major"


def shared_items_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 item texts that most jobs share."""
    return items(spark, d).groupBy("p_name").agg(F.count_distinct("job").alias("n_jobs"), F.count("*").alias("n")).orderBy(F.desc("n_jobs"), F.desc("n"), "p_name").limit(20)


SHARED_ITEMS_TOPK = "WITH " + JOBS_SQL + " SELECT p_name, count(DISTINCT job) AS n_jobs, count(*) AS n FROM items GROUP BY p_name ORDER BY n_jobs DESC, n DESC, p_name LIMIT 20"


def lexicon_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of items with a term of either vocabulary, by job."""
    name = F.col("p_name")
    rates = {f"rate_{s}": F.round(F.avg(X.matches_any(name, t).cast("int")), 6) for s, t in (("a", ITEM_TERMS_A), ("b", ITEM_TERMS_B))}
    return items(spark, d).groupBy("job").agg(F.count("*").alias("n"), *(c.alias(k) for k, c in rates.items()))


LEXICON_RATE = "WITH " + JOBS_SQL + " SELECT job, count(*) AS n, round(avg(regexp_matches(p_name, 'steel|bolt|gear')::INT), 6) AS rate_a, round(avg(regexp_matches(p_name, 'steel|bolt|gear|widget|hot')::INT), 6) AS rate_b FROM items GROUP BY job"


def lexicon_ci_filter_count(spark: SparkSession, d: str) -> DataFrame:
    """Items and those with a term in any case, by job."""
    hit = X.matches_any(F.col("p_name"), ("STEEL", "Bolt"), ignore_case=True)
    return items(spark, d).groupBy("job").agg(F.count("*").alias("n"), F.count_if(hit).alias("hit"))


LEXICON_CI = "WITH " + JOBS_SQL + " SELECT job, count(*) AS n, count(*) FILTER (WHERE regexp_matches(p_name, '(?i)STEEL|Bolt')) AS hit FROM items GROUP BY job"


def k50_concentration(spark: SparkSession, d: str) -> DataFrame:
    """How few jobs hold half of the returned items."""
    n = items(spark, d).groupBy("job").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_dev"))
    return stats.smallest_half(n, "job", "n_dev")


K50 = "WITH " + JOBS_SQL + """, n AS (SELECT job, count(*) FILTER (WHERE l_returnflag = 'R') AS n_dev FROM items GROUP BY job),
r AS (SELECT *, sum(n_dev) OVER (ORDER BY n_dev DESC, job ROWS UNBOUNDED PRECEDING) AS cum, sum(n_dev) OVER () AS total FROM n WHERE n_dev > 0)
SELECT (count(*) FILTER (WHERE 2 * cum < total) + 1)::BIGINT AS k50, count(*) AS n_units, sum(n_dev)::BIGINT AS total FROM r"""

_MIDRANK = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0)"


def midrank_kruskal(spark: SparkSession, d: str) -> DataFrame:
    """Kruskal-Wallis of unique rates of jobs over majors."""
    out = stats.kruskal(_metrics(spark, d), "major", "unique_rate")
    return out.select(F.round("h", 6).alias("h"), "k", "n", F.round("eps2", 6).alias("eps2"))


MIDRANK_KRUSKAL = METRICS_SQL + ", r AS (SELECT major, unique_rate, " + _MIDRANK.format(x="unique_rate") + """ AS rk FROM metrics WHERE unique_rate IS NOT NULL),
g AS (SELECT sum(rk) AS s, count(*) AS m FROM r GROUP BY major), t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM r GROUP BY unique_rate)),
o AS (SELECT sum(s * s / m) AS ss, count(*) AS k, sum(m)::BIGINT AS n FROM g), h AS (SELECT k, n, (12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n::DOUBLE * n * n - n)) AS h FROM o, t)
SELECT round(h, 6) AS h, k, n, round((h - k + 1) / (n - k), 6) AS eps2 FROM h"""


def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of item counts and unique rates of jobs."""
    return stats.spearman(_metrics(spark, d), "n_ksa", "unique_rate").withColumn("rho", F.round("rho", 6))


SPEARMAN = METRICS_SQL + ", r AS (SELECT " + _MIDRANK.format(x="n_ksa") + " AS a, " + _MIDRANK.format(x="unique_rate") + """ AS b FROM metrics WHERE n_ksa IS NOT NULL AND unique_rate IS NOT NULL)
SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r"""


def within_group_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of digital share and mean year after centering both by major."""
    m = stats.centered(_metrics(spark, d).select("major", "digital_a", "mean_rev_year"), "major", "digital_a", "mean_rev_year")
    m = m.select(F.round("digital_a", 9).alias("x"), F.round("mean_rev_year", 9).alias("y"))
    return stats.spearman(m, "x", "y").withColumn("rho", F.round("rho", 6))


WITHIN_SPEARMAN = METRICS_SQL + """, ce AS (SELECT round(digital_a - avg(digital_a) OVER (PARTITION BY major), 9) AS x, round(mean_rev_year - avg(mean_rev_year) OVER (PARTITION BY major), 9) AS y FROM metrics),
r AS (SELECT """ + _MIDRANK.format(x="x") + " AS a, " + _MIDRANK.format(x="y") + " AS b FROM ce WHERE x IS NOT NULL AND y IS NOT NULL) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r"


def gini(spark: SparkSession, d: str) -> DataFrame:
    """Shifted Gini coefficient of item counts of jobs."""
    return stats.gini(_metrics(spark, d), "n_ksa").withColumn("gini", F.round("gini", 6))


GINI = METRICS_SQL + """, v AS (SELECT n_ksa::DOUBLE - min(n_ksa) OVER () + 1e-9 AS v FROM metrics WHERE n_ksa IS NOT NULL), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM v)
SELECT round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini, count(*) AS n FROM r"""


def ols_residual_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean residual by major of unique rate on log counts of items and units."""
    m = _metrics(spark, d).filter("n_ksa >= 30").select("major", "unique_rate", F.ln("n_ksa").alias("x1"), F.ln("n_units").alias("x2"))
    w = stats.linear_fit(m, "unique_rate", "x1", "x2")
    return m.withColumn("e", stats.residual("unique_rate", ["x1", "x2"], w)).groupBy("major").agg(F.count("*").alias("n"), F.round(F.avg("e"), 5).alias("mean_residual"))


OLS = METRICS_SQL + """, m AS (SELECT major, unique_rate AS y, ln(n_ksa) AS a, ln(n_units) AS b FROM metrics WHERE n_ksa >= 30),
co AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb FROM m),
w AS (SELECT my, ma, mb, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS w1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS w2 FROM co)
SELECT major, count(*) AS n, round(avg(y - my - w1 * (a - ma) - w2 * (b - mb)), 5) AS mean_residual FROM m, w GROUP BY major"""


def _by_major(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).groupBy("middle").agg(F.round(F.avg("digital_a"), 9).alias("digital"), F.round(F.avg("mean_rev_year"), 9).alias("year"), F.round(F.avg("unique_rate"), 9).alias("uniq"))


_MIDDLE_SQL = METRICS_SQL + ", g AS (SELECT middle, round(avg(digital_a), 9) AS digital, round(avg(mean_rev_year), 9) AS year, round(avg(unique_rate), 9) AS uniq FROM metrics GROUP BY middle)"


def kendall_w(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of three rankings of nations."""
    out = stats.kendall_w(_by_major(spark, d), "middle", "digital", "year", "uniq")
    return out.select(F.round("w", 6).alias("w"), F.round("chi2", 6).alias("chi2"), "n")


KENDALL = _MIDDLE_SQL + ", r AS (SELECT " + " + ".join(_MIDRANK.format(x=x) for x in ("digital", "year", "uniq")) + """ AS s FROM g), w AS (SELECT 12 * var_pop(s) * count(*) / (9 * (count(*) ** 3 - count(*))) AS w, count(*) AS n FROM r)
SELECT round(w, 6) AS w, round(3 * (n - 1) * w, 6) AS chi2, n FROM w"""


def zscore_gap(spark: SparkSession, d: str) -> DataFrame:
    """Gap of standard scores of digital share and year, by nation."""
    g = _by_major(spark, d)
    return g.select("middle", F.round(stats.zscore(F.col("digital")) - stats.zscore(F.col("year")), 6).alias("gap"))


ZSCORE = _MIDDLE_SQL + """ SELECT middle, round((digital - avg(digital) OVER ()) / coalesce(nullif(stddev_pop(digital) OVER (), 0), 1) - (year - avg(year) OVER ()) / coalesce(nullif(stddev_pop(year) OVER (), 0), 1), 6) AS gap FROM g"""


def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    """Job metrics averaged by major with their own weights."""
    return _metrics(spark, d).groupBy("major").agg(
        F.round(stats.weighted_mean("mean_level", "n_units"), 4).alias("mean_level"),
        F.round(stats.weighted_mean("unique_rate", "n_ksa"), 6).alias("unique_rate"),
        F.round(stats.weighted_mean("template_rate", "n_pc"), 6).alias("template_rate"),
    )


WEIGHTED = METRICS_SQL + """ SELECT major, round(sum(mean_level * n_units) / sum(n_units), 4) AS mean_level, round(sum(unique_rate * n_ksa) / sum(n_ksa), 6) AS unique_rate,
  round(sum(template_rate * n_pc) / sum(n_pc), 6) AS template_rate FROM metrics GROUP BY major"""


def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    """Nation metrics scaled to 0..1, the last inverted."""
    g = _by_major(spark, d)
    return g.select("middle", F.round(stats.minmax(F.col("digital")), 6).alias("digital"), F.round(stats.minmax(F.col("uniq"), invert=True), 6).alias("redundancy"))


MINMAX = _MIDDLE_SQL + """ SELECT middle, round((digital - min(digital) OVER ()) / (max(digital) OVER () - min(digital) OVER ()), 6) AS digital, round(1 - (uniq - min(uniq) OVER ()) / (max(uniq) OVER () - min(uniq) OVER ()), 6) AS redundancy FROM g"""


def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    """Step-up control over nations, with each unit's share of digital items as its p-value."""
    p = _by_major(spark, d).select("middle", F.round(F.col("digital") * F.col("digital"), 9).alias("p"))
    return stats.benjamini_hochberg(p, "p", 0.15).select("middle", "p", "rank", F.round("crit", 6).alias("crit"), "reject")


BH = _MIDDLE_SQL + """, p AS (SELECT middle, round(digital * digital, 9) AS p FROM g), r AS (SELECT middle, p, row_number() OVER (ORDER BY p, middle)::INT AS rank, count(*) OVER () AS m FROM p),
cr AS (SELECT *, 0.15::DOUBLE * rank / m AS crit FROM r) SELECT middle, p, rank, round(crit, 6) AS crit, rank <= coalesce(max(rank) FILTER (WHERE p <= crit) OVER (), 0) AS reject FROM cr"""


def codebook_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the first matching category of a codebook, with all matching ones."""
    c = X.first_match(F.col("p_name"), CODEBOOK, "other")
    return table(spark, d, "part").groupBy(c.alias("category"), F.array_join(X.all_matches(F.col("p_name"), CODEBOOK), "+").alias("hits")).agg(F.count("*").alias("n"))


CODEBOOK = (("colour", ("red", "blue", "green")), ("size", ("small", "large")), ("thing", ("bolt", "gear", "ring")))
_CASE = "CASE WHEN regexp_matches(p_name, 'red|blue|green') THEN 'colour' WHEN regexp_matches(p_name, 'small|large') THEN 'size' WHEN regexp_matches(p_name, 'bolt|gear|ring') THEN 'thing' ELSE 'other' END"
_HITS = "concat_ws('+', CASE WHEN regexp_matches(p_name, 'red|blue|green') THEN 'colour' END, CASE WHEN regexp_matches(p_name, 'small|large') THEN 'size' END, CASE WHEN regexp_matches(p_name, 'bolt|gear|ring') THEN 'thing' END)"
FIRST_MATCH = f"SELECT {_CASE} AS category, {_HITS} AS hits, count(*) AS n FROM part GROUP BY ALL"


def codebook_contingency_chi2(spark: SparkSession, d: str) -> DataFrame:
    """Association of part type and category."""
    p = table(spark, d, "part").select("p_type", X.first_match(F.col("p_name"), CODEBOOK, "other").alias("category"))
    return stats.chi_square(p, "p_type", "category").select(F.round("chi2", 6).alias("chi2"), "dof", "n", F.round("cramers_v", 6).alias("cramers_v"))


CHI2 = f"""WITH p AS (SELECT p_type AS a, {_CASE} AS b FROM part), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b), ra AS (SELECT a, count(*) AS na FROM p GROUP BY a), rb AS (SELECT b, count(*) AS nb FROM p GROUP BY b),
e AS (SELECT coalesce(n, 0) AS o, na * nb / (SELECT count(*) FROM p) AS x FROM ra CROSS JOIN rb LEFT JOIN c USING (a, b)),
s AS (SELECT sum((o - x) ** 2 / x) AS chi2, (SELECT count(*) FROM ra) AS ka, (SELECT count(*) FROM rb) AS kb, (SELECT count(*) FROM p) AS n FROM e)
SELECT round(chi2, 6) AS chi2, (ka - 1) * (kb - 1) AS dof, n, round(sqrt(chi2 / (n * (least(ka, kb) - 1))), 6) AS cramers_v FROM s"""


def codebook_order_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Share of parts that change category when the codebook's order is reversed; rates of several and no matches."""
    hits = X.all_matches(F.col("p_name"), CODEBOOK)
    order = [c for c, _ in CODEBOOK]
    g = table(spark, d, "part").groupBy(hits.alias("hits")).agg(F.count("*").alias("n"))  # a row per set of categories
    share = lambda c: F.round(F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    h = F.col("hits")
    return g.agg(
        share(F.size(h) > 1).alias("multi_rate"), share(F.size(h) == 0).alias("none_rate"), share(X.by_order(h, order) != X.by_order(h, order[::-1])).alias("changed_rate")
    )


ORDER = f"""WITH h AS (SELECT string_split({_HITS}, '+') AS x, {_HITS} AS s FROM part)
SELECT round(avg((s <> '' AND len(x) > 1)::INT), 6) AS multi_rate, round(avg((s = '')::INT), 6) AS none_rate, round(avg((s <> '' AND len(x) > 1)::INT), 6) AS changed_rate FROM h"""


def keyword_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of item texts: distinct texts, uses, share of the five most used texts, and the most used."""
    words = ("red", "blue", "small", "bolt", "gear")
    n = items(spark, d).groupBy("p_name").agg(F.count("*").alias("n"))
    rows = n.select("p_name", "n", F.explode(F.array(*map(F.lit, words))).alias("keyword")).filter(F.col("p_name").contains(F.col("keyword")))
    w = Window.partitionBy("keyword").orderBy(F.desc("n"), "p_name")  # distinct texts only
    rows = rows.withColumn("r", F.row_number().over(w))
    return rows.groupBy("keyword").agg(
        F.count("*").alias("n_texts"),
        F.sum("n").alias("n_uses"),
        F.round(F.sum(F.when(F.col("r") <= 5, F.col("n"))) / F.sum("n"), 6).alias("top5_share"),
        F.max(F.when(F.col("r") == 1, F.col("p_name"))).alias("top_text"),
    )


KEYWORDS = "WITH " + JOBS_SQL + """, n AS (SELECT p_name, count(*) AS n FROM items GROUP BY p_name),
r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY n DESC, p_name) AS r FROM n JOIN (SELECT unnest(['red', 'blue', 'small', 'bolt', 'gear']) AS keyword) ON contains(p_name, keyword))
SELECT keyword, count(*) AS n_texts, sum(n)::BIGINT AS n_uses, round(sum(n) FILTER (WHERE r <= 5) / sum(n), 6) AS top5_share, max(p_name) FILTER (WHERE r = 1) AS top_text FROM r GROUP BY keyword"""


def reuse_strata(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the number of orders that use them."""
    use = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, d, "part").select("p_partkey")
    n = F.floor(F.coalesce("n", F.lit(0)) / 4)
    return p.join(use, p.p_partkey == use.l_partkey, "left").groupBy(X.stratum(n).alias("stratum")).agg(F.count("*").alias("n_parts"), F.sum(F.coalesce("n", F.lit(0))).alias("n_uses"))


REUSE = """WITH u AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), p AS (SELECT coalesce(n, 0) AS n, floor(coalesce(n, 0) / 4)::INT AS q FROM part LEFT JOIN u ON p_partkey = l_partkey)
SELECT CASE WHEN q >= 10 THEN '10+' WHEN q >= 3 THEN '3-9' WHEN q = 2 THEN '2' WHEN q = 1 THEN '1' ELSE '0' END AS stratum, count(*) AS n_parts, sum(n)::BIGINT AS n_uses FROM p GROUP BY 1"""


def normalize_dim_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A dimension after a second batch with new names for some codes and new codes: the latest batch wins."""
    from taxolyte.sources.warehouse import upsert

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("code"), F.col("s_name").alias("name"))
    return upsert(c, s, ["code"])


UPSERT = "SELECT coalesce(s.code, c_custkey) AS code, CASE WHEN s.code IS NOT NULL THEN s.name ELSE c_name END AS name FROM customer FULL JOIN (SELECT s_suppkey * 20 AS code, s_name AS name FROM supplier) s ON s.code = c_custkey"


def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    """A dimension after an insert that leaves known codes alone."""
    from taxolyte.sources.warehouse import insert_if_absent

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("code"), F.col("s_name").alias("name"))
    return insert_if_absent(c, s, ["code"])


INSERT_ABSENT = "SELECT c_custkey AS code, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 20, s_name FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)"


QUERIES = {
    "unit_metrics": (unit_metrics, UNIT_METRICS),
    "classification_paths": (classification_paths, CLASSIFICATION_PATHS),
    "ontology_edges": (ontology_edges, ONTOLOGY_EDGES),
    "code_suffix_stats": (code_suffix_stats, CODE_SUFFIX_STATS),
    "level_ladder": (level_ladder, LEVEL_LADDER),
    "unique_ratio": (unique_ratio, UNIQUE_RATIO),
    "shared_items_topk": (shared_items_topk, SHARED_ITEMS_TOPK),
    "lexicon_rate": (lexicon_rate, LEXICON_RATE),
    "lexicon_ci_filter_count": (lexicon_ci_filter_count, LEXICON_CI),
    "k50_concentration": (k50_concentration, K50),
    "midrank_kruskal": (midrank_kruskal, MIDRANK_KRUSKAL),
    "spearman": (spearman, SPEARMAN),
    "within_group_spearman": (within_group_spearman, WITHIN_SPEARMAN),
    "gini": (gini, GINI),
    "ols_residual_means": (ols_residual_means, OLS),
    "kendall_w": (kendall_w, KENDALL),
    "zscore_gap": (zscore_gap, ZSCORE),
    "weighted_means": (weighted_means, WEIGHTED),
    "minmax_scale": (minmax_scale, MINMAX),
    "bh_fdr": (bh_fdr, BH),
    "codebook_first_match": (codebook_first_match, FIRST_MATCH),
    "codebook_contingency_chi2": (codebook_contingency_chi2, CHI2),
    "codebook_order_sensitivity": (codebook_order_sensitivity, ORDER),
    "keyword_concentration": (keyword_concentration, KEYWORDS),
    "reuse_strata": (reuse_strata, REUSE),
    "normalize_dim_upsert": (normalize_dim_upsert, UPSERT),
    "insert_absent": (insert_absent, INSERT_ABSENT),
}
