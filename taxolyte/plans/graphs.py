"""Queries on graphs of jobs that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.operators import agreement, graph, resample, stats
from taxolyte.plans.texts import TOK_SQL, tokens
from taxolyte.session import table


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).filter("key <> ''").select("job", "key").distinct()


E_SQL = "WITH " + TOK_SQL + """, e0 AS (SELECT DISTINCT job, key FROM tok WHERE key <> ''),
dg AS (SELECT key, count(*) AS df FROM e0 GROUP BY key HAVING count(*) >= 2), ed AS (SELECT job, key, df FROM e0 JOIN dg USING (key)),
sz AS (SELECT job, count(*) AS n FROM ed GROUP BY job), cm AS (SELECT a.job AS u, b.job AS v, count(*) AS common FROM ed a JOIN ed b ON a.key = b.key AND a.job < b.job GROUP BY 1, 2),
jac AS (SELECT u, v, common, common / (x.n + y.n - common) AS w FROM cm JOIN sz x ON u = x.job JOIN sz y ON v = y.job)"""


def jaccard_edges(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of jobs on keys that at least two jobs have."""
    return graph.jaccard_edges(edges_of(spark, d), "job", "key").withColumn("w", F.round("w", 9))


def jaccard_hub_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same without keys that more than a tenth of the jobs have."""
    return graph.jaccard_edges(edges_of(spark, d), "job", "key", drop_share=0.1).withColumn("w", F.round("w", 9))


def tfidf_cosine_edges(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of jobs on TF-IDF weights of shared keys."""
    return graph.tfidf_edges(edges_of(spark, d), "job", "key").withColumn("w", F.round("w", 6)).filter("w > 0")


TFIDF = E_SQL + """, idf AS (SELECT job, key, ln((SELECT count(DISTINCT job) FROM ed) / df) AS x FROM ed), nm AS (SELECT job, sqrt(sum(x * x)) AS n FROM idf GROUP BY job),
un AS (SELECT job, key, x / n AS x FROM idf JOIN nm USING (job) WHERE n > 0)
SELECT u, v, w FROM (SELECT a.job AS u, b.job AS v, round(sum(a.x * b.x), 6) AS w FROM un a JOIN un b ON a.key = b.key AND a.job < b.job GROUP BY 1, 2) WHERE w > 0"""


def _rounded(spark: SparkSession, d: str) -> DataFrame:
    return graph.jaccard_edges(edges_of(spark, d), "job", "key").select("u", "v", F.round("w", 9).alias("w"))


def topk_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest jobs of each job."""
    return graph.nearest(_rounded(spark, d), 5)


_BOTH = E_SQL + ", r AS (SELECT u, v, round(w, 9) AS w FROM jac), bo AS (SELECT u, v, w FROM r UNION ALL SELECT v, u, w FROM r)"
_TOP = _BOTH + ", tp AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, v)::INT AS rank FROM bo QUALIFY rank <= 5)"


def precision_at_5(spark: SparkSession, d: str) -> DataFrame:
    """Share of the five nearest jobs in the same language, by language and in all."""
    n = graph.nearest(_rounded(spark, d), 5)
    lang = lambda c: F.split_part(F.col(c), F.lit("|"), F.lit(1))
    hit = n.groupBy("u").agg(F.avg((lang("u") == lang("v")).cast("double")).alias("p"))
    return hit.rollup(lang("u").alias("lang")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("precision")).na.fill("all", ["lang"])


P5 = _TOP + """, h AS (SELECT u, avg((split_part(u, '|', 1) = split_part(v, '|', 1))::INT) AS p FROM tp GROUP BY u)
SELECT coalesce(split_part(u, '|', 1), 'all') AS lang, count(*) AS n, round(avg(p), 6) AS precision FROM h GROUP BY ROLLUP (split_part(u, '|', 1))"""


def pulled_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that are nearer to another group than to their own; groups are sources here."""
    e = _rounded(spark, d)
    g = e.select("u").union(e.select("v")).distinct().select(F.col("u").alias("node"), F.split_part(F.col("u"), F.lit("|"), F.lit(2)).alias("grp"))
    return graph.pulled(e, g).select("node", "grp", F.round("own", 6).alias("own"), F.round("other", 6).alias("other"), "is_pulled")


PULLED = _BOTH + """, nd AS (SELECT DISTINCT u AS node, split_part(u, '|', 2) AS grp FROM bo), gs AS (SELECT grp, count(*) AS size FROM nd GROUP BY grp),
sm AS (SELECT a.node, a.grp, b.grp AS g, sum(w) AS s FROM bo JOIN nd a ON a.node = u JOIN nd b ON b.node = v GROUP BY ALL),
mn AS (SELECT node, sm.grp, g, s / (CASE WHEN g = sm.grp THEN greatest(size - 1, 1) ELSE size END) AS m FROM sm JOIN gs ON gs.grp = g),
fd AS (SELECT node, max(m) FILTER (WHERE g = grp) AS own, max(m) FILTER (WHERE g <> grp) AS other FROM mn GROUP BY node)
SELECT node, grp, round(coalesce(own, 0), 6) AS own, round(coalesce(other, 0), 6) AS other, coalesce(own, 0) < coalesce(other, 0) AS is_pulled FROM nd LEFT JOIN fd USING (node)"""


def _nations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and links of those whose customers' mean balances are within 60 of each other."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 2).alias("b"))
    a, b = c.select(F.col("c_nationkey").alias("u"), F.col("b").alias("x")), c.select(F.col("c_nationkey").alias("v"), F.col("b").alias("y"))
    # Buckets as wide as the limit: near values are in the same or the next one.
    near = a.withColumn("k", F.explode(F.array(*(F.floor(F.col("x") / 60) + i for i in (-1, 0, 1)))))
    e = near.join(b.withColumn("k", F.floor(F.col("y") / 60)), "k").filter("u < v AND abs(x - y) <= 60").select("u", "v")
    return c.select(F.col("c_nationkey").alias("node")), e


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Nations that are linked by chains of near mean balances."""
    nodes, edges = _nations(spark, d)
    return graph.components(spark, nodes, edges)


CC = """WITH RECURSIVE c AS (SELECT c_nationkey AS node, round(avg(c_acctbal), 2) AS b FROM customer GROUP BY 1), e AS (SELECT x.node AS u, y.node AS v FROM c x JOIN c y ON x.node <> y.node AND abs(x.b - y.b) <= 60),
r AS (SELECT node, node AS comp FROM c UNION SELECT e.v, r.comp FROM r JOIN e ON r.node = e.u) SELECT node, min(comp) AS comp FROM r GROUP BY node"""


def _communities(spark: SparkSession, d: str) -> DataFrame:
    e = graph.jaccard_edges(edges_of(spark, d), "job", "key").select("u", "v", "w")
    nodes = tokens(spark, d).select(F.col("job").alias("node")).distinct()
    return graph.louvain(spark, nodes, e)


def louvain(spark: SparkSession, d: str) -> DataFrame:
    """Communities of jobs on shared keys."""
    return _communities(spark, d)


def cluster_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose language is not their community's most frequent."""
    c = _communities(spark, d).withColumn("lang", F.split_part(F.col("node"), F.lit("|"), F.lit(1)))
    return agreement.mismatched(c, "node", "lang", "community")


def cluster_contingency(spark: SparkSession, d: str) -> DataFrame:
    """Shares of languages in communities."""
    c = _communities(spark, d).withColumn("lang", F.split_part(F.col("node"), F.lit("|"), F.lit(1)))
    n = stats.contingency(c, "community", "lang")
    size = n.groupBy("community").agg(F.sum("n").alias("size"))
    return n.join(size, "community").withColumn("share", F.col("n") / F.col("size"))


def nmi_ari(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of regions with a deterministic grouping of customers."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("n_regionkey").alias("a"), F.pmod(F.col("c_nationkey") * 7, F.lit(6)).alias("b"))
    return agreement.partition_scores(c, "a", "b").select(F.round("nmi", 6).alias("nmi"), F.round("ari", 6).alias("ari"), "n")


NMI = """WITH x AS (SELECT n_regionkey AS a, (c_nationkey * 7) % 6 AS b FROM customer JOIN nation ON c_nationkey = n_nationkey), c AS (SELECT a, b, count(*)::DOUBLE AS c FROM x GROUP BY a, b), n AS (SELECT sum(c) AS n FROM c),
ra AS (SELECT a, sum(c) AS x FROM c GROUP BY a), rb AS (SELECT b, sum(c) AS y FROM c GROUP BY b),
m AS (SELECT sum(c / n * ln(c * n / (x * y))) AS mi, sum(c * (c - 1) / 2) AS s FROM c JOIN ra USING (a) JOIN rb USING (b), n),
ha AS (SELECT sum(-x / n * ln(x / n)) AS h, sum(x * (x - 1) / 2) AS s FROM ra, n), hb AS (SELECT sum(-y / n * ln(y / n)) AS h, sum(y * (y - 1) / 2) AS s FROM rb, n)
SELECT round(mi / ((ha.h + hb.h) / 2), 6) AS nmi, round((m.s - ha.s * hb.s / (n * (n - 1) / 2)) / ((ha.s + hb.s) / 2 - ha.s * hb.s / (n * (n - 1) / 2)), 6) AS ari, n::BIGINT AS n FROM m, ha, hb, n"""


def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """NMI of labels with a chance grouping, against shuffled labels."""
    e = table(spark, d, "embeddings").select("label", F.pmod("vec_id", F.lit(7)).alias("g"))
    return resample.permutation_null(spark, e, "label", "g")


QUERIES = {
    "jaccard_edges": (jaccard_edges, E_SQL + " SELECT u, v, common, round(w, 9) AS w FROM jac"),
    "jaccard_hub_pruned": (jaccard_hub_pruned, E_SQL.replace("count(*) >= 2)", "count(*) >= 2 AND count(*) <= floor((SELECT count(DISTINCT job) FROM e0) * 0.1))") + " SELECT u, v, common, round(w, 9) AS w FROM jac"),
    "tfidf_cosine_edges": (tfidf_cosine_edges, TFIDF),
    "topk_neighbors": (topk_neighbors, _TOP + " SELECT u, v, w, rank FROM tp"),
    "precision_at_5": (precision_at_5, P5),
    "pulled_jobs": (pulled_jobs, PULLED),
    "connected_components": (connected_components, CC),
    "louvain": (louvain, None),
    "cluster_mismatch": (cluster_mismatch, None),
    "cluster_contingency": (cluster_contingency, None),
    "nmi_ari": (nmi_ari, NMI),
    "permutation_null": (permutation_null, None),
}
