"""Confirmatory tests: each hypothesis gives one row (name, statistic, p, effect, n), and a step-up procedure
controls the false discovery rate over them. Statistics are Spark aggregates; tails are computed from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.functions import special
from taxolyte.operators import agreement, fragment, graph, resample, sampling, stats
from taxolyte.plans.graphs import edges_of
from taxolyte.plans.jobs import _metrics, items
from taxolyte.plans.texts import tokens
from taxolyte.session import table

Result = dict[str, float | int | str | bool | None]


def _result(name: str, statistic: float | None, p: float | None, effect: float | None, n: int, met: bool | None = None) -> Result:
    return {"name": name, "statistic": statistic, "p": p, "effect": effect, "n": n, "expectation_met": met}


def _kruskal(name: str, df: DataFrame, group: str, value: str, least: float) -> Result:
    r = stats.kruskal(df, group, value).first()
    return _result(name, r["h"], stats.kruskal_p(r), r["eps2"], r["n"], None if r["eps2"] is None else r["eps2"] >= least)


def h1_template(spark: SparkSession, d: str) -> Result:
    """Template compliance against .99, one-sided, with the fewest groups that hold half of the deviations."""
    t = table(spark, d, "documents").select("lang", "source", F.col("text").rlike(r"\.\s*\z").alias("ok"))
    r = t.agg(F.count("*").alias("n"), F.count_if("ok").alias("k")).first()
    dev = t.groupBy(F.concat_ws("|", "lang", "source").alias("g")).agg(F.count_if(~F.col("ok")).alias("dev"))
    k50 = stats.smallest_half(dev, "g", "dev").first()["k50"]
    rate = r["k"] / r["n"] if r["n"] else None
    return _result("h1", float(k50), special.binomial_upper(r["k"], r["n"], 0.99) if r["n"] else None, rate, r["n"], rate is not None and rate >= 0.99)


def h2_duplication(spark: SparkSession, d: str) -> Result:
    """Unique rates differ between majors after item and unit counts are taken out."""
    m = _metrics(spark, d).filter("n_ksa >= 30").select("major", "unique_rate", F.ln("n_ksa").alias("x1"), F.ln("n_units").alias("x2"))
    w = stats.linear_fit(m, "unique_rate", "x1", "x2")
    return _kruskal("h2", m.withColumn("e", F.round(stats.residual("unique_rate", ["x1", "x2"], w), 12)), "major", "e", 0.06)


def h3_fragmentation(spark: SparkSession, d: str) -> Result:
    """Keys in more jobs have more surfaces."""
    k = tokens(spark, d).filter("key <> ''").groupBy("key").agg(F.count_distinct("surface").alias("s"), F.count_distinct("job").alias("j"))
    r = stats.spearman(k, "j", "s").first()
    share = fragment.index(tokens(spark, d)).first()["merged_share"]
    return _result("h3", r["rho"], None if r["rho"] is None else stats.spearman_p(r["rho"], r["n"]), share, r["n"], r["rho"] is not None and r["rho"] > 0.3)


def h4_clusters(spark: SparkSession, d: str) -> Result:
    """Communities of jobs agree with their major more than by chance; the statistic is NMI, the effect AMI."""
    e = graph.jaccard_edges(edges_of(spark, d), "job", "key").select("u", "v", "w")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v"))
    c = graph.louvain(spark, nodes, e).withColumn("major", F.split_part(F.col("node"), F.lit("|"), F.lit(1)))
    r = resample.permutation_null(spark, c, "major", "community").first()
    return _result("h4", r["observed"], r["p"], agreement.ami(c, "major", "community"), c.count(), r["p"] < 0.05)


def h5_revision(spark: SparkSession, d: str) -> Result:
    """Revision years differ between majors."""
    return _kruskal("h5", _metrics(spark, d), "major", "mean_rev_year", 0.06)


def h6_digital(spark: SparkSession, d: str) -> Result:
    """Digital share differs between majors."""
    return _kruskal("h6", _metrics(spark, d), "major", "digital_a", 0.14)


def s1_levels(spark: SparkSession, d: str) -> Result:
    """Levels differ between majors."""
    return _kruskal("s1", _metrics(spark, d), "major", "mean_level", 0.06)


def s2_attitudes(spark: SparkSession, d: str) -> Result:
    """Categories of items depend on the major."""
    i = items(spark, d).select("major", "p_type")
    r = stats.chi_square(i, "major", "p_type").first()
    return _result("s2", r["chi2"], special.chi2_tail(r["chi2"], r["dof"]), r["cramers_v"], r["n"], r["cramers_v"] >= 0.1)


def s4_overlap(spark: SparkSession, d: str) -> Result:
    """Three rankings of nations agree."""
    g = _metrics(spark, d).groupBy("middle").agg(*(F.avg(c).alias(c) for c in ("digital_a", "mean_rev_year", "unique_rate")))
    r = stats.kendall_w(g, "middle", "digital_a", "mean_rev_year", "unique_rate").first()
    return _result("s4", r["chi2"], special.chi2_tail(r["chi2"], r["n"] - 1), r["w"], r["n"], r["w"] > 0.5)


REGISTRY: dict[str, Callable[[SparkSession, str], Result]] = {
    "h1": h1_template, "h2": h2_duplication, "h3": h3_fragmentation, "h4": h4_clusters, "h5": h5_revision,
    "h6": h6_digital, "s1": s1_levels, "s2": s2_attitudes, "s4": s4_overlap,
}


def hypotheses(spark: SparkSession, d: str, names: tuple[str, ...] = tuple(REGISTRY)) -> DataFrame:
    """All hypotheses with their false discovery control."""
    rows = [REGISTRY[n](spark, d) for n in names]
    kind = "name string, statistic double, p double, effect double, n long, expectation_met boolean"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    tested = stats.benjamini_hochberg(df.select("name", "p"), "p").select("name", "rank", "crit", "reject")
    return df.join(tested, "name", "left")


def replication(spark: SparkSession, d: str) -> DataFrame:
    """Digital share against majors in two halves of the jobs: both significant and of one sign."""
    m = sampling.split_half(_metrics(spark, d), "major", "job")
    rows = []
    for half in "AB":
        r = stats.spearman(m.filter(F.col("half") == half), "digital_a", "unique_rate").first()
        rows.append((half, r["rho"], None if r["rho"] is None else stats.spearman_p(r["rho"], r["n"]), r["n"]))
    (_, a, pa, _), (_, b, pb, _) = rows
    agree = None not in (a, b) and pa < 0.05 and pb < 0.05 and (a >= 0) == (b >= 0)
    return spark.createDataFrame([(*r, agree) for r in rows], "half string, rho double, p double, n long, agree boolean")


def job_fragmentation_spread(spark: SparkSession, d: str) -> DataFrame:
    """Fragmentation index and type mismatch by major, with the spread of the jobs' indexes."""
    t = tokens(spark, d).filter("key <> ''")
    jobs = fragment.by_group(t, "job").withColumn("major", F.split_part(F.col("job"), F.lit("|"), F.lit(1)))
    spread = jobs.groupBy("major").agg(F.count("*").alias("n_jobs"), F.round(F.min("frag_index"), 6).alias("low"), F.round(F.max("frag_index"), 6).alias("high"))
    return fragment.by_group(t, "major").join(spread, "major").withColumn("frag_index", F.round("frag_index", 6))


_SPREAD = r"""WITH tok AS (SELECT DISTINCT lang || '|' || source AS job, lang AS major, surface, lower(regexp_replace(surface, '[^\p{L}\p{N}]+', '', 'g')) AS key
  FROM (SELECT lang, source, unnest(regexp_split_to_array(text, '\s+')) AS surface FROM documents) WHERE surface <> ''), t AS (SELECT * FROM tok WHERE key <> ''),
j AS (SELECT job, split_part(job, '|', 1) AS major, count(DISTINCT surface) / count(DISTINCT key) AS f FROM t GROUP BY job),
s AS (SELECT major, count(*) AS n_jobs, round(min(f), 6) AS low, round(max(f), 6) AS high FROM j GROUP BY major)
SELECT major, count(DISTINCT surface) AS n_surfaces, count(DISTINCT key) AS n_keys, round(count(DISTINCT surface) / count(DISTINCT key), 6) AS frag_index, any_value(n_jobs) AS n_jobs, any_value(low) AS low, any_value(high) AS high
FROM t JOIN s USING (major) GROUP BY major"""

QUERIES = {
    "hypotheses": (hypotheses, None),
    "replication": (replication, None),
    "job_fragmentation_spread": (job_fragmentation_spread, _SPREAD),
}
