"""Bootstraps and permutation nulls. Data are first reduced to distinct rows with counts, which stay on the workers in
buckets of about BUCKET distinct rows; a replicate is a multinomial draw of counts, split over the buckets by another.
Every draw has a generator of its own, so results don't depend on the number of tasks, and no number of rows is too large."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct rows in a bucket, about, and replicates that a task draws from one.
BUCKET, RUNS = 65_536, 250


def _runs(spark: SparkSession, n: int, one: Callable[[np.random.Generator], float], seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "value": [one(np.random.default_rng([seed, int(i)])) for i in pdf["id"]]})

    return spark.range(0, n, 1, min(32, max(1, n // 50))).mapInPandas(run, "id long, value double")


def _sums(df: DataFrame, columns: list[str], n: int, seed: int) -> DataFrame:
    """id, sums: of the columns and of ones, over rows drawn with replacement (as many as df has) for each id from 0
    to n - 1, and over all rows for id -1."""
    k = len(columns)
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"v{i}") for i, c in enumerate(columns)]
    distinct = df.select(*values).groupBy(*(f"v{i}" for i in range(k))).agg(F.count("*").alias("n"))
    n_buckets = max(1, -(-distinct.count() // BUCKET))
    distinct = distinct.withColumn("bucket", F.pmod(F.xxhash64(*(f"v{i}" for i in range(k))), F.lit(n_buckets)).cast("int"))
    found = {r["bucket"]: r["n"] for r in distinct.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # n_buckets rows at most
    sizes = np.array([found.get(b, 0) for b in range(n_buckets)], np.int64)
    total = int(sizes.sum())

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, part = (int(x) for x in key)
        pdf = pdf.sort_values([f"v{i}" for i in range(k)])
        x = np.column_stack([*(pdf[f"v{i}"].to_numpy(float) for i in range(k)), np.ones(len(pdf))])
        counts = pdf["n"].to_numpy(np.int64)
        ids = list(range(part * RUNS, min(n, (part + 1) * RUNS)))
        out = [counts @ x] if part == 0 else []
        for i in ids:
            share = np.random.default_rng([seed, i]).multinomial(total, sizes / total)[bucket]
            out.append(np.random.default_rng([seed, i, bucket + 1]).multinomial(share, counts / counts.sum()) @ x)
        return pd.DataFrame({"id": [-1] * (part == 0) + ids, "bucket": bucket, "sums": [list(o) for o in out]})

    parts = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // RUNS) - 1))))
    drawn = distinct.withColumn("part", parts).groupBy("bucket", "part").applyInPandas(draw, "id long, bucket int, sums array<double>")
    # Buckets are added in order, so that results are the same to the last bit.
    each = drawn.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bucket", "sums"))).alias("all"))
    zero = F.array_repeat(F.lit(0.0), k + 1)
    return each.select("id", F.aggregate("all", zero, lambda a, x: F.zip_with(a, x["sums"], lambda p, q: p + q)).alias("sums"))


def _values(sums: DataFrame, value) -> DataFrame:
    """value of each replicate, nan left out, and of all rows (seen, on each row)."""
    one = sums.select("id", value.alias("value"))
    seen = one.filter("id = -1").agg(F.first("value").alias("seen"))
    return one.filter("id >= 0 AND value IS NOT NULL").filter(~F.isnan("value")).join(F.broadcast(seen), how="right")


def bootstrap_ratio(spark: SparkSession, clusters: DataFrame, num: str, den: str, n: int = 2000, seed: int = 20260909, level: float = 0.95) -> DataFrame:
    """lo, hi, estimate of sum(num) / sum(den), clusters drawn with replacement (one row each)."""
    a, b = F.col("sums")[0], F.col("sums")[1]
    tail = (1 - level) / 2
    runs = _values(_sums(clusters, [num, den], n, seed), F.when(b != 0, a / b))
    return runs.agg(F.percentile("value", tail).alias("lo"), F.percentile("value", 1 - tail).alias("hi"), F.first("seen").alias("estimate"))


def bootstrap_difference(spark: SparkSession, pairs: DataFrame, difference: str, n: int = 4000, seed: int = 20260909) -> DataFrame:
    """mean, lo, hi of paired differences and the share of replicates at or below 0."""
    runs = _values(_sums(pairs, [difference], n, seed), F.when(F.col("sums")[1] > 0, F.col("sums")[0] / F.col("sums")[1]))
    return runs.agg(
        F.first("seen").alias("mean"), F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"), F.avg((F.col("value") <= 0).cast("double")).alias("p_at_most_0")
    )


def bootstrap_by_group(spark: SparkSession, rows: DataFrame, group: str, num: str, den: str, n: int = 2000, seed: int = 20260909) -> DataFrame:
    """group, lo, hi, estimate of sum(num) / sum(den) for each of a few groups."""
    out = None
    for name in sorted(r[0] for r in rows.select(group).filter(F.col(group).isNotNull()).distinct().collect()):  # strata of a design
        one = bootstrap_ratio(spark, rows.filter(F.col(group) == name), num, den, n, seed).select(F.lit(name).alias(group), "lo", "hi", "estimate")
        out = one if out is None else out.unionByName(one)
    return out


def joint_recovery(spark: SparkSession, sample: DataFrame, buckets: DataFrame, policies: dict[str, list[str]], n_surfaces: int, rule: float, n: int = 4000, seed: int = 20260909) -> DataFrame:
    """policy, verified, recovery, lo, hi: verified recovery with all strata drawn anew in each replicate.

    sample: bucket, num, den of judged items; buckets: bucket, keys_absorbed. A stratum without judged items counts as 0.
    """
    total = None
    for k, name in enumerate(sorted({b for x in policies.values() for b in x})):  # size buckets
        sums = _sums(sample.filter(F.col("bucket") == name), ["num", "den"], n, seed + k)
        one = sums.select("id", F.lit(name).alias("bucket"), F.when(F.col("sums")[1] > 0, F.col("sums")[0] / F.col("sums")[1]).otherwise(0.0).alias("p"))
        total = one if total is None else total.unionByName(one)
    named = F.array(*(F.when(F.col("bucket").isin(*b), F.lit(p)) for p, b in policies.items()))
    rows = total.join(F.broadcast(buckets.select("bucket", "keys_absorbed")), "bucket")  # a row per bucket
    rows = rows.select("id", (F.col("p") * F.col("keys_absorbed")).alias("v"), F.explode(F.filter(named, lambda x: x.isNotNull())).alias("policy"))
    each = rows.groupBy("policy", "id").agg(F.sum("v").alias("v"))
    recovery = lambda v: rule + v / n_surfaces
    drawn = F.when(F.col("id") >= 0, F.col("v"))
    out = each.groupBy("policy").agg(F.max(F.when(F.col("id") < 0, F.col("v"))).alias("verified"), F.percentile(drawn, 0.025).alias("a"), F.percentile(drawn, 0.975).alias("b"))
    return out.select("policy", "verified", recovery(F.col("verified")).alias("recovery"), recovery(F.col("a")).alias("lo"), recovery(F.col("b")).alias("hi"))


def _codes(values: list) -> np.ndarray:
    return np.unique(np.array([str(v) for v in values]), return_inverse=True)[1]


def nmi(table: np.ndarray) -> float:
    p = table / table.sum()
    x, y = p.sum(1), p.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        mi = np.nansum(np.where(p > 0, p * np.log(p / np.outer(x, y)), 0))
    h = (-(x[x > 0] * np.log(x[x > 0])).sum() - (y[y > 0] * np.log(y[y > 0])).sum()) / 2
    return float(mi / h) if h > 0 else 1.0


def permutation_null(spark: SparkSession, labels: DataFrame, truth: str, pred: str, n: int = 1000, seed: int = 20260909) -> DataFrame:
    """observed nmi, mean and sd of nmi with shuffled labels, p = (as large or larger + 1) / (n + 1).

    nmi depends only on the counts of pairs of labels, which shuffling makes a random table with the same margins; it is
    drawn row by row. numpy draws from fewer than 10**9 rows. The driver holds a row for each pair of labels that occurs.
    """
    rows = labels.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n")).collect()
    a, b = _codes([r["t"] for r in rows]), _codes([r["p"] for r in rows])
    table = np.zeros((a.max() + 1, b.max() + 1), np.int64)
    np.add.at(table, (a, b), [r["n"] for r in rows])
    sizes, columns = table.sum(1), table.sum(0)
    seen = nmi(table)

    def one(rng: np.random.Generator) -> float:
        left, out = columns.copy(), np.zeros_like(table)
        for i, size in enumerate(sizes):
            out[i] = rng.multivariate_hypergeometric(left, size, method="marginals")
            left -= out[i]
        return nmi(out)

    runs = _runs(spark, n, one, seed)
    return runs.agg(
        F.lit(seen).alias("observed"), F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_sd"), ((F.count_if(F.col("value") >= seen) + 1) / (n + 1)).alias("p")
    )


def bootstrap_alpha(spark: SparkSession, ratings: DataFrame, item: str, value: str, n: int = 1000, seed: int = 20260909) -> DataFrame:
    """lo, hi of Krippendorff's nominal alpha, items drawn with replacement."""
    counts = ratings.filter(F.col(value).isNotNull()).groupBy(item).pivot(value).count().na.fill(0)
    names = [c for c in counts.columns if c != item]
    k = len(names)
    # Alpha is made of sums over items: ratings by value, and disagreeing pairs over the item's ratings less one.
    cells = counts.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)))
    m = sum((F.col(f"c{i}") for i in range(k)), F.lit(0.0))
    squares = sum((F.col(f"c{i}") * F.col(f"c{i}") for i in range(k)), F.lit(0.0))
    cells = cells.filter(m >= 2).withColumn("apart", (m * m - squares) / (m - 1))
    s = [F.col("sums")[i] for i in range(k + 1)]
    total = sum(s[:k], F.lit(0.0))
    expected = (total * total - sum((x * x for x in s[:k]), F.lit(0.0))) / (total * (total - 1))
    runs = _values(_sums(cells, [*(f"c{i}" for i in range(k)), "apart"], n, seed), F.when((total > 1) & (expected != 0), 1 - s[k] / total / expected))
    return runs.agg(F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"))
