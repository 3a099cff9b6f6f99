"""Rank tests, concentration, association and scaling.

Inputs have one row per unit of analysis (a job, a group), unless a function first reduces its rows by
value. Nulls take no part. Results are one row unless stated otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolyte.functions.special import chi2_tail, t_two_sided


def midranks(df: DataFrame, value: str, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """df with the average rank of value among non-null values (within by). Only one row per distinct
    value goes through the ordered window."""
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(value))
    ranks = counts.select(*by, value, (upto - (F.col("_n") - 1) / 2).alias(rank))
    return df.join(ranks, [*by, value], "left")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """h (corrected for ties), k groups, n, eps2; null h with fewer than two groups or one distinct value."""
    rows = df.filter(F.col(value).isNotNull())
    ranked = midranks(rows, value)
    groups = ranked.groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("m"))
    sums = groups.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.count("*").alias("k"), F.sum("m").alias("n"))
    ties = rows.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    out = sums.join(F.broadcast(ties)).select(F.when((F.col("k") >= 2) & (n > 1), h).alias("h"), "k", "n")
    return out.withColumn("eps2", (F.col("h") - F.col("k") + 1) / F.nullif(F.col("n") - F.col("k"), F.lit(0)))


def kruskal_p(row) -> float | None:
    return None if row["h"] is None else chi2_tail(row["h"], row["k"] - 1)


def spearman(df: DataFrame, x: str, y: str, least: int = 8) -> DataFrame:
    """rho of complete pairs and n; null rho with fewer pairs than least."""
    rows = df.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = midranks(midranks(rows, x, "rx"), y, "ry")
    return ranked.agg(F.when(F.count("*") >= least, F.corr("rx", "ry")).alias("rho"), F.count("*").alias("n"))


def spearman_p(rho: float, n: int) -> float:
    return 0.0 if abs(rho) >= 1 else t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def centered(df: DataFrame, group: str, *values: str) -> DataFrame:
    """Values less their group's mean."""
    w = Window.partitionBy(group)
    return df.withColumns({v: F.col(v) - F.avg(v).over(w) for v in values})


def gini(df: DataFrame, value: str, shift: bool = True) -> DataFrame:
    """Gini coefficient, by default of values less their minimum plus 1e-9; reduced by value first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("m"))
    low = counts.agg(F.min("v").alias("low"))
    w = Window.orderBy("v")
    v = F.col("v") - F.col("low") + 1e-9 if shift else F.col("v")
    # The ranks of m equal values sum to m * (last - (m - 1) / 2).
    one = counts.withColumn("last", F.sum("m").over(w)).join(F.broadcast(low)).withColumn("v", v)
    sums = one.agg(
        F.sum(F.col("v") * F.col("m") * (F.col("last") - (F.col("m") - 1) / 2)).alias("a"), F.sum(F.col("v") * F.col("m")).alias("b"), F.sum("m").alias("n")
    )
    return sums.select((2 * F.col("a") / F.nullif(F.col("n") * F.col("b"), F.lit(0.0)) - (F.col("n") + 1) / F.col("n")).alias("gini"), F.col("n").cast("long").alias("n"))


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.05) -> DataFrame:
    """df's rows with a p-value, with their step-up rank, crit and reject. One row per test."""
    rows = df.filter(F.col(p).isNotNull() & ~F.isnan(p))
    everything = Window.partitionBy()
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(p, *[c for c in rows.columns if c != p]))).withColumn("m", F.count("*").over(everything))
    crit = q * F.col("rank") / F.col("m")
    out = ranked.withColumn("crit", crit)
    last = F.coalesce(F.max(F.when(F.col(p) <= F.col("crit"), F.col("rank"))).over(everything), F.lit(0))
    return out.withColumn("reject", F.col("rank") <= last).drop("m")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts n of each pair of values."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 (Yates-corrected for 2 by 2), dof, n and Cramér's v of two columns, from their contingency counts."""
    cells = contingency(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{s}")) for c, s in ((a, "a"), (b, "b")))
    total = cells.agg(F.sum("n").cast("double").alias("n_all"))
    sizes = rows.agg(F.count("*").alias("ra")).join(F.broadcast(cols.agg(F.count("*").alias("rb"))))
    # All cells, also empty ones: rows times columns of the table, not of the data.
    grid = rows.join(F.broadcast(cols)).join(F.broadcast(total)).join(cells, [a, b], "left").join(F.broadcast(sizes))
    expected = F.col("n_a") * F.col("n_b") / F.col("n_all")
    gap = F.abs(F.coalesce("n", F.lit(0)) - expected)
    gap = F.when((F.col("ra") == 2) & (F.col("rb") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = grid.agg(F.sum(gap * gap / expected).alias("chi2"), F.first("ra").alias("ra"), F.first("rb").alias("rb"), F.first("n_all").alias("n_all"))
    least = F.least("ra", "rb") - 1
    return out.select("chi2", ((F.col("ra") - 1) * (F.col("rb") - 1)).alias("dof"), F.col("n_all").cast("long").alias("n"), F.sqrt(F.col("chi2") / F.nullif(F.col("n_all") * least, F.lit(0.0))).alias("cramers_v"))


def kendall_w(df: DataFrame, unit: str, *rankings: str) -> DataFrame:
    """Agreement w of rankings of units, its chi2 with n - 1 degrees, and n."""
    ranked = df
    for r in rankings:
        ranked = midranks(ranked, r, f"_{r}")
    k = len(rankings)
    total = sum((F.col(f"_{r}") for r in rankings[1:]), F.col(f"_{rankings[0]}"))
    sums = ranked.select(total.alias("s")).agg((F.var_pop("s") * F.count("*")).alias("ss"), F.count("*").cast("double").alias("n"))
    w = 12 * F.col("ss") / (k * k * (F.pow("n", F.lit(3)) - F.col("n")))
    return sums.select(w.alias("w"), (k * (F.col("n") - 1) * w).alias("chi2"), F.col("n").cast("long").alias("n"))


def zscore(value: Column, window=None) -> Column:
    """Standard score with the population deviation, 1 where that is 0."""
    w = window or Window.partitionBy()
    return (value - F.avg(value).over(w)) / F.coalesce(F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)), F.lit(1.0))


def minmax(value: Column, invert: bool = False, window=None) -> Column:
    """value scaled to 0..1, 0.5 if constant."""
    w = window or Window.partitionBy()
    low, high = F.min(value).over(w), F.max(value).over(w)
    scaled = F.when(high > low, (value - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5)
    return 1 - scaled if invert else scaled


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of non-null values with weights, null if the weights sum to 0."""
    there = F.col(value).isNotNull()
    return F.sum(F.when(there, F.col(value) * F.col(weight))) / F.nullif(F.sum(F.when(there, F.col(weight))).cast("double"), F.lit(0.0))


def linear_fit(df: DataFrame, y: str, *xs: str) -> list[float]:
    """Intercept and slopes by least squares; Spark sums the normal equations, rows with a null or non-finite value are left out."""
    names = [*xs, y]
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df
    for c in names:
        rows = rows.filter(finite(c))
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in names)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = rows.agg(*(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in pairs)).first()
    p = len(xs) + 1
    get = lambda i, j: sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0
    m = [[get(i, j) for j in range(p)] + [get(i, p)] for i in range(p)]
    for i in range(p):  # Gauss-Jordan with pivoting
        best = max(range(i, p), key=lambda r: abs(m[r][i]))
        m[i], m[best] = m[best], m[i]
        if m[i][i] == 0:
            raise ValueError("the columns are linearly dependent")
        m[i] = [v / m[i][i] for v in m[i]]
        for r in range(p):
            if r != i:
                m[r] = [a - m[r][i] * b for a, b in zip(m[r], m[i], strict=True)]
    return [row[-1] for row in m]


def residual(y: str, xs: list[str], weights: list[float]) -> Column:
    out = F.col(y) - weights[0]
    for x, w in zip(xs, weights[1:], strict=True):
        out = out - w * F.col(x)
    return out


def smallest_half(df: DataFrame, unit: str, count: str) -> DataFrame:
    """k50: the fewest units, most first, that hold half of all counts, and how many units have any."""
    w = Window.orderBy(F.desc(count), unit).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.filter(F.col(count) > 0).withColumn("cum", F.sum(count).over(w)).withColumn("all", F.sum(count).over(Window.partitionBy()))
    return rows.agg((F.count_if(2 * F.col("cum") < F.col("all")) + 1).alias("k50"), F.count("*").alias("n_units"), F.sum(count).alias("total"))
