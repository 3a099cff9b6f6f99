"""Graphs of jobs that share keys, components and communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolyte.session import materialize


def prune_keys(edges: DataFrame, job: str, key: str, least: int = 2, drop_share: float | None = None) -> DataFrame:
    """Distinct (job, key) of keys in at least so many jobs; with drop_share, keys in more than
    int(jobs * drop_share) jobs go too."""
    rows = edges.select(job, key).distinct()
    degree = rows.groupBy(key).agg(F.count("*").alias("_d")).filter(F.col("_d") >= least)
    if drop_share is not None:
        n = rows.agg(F.floor(F.count_distinct(job) * F.lit(drop_share)).alias("_most"))
        degree = degree.join(F.broadcast(n)).filter(F.col("_d") <= F.col("_most"))
    return rows.join(degree.select(key), key).select(job, key)


def shared(edges: DataFrame, job: str, key: str, weight: str | None = None) -> DataFrame:
    """u, v (u < v), common: the number of shared keys, or the sum of products of weights."""
    a = edges.select(F.col(key), F.col(job).alias("u"), *([F.col(weight).alias("wu")] if weight else []))
    b = edges.select(F.col(key), F.col(job).alias("v"), *([F.col(weight).alias("wv")] if weight else []))
    common = F.sum(F.col("wu") * F.col("wv")) if weight else F.count("*")
    return a.join(b, key).filter("u < v").groupBy("u", "v").agg(common.alias("common"))


def jaccard_edges(edges: DataFrame, job: str, key: str, least: int = 2, drop_share: float | None = None) -> DataFrame:
    """u, v, common, w: Jaccard similarity of jobs on their remaining keys."""
    rows = prune_keys(edges, job, key, least, drop_share)
    size = rows.groupBy(job).agg(F.count("*").alias("n"))
    out = shared(rows, job, key)
    out = out.join(size.select(F.col(job).alias("u"), F.col("n").alias("nu")), "u").join(size.select(F.col(job).alias("v"), F.col("n").alias("nv")), "v")
    return out.select("u", "v", "common", (F.col("common") / (F.col("nu") + F.col("nv") - F.col("common"))).alias("w"))


def tfidf_edges(edges: DataFrame, job: str, key: str, least: int = 2) -> DataFrame:
    """u, v, w: cosine of binary TF-IDF vectors, idf = ln(jobs / jobs with the key)."""
    rows = prune_keys(edges, job, key, least)
    n = rows.agg(F.count_distinct(job).alias("_n"))
    idf = rows.groupBy(key).agg(F.count("*").alias("_d")).join(F.broadcast(n)).select(key, F.ln(F.col("_n") / F.col("_d")).alias("idf"))
    rows = rows.join(idf, key)
    norm = rows.groupBy(job).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    unit = rows.join(norm, job).filter("norm > 0").select(job, key, (F.col("idf") / F.col("norm")).alias("x"))
    return shared(unit, job, key, "x").filter("common > 0").withColumnRenamed("common", "w")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (u, v, w) in both directions."""
    return edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """u, v, w, rank: each node's k most similar others, ties by name."""
    w = Window.partitionBy("u").orderBy(F.desc("w"), "v")
    return both_ways(edges).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pulled(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """node, own, other, best, is_pulled: mean similarity to the own group (without itself) and to the best
    other group, absent edges being 0. groups: node, grp."""
    size = groups.groupBy("grp").agg(F.count("*").alias("size"))
    to = both_ways(edges).join(groups.select(F.col("node").alias("v"), F.col("grp").alias("g")), "v").groupBy("u", "g").agg(F.sum("w").alias("s"))
    rows = to.join(groups.select(F.col("node").alias("u"), "grp"), "u").join(size.select(F.col("grp").alias("g"), "size"), "g")
    same = F.col("g") == F.col("grp")
    mean = F.col("s") / F.when(same, F.greatest(F.col("size") - 1, F.lit(1))).otherwise(F.col("size"))
    rows = rows.withColumn("mean", mean)
    best = F.max(F.when(~same, F.struct("mean", (F.col("g")).alias("g"))))
    found = rows.groupBy("u").agg(F.max(F.when(same, F.col("mean"))).alias("own"), best.alias("b"))
    out = groups.join(found, groups.node == found.u, "left")
    own, other = F.coalesce("own", F.lit(0.0)), F.coalesce("b.mean", F.lit(0.0))
    return out.select("node", "grp", own.alias("own"), other.alias("other"), F.col("b.g").alias("best"), (own < other).alias("is_pulled"))


def components(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over edges (u, v); nodes without edges are their own.

    Rounds of least label and pointer jumping; each is written out, so lineage stays short.
    """
    both = materialize(spark, edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct(), "cc-edges")
    labels = materialize(spark, both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "cc")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        hook = labels.join(near, labels.node == near.u).groupBy("comp").agg(F.min("near").alias("to")).filter("to < comp")
        up = labels.join(hook, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        up = materialize(spark, up, "cc")
        jump = up.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = materialize(spark, up.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "cc")
        if new.join(labels, ["node", "comp"], "left_anti").isEmpty():
            return nodes.select("node").distinct().join(new, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
        labels = new


def _louvain(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, total: float, resolution: float, seed: int) -> np.ndarray:
    """Communities of one component by local moves and aggregation; total is the weight of the whole graph."""
    rng = np.random.default_rng(seed)
    label = np.arange(n)
    loops = np.zeros(n)
    while True:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        for a, b, x in zip(u.tolist(), v.tolist(), w.tolist(), strict=True):
            near[a][b] = near[a].get(b, 0.0) + x
            near[b][a] = near[b].get(a, 0.0) + x
        degree = np.array([sum(m.values()) for m in near]) + 2 * loops
        own = np.arange(n)
        weight = degree.copy()
        moved = improved = True
        while moved:
            moved = False
            for i in rng.permutation(n).tolist():
                links: dict[int, float] = {}
                for j, x in near[i].items():
                    links[own[j]] = links.get(own[j], 0.0) + x
                here = own[i]
                weight[here] -= degree[i]
                gain = lambda c: links.get(c, 0.0) - resolution * degree[i] * weight[c] / (2 * total)  # noqa: B023, E731
                best = max(sorted(links), key=gain, default=here)
                if best != here and gain(best) <= gain(here) + 1e-12:
                    best = here
                weight[best] += degree[i]
                if best != here:
                    own[i] = best
                    moved = True
        names, own = np.unique(own, return_inverse=True)
        improved = len(names) < n
        label = own[label]
        if not improved:
            return label
        inner = own[u] == own[v]
        new = np.bincount(own, loops, len(names)) + np.bincount(own[u[inner]], w[inner], len(names))
        u, v, w, loops, n = own[u[~inner]], own[v[~inner]], w[~inner], new, len(names)


def louvain(spark: SparkSession, nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 20260909) -> DataFrame:
    """node, community (its smallest node) by Louvain's method on edges (u, v, w).

    Components are independent but for the graph's total weight, so each is one task. Nodes are taken in
    name order and moves in seeded order, so equal input gives equal output.
    """
    edges = materialize(spark, edges.select("u", "v", "w"), "louvain-edges")  # used several times
    comps = components(spark, nodes, edges)
    total = edges.agg(F.sum("w").alias("t")).first()["t"] or 1.0
    kind = nodes.schema["node"].dataType.simpleString()
    rows = edges.select("u", "v", F.col("w").cast("double").alias("w")).join(comps.select(F.col("node").alias("u"), "comp"), "u")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"])
        names = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]))
        at = {x: i for i, x in enumerate(names.tolist())}
        u, v = (np.array([at[x] for x in pdf[c]], np.int64) for c in "uv")
        label = _louvain(len(names), u, v, pdf["w"].to_numpy(), total, resolution, seed)
        first = {}
        for i, c in enumerate(label.tolist()):
            first.setdefault(c, names[i])
        return pd.DataFrame({"node": names, "community": [first[c] for c in label.tolist()]})

    found = rows.groupBy("comp").applyInPandas(one, f"node {kind}, community {kind}")
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


def louvain_pairs(spark: SparkSession, nodes: DataFrame, pairs: DataFrame, threshold: float, seed: int = 20260909) -> DataFrame:
    """node, community, min_sim: Louvain on pairs (i, j, sim) of at least the threshold, weighted by similarity; min_sim is the
    least similarity of an edge within the community, null for those of one node."""
    edges = materialize(spark, pairs.filter(F.col("sim") >= threshold).select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("sim").alias("w")), "pairs")
    found = materialize(spark, louvain(spark, nodes, edges, seed=seed), "communities")
    a, b = (found.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "uv")
    least = edges.join(a, "u").join(b, "v").filter("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.min("w").alias("min_sim"))
    return found.join(least, "community", "left").select("node", "community", "min_sim")


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """q of a partition (node, community) of the graph (u, v, w)."""
    c = communities
    rows = edges.join(c.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(c.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
    inner = rows.agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("m"))
    degree = both_ways(edges).join(c.select(F.col("node").alias("u"), "community"), "u").groupBy("community").agg(F.sum("w").alias("d"))
    squares = degree.agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    m = F.col("m")
    return inner.join(F.broadcast(squares)).select((F.col("inner") / m - resolution * F.col("dd") / (4 * m * m)).alias("q"))


def seeds(spark: SparkSession, nodes: DataFrame, edges: DataFrame, resolution: float, n: int) -> Iterator[DataFrame]:
    """Partitions from n seeds."""
    for seed in range(n):
        yield louvain(spark, nodes, edges, resolution, seed)
