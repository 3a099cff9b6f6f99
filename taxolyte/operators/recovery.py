"""Clusters of keys against a known truth, and what merging them recovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolyte.functions.text import size_bucket


def with_truth(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """pairs (i, j, ...) with same: whether both have a concept in common. concepts: node, concept."""
    a, b = (concepts.select(F.col("node").alias(x), F.col("concept").alias("_c")) for x in "ij")
    hit = pairs.select("i", "j").join(a, "i").join(b, ["j", "_c"]).select("i", "j").distinct().withColumn("_hit", F.lit(True))
    return pairs.join(hit, ["i", "j"], "left").withColumn("same", F.coalesce("_hit", F.lit(False))).drop("_hit")


def true_pairs(concepts: DataFrame) -> DataFrame:
    """i < j that share a concept."""
    a, b = (concepts.select("concept", F.col("node").alias(x)) for x in "ij")
    return a.join(b, "concept").filter("i < j").select("i", "j").distinct()


def n_true_pairs(concepts: DataFrame) -> DataFrame:
    """n: how many pairs of nodes share a concept, counted and not made, where each node has one concept."""
    m = concepts.filter("concept IS NOT NULL").groupBy("concept").agg(F.count("*").alias("m"))
    return m.agg(F.coalesce(F.sum((F.col("m") * (F.col("m") - 1) / 2).cast("long")), F.lit(0)).alias("n"))


def cluster_sizes(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """By size bucket of clusters of several nodes: clusters, keys_absorbed, intra_pairs, direct_edge_pairs,
    direct_edge_share. clusters: node, comp; edges: i, j."""
    size = clusters.groupBy("comp").agg(F.count("*").alias("size")).filter("size > 1")
    inner = edges.join(clusters.select(F.col("node").alias("i"), "comp"), "i").join(clusters.select(F.col("node").alias("j"), F.col("comp").alias("cj")), "j").filter("comp = cj")
    direct = inner.groupBy("comp").agg(F.count("*").alias("direct"))
    rows = size.join(direct, "comp", "left").na.fill(0, ["direct"])
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return rows.groupBy(size_bucket(F.col("size")).alias("bucket")).agg(
        F.count("*").alias("clusters"),
        F.sum(F.col("size") - 1).alias("keys_absorbed"),
        F.sum(pairs).cast("long").alias("intra_pairs"),
        F.sum("direct").alias("direct_edge_pairs"),
        (F.sum("direct") / F.sum(pairs)).alias("direct_edge_share"),
    )


def cluster_truth(clusters: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """n_clusters, absorbed, verified (nodes less distinct concept sets of clusters), merge_precision,
    n_transitive and transitive_precision (pairs without an edge). Pairs are counted, not made: equal
    pairs of a cluster from its counts per concept set, which holds where each node has one concept."""
    sets = concepts.groupBy("node").agg(F.array_join(F.sort_array(F.collect_set(F.col("concept").cast("string"))), "|").alias("set"))
    rows = clusters.join(sets, "node")
    by_set = rows.groupBy("comp", "set").agg(F.count("*").alias("m"))
    per = by_set.groupBy("comp").agg(F.sum("m").alias("size"), F.count("*").alias("sets"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("same_pairs")).filter("size > 1")
    inner = edges.select("i", "j").join(rows.select(F.col("node").alias("i"), "comp", F.col("set").alias("si")), "i")
    inner = inner.join(rows.select(F.col("node").alias("j"), F.col("comp").alias("cj"), F.col("set").alias("sj")), "j").filter("comp = cj")
    direct = inner.groupBy("comp").agg(F.count("*").alias("d"), F.count_if(F.col("si") == F.col("sj")).alias("dh"))
    rows = per.join(direct, "comp", "left").na.fill(0, ["d", "dh"])
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return rows.agg(
        F.count("*").alias("n_clusters"),
        F.sum(F.col("size") - 1).alias("absorbed"),
        F.sum(F.col("size") - F.col("sets")).alias("verified"),
        (F.sum(F.col("size") - F.col("sets")) / F.sum(F.col("size") - 1)).alias("merge_precision"),
        F.sum(pairs - F.col("d")).cast("long").alias("n_transitive"),
        (F.sum(F.col("same_pairs") - F.col("dh")) / F.nullif(F.sum(pairs - F.col("d")), F.lit(0.0))).alias("transitive_precision"),
    )


def summary(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_nodes, n_clusters, reduction, participation by stratum. nodes: node, stratum."""
    size = clusters.groupBy("comp").agg(F.count("*").alias("size"))
    rows = nodes.join(clusters, "node").join(size, "comp")
    return rows.groupBy("stratum").agg(F.count("*").alias("n_nodes"), F.avg((F.col("size") > 1).cast("int")).alias("participation"), F.sum(1 - 1 / F.col("size")).alias("absorbed"))


def merge_path(n_single: Column, n: Column, n_jobs: Column) -> Column:
    """How a merge of keys joins single-job keys: c into a shared key, a across jobs, b within one job."""
    return F.when(n_single < n, "c").when(n_jobs > 1, "a").otherwise("b")


def expected_precision(share_direct: Column, direct: float, transitive: float) -> Column:
    return share_direct * direct + (1 - share_direct) * transitive


def verified_recovery(buckets: DataFrame, precision: DataFrame, direct: float, n_surfaces: int, rule: float) -> DataFrame:
    """policy, keys_absorbed, verified, recovery: what is verified by size policies.

    buckets: bucket, keys_absorbed, direct_edge_share; precision: bucket, transitive. Size-2 clusters have
    direct edges only. recovery is the rule stage's plus verified keys over surfaces.
    """
    order = ["2", "3-5", "6-20", "21-100", "100+"]
    rows = buckets.join(precision, "bucket", "left").na.fill(0.0, ["direct_edge_share", "transitive"])
    share = F.when(F.col("bucket") == "2", 1.0).otherwise(F.col("direct_edge_share"))
    rows = rows.withColumn("verified", F.col("keys_absorbed") * expected_precision(share, F.lit(direct), F.col("transitive")))
    policies = F.array(*(F.when(F.col("bucket").isin(*order[:k]), F.lit(name)) for name, k in (("size2", 1), ("size<=5", 2), ("size<=20", 3), ("all", 5))))
    rows = rows.select("keys_absorbed", "verified", F.explode(F.filter(policies, lambda x: x.isNotNull())).alias("policy"))
    out = rows.groupBy("policy").agg(F.sum("keys_absorbed").alias("keys_absorbed"), F.sum("verified").alias("verified"))
    return out.withColumn("recovery", rule + F.col("verified") / n_surfaces)


def singleton_accounting(clusters: DataFrame, single: DataFrame, caps: dict[str, int | None]) -> DataFrame:
    """layer, merged_keys, merged_single, merged_shared, single_into_shared: keys in clusters of several keys up to each
    cap, those of one job (single: node, single) and of several, and single ones that join a shared key."""
    per = clusters.join(single, "node").groupBy("comp").agg(F.count("*").alias("n"), F.count_if("single").alias("s")).filter("n > 1")
    layers = F.array(*(F.when(F.col("n") <= cap if cap else F.lit(True), F.lit(name)) for name, cap in caps.items()))
    rows = per.select("n", "s", F.explode(F.filter(layers, lambda x: x.isNotNull())).alias("layer"))
    return rows.groupBy("layer").agg(
        F.sum("n").alias("merged_keys"), F.sum("s").alias("merged_single"), F.sum(F.col("n") - F.col("s")).alias("merged_shared"), F.sum(F.when(F.col("s") < F.col("n"), F.col("s")).otherwise(0)).alias("single_into_shared")
    )


def rule_pairs(surfaces: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """rule, n_surfaces, ambiguous, n_keys, reduction, merged_pairs, pair_precision: what rules (columns of surface) merge.

    surfaces: surface, concept. A merged pair is right if its surfaces have a concept in common. Pairs are counted from the numbers
    of surfaces by key and set of concepts; only unequal sets of one key meet.
    """
    one = surfaces.groupBy("surface").agg(F.sort_array(F.collect_set("concept")).alias("set"))
    totals = one.agg(F.count("*").alias("n_surfaces"), F.count_if(F.size("set") > 1).alias("ambiguous"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), key.alias("key")) for name, key in keys.items()))
    by_set = one.select("set", F.explode(rules).alias("x")).groupBy("x.rule", "x.key", "set").agg(F.count("*").alias("m"))
    per = by_set.groupBy("rule", "key").agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("equal"))
    a, b = by_set.toDF("rule", "key", "sa", "ma"), by_set.toDF("rule", "key", "sb", "mb")
    meet = a.join(b, ["rule", "key"]).filter((F.array_join("sa", "|") < F.array_join("sb", "|")) & F.arrays_overlap("sa", "sb"))
    meet = meet.groupBy("rule", "key").agg(F.sum(F.col("ma") * F.col("mb")).alias("meet"))
    rows = per.join(meet, ["rule", "key"], "left").groupBy("rule").agg(
        F.count("*").alias("n_keys"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("merged_pairs"), F.sum(F.col("equal") + F.coalesce("meet", F.lit(0))).alias("right")
    )
    return rows.join(F.broadcast(totals)).select(
        "rule", "n_surfaces", "ambiguous", "n_keys", ((F.col("n_surfaces") - F.col("n_keys")) / F.col("n_surfaces")).alias("reduction"), "merged_pairs", F.try_divide("right", "merged_pairs").alias("pair_precision")
    )


def concept_layer(nodes: DataFrame, clusters: DataFrame, cap: int | None = None) -> DataFrame:
    """node, concept: nodes of clusters of at most cap (any size without) share a concept, others keep theirs."""
    size = clusters.groupBy("comp").agg(F.count("*").alias("size"))
    merged = clusters.join(size, "comp").filter((F.col("size") > 1) & (F.col("size") <= cap if cap else F.lit(True)))
    found = merged.select("node", F.concat(F.lit("c:"), F.col("comp").cast("string")).alias("c"))
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("c", F.concat(F.lit("k:"), F.col("node").cast("string"))).alias("concept"))
