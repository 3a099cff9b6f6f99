"""Samples and assignments that depend on ids and a seed only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(seed: int, *columns: str) -> Column:
    """A pseudo-random order of rows: a hash of the seed and the columns, as hexadecimal text that SQL can give too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def split_half(df: DataFrame, stratum: str, unit: str, seed: int = 20260909) -> DataFrame:
    """df with half: within each stratum the first half of units in hash order is A, the rest B."""
    w = Window.partitionBy(stratum)
    rank = F.row_number().over(w.orderBy(order_of(seed, unit), unit))
    return df.withColumn("half", F.when(rank <= F.floor(F.count("*").over(w) / 2), "A").otherwise("B"))


def split_half_exact(strata: dict[str, list[str]], seed: int = 20260909) -> dict[str, str]:
    """The same by a shuffle of sorted units on the driver, for the few hundred units of a taxonomy."""
    rng = random.Random(seed)
    out = {}
    for stratum in sorted(strata):
        units = sorted(strata[stratum])
        rng.shuffle(units)
        out |= {u: "A" if i < len(units) // 2 else "B" for i, u in enumerate(units)}
    return out


def stratified(df: DataFrame, stratum: str, ids: list[str], k: int, seed: int = 20260909) -> DataFrame:
    """At most k rows of each stratum, without replacement."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(order_of(seed, *ids), *ids))
    return df.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def transitive_sample(clusters: DataFrame, edges: DataFrame, k: int, seed: int = 20260909) -> DataFrame:
    """i, j, comp: one pair without an edge from each of k clusters that have one, clusters in hash order.

    Pairs are uniform within a cluster: a node is drawn by its number of members that it has no edge to, then one
    of these. Nodes race with exponential times, so members and edges are only grouped and all pairs never made.
    """
    members = clusters.select("comp", "node")
    once = edges.filter("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    inside = once.join(members.toDF("comp", "i"), "i").join(members.toDF("comp", "j"), ["comp", "j"])
    linked = inside.select("comp", F.col("i").alias("node"), F.col("j").alias("other"))
    linked = linked.unionByName(inside.select("comp", F.col("j").alias("node"), F.col("i").alias("other")))
    degrees = linked.groupBy("comp", "node").agg(F.count("*").alias("degree"))
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"))
    free = members.join(degrees, ["comp", "node"], "left").join(sizes, "comp")
    free = free.select("comp", "node", (F.col("size") - 1 - F.coalesce("degree", F.lit(0))).alias("free")).filter("free > 0")
    chance = (F.conv(F.substring(order_of(seed, "comp", "node"), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    one = free.groupBy("comp").agg(F.min(F.struct((-F.ln(chance) / F.col("free")).alias("time"), "node"))["node"].alias("node"))
    one = one.orderBy(order_of(seed, "comp"), "comp").limit(k)
    others = members.toDF("comp", "other").join(F.broadcast(one), "comp").filter("other <> node")
    others = others.join(linked, ["comp", "node", "other"], "left_anti").groupBy("comp", "node")
    pairs = others.agg(F.min(F.struct(order_of(seed, "node", "other").alias("order"), "other"))["other"].alias("other"))
    return pairs.select(F.least("node", "other").alias("i"), F.greatest("node", "other").alias("j"), "comp")


def blocks(df: DataFrame, stratum: str, item: str, anchors: int, n_blocks: int) -> DataFrame:
    """df with block: 0 for anchors, a proportional number of each stratum, and 1 to n_blocks in turn for the rest."""
    w = Window.partitionBy(stratum)
    rn = F.row_number().over(w.orderBy(item))
    share = F.round(anchors * F.count("*").over(w) / F.count("*").over(Window.partitionBy()))
    return df.withColumn("block", F.when(rn <= share, 0).otherwise(F.pmod(rn - 1 - share, F.lit(n_blocks)) + 1).cast("int"))


def leave_one_out(df: DataFrame, stratum: str, item: str, raters: list[str]) -> DataFrame:
    """df with raters: all but one, in turn within each stratum."""
    patterns = F.array(*(F.array(*(F.lit(r) for j, r in enumerate(raters) if j != i)) for i in range(len(raters))))
    i = F.row_number().over(Window.partitionBy(stratum).orderBy(item)) - 1
    return df.withColumn("raters", F.get(patterns, F.pmod(i, F.lit(len(raters)))))


def some(df: DataFrame, n: int, *ids: str, seed: int = 20260909) -> DataFrame:
    """n rows in hash order of their ids."""
    return df.orderBy(order_of(seed, *ids), *ids).limit(n)
