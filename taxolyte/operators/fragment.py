"""Surfaces and keys: how many surface forms share a key.

Input rows are distinct job, major (the type), surface and key; empty keys count as surfaces but not as
keys. Counts of distinct values are two-step aggregates, so frequent keys are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolyte.functions.text import strip_suffixes


def index(tok: DataFrame) -> DataFrame:
    """n_surfaces, n_keys, frag_index, n_merged, merged_share, type_mismatch (share of keys with several types)."""
    keys = tok.filter("key <> ''").groupBy("key").agg(F.count_distinct("surface").alias("s"), F.count_distinct("major").alias("m"))
    one = keys.agg(F.count("*").alias("n_keys"), F.sum(F.col("s") - 1).alias("n_merged"), F.avg((F.col("m") > 1).cast("int")).alias("type_mismatch"))
    n = tok.agg(F.count_distinct("surface").alias("n_surfaces"))
    return one.join(F.broadcast(n)).select(
        "n_surfaces",
        "n_keys",
        F.try_divide("n_surfaces", "n_keys").alias("frag_index"),
        "n_merged",
        F.try_divide("n_merged", "n_surfaces").alias("merged_share"),
        "type_mismatch",
    )


def by_group(tok: DataFrame, group: str) -> DataFrame:
    """n_surfaces, n_keys and frag_index of each group."""
    g = tok.filter("key <> ''").groupBy(group).agg(F.count_distinct("surface").alias("n_surfaces"), F.count_distinct("key").alias("n_keys"))
    return g.withColumn("frag_index", F.col("n_surfaces") / F.col("n_keys"))


def aliases(tok: DataFrame, least: int = 2) -> DataFrame:
    """key, n_surfaces, n_jobs, types, type_mismatch, surfaces of keys with several surfaces, lists joined by bars."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "|")
    rows = tok.filter("key <> ''").select("key", "surface", "job", "major")
    # Surfaces first, so that lists are only made of keys that have several.
    many = rows.select("key", "surface").distinct().groupBy("key").agg(F.count("*").alias("n_surfaces"), joined("surface").alias("surfaces")).filter(F.col("n_surfaces") >= least)
    jobs = rows.select("key", "job", "major").distinct().join(many.select("key"), "key", "left_semi").groupBy("key")
    jobs = jobs.agg(F.size(F.collect_set("job")).cast("long").alias("n_jobs"), F.sort_array(F.collect_set("major")).alias("m"))
    return many.join(jobs, "key").select("key", "n_surfaces", "n_jobs", F.array_join("m", "|").alias("types"), (F.size("m") > 1).alias("type_mismatch"), "surfaces")


def variants(surfaces: DataFrame, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """variant, n_keys, n_merged, merged_share, n_joined (keys that join several base keys) for each list of
    suffix patterns applied to key; surfaces: distinct surface, key."""
    keyed = F.array(*(F.struct(F.lit(v).alias("variant"), strip_suffixes(F.col("key"), p).alias("k")) for v, p in patterns.items()))
    rows = surfaces.select("surface", "key", F.explode(keyed).alias("x")).select("surface", "key", "x.variant", "x.k")
    g = rows.groupBy("variant", "k").agg(F.count_distinct("surface").alias("n"), F.count_distinct("key").alias("b"))
    return g.groupBy("variant").agg(
        F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("n_merged"), (F.sum(F.col("n") - 1) / F.sum("n")).alias("merged_share"), F.count_if(F.col("b") > 1).alias("n_joined")
    )
