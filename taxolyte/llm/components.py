"""Connected components of a link table by least labels, hooked and shortened at roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.llm.common import materialize


def connected(spark: SparkSession, links: DataFrame, name: str = "components") -> DataFrame:
    """id, comp for every id of links (a, b): comp is the smallest id reachable.

    In each round a label takes the smallest label next to any of its members, and the one that this takes
    in turn, so rounds grow with the logarithm of a component's width. A round is written to the shared
    folder; minima are combined before they are shuffled, so a hub is not a hot key.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp"), F.lit(True).alias("moved"))
    labels = materialize(spark, labels, name)
    while True:
        theirs = labels.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        near = both.join(theirs, "b").groupBy("a").agg(F.min("cb").alias("near"))
        own = labels.select(F.col("id").alias("a"), "comp")
        # A label is also the id of a member, whose own label may be smaller by now.
        roots = labels.select(F.col("id").alias("c"), F.col("comp").alias("to"))
        seen = own.join(near, "a").select(F.col("comp").alias("c"), F.col("near").alias("to")).unionByName(roots)
        hooks = seen.groupBy("c").agg(F.min("to").alias("to"))
        first, second = hooks.select(F.col("c").alias("comp"), F.col("to").alias("h")), hooks.select(F.col("c").alias("h"), F.col("to").alias("g"))
        new = own.join(first, "comp", "left").withColumn("h", F.least("comp", "h")).join(second, "h", "left")
        new = new.select(F.col("a").alias("id"), F.least("h", "g").alias("to"), "comp")
        labels = materialize(spark, new.select("id", F.col("to").alias("comp"), (F.col("to") != F.col("comp")).alias("moved")), name)
        if labels.filter("moved").isEmpty():
            return labels.select("id", "comp")


def relink(spark: SparkSession, labels: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """labels (id, comp) after further links (a, b). Only new links are walked, between components."""
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    new = ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("comp"))
    known = labels.unionByName(new)
    across = links.join(known.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a")
    across = across.join(known.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b").filter("ca <> cb")
    across = materialize(spark, across.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), name)
    moved = connected(spark, across, name).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return materialize(spark, known.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), name)
