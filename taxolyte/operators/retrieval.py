"""Retrieval by shared concepts and by character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(queries: DataFrame, answers: DataFrame, truth: DataFrame) -> DataFrame:
    """n, answered_rate, hit_rate, precision, recall, f1 over queries (q), precision_answered over answered ones.

    answers and truth: q, item. Unanswered queries count as 0.
    """
    got = answers.select("q", "item").distinct()
    want = truth.select("q", "item").distinct()
    n_got, n_want = got.groupBy("q").agg(F.count("*").alias("g")), want.groupBy("q").agg(F.count("*").alias("w"))
    both = got.join(want, ["q", "item"]).groupBy("q").agg(F.count("*").alias("b"))
    rows = queries.select("q").distinct().join(n_got, "q", "left").join(n_want, "q", "left").join(both, "q", "left").na.fill(0, ["g", "w", "b"])
    return rates(rows)


def rates(rows: DataFrame, weight: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The figures of precision_recall from counts: g answers, w true ones and b that are both, of a query or of weight equal ones."""
    weight = F.lit(1) if weight is None else weight
    mean = lambda x, w=weight: F.try_divide(F.sum(x * w), F.sum(w))
    p, r = F.when(F.col("g") > 0, F.col("b") / F.col("g")).otherwise(0.0), F.when(F.col("w") > 0, F.col("b") / F.col("w")).otherwise(0.0)
    f1 = F.when(F.col("b") > 0, 2 * F.col("b") / (F.col("g") + F.col("w"))).otherwise(0.0)
    return rows.groupBy(*by).agg(
        F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("n"),
        mean((F.col("g") > 0).cast("int")).alias("answered_rate"),
        mean((F.col("b") > 0).cast("int")).alias("hit_rate"),
        mean(p).alias("precision"),
        mean(r).alias("recall"),
        mean(f1).alias("f1"),
        mean(p, F.when(F.col("g") > 0, weight)).alias("precision_answered"),
    )


def by_partitions(cells: DataFrame, caps: dict[str, int | None]) -> DataFrame:
    """The figures of precision_recall by layer, where a query is answered by the others of its group, if that has at most cap
    members, and those of its concept are true. cells: grp, concept (null: like no other), m members, each member in one cell.

    Members of equal groups and concepts are counted together, so no pair is made.
    """
    size = cells.groupBy("grp").agg(F.sum("m").alias("size"))
    want = cells.groupBy("concept").agg((F.sum("m") - 1).alias("w"))
    alike = cells.join(size, "grp").groupBy("concept", "size", "m").agg(F.sum("m").alias("weight"))
    layers = F.array(*(F.struct(F.lit(name).alias("layer"), (F.col("size") <= cap if cap else F.lit(True)).alias("there")) for name, cap in caps.items()))
    rows = alike.join(want, "concept", "left").withColumn("x", F.explode(layers))
    g = F.when(F.col("x.there"), F.col("size") - 1).otherwise(0)
    b = F.when(F.col("x.there") & F.col("concept").isNotNull(), F.col("m") - 1).otherwise(0)
    return rates(rows.select("x.layer", "weight", g.alias("g"), F.coalesce("w", F.lit(0)).alias("w"), b.alias("b")), F.col("weight"), ("layer",))


def ngrams(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """key, gram, tf of the n-grams of characters, with a space before and after the text."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
    return df.select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))


def ngram_neighbours(df: DataFrame, key: str, text: str, k: int = 21, threshold: float = 0.0, n: int = 3) -> DataFrame:
    """u, v, sim, rank: each text's k nearest others by cosine of TF-IDF of n-grams (sublinear tf, smoothed idf)."""
    tf = ngrams(df, key, text, n)
    total = df.agg(F.count("*").alias("_n"))
    idf = tf.groupBy("gram").agg(F.count("*").alias("d")).join(F.broadcast(total)).select("gram", (F.ln((1 + F.col("_n")) / (1 + F.col("d"))) + 1).alias("idf"))
    w = tf.join(idf, "gram").select(key, "gram", ((1 + F.ln("tf")) * F.col("idf")).alias("x"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    unit = w.join(norm, key).select(key, "gram", (F.col("x") / F.col("norm")).alias("x"))
    a, b = unit.select(F.col(key).alias("u"), "gram", F.col("x").alias("xu")), unit.select(F.col(key).alias("v"), "gram", F.col("x").alias("xv"))
    sim = a.join(b, "gram").filter("u <> v").groupBy("u", "v").agg(F.round(F.sum(F.col("xu") * F.col("xv")), 9).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return sim.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("sim") >= threshold))
