"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Five metrics of a text are binned (RULES). A rule rejects a text whose bin reaches the rule's cutoff.
Cutoffs come from labelled texts that pass the base rule: per stratum and rule, a cutoff is certified if
the exact binomial tail P(X <= rejected good texts) at a false rejection rate of ALPHA / rules is at most
DELTA / (strata * rules), a Bonferroni correction over all families; within a family the certified cutoffs
are those above a point, so fixed-sequence testing from lenient to strict needs no further correction. So
with probability 1 - DELTA no stratum loses more than ALPHA of its good texts. Of the certified cutoffs
the one with the most gain (share of bad texts rejected less GUARD times that of good ones) is taken, the
most lenient of equals, and none if no gain is positive. Where a stratum's own texts choose none, the cutoff chosen on
all texts together applies if the stratum's own texts certify it by the same test; else the rule rejects nothing there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolyte.llm.common import SPACE_RE, materialize, table

ALPHA, DELTA, GUARD = 0.10, 0.05, 10
#: Strata whose cutoffs may be broadcast, and parts in which a stratum is joined otherwise.
FEW_STRATA, SALTS = 10_000, 16
RULES = ("symbols", "dup_lines", "repeats", "word_length", "capitals")
BINS = 100
POOLED = "*"
_SYMBOL = r"[^#*$%&|<>]+"


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base columns, bins: one row per row of docs (doc_id, text, lang).

    n_repeat_words compares 3-word windows by a 64-bit hash. Null and blank texts have no words and
    fail the base rule; a null lang is the stratum ''.
    """
    text = F.coalesce("text", F.lit(""))
    w, h = F.col("w"), F.col("h")
    n = F.size("w")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
    )
    # Positions of windows whose hash occurs again: sorted by hash, equal ones are neighbours.
    s = F.col("s")
    twice = F.filter(
        F.transform(
            s,
            lambda x, j: F.when(
                (x["h"] == F.get(s, j + 1)["h"]) | ((j > 0) & (x["h"] == F.get(s, F.greatest(j - 1, F.lit(0)))["h"])), x["i"]
            ).otherwise(-1),
        ),
        lambda p: p >= 0,
    )
    covered = F.aggregate(
        F.sort_array("p"),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    m = (
        docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"))
        .select("*", F.array_remove(F.split("text", SPACE_RE), "").alias("w"), lines.alias("lines"))
        .select(
            "doc_id",
            "lang",
            n.cast("long").alias("n_words"),
            F.length(F.regexp_replace("text", SPACE_RE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("text", _SYMBOL, "")).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
            windows.alias("h"),
        )
        .withColumn(
            "s",
            F.when(
                F.size(F.array_distinct("h")) < F.size("h"),
                F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            ).otherwise(none),
        )
        .drop("h")
        .withColumn("p", twice)
        .drop("s")
        .withColumn("n_repeat_words", covered)
        .drop("p")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("bins", _bins())


def _bins() -> Column:
    """The bin of each rule, 0 to BINS, from whole numbers only."""

    def part(scale: int, x: str, of: str) -> Column:
        c = F.when(F.col(of) > 0, F.floor(scale * F.col(x) / F.col(of))).otherwise(0)
        return F.least(c, F.lit(BINS)).cast("int")

    return F.array(
        part(50, "n_symbols", "n_words"),
        part(100, "n_dup_lines", "n_lines"),
        part(100, "n_repeat_words", "n_words"),
        part(5, "word_chars", "n_words"),
        part(100, "n_capitals", "word_chars"),
    )


def _log_factorial(n: Column) -> Column:
    """ln n!: exact below 10, else Stirling's series, whose error is below 1e-10."""
    small = F.array(*(F.lit(float(x)) for x in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)))
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 10, F.ln(F.get(small, F.least(n, F.lit(9)).cast("int")))).otherwise(series)


def binomial_tail(x: Column, n: Column, rate: float) -> Column:
    """P(X <= x) of Binomial(n, rate); 1 where x is at or above the mean.

    Terms are summed downwards from x for at most 2000 steps; what is left is bounded by a geometric
    series and added, so the result is never too small.
    """
    odds = (1 - rate) / rate
    top = F.exp(
        _log_factorial(n) - _log_factorial(x) - _log_factorial(n - x) + x * F.ln(F.lit(rate)) + (n - x) * F.ln(F.lit(1 - rate))
    )
    start = F.struct(top.alias("term"), top.alias("sum"), F.lit(1.0).alias("ratio"))

    def step(a: Column, i: Column) -> Column:
        ratio = i / (n - i + 1) * odds  # from the term at i to the one at i - 1
        return F.struct((a["term"] * ratio).alias("term"), (a["sum"] + a["term"] * ratio).alias("sum"), ratio.alias("ratio"))

    down = F.when(x > 0, F.sequence(x, F.greatest(x - 1999, F.lit(1)), F.lit(-1).cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    rest = lambda a: F.when((x > 2000) & (a["ratio"] < 1), a["term"] * a["ratio"] / (1 - a["ratio"])).otherwise(
        F.when(x > 2000, 1.0).otherwise(0.0)
    )
    total = F.aggregate(down, start, step, lambda a: a["sum"] + rest(a))
    return F.when(x >= n * rate, 1.0).otherwise(F.least(total, F.lit(1.0)))


def fit_cutoffs(metrics: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs: a cutoff per rule that the stratum's own texts certify, and no row or entry where there is none.

    labels: doc_id, quality (1 good, 0 bad); a document with several labels counts as bad if one is 0,
    and null labels are ignored. All labelled documents that pass the base rule are used.
    """
    one = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = (
        metrics.filter("NOT base_failed")
        .join(one, "doc_id")
        .select(
            F.explode(F.array_distinct(F.array("lang", F.lit(POOLED)))).alias("stratum"),
            "quality",
            F.posexplode("bins").alias("rule", "bin"),
        )
    )
    counts = rows.groupBy("stratum", "rule", "bin").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    )
    # From here on at most BINS + 1 rows for each stratum and rule.
    family = Window.partitionBy("stratum", "rule")
    above = family.orderBy(F.desc("bin"))
    sums = counts.select(
        "stratum",
        "rule",
        F.col("bin").alias("cutoff"),
        F.sum("good").over(above).alias("x"),
        F.sum("bad").over(above).alias("y"),
        F.sum("good").over(family).alias("n_good"),
        F.sum("bad").over(family).alias("n_bad"),
    )
    families = counts.agg((F.count_distinct("stratum") * len(RULES)).alias("families"))
    gain = F.col("y") * F.col("n_good") - GUARD * F.col("x") * F.col("n_bad")
    certain = binomial_tail(F.col("x"), F.col("n_good"), alpha / len(RULES)) <= delta / F.col("families")
    certified = (
        sums.join(F.broadcast(families))
        .filter("cutoff > 0")
        .withColumn("gain", gain)
        .filter("gain > 0")
        .filter(certain)
    )
    best = certified.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff"))["cutoff"].alias("cutoff"))
    # The pooled cutoff is one of the nested cutoffs of each stratum's family, so its test needs no further correction.
    pooled = best.filter(F.col("stratum") == POOLED).select("rule", "cutoff")  # a row per rule at most
    tried = counts.filter(F.col("stratum") != POOLED).join(F.broadcast(pooled), "rule").groupBy("stratum", "rule", "cutoff")
    tried = tried.agg(F.sum(F.when(F.col("bin") >= F.col("cutoff"), F.col("good")).otherwise(0)).alias("x"), F.sum("good").alias("n_good"))
    shared = tried.join(F.broadcast(families)).filter(certain).select("stratum", "rule", "cutoff", F.lit(1).alias("order"))
    both = best.filter(F.col("stratum") != POOLED).select("stratum", "rule", "cutoff", F.lit(0).alias("order")).unionByName(shared)
    best = both.groupBy("stratum", "rule").agg(F.min(F.struct("order", "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(metrics: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """metrics with kept: false if base_failed or if a rule rejects.

    A rule takes its stratum's cutoff and rejects nothing in a stratum without one. cutoffs has at most a row per
    stratum with labelled documents (languages); up to FEW_STRATA are broadcast, more are joined with each
    stratum dealt to SALTS parts, as one may hold most rows.
    """
    own = materialize(metrics.sparkSession, cutoffs.withColumnsRenamed({"stratum": "lang", "cutoffs": "own"}), "cutoffs")
    if own.limit(FEW_STRATA + 1).count() <= FEW_STRATA:
        both = metrics.join(F.broadcast(own), "lang", "left")
    else:
        own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = metrics.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        both = salted.join(own, ["lang", "_salt"], "left").drop("_salt")
    empty = F.create_map().cast("map<int,int>")
    rejects = [
        F.coalesce(F.get("bins", F.lit(k)) >= F.try_element_at(F.coalesce("own", empty), F.lit(k)), F.lit(False))
        for k in range(len(RULES))
    ]
    kept = ~F.col("base_failed")
    for r in rejects:
        kept = kept & ~r
    return both.withColumn("kept", kept).drop("own")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics and verdict for all documents."""
    metrics = materialize(spark, base_metrics(table(spark, sf_dir, "documents")), "quality-metrics")
    return judge(metrics, fit_cutoffs(metrics, table(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
