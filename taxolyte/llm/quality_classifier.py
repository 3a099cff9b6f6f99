"""Quality classifier with hierarchical empirical Bayes over sites.

Two logistic models (bad quality, toxic) on shares of symbols, capitals, repeats and the like, and on
words that labelled texts select, give each document a probability of being bad. Grouped sums of these
give every host a rate and every path within a host a rate. Rates are posterior means: a host shrinks to
the global rate and a path to its host, with strengths fitted by moments from how much hosts and paths
really differ, so sparse sites say little. The final odds are the document's evidence (its odds over the
base rate's) times its path's odds.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolyte.llm.common import materialize, table
from taxolyte.llm.words import Words, groups, shingles, tidy

#: Labelled documents that the models are fitted on at most, those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
#: Words that each model may use, and the chi-square that a word must have; its exact tail must be as small.
MODEL_WORDS, LEAST_CHI2 = 256, 15.0
REJECT = 0.5
#: Rows of a rate table that may be broadcast (a few MB), and parts in which sites of a larger one are joined.
FEW_SITES, SALTS = 100_000, 16
HEADS = ("bad", "toxic")
DENSE = 9


@dataclass
class Model:
    """Word hashes in ascending order with a weight for each head; scaling and weights of dense features."""

    words: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    base: float

    def probability(self, dense: np.ndarray, text: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of each text to be bad or toxic; (text, word) are the places of model words in texts."""
        z = ((dense - self.mean) / self.scale) @ self.dense + self.bias
        if len(text):
            for h in range(len(HEADS)):
                z[:, h] += np.bincount(text, self.weights[word, h], len(z))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return 1 - (1 - p).prod(1)


def _dense(texts: list[str], words: Words, hashes: np.ndarray) -> np.ndarray:
    array = pa.array(texts, pa.large_string())
    n = np.maximum(np.asarray(pc.add(pc.count_substring_regex(array, r"[^\x20\x09-\x0D]+"), 0)), 1)
    chars = np.maximum(np.asarray(pc.utf8_length(array)), 1)
    count = lambda pattern: np.asarray(pc.count_substring_regex(array, pattern))
    grams, begins = shingles(hashes, words.offsets, 3)
    again = np.array([1 - len(np.unique(grams[a:b])) / max(b - a, 1) for a, b in zip(begins[:-1], begins[1:], strict=True)])
    kept = np.diff(words.offsets)
    return np.stack(
        [
            np.log1p(n),
            np.minimum(count(r"[#*$%&<>]") / n, 3),
            np.minimum(count(r"\|") / n, 1),
            np.minimum(count("!") / n, 3),
            count("[A-Z]") / chars,
            np.minimum(count("[0-9]") / n, 1),
            again,
            np.minimum(chars / n, 20) / 20,
            kept / n,
        ],
        1,
    )


def _places(words: Words, hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, number in known) of known words."""
    if not len(known) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    at = np.flatnonzero(known[place] == hashes)
    text = np.searchsorted(words.offsets, at, side="right") - 1
    both = np.unique(text * len(known) + place[at])
    return both // len(known), both % len(known)


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, bad, toxic of at most so many labelled documents (labels: doc_id, quality, toxic).

    A document with several labels is bad or toxic if one says so; null labels say nothing.
    """
    one = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0)).alias("bad"), F.max("toxic").alias("toxic")
    )
    chosen = one.filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _tails(n: np.ndarray, k: np.ndarray, rows: int, yes: int) -> np.ndarray:
    """The smaller hypergeometric tail, doubled: of k labelled ones among n of so many rows, yes of them labelled."""
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, rows + 1)))])
    choose = lambda a, b: log[a] - log[b] - log[a - b]
    pairs, which = np.unique(np.stack([n, k], 1), axis=0, return_inverse=True)
    out = np.ones(len(pairs))
    for i, (m, x) in enumerate(pairs.tolist()):
        least, most = max(0, m - (rows - yes)), min(m, yes)
        j = np.arange(x, most + 1) if x * rows > m * yes else np.arange(least, x + 1)
        out[i] = 2 * np.exp(choose(yes, j) + choose(rows - yes, m - j) - choose(rows, m)).sum()
    return out[which.ravel()]


def _select_words(rows: DataFrame) -> np.ndarray:
    """Hashes of the words whose presence tells most about either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.stack([np.asarray(batch.column(i)) for i in (1, 2)], 1)
            at = 0
            for group in groups(batch.column(0).to_pylist()):
                words = Words(group, strip=True)
                hashes = words.hashes()
                text = np.repeat(np.arange(len(group)), np.diff(words.offsets))
                pair = np.unique(np.stack([hashes, text.astype(np.uint64)], 1), axis=0) if len(hashes) else np.zeros((0, 2), np.uint64)
                own, which = np.unique(pair[:, 0], return_inverse=True)
                y = labels[at : at + len(group)][pair[:, 1].astype(np.int64)]
                sums = [np.bincount(which, w, len(own)).astype(np.int64) for w in (None, y[:, 0], y[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *map(pa.array, sums)], ["word", "n", "bad", "toxic"])
                at += len(group)

    def certain(size: int, yes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Of word, n, k, chi2 the words whose exact tail is as small as that of LEAST_CHI2, which few documents need."""
        least = math.erfc(math.sqrt(LEAST_CHI2 / 2))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, k = (np.asarray(batch.column(i)).astype(np.int64) for i in (1, 2))
                yield batch.select(["word", "chi2"]).filter(pa.array(_tails(n, k, size, yes) <= least))

        return keep

    totals = rows.agg(F.count("*").alias("rows"), F.sum("bad").alias("bad"), F.sum("toxic").alias("toxic")).first()
    counts = rows.mapInArrow(tidy(run), "word long, n long, bad long, toxic long").groupBy("word")
    counts = counts.agg(*(F.sum(c).alias(c) for c in ("n", *HEADS)))
    found: set[int] = set()
    for head in HEADS:
        yes = totals[head] or 0
        rate = yes / max(totals["rows"], 1)
        if 0 < rate < 1:
            gap = F.col(head) - F.col("n") * rate
            chi2 = gap * gap / (F.col("n") * rate * (1 - rate)) * totals["rows"] / F.greatest(totals["rows"] - F.col("n"), F.lit(1))
            top = counts.select("word", "n", F.col(head).alias("k"), chi2.alias("chi2")).filter(F.col("chi2") >= LEAST_CHI2)
            top = top.mapInArrow(certain(totals["rows"], yes), "word long, chi2 double")
            found |= {r["word"] for r in top.orderBy(F.desc("chi2"), "word").limit(MODEL_WORDS).collect()}
    return np.unique(np.array(sorted(found), np.int64).view(np.uint64))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of an L2-penalized logistic model, by accelerated gradient steps."""
    w = v = np.zeros(x.shape[1], x.dtype)
    limit = np.float32(0.25 * _largest(x) / len(y) + penalty.max())
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - (x.T @ (p - y) / len(y) + penalty * v) / limit
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def _largest(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x, slightly over."""
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(30):
        u = x.T @ (x @ v)
        v = u / (np.linalg.norm(u) or 1)
    return float(np.linalg.norm(x.T @ (x @ v))) * 1.05 + 1e-9


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """The model from labelled documents; without labels of both kinds every document gets the base rate."""
    rows = materialize(spark, sample(docs, labels), "labelled")
    known = _select_words(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in groups(batch.column(0).to_pylist()):
                words = Words(group, strip=True)
                hashes = words.hashes()
                text, word = _places(words, hashes, known)
                split = np.searchsorted(text, np.arange(len(group) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(_dense(group, words, hashes)), pa.list_(pa.float64())),
                        pa.ListArray.from_arrays(pa.array(split, pa.int32()), pa.array(word, pa.int64())),
                        batch.column(1).slice(at, len(group)),
                        batch.column(2).slice(at, len(group)),
                    ],
                    ["dense", "words", *HEADS],
                )
                at += len(group)

    data = rows.mapInArrow(tidy(run), "dense array<double>, words array<long>, bad int, toxic int").toArrow().combine_chunks()
    n = len(data)
    lists = data.column("words").combine_chunks() if n else None
    dense = pc.list_flatten(data.column("dense")).to_numpy().reshape(n, DENSE)
    mean, scale = (dense.mean(0), dense.std(0) + 1e-6) if n else (np.zeros(DENSE), np.ones(DENSE))
    x = np.zeros((n, DENSE + len(known) + 1), np.float32)
    if n:
        x[:, :DENSE] = (dense - mean) / scale
        x[:, -1] = 1
        text = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lists)))
        x[text, DENSE + np.asarray(pc.list_flatten(lists))] = 1
    penalty = np.full(x.shape[1], 1e-4, np.float32)
    penalty[-1] = 0
    w = np.zeros((x.shape[1], len(HEADS)))
    w[-1] = -7
    bad = np.zeros(n, bool)
    for h, head in enumerate(HEADS):
        y = np.asarray(data.column(head)).astype(np.float32)
        bad |= y > 0
        if 0 < y.sum() < n:
            w[:, h] = _logistic(x, y, penalty)
    base = min(max(bad.mean() if n else 0.0, 1e-3), 0.5)
    return Model(known, w[DENSE:-1], mean, scale, w[:DENSE], w[-1], float(base))


def score(spark: SparkSession, docs: DataFrame, model: Model, name: str = "p_document") -> DataFrame:
    """docs with the model's probability of a document to be bad; null texts are empty."""
    held = spark.sparkContext.broadcast(pickle.dumps(model))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(held.value)
        for batch in batches:
            out = [np.zeros(0)]
            for group in groups(batch.column(at).to_pylist()):
                words = Words(group, strip=True)
                hashes = words.hashes()
                out.append(own.probability(_dense(group, words, hashes), *_places(words, hashes, own.words)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out), pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.ln(p / (1 - p))


def site_rates(scored: DataFrame) -> DataFrame:
    """host, path, host_rate, path_rate from host, path, p_document of all documents.

    Strengths (pseudo-documents) come from moments: the spread of site means beyond that of sampling.
    """
    paths = scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p_document").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))

    def strength(n: Column, m: Column, mean: Column) -> Column:
        """From all sites: mean * (1 - mean) / spread, at least 1."""
        spread = F.sum(n * (m - mean) * (m - mean)) / F.sum(n) - F.sum(F.lit(1.0)) / F.sum(n) * F.first(mean) * (1 - F.first(mean))
        rate = F.first(mean)
        return F.greatest(F.lit(1.0), F.least(F.lit(1e6), rate * (1 - rate) / F.greatest(spread, F.lit(1e-9))))

    # One row each.
    total = hosts.agg((F.sum("hs") / F.sum("hn")).alias("rate"))
    hosts = hosts.join(F.broadcast(total))
    k = hosts.agg(strength(F.col("hn"), F.col("hs") / F.col("hn"), F.col("rate")).alias("k"))
    hosts = hosts.join(F.broadcast(k)).select("host", "rate", ((F.col("k") * F.col("rate") + F.col("hs")) / (F.col("k") + F.col("hn"))).alias("host_rate"))
    paths = paths.join(hosts, "host")
    gap = F.col("s") / F.col("n") - F.col("host_rate")
    noise = F.col("host_rate") * (1 - F.col("host_rate"))
    spread = F.sum(F.col("n") * gap * gap) / F.sum("n") - F.sum(noise) / F.sum("n")
    k = paths.agg(F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.avg(noise) / F.greatest(spread, F.lit(1e-9)))).alias("k"))
    return paths.join(F.broadcast(k)).select(
        "host", "path", "host_rate", ((F.col("k") * F.col("host_rate") + F.col("s")) / (F.col("k") + F.col("n"))).alias("path_rate")
    )


def _site() -> list[Column]:
    """host: the source; path: its part in one language."""
    return [F.coalesce("source", F.lit("")).alias("host"), F.coalesce("lang", F.lit("")).alias("path")]


def _joined(scored: DataFrame, rates: DataFrame, model: Model) -> DataFrame:
    if rates.limit(FEW_SITES + 1).count() <= FEW_SITES:
        both = scored.join(F.broadcast(rates), ["host", "path"])
    else:  # a site may hold most rows
        salted = scored.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        rates = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = salted.join(rates, ["host", "path", "_salt"]).drop("_salt")
    odds = _logit(F.col("p_document")) - _logit(F.lit(model.base)) + _logit(F.col("path_rate"))
    p_bad = 1 / (1 + F.exp(-odds))
    return both.withColumn("p_bad", p_bad).withColumn("kept", p_bad < REJECT)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, host, path, p_document, host_rate, path_rate, p_bad, kept: one row per row of docs.

    docs: doc_id, text, source, lang; labels: doc_id, quality (0 is bad), toxic (1 is toxic). Null texts
    are empty, null sources and langs are a site of their own, repeated rows are judged alike, a null
    doc_id has no label; without labels all are kept; empty tables give an empty result.
    """
    model = fit(spark, docs, labels)
    rows = docs.select("doc_id", *_site(), "text")
    scored = materialize(spark, score(spark, rows, model).drop("text"), "scored")
    rates = materialize(spark, site_rates(scored), "rates")
    return _joined(scored, rates, model).select("doc_id", "host", "path", "p_document", "host_rate", "path_rate", "p_bad", "kept")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all columns. Texts are scored twice, which spares their shuffle."""
    model = fit(spark, docs, labels)
    rows = docs.select(*_site(), "text")
    rates = materialize(spark, site_rates(materialize(spark, score(spark, rows, model).drop("text"), "scored")), "rates")
    names = {c: f"_{i}" if c != "text" else c for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), *_site())
    return _joined(score(spark, own, model), rates, model).filter("kept").select(*(F.col(n).alias(c) for c, n in names.items()))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents."""
    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
