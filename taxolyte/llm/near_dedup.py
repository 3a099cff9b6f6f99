"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Each text's set of word shingles gives a MinHash signature. Texts with one set are one node.
2. Signatures are cut into bands; equal bands share a bucket. A bucket proposes star pairs, each member
   with the bucket's centre, never all pairs; of its centres a member takes the one that it meets in most
   buckets.
3. Signatures of a pair are compared batch by batch. A pair is dropped once the posterior probability
   that its similarity reaches the threshold (uniform prior) is below a level, which is such that a link right
   at the threshold is lost with a probability of at most MISS over all batches.
4. What survives is verified on full shingle sets; links give components.
5. Buckets whose members are still in different components propose again: first stars with other
   centres, then, for what is left, all pairs across components, compared as blocks of signatures inside
   a task, of which only those that pass step 3 come out, each from the first band that it shares. So no
   link within a bucket is lost, and members of one component, however many, are never compared with
   each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.llm.common import HOT_ROWS, hot_keys, join_unique, materialize, table
from taxolyte.llm.components import connected, relink
from taxolyte.llm.words import Words, groups, shingles, tidy

BANDS, ROWS = 26, 5
#: Hashes of a signature: those of the bands, and twice as many that only comparisons use.
HASHES = 3 * BANDS * ROWS
BATCH = 26
#: The probability that a link right at the threshold is dropped, over all batches.
MISS = 1e-3
#: Rounds of stars before all pairs across components are compared, and members in a block of those.
STARS, BLOCK = 2, 1024
#: So many ids, 2 MB, may be broadcast; above, texts are joined without that filter.
FEW_IDS = 250_000
_rng = np.random.default_rng(20240613)
_FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least_at(threshold: float, level: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): below, P(similarity >= threshold) < level.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and its tail
    equals P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < level:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def lost(similarity: float, steps: list[tuple[int, int]]) -> float:
    """The probability that a pair of this similarity is dropped at one of the steps."""
    one = np.array([comb(BATCH, m) * similarity**m * (1 - similarity) ** (BATCH - m) for m in range(BATCH + 1)])
    alive = np.ones(1)
    for _, least in steps:
        alive = np.convolve(alive, one)
        alive[:least] = 0
    return float(1 - alive.sum())


@cache
def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on) at each batch, by the highest level whose loss over all batches is at most miss."""
    level = miss
    while lost(threshold, steps := _least_at(threshold, level)) > miss:
        level *= 0.8
    return steps


def passing(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two tables of signatures go on after all batches."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n, least in least_matches(threshold):
        part = slice(n - BATCH, n)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    return alive


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of non-empty sets of 64-bit hashes, 16 bits for each hash function."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint16)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = (np.minimum.reduceat(flat * factor, begins) >> np.uint64(40)).astype(np.uint16)
    return out


def shingle_sets(texts: list[str], k: int, strip: bool = False) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, strip)
    hashes, begins = shingles(words.hashes(), words.offsets, k)
    return [np.unique(hashes[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, fp (of the set; null if empty), signature of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in groups(batch.column(1).to_pylist()):
                sets = shingle_sets(group, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                signatures: list[bytes | None] = [None] * len(sets)
                fps: list[bytes | None] = [None] * len(sets)
                if full:
                    rows = signature([sets[i] for i in full])
                    for i, row in zip(full, rows, strict=True):
                        signatures[i], fps[i] = row.tobytes(), xxhash.xxh3_128_digest(sets[i].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(group)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(fps, pa.binary()),
                        pa.array(signatures, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "fp", "signature"],
                )
                at += len(group)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, n_shingles long, fp binary, signature binary")


def _prune(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that survive sizes and signature batches."""
    left = nodes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
            yield batch.select([0, 1]).take(pa.array(passing(sa, sb, percent / 100)))

    return both.mapInArrow(tidy(run), "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose texts' full shingle sets reach the similarity."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    if ids.limit(FEW_IDS + 1).count() <= FEW_IDS:  # then only their texts are shuffled
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    # Rows reach a worker sorted by b, the star's centre, so its set is made once for many rows.
    both = (
        pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a")
        .join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
        .select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in batches:
            keep, at = [], 0
            tb = batch.column(3)
            for group in groups(batch.column(2).to_pylist()):
                for x in shingle_sets(group, k):
                    text = tb[at].as_py() or ""
                    if text != last[0]:
                        last = (text, shingle_sets([text], k)[0])
                    y = last[1]
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and len(x):
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * common >= percent * (len(x) + len(y) - common):
                            keep.append(at)
                    at += 1
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(tidy(run), "a long, b long").distinct()


def _one_centre(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each id with the centre that it meets in most rows (id, center)."""
    met = rows.groupBy("id", "center").agg(F.count("*").alias("n"))
    best = met.groupBy("id").agg(F.min(F.struct(-F.col("n"), "center"))["center"].alias("center"))
    return best.select(F.greatest("id", "center").alias("a"), F.least("id", "center").alias("b")).distinct()


def _across(spark: SparkSession, rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket (band, key, id, comp) in different components that pass the signature batches.

    A bucket is cut into blocks of members by the hash of their id, and a task compares two blocks.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = (
        rows.join(sizes, "key")
        .join(nodes.select("id", "n_shingles", "signature"), "id")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    )
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")),
    )
    spread = placed.select("band", "key", "id", "comp", "n_shingles", "signature", "block", F.explode(cells).alias("cell"))

    def cell(table: pa.Table) -> pa.Table:
        ids, comps, n, blocks = (np.asarray(table.column(c)) for c in ("id", "comp", "n_shingles", "block"))
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
        bands = signatures[:, : BANDS * ROWS].reshape(len(ids), BANDS, ROWS)
        one, band = table.column("cell")[0].as_py(), table.column("band")[0].as_py()
        left, right = np.flatnonzero(blocks == one["i"]), np.flatnonzero(blocks == one["j"])
        a, b = [], []
        for x in left:
            y = right[(comps[right] != comps[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            if one["i"] == one["j"]:
                y = y[y > x]
            if len(y):
                y = y[passing(np.broadcast_to(signatures[x], (len(y), HASHES)), signatures[y], percent / 100)]
                y = y[~(bands[y, :band] == bands[x, :band]).all(2).any(1)]
                a += [max(ids[x], ids[z]) for z in y]
                b += [min(ids[x], ids[z]) for z in y]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("band", "key", "cell").applyInArrow(cell, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs (doc_id, text).

    Documents are linked if 100 * |A and B| >= percent * |A or B| on their sets of k-word shingles (fewer
    words: the whole sequence); component_id is the smallest doc_id reachable and kept says whether a row
    is it. Texts without words are linked with nothing. Rows that repeat a doc_id are one node, linked
    with whatever one of them is; a null doc_id is linked with nothing, has a null component and is
    kept. Other columns are ignored, an empty table gives an empty result. A link is missed if no band agrees (2.4e-7 at 0.85,
    3.3e-5 at 0.8) or if pruned (at most MISS right at the threshold, over all batches).
    """
    sets = materialize(spark, sketch(docs, k), "sketches")
    filled = sets.filter("fp IS NOT NULL AND doc_id IS NOT NULL")
    nodes = filled.groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = materialize(spark, nodes, "nodes")
    width = 2 * ROWS
    keys = [F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(BANDS)]
    bands = nodes.select(F.posexplode(F.array(*keys)).alias("band", "key"), "id")
    shared = bands.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("n")).filter("n > 1")
    shared = materialize(spark, shared, "shared")
    # A bucket may hold most rows.
    buckets = join_unique(spark, bands, shared.select("key", "center"), "key", shared.filter(F.col("n") > HOT_ROWS).select("key"), "inner")
    buckets = materialize(spark, buckets, "buckets")
    pairs = _one_centre(buckets.filter("id <> center"))
    links = materialize(spark, _verify(materialize(spark, _prune(pairs, nodes, percent), "survivors"), docs, k, percent), "links")
    # A doc_id with different texts ties their nodes.
    several = filled.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("doc_id")
    ties = filled.join(several, "doc_id").join(nodes.select("fp", "id"), "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    links = links.unionByName(materialize(spark, ties.filter("a <> b"), "ties"))
    rows = buckets.select("band", "key", "id")
    comps = connected(spark, links)
    for turn in range(STARS + 1):
        # Buckets in which different components still meet.
        named = rows.select("band", "key", "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        pick = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("id"), F.col("comp").alias("comp")))
        mixed = named.groupBy("key").agg(pick.alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        rows = materialize(spark, named.join(mixed.select("key", "c"), "key"), "mixed")
        if rows.isEmpty():
            break
        if turn < STARS:
            found = _prune(_one_centre(rows.filter(F.col("comp") != F.col("c.comp")).select("id", F.col("c.id").alias("center"))), nodes, percent)
        else:
            found = _across(spark, rows.select("band", "key", "id", "comp"), nodes, percent)
        comps = relink(spark, comps, materialize(spark, _verify(materialize(spark, found, "survivors"), docs, k, percent), "links"))
    placed = materialize(spark, nodes.select("fp", "id").join(comps, "id", "left"), "placed")
    out = join_unique(spark, sets.drop("signature"), placed, "fp", hot_keys(sets, "fp"))  # copies of a text share fp
    component = F.coalesce("comp", "id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays.

    All columns are kept; of rows that share a doc_id one stays, rows with a null doc_id all stay.
    """
    gone = near_duplicates(spark, docs, k, percent).filter("NOT kept").select("doc_id").distinct()
    if not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        none = docs.filter("doc_id IS NULL")
        docs = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(none)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.85 on 3-word shingles."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"), k=3, percent=85)
