"""Harmonic packing of documents into fixed-length sequences.

Lengths fall into classes of reciprocal capacity: class k takes lengths up to capacity // k and puts
exactly k pieces in a sequence, so a piece's sequence follows from its rank in its class alone and
workers fill classes independently. A document is cut where that saves padding: full sequences first,
then the rest in at most MAX_CUTS + 1 pieces whose lengths come close to class limits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolyte.llm.common import materialize, table
from taxolyte.llm.tokens import END, MAX_ENTRIES, PIECES, TextEncoder, default_tokenizer
from taxolyte.llm.words import tidy

CAPACITY = 2048
MAX_CUTS = 2
#: Padding that a further cut must save, in tokens.
CUT_COST = 3.0
_PIECES = "doc_id long, doc_row long, start long, length long, ids_crc32 long, doc_tokens long, klass int, part int, rank long"


@cache
def classes(capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Pieces per sequence and largest length of each class, by falling length: all distinct capacity // k."""
    limits = sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True)
    return np.array([capacity // c for c in limits]), np.array(limits)


@cache
def plans(capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """For each length below capacity its pieces, which waste the fewest tokens, a cut counted as CUT_COST."""
    per, limit = classes(capacity)
    spare = (capacity - per * limit) / per  # what each slot of a class leaves unused at least
    lengths = np.arange(capacity + 1)
    own = np.searchsorted(-limit, -lengths, side="right") - 1  # the narrowest class that takes a length
    cost = limit[own] - lengths + spare[own]
    cost[0] = 0
    best, cut = cost.copy(), np.zeros(capacity + 1, int)
    levels = [cut]
    for _ in range(MAX_CUTS):
        before, best, cut = best, best.copy(), np.zeros(capacity + 1, int)
        for c, s in zip(limit, spare, strict=True):
            total = np.full(capacity + 1, np.inf)
            total[c + 1 :] = s + CUT_COST + before[1 : capacity + 1 - c]
            better = total < best
            best[better], cut[better] = total[better], c
        levels.append(cut)

    def pieces(n: int, level: int) -> tuple[int, ...]:
        while level and not levels[level][n]:
            level -= 1
        return (n,) if not level else (int(levels[level][n]), *pieces(n - int(levels[level][n]), level - 1))

    return [pieces(n, MAX_CUTS) if n else () for n in range(capacity)]


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The pieces of all documents (doc_id, text), with their class and their rank among those of one task.

    with_ids adds the ids as an array. A null text is empty (its piece holds the end id alone).
    """
    kind = _PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, plan = TextEncoder.of_worker(tokenizer, max_entries), TaskContext.get().partitionId(), plans(capacity)
        _, limit = classes(capacity)
        ranks, row = np.zeros(len(limit), np.int64), 0
        for batch in batches:
            out: list[tuple] = []
            kept: list[np.ndarray] = []
            for doc_id, coded in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(coded + END, "<u4")
                n, start = len(ids), 0
                for length in (*([capacity] * (n // capacity)), *plan[n % capacity]):
                    k = int(np.searchsorted(-limit, -length, side="right")) - 1
                    own = ids[start : start + length]
                    out.append((doc_id, row, start, length, zlib.crc32(own.tobytes()), n, k, part, int(ranks[k])))
                    ranks[k] += 1
                    start += length
                    if with_ids:
                        kept.append(own)
                row += 1
            types = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, types, strict=True)]
            names = [x.split()[0] for x in _PIECES.split(", ")]
            if with_ids:
                ends = pa.array(np.cumsum([0, *map(len, kept)]).astype(np.int32))
                columns, names = [*columns, pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *kept]).astype(np.int32)))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        if with_ids:  # ids need memory, and so do other tasks of this worker
            encoder.forget()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(cut), kind)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """One row per piece with its sequence_id and offset; sequences are gapless from offset 0.

    Ranks are made global by counts per task and class, so no task sees a class whole. Each class leaves
    fewer pieces than one sequence takes; these, fewer than the sum of classes() whatever the input, are
    packed by first fit, longest first, in one task. Repeated rows and repeated or null doc_ids are packed
    as documents of their own, other columns are ignored; an empty table gives an empty result.
    """
    per, _ = classes(capacity)
    pieces = materialize(spark, cut_documents(docs, tokenizer, capacity, with_ids, max_entries), "pieces")
    size = F.element_at(F.array(*map(F.lit, map(int, per))), F.col("klass") + 1).cast("long")
    # One row per task and class.
    counts = pieces.groupBy("part", "klass").agg(F.count("*").alias("n"))
    own = Window.partitionBy("klass")
    counts = counts.select(
        "part",
        "klass",
        (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(own).alias("n_class"),
    )
    by_class = counts.groupBy("klass").agg(F.first("n_class").alias("n_class"))
    full = F.floor(F.col("n_class") / size)
    by_class = by_class.select("klass", (F.sum(full).over(Window.orderBy("klass")) - full).alias("first_sequence"))
    counts = counts.join(F.broadcast(by_class), "klass")
    ranked = (
        pieces.join(F.broadcast(counts) if _few(spark, pieces) else counts, ["part", "klass"])
        .withColumn("r", F.col("rank") + F.col("before"))
        .withColumn("size", size)
    )
    whole = F.col("r") < F.floor(F.col("n_class") / F.col("size")) * F.col("size")
    keep = [c for c in pieces.columns if c not in ("part", "rank", "klass", "doc_row")]
    inside = Window.partitionBy("sequence_id").orderBy("r")
    filled = (
        ranked.filter(whole)
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(F.col("r") / F.col("size")))
        .withColumn("offset", F.sum("length").over(inside) - F.col("length"))
        .select(*keep, "sequence_id", "offset")
    )

    def first_fit(_: tuple, left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["length", "klass", "r"], ascending=[False, True, True])
        used: list[int] = []
        at, offset = [], []
        for n in left["length"]:
            j = next((j for j, u in enumerate(used) if u + n <= capacity), len(used))
            if j == len(used):
                used.append(0)
            at.append(j)
            offset.append(used[j])
            used[j] += n
        # Below the sequences of full classes, so that neither side needs the other's count.
        return left.assign(sequence_id=-1 - np.array(at, np.int64), offset=np.array(offset, np.int64))[[*keep, "sequence_id", "offset"]]

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in filled.schema.fields)
    left = ranked.filter(~whole).select(*keep, "klass", "r", F.lit(0).alias("one"))
    return filled.unionByName(left.groupBy("one").applyInPandas(first_fit, kind))


def _few(spark: SparkSession, pieces: DataFrame) -> bool:
    """Whether the counts per task and class, at most a hundred for each task, are at most a million rows."""
    return len(pieces.inputFiles()) * 100 <= 1_000_000


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return pack(spark, table(spark, sf_dir, "documents"), default_tokenizer(), max_entries=PIECES).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
