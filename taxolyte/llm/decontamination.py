"""Benchmark decontamination: SimHash windows as long as the items, verified by weighted shingles.

A text's words (lower case, ASCII punctuation stripped at both ends) are compared with each item through
windows of as many words as the item has. Windows are fingerprinted by SimHash over their word shingles;
a multi-index of BLOCKS sorted tables, one for each part of the fingerprint, finds every item within RADIUS bits, because two
fingerprints that differ in at most RADIUS bits have a part that differs in at most RADIUS // BLOCKS. A
window with a similarity right at 0.8 lies further away with a probability of about 1e-5 (simulated: none to 1 of
100,000 for windows of 15 to 59 words; beyond 19 bits it were up to 55). Found pairs are verified by the exact weighted Jaccard similarity of their shingles, each shingle weighted
by how often it occurs. Windows without a shingle of the benchmark have similarity 0 and are not made.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.llm.common import materialize, table
from taxolyte.llm.tokens import gather
from taxolyte.llm.words import Words, groups, shingles, tidy

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 4, 23
#: Items in one index, which goes to all workers; a larger benchmark is matched in several passes.
INDEX_ITEMS = 50_000
INDEX_CHARS = 16_000_000
#: Cells of a table that is compared at a time, and characters of texts that a worker handles at a time.
CELLS, GROUP_CHARS = 1 << 20, 1_000_000
_PART = BITS // BLOCKS
#: What a part may differ by.
_NEAR = np.array([m for m in range(1 << _PART) if m.bit_count() <= RADIUS // BLOCKS], np.int64)
_SHIFTS = np.arange(BITS, dtype=np.uint64)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of signed sums, one for each bit."""
    return (sums > 0).astype(np.uint64) @ (np.uint64(1) << _SHIFTS)


def signs(hashes: np.ndarray) -> np.ndarray:
    return (((hashes[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.int32) << 1) - 1


def _sums(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Signed sums of the k hashes from each start (fewer at the end), from tables as long as the starts are apart."""
    lo, span = int(starts[0]), int(starts[-1] - starts[0])
    whole = np.zeros(BITS, np.int64)
    for a in range(lo, min(lo + k, len(hashes)), 65536):
        whole += signs(hashes[a : min(a + 65536, lo + k)]).sum(0)
    # The window moves: hashes that it leaves behind and those that it reaches.
    gone, come = (np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(hashes[a : a + span]), 0, dtype=np.int32)]) for a in (lo, lo + k))
    return whole + come[np.minimum(starts - lo, len(come) - 1)] - gone[np.minimum(starts - lo, len(gone) - 1)]


class Items:
    """Items with the same number of words: fingerprints, sorted shingles of each and, if there are so many that fingerprints are
    looked up, a sorted table for each of their parts."""

    def __init__(self, ids: list[int], rows: np.ndarray):
        self.ids = ids
        self.rows = np.sort(rows, 1)
        self.prints = np.concatenate([fingerprint(np.stack([signs(r).sum(0) for r in rows[a : a + 1024]])) for a in range(0, len(rows), 1024)])
        self.tables = []
        for b in range(BLOCKS if len(ids) > len(_NEAR) else 0):
            part = self._part(self.prints, b)
            order = np.argsort(part, kind="stable")
            self.tables.append((order.astype(np.int32), np.searchsorted(part[order], np.arange((1 << _PART) + 1)).astype(np.int32)))

    @staticmethod
    def _part(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(_PART * b)) & np.uint64((1 << _PART) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place, items within RADIUS bits) for fingerprints that have any."""
        if not self.tables:  # fewer items than entries to look up: all are compared, with the same result
            for a in range(0, len(prints), max(1, CELLS // len(self.ids))):
                some = prints[a : a + max(1, CELLS // len(self.ids))]
                i, j = np.nonzero(np.bitwise_count(some[:, None] ^ self.prints[None, :]) <= RADIUS)
                for w in np.unique(i).tolist():
                    yield a + w, j[i == w]
            return
        found = np.zeros(len(self.ids), bool)
        parts = [self._part(prints, b) for b in range(BLOCKS)]
        for w in range(len(prints)):
            found[:] = False
            for part, (order, begins) in zip(parts, self.tables, strict=True):
                values = part[w] ^ _NEAR
                found[gather(order, begins[values], begins[values + 1] - begins[values])] = True
            items = np.flatnonzero(found)
            items = items[np.bitwise_count(self.prints[items] ^ prints[w]) <= RADIUS]
            if len(items):
                yield w, items

    def similar(self, window: np.ndarray, items: np.ndarray, least: float) -> Iterator[tuple[int, float]]:
        """(item, weighted Jaccard similarity) of those items that are at least so similar to the shingles of a window."""
        own, counts = np.unique(window, return_counts=True)
        k = self.rows.shape[1]
        needed = least * (len(window) + k) / (1 + least) - 1e-9  # common shingles at that similarity
        for a in range(0, len(items), max(1, CELLS // k)):
            some = items[a : a + max(1, CELLS // k)]
            place = np.minimum(np.searchsorted(own, self.rows[some]), len(own) - 1)
            for j in some[(own[place] == self.rows[some]).sum(1) >= needed].tolist():
                theirs, times = np.unique(self.rows[j], return_counts=True)
                place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                common = int(np.minimum(times, counts[place])[own[place] == theirs].sum())
                value = common / (len(window) + k - common)
                if value >= least:
                    yield j, value


class Index:
    """Items by length, and the shingles of all of them."""

    def __init__(self, items: list[tuple[int, str]]):
        words = Words([text for _, text in items], strip=True)
        hashes, begins = shingles(words.hashes(), words.offsets, SHINGLE)
        lengths = np.diff(words.offsets)
        self.by_length: dict[int, Items] = {}
        for n in sorted(set(lengths.tolist()) - {0}):
            mine = np.flatnonzero(lengths == n)
            self.by_length[n] = Items([items[i][0] for i in mine], np.stack([hashes[begins[i] : begins[i + 1]] for i in mine]))
        # Items with fewer words than a shingle, by their words' hash.
        self.by_words: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero((lengths > 0) & (lengths < SHINGLE)).tolist():
            self.by_words.setdefault(int(lengths[i]), {}).setdefault(int(hashes[begins[i]]), []).append(items[i][0])
        # The lengths of the items that each shingle occurs in, one list after the other.
        both = np.unique(np.stack([hashes, np.repeat(lengths, np.diff(begins)).astype(np.uint64)], 1), axis=0) if len(hashes) else np.zeros((0, 2), np.uint64)
        self.known, first = np.unique(both[:, 0], return_index=True)
        self.firsts, self.lengths = np.append(first, len(both)), both[:, 1].astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known >> np.uint64(44)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of hashes that are shingles of an item."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        if not len(at) or not len(self.known):
            return at[:0]
        place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        return at[self.known[place] == hashes[at]]

    def short(self, words: np.ndarray, offsets: np.ndarray) -> dict[int, dict[int, tuple[float, int, int]]]:
        """text -> item id -> (1, first word, words) of items with fewer words than a shingle, found word for word."""
        out: dict[int, dict[int, tuple[float, int, int]]] = {}
        for n, items in self.by_words.items():
            hashes, begins = shingles(words, offsets, n)
            for p in np.flatnonzero(np.isin(hashes, np.array(list(items), np.uint64))).tolist():
                text = int(np.searchsorted(begins, p, side="right")) - 1
                for item in items[int(hashes[p])]:
                    best = out.setdefault(text, {})
                    best[item] = min(best.get(item, (1.0, p, n)), (1.0, int(p - begins[text]), n), key=lambda x: x[1])
        return out

    def match(self, words: np.ndarray, hits: np.ndarray, hashes: np.ndarray, similarity: float) -> dict[int, tuple[float, int, int]]:
        """item id -> (similarity, first word, words) of its best window in a text.

        words are the text's word hashes, hashes its shingles and hits the positions of known ones.
        """
        best: dict[int, tuple[float, int, int]] = {}
        place = np.searchsorted(self.known, hashes[hits])
        which = np.unique(place)
        lengths = gather(self.lengths, self.firsts[which], self.firsts[which + 1] - self.firsts[which])
        owner = np.repeat(which, self.firsts[which + 1] - self.firsts[which])
        for n in np.unique(lengths).tolist():
            k = max(1, n - SHINGLE + 1)  # shingles in a window
            if n < SHINGLE:
                continue  # matched by short
            if len(words) < n:
                starts = np.array([0])  # a text shorter than the item is one window
            else:
                p = hits[np.isin(place, owner[lengths == n])]
                change = np.zeros(len(words) + 1, np.int64)  # windows that hold a hit, by where they begin and end
                np.add.at(change, np.maximum(p - k + 1, 0), 1)
                np.add.at(change, p + 1, -1)
                starts = np.flatnonzero(np.cumsum(change)[: len(words) - n + 1] > 0)
            self._windows(n, k, starts, hashes, similarity, best)
        return best

    def _windows(self, n: int, k: int, starts: np.ndarray, hashes: np.ndarray, similarity: float, best: dict) -> None:
        own = self.by_length[n]
        for a in range(0, len(starts), 4096):  # bounds memory on texts full of hits
            part = starts[a : a + 4096]
            if len(part) > 1 and part[-1] - part[0] > 32768:
                self._windows(n, k, part[: len(part) // 2], hashes, similarity, best)
                self._windows(n, k, part[len(part) // 2 :], hashes, similarity, best)
                continue
            for w, items in own.near(fingerprint(_sums(hashes, part, k))):
                first = int(part[w])
                for item, value in own.similar(hashes[first : first + k], items, similarity):
                    key = own.ids[item]
                    if key not in best or (-value, first) < (-best[key][0], best[key][1]):
                        best[key] = (value, first, n)


def _indexes(spark: SparkSession, benchmark: DataFrame) -> Iterator[bytes]:
    """Pickled indexes of about INDEX_ITEMS items or INDEX_CHARS characters each; items that share an item_id are in one."""
    items: list[tuple[int, str]] = []
    chars = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    for r in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        if (len(items) >= INDEX_ITEMS or chars >= INDEX_CHARS) and r.item_id != items[-1][0]:
            yield pickle.dumps(Index(items))
            items, chars = [], 0
        items.append((r.item_id, r.text))
        chars += len(r.text)
    if items:
        yield pickle.dumps(Index(items))


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each item in each text it leaked to.

    docs: doc_id, text; benchmark: item_id, text. Only items with a similarity of at least the given one
    are reported; equal windows count from the first. An item with fewer than SHINGLE words is found
    where its words occur in a row. Null texts, null item_ids and items without words match nothing; repeated rows of docs repeat
    their rows, repeated items with one item_id count once; other columns are ignored; empty tables give an
    empty result. Nothing is shuffled: the benchmark goes to the workers as indexes of bounded size, a
    pass over docs for each.
    """
    out = None
    for data in _indexes(spark, benchmark):
        held = spark.sparkContext.broadcast(data)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index: Index = pickle.loads(held.value)
            for batch in batches:
                at = 0
                rows: list[tuple] = []
                for group in groups(batch.column(1).to_pylist(), GROUP_CHARS):
                    words = Words(group, strip=True)
                    own = words.hashes()
                    hashes, begins = shingles(own, words.offsets, SHINGLE)
                    hits = index.hits(hashes)
                    which = np.searchsorted(begins, hits, side="right") - 1
                    short = index.short(own, words.offsets)
                    for i in sorted({*which.tolist(), *short}):
                        a, b = begins[i], begins[i + 1]
                        found = index.match(own[words.offsets[i] : words.offsets[i + 1]], hits[which == i] - a, hashes[a:b], similarity)
                        for item, (value, first, n) in short.get(i, {}).items():
                            if item not in found or (-value, first) < (-found[item][0], found[item][1]):
                                found[item] = (value, first, n)
                        doc_id = batch.column(0)[at + i].as_py()
                        rows += [(doc_id, item, *best) for item, best in found.items()]
                    at += len(group)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        one = rows.mapInArrow(tidy(run), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, similarity double, first_word long, n_words long")


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs in which no item was found, with all columns; rows that share a doc_id with such a text go too."""
    leaks = materialize(spark, find_leaks(spark, docs, benchmark, similarity).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark found in all documents."""
    return find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
