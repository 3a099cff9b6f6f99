"""Language-model scores of whole texts from a causal self-attention model on subword ids.

The model gives the next id's class from attention over the ids before it, and the id within its class
from corpus counts: P(id | before) = P(class | attention) * P(id | class, last id). Attention
is block-wise: a block of BLOCK positions attends, causally masked, to itself and the block before, that
is to overlapping windows of 2 * BLOCK positions of which each scores its second half once; all blocks of
many texts are one batch.

Everything is learnt from all training texts, those whose crc32(doc_id as text) mod 10 is not 0. Counts of
all pairs of adjacent ids give the classes, the ids' embeddings, the class that follows an id and the ids
within a class. Attention weights are fitted in numpy to every position of every training text: shards of
texts take gradient steps from one start, and the shards' weights are averaged by their positions.

The base score is that of a smoothed word unigram model. Counts of the HEAD most frequent words and the
most frequent pairs of ids go to the workers; other words and pairs are joined to their counts as rows.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.llm.common import materialize, table
from taxolyte.llm.tokens import END, END_ID, TextEncoder, chunked, default_tokenizer
from taxolyte.llm.words import Words, groups, tidy

BLOCK, WIDTH = 16, 16
CLASSES = 64
#: Ids, by frequency, with an embedding of their own; others share one for each class.
ROWS = 2048
#: The most frequent ids that count as contexts for classes and embeddings; all others are one more.
CONTEXTS = 127
#: Counts of pairs that are broadcast: a table of the COLUMNS most frequent ids after each of the ROWS most
#: frequent, and the PAIRS most frequent others. The rest is joined.
COLUMNS, PAIRS = 4096, 2_000_000
MU = 10.0
#: Blocks in a gradient step, ids in a shard at least, shards at most, and ids that are seen at least: fewer are gone through again.
STEP_BLOCKS, SHARD_IDS, SHARDS, LEAST_IDS = 512, 16_000_000, 4096, 4_000_000
#: Blocks that are handled at a time, so that their tables stay in the cache; gradients of a step are added up.
PART_BLOCKS = 128
STEP_SIZE = 0.02
#: Logits of attention and of what it adds to classes are at most so large, which keeps exponentials finite.
MOST_LOGIT = 30.0
#: Pieces that a worker's encoder remembers while it also holds counts.
HELD_PIECES = 300_000
#: Words whose counts are broadcast (16 bytes each).
HEAD = 131_072
#: Characters of texts, and bytes of ids, that a worker handles at a time; parts in which hot keys are joined.
GROUP_CHARS, GROUP_BYTES, SALTS = 3_000_000, 1 << 20, 16
_NEVER = np.float32(-1e9)
_BACK = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]  # how far a key lies before a query
_CAUSAL = np.where(_BACK >= 0, 0, _NEVER).astype(np.float32)
_NEAR = np.clip(_BACK, 0, 2 * BLOCK - 1)


def held_out(doc_id: int | None) -> bool:
    """A null doc_id is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _below(bound: float) -> np.float32:
    return np.float32(min(1.0, MOST_LOGIT / bound)) if bound > 0 else np.float32(1)


@dataclass
class Attention:
    """Row and class of each id, embedding of each row, log class frequencies after each row, and weights."""

    row: np.ndarray
    klass: np.ndarray
    embedding: np.ndarray
    direct: np.ndarray
    weights: dict[str, np.ndarray]
    tables: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.set_weights(self.weights)

    def set_weights(self, w: dict[str, np.ndarray]) -> None:
        """Takes weights, scaled down where logits could exceed MOST_LOGIT, and makes the tables by row. Embeddings are not
        projected one by one: q and k act by their product, as do v and out. The last column of near is 1, so that
        weighted sums of embeddings hold the sum of weights too."""
        largest = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))
        q, k = self.embedding @ w["q"] / np.float32(np.sqrt(WIDTH)), self.embedding @ w["k"]
        scale = _below(largest(q) * largest(k))
        both = w["v"] @ w["out"]
        logits = self.embedding @ both
        added = _below(float(max(logits.max(), -logits.min())))  # mixed embeddings are weighted means of embeddings
        near = np.clip(w["near"], -MOST_LOGIT, MOST_LOGIT)
        self.weights = {**w, "q": w["q"] * scale, "out": w["out"] * added, "near": near}
        if "near" not in self.tables:
            self.tables["near"] = np.concatenate([self.embedding, np.ones((len(self.embedding), 1), np.float32)], 1)
        self.tables.update(q=(q * scale) @ w["k"].T, logits=both * added, place=near[_NEAR] + _CAUSAL)

    def _mixed(self, rows: np.ndarray, first: np.ndarray, a: int, b: int) -> tuple[np.ndarray, ...]:
        """For blocks a to b: embeddings (and 1) of their windows, attention weights, sums of weights, weighted means of embeddings."""
        near = rows[a - 1 : b] if a else np.concatenate([rows[:1], rows[:b]])
        t = self.tables
        each = t["near"].take(near.ravel(), 0)
        x, y = each.strides
        window = np.ndarray((b - a, 2 * BLOCK, WIDTH + 1), each.dtype, each, 0, (BLOCK * x, x, y))  # windows overlap
        q = t["q"].take(rows[a:b].ravel(), 0).reshape(-1, BLOCK, WIDTH)
        s = np.matmul(q, window[:, :, :WIDTH].transpose(0, 2, 1))
        s += t["place"]
        s[first[a:b], :, :BLOCK] = _NEVER
        np.exp(s, out=s)
        mixed = np.matmul(s, window).reshape(-1, WIDTH + 1)
        share = 1 / mixed[:, WIDTH:]
        return window, s, share, mixed[:, :WIDTH] * share

    def class_log(self, rows: np.ndarray, first: np.ndarray, target: np.ndarray) -> np.ndarray:
        """ln P(class) of target classes. rows: (blocks, BLOCK) of the ids before each; first: blocks that
        begin a text."""
        out = np.empty(rows.shape, np.float32)
        for a in range(0, len(rows), PART_BLOCKS):  # keeps intermediate tables in the cache
            b = min(a + PART_BLOCKS, len(rows))
            logits = self._mixed(rows, first, a, b)[-1] @ self.tables["logits"]
            logits += self.direct.take(rows[a:b].ravel(), 0)
            chosen = logits.ravel().take(np.arange(0, logits.size, CLASSES) + target[a:b].ravel())
            np.exp(logits, out=logits)
            out[a:b] = (chosen - np.log(logits @ np.ones(CLASSES, np.float32))).reshape(-1, BLOCK)
        return out

    def gradients(self, rows: np.ndarray, first: np.ndarray, target: np.ndarray, filled: np.ndarray, a: int, b: int) -> dict[str, np.ndarray]:
        """Of the mean of -ln P(class) over the filled positions of blocks a to b, by weight."""
        share = np.float32(1 / max(int(filled[a:b].sum()), 1))
        cuts = np.linspace(a, b, -(-(b - a) // PART_BLOCKS) + 1).astype(int).tolist()
        parts = [self._sums(rows, first, target, filled, i, j, share) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        pairs, logits, near = (np.sum(x, 0) for x in zip(*parts, strict=True))
        w, root = self.weights, np.float32(np.sqrt(WIDTH))
        return {"q": pairs @ w["k"] / root, "k": pairs.T @ w["q"] / root, "v": logits @ w["out"].T, "out": w["v"].T @ logits, "near": near}

    def _sums(self, rows: np.ndarray, first: np.ndarray, target: np.ndarray, filled: np.ndarray, a: int, b: int, share: np.float32) -> tuple[np.ndarray, ...]:
        """Gradients by the products of q and k and of v and out, and by near, from blocks a to b."""
        window, s, inverse, mixed = self._mixed(rows, first, a, b)
        z = mixed @ self.tables["logits"]
        z += self.direct.take(rows[a:b].ravel(), 0)
        np.exp(z, out=z)
        whole = z @ np.ones(CLASSES, np.float32)
        z.ravel()[np.arange(0, z.size, CLASSES) + target[a:b].ravel()] -= whole
        used = (filled[a:b].ravel() * share / whole)[:, None]  # z times this is the gradient by logits
        # By attention logits: weight * (gradient by the mixed embedding) . (embedding - mixed embedding).
        d = np.empty((len(z), WIDTH + 1), np.float32)
        np.multiply(z @ self.tables["logits"].T, inverse * used, out=d[:, :WIDTH])
        np.einsum("ij,ij->i", d[:, :WIDTH], mixed, out=d[:, WIDTH])
        np.negative(d[:, WIDTH], out=d[:, WIDTH])
        s *= np.matmul(d.reshape(-1, BLOCK, WIDTH + 1), window.transpose(0, 2, 1))
        moved = np.matmul(s, window[:, :, :WIDTH]).reshape(-1, WIDTH)
        own = window[:, BLOCK:, :WIDTH].reshape(-1, WIDTH)
        near = np.bincount(_NEAR.ravel(), s.sum(0).ravel(), 2 * BLOCK).astype(np.float32)
        return own.T @ moved, (z.T @ (mixed * used)).T, near

    def learn(self, groups_of_ids: Iterator[list[np.ndarray]]) -> int:
        """Gradient steps (Adam, steps falling with the root of their number) over all positions of all texts (ids with
        their end id each); returns how many there were."""
        m, u = ({k: np.zeros_like(x) for k, x in self.weights.items()} for _ in range(2))
        step = seen = 0
        for streams in groups_of_ids:
            ids, filled, text = _blocks(streams)
            before, first = _before(ids, text)
            rows, target = self.row[before], self.klass[ids]
            cuts = np.linspace(0, len(rows), max(1, round(len(rows) / STEP_BLOCKS)) + 1).astype(int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                g = self.gradients(rows, first, target, filled, a, b)
                step += 1
                w = dict(self.weights)
                for name, grad in g.items():
                    m[name] = 0.9 * m[name] + np.float32(0.1) * grad
                    u[name] = 0.99 * u[name] + np.float32(0.01) * grad * grad
                    rate = STEP_SIZE / math.sqrt(1 + step / 100)
                    w[name] = w[name] - np.float32(rate / (1 - 0.9**step)) * m[name] / (np.sqrt(u[name] / np.float32(1 - 0.99**step)) + np.float32(1e-8))
                self.set_weights(w)
            seen += int(filled.sum())
        return seen


def _blocks(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of texts (each with its end id) cut into blocks: (blocks, BLOCK) padded, filled, text of each block."""
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    n = -(-sizes // BLOCK)
    at = np.arange(int(sizes.sum())) + np.repeat(np.cumsum(n * BLOCK) - n * BLOCK - (np.cumsum(sizes) - sizes), sizes)
    ids = np.zeros(int(n.sum()) * BLOCK, np.int64)
    filled = np.zeros(len(ids), bool)
    ids[at] = np.concatenate(streams)
    filled[at] = True
    return ids.reshape(-1, BLOCK), filled.reshape(-1, BLOCK), np.repeat(np.arange(len(streams)), n)


def _before(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id before each position (the end id before a text), and which blocks begin a text."""
    first = np.diff(text, prepend=-1) != 0
    flat = ids.ravel()
    before = np.concatenate([[END_ID], flat[:-1]]).reshape(ids.shape)
    before[first, 0] = END_ID
    return before, first


def _cluster(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by cosine on the unit sphere, from evenly spaced points."""
    centers = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (points @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centers)
    return (points @ centers.T).argmax(1)


def structure(counts: np.ndarray, cells: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row and klass of each id, and embedding of each row, from counts of ids and of their neighbours.

    cells: place id * 2 * (CONTEXTS + 1) + side * (CONTEXTS + 1) + context, and count. Classes are ids with like neighbours;
    ids without counts are dealt to all classes. Embeddings are the main directions of the neighbours' counts.
    """
    n = len(counts)
    order = np.argsort(-counts, kind="stable")
    known = order[: max(int((counts > 0).sum()), 1)]
    width = 2 * (CONTEXTS + 1)
    spot = np.full(n, -1, np.int64)
    spot[known] = np.arange(len(known))
    points = np.zeros((len(known), width), np.float32)
    own, context = np.divmod(cells[0], width)
    there = spot[own] >= 0  # the end id's left side may be all that is seen of it
    points[spot[own[there]], context[there]] = cells[1][there]
    points = np.sqrt(points + points.sum(0) / max(points.sum(), 1))  # a little of the average, for rare ids
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    apart = points - points.mean(0)
    mean = points.mean(0) * 0.7
    points -= mean
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    klass = np.arange(n) % CLASSES
    klass[known] = _cluster(points, CLASSES)
    row = ROWS + klass
    row[order[:ROWS]] = np.arange(len(order[:ROWS]))
    often = np.sqrt(counts[known]).astype(np.float32)[:, None]
    _, main = np.linalg.eigh((apart * often).T @ (apart * often))
    each = np.zeros((n, WIDTH), np.float32)
    each[known, : WIDTH - 1] = apart @ main[:, ::-1][:, : WIDTH - 1].astype(np.float32)
    each[:, : WIDTH - 1] /= np.sqrt((each[known, : WIDTH - 1] ** 2).mean(0)) + np.float32(1e-6)
    each = np.clip(each, -3, 3)
    each[:, WIDTH - 1] = 1
    sums, sizes = np.zeros((ROWS + CLASSES, WIDTH)), np.bincount(row, minlength=ROWS + CLASSES)
    np.add.at(sums, row, each)
    return row.astype(np.int32), klass.astype(np.int32), (sums / np.maximum(sizes, 1)[:, None]).astype(np.float32)


def untrained(row: np.ndarray, klass: np.ndarray, embedding: np.ndarray, follow: np.ndarray) -> Attention:
    """The start of training. follow: counts of the next class, by id."""
    by_row = np.zeros((ROWS + CLASSES, CLASSES))
    np.add.at(by_row, row, follow)
    base = (by_row.sum(0) + 1) / (by_row.sum() + CLASSES)
    direct = np.log((by_row + 4 * base) / (by_row.sum(1, keepdims=True) + 4)).astype(np.float32)
    rng = np.random.default_rng(7)
    start = {k: rng.normal(0, 0.3, (WIDTH, WIDTH)).astype(np.float32) for k in "qkv"}
    return Attention(row, klass, embedding, direct, {**start, "out": np.zeros((WIDTH, CLASSES), np.float32), "near": np.zeros(2 * BLOCK, np.float32)})


@dataclass
class Within:
    """ln P(id | class, last id) from counts of pairs: (n + MU * share) / (all of the class + MU), a proper distribution in each class, where
    share is the id's smoothed share of its class. rank: of each id by frequency; dense: n by rank of both; keys (ascending), n: other
    pairs as last << 16 | id; whole: counts of the next class by last id; complete: whether no pairs are left out."""

    klass: np.ndarray
    share: np.ndarray
    rank: np.ndarray
    dense: np.ndarray
    keys: np.ndarray
    n: np.ndarray
    less: np.ndarray
    complete: bool

    @classmethod
    def of(cls, klass: np.ndarray, counts: np.ndarray, rank: np.ndarray, whole: np.ndarray, dense: np.ndarray, keys: np.ndarray, n: np.ndarray, complete: bool) -> Within:
        total = counts + 0.05
        share = total / np.bincount(klass, total, CLASSES)[klass]
        order, by_rank = np.argsort(keys), np.argsort(rank)
        for r in range(len(dense)):  # row by row, so that no second table of this size is held
            there = np.flatnonzero(dense[r])
            dense[r, there] = np.log1p(dense[r, there] / (MU * share[by_rank[there]]))
        keys, n = keys[order], n[order]
        return cls(klass, np.log(share).astype(np.float32), rank, dense, keys, np.log1p(n / (MU * share[keys & 0xFFFF])).astype(np.float32), np.log(MU / (whole + MU)).astype(np.float32), complete)

    def log(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln P without the counts of pairs that are left out, and where these may be missing (flat places)."""
        out = self.less[before, self.klass[ids]]
        out += self.share[ids]
        i, j = self.rank[before], self.rank[ids]
        rest = np.flatnonzero((i >= len(self.dense)) | (j >= self.dense.shape[1]))
        i.ravel()[rest] = 0
        j.ravel()[rest] = 0
        more = self.dense[i, j]
        flat = more.ravel()
        flat[rest] = 0
        if len(rest) and len(self.keys):
            key = before.ravel()[rest] << 16 | ids.ravel()[rest]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[place] == key
            flat[rest[known]] = self.n[place[known]]
            rest = rest[~known]
        out += more
        return out, rest[:0] if self.complete else rest


_SEEN = "key binary, ids binary, word long, pair boolean, n long"


def _ids_of(coded: list[bytes]) -> Iterator[list[np.ndarray]]:
    """Ids of texts in groups of about GROUP_BYTES."""
    a = 0
    while a < len(coded):
        b, size = a, 0
        while b < len(coded) and (b == a or size + len(coded[b]) <= GROUP_BYTES):
            size += len(coded[b])
            b += 1
        yield [np.frombuffer(x, "<u2") for x in coded[a:b]]
        a = b


def _count(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of three sorts: key and ids of each text, n is 1 if it is for training; word and n; with pair, word is
    last id << 16 | id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of_worker(tokenizer, HELD_PIECES)
        words_held, pairs_held = [], []

        def rows(size: int, /, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {"key": pa.binary(), "ids": pa.binary(), "word": pa.int64(), "pair": pa.bool_(), "n": pa.int64()}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in kinds.items()], list(kinds))

        def added(held: list, pair: bool, most: int) -> Iterator[pa.RecordBatch]:
            """Rows of counts, added up, if there are more than so many; else they are held on."""
            if sum(len(x) for x, _ in held) > most:
                own, which = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
                n = np.bincount(which, np.concatenate([n for _, n in held]), len(own)).astype(np.int64)
                held.clear()
                if len(own) <= most // 2:
                    held.append((own, n))
                else:
                    yield rows(len(own), word=pa.array(own.view(np.int64)), pair=pa.array(np.full(len(own), pair)), n=pa.array(n))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            for group in groups(batch.column(1).to_pylist(), GROUP_CHARS):
                train_ = np.fromiter((not held_out(d) for d in ids[at : at + len(group)]), bool, len(group))
                at += len(group)
                chunks = chunked(group)
                words = Words.of_chunks(group, *chunks)
                own = np.bincount(words.codes[np.repeat(train_, np.diff(words.offsets))], minlength=len(words.distinct))
                there = np.flatnonzero(own)
                words_held.append((words.distinct_hashes()[there], own[there]))
                yield from added(words_held, False, 3_000_000)
                coded = [np.frombuffer(x + END, "<u4").astype("<u2") for x in encoder.encode_chunks(*chunks)]
                yield rows(
                    len(group),
                    key=pa.array(list(map(xxhash.xxh3_128_digest, group)), pa.binary()),
                    ids=pa.array([x.tobytes() for x in coded], pa.binary()),
                    n=pa.array(train_.astype(np.int64)),
                )
                if train_.any():
                    x = np.concatenate([x for x, used in zip(coded, train_, strict=True) if used]).astype(np.uint32)
                    before = np.concatenate([np.array([END_ID], np.uint32), x[:-1]])  # texts end with END_ID
                    pair, n = np.unique(before << np.uint32(16) | x, return_counts=True)
                    pairs_held.append((pair.astype(np.uint64), n))
                    yield from added(pairs_held, True, 4_000_000)
        for held, pair in ((words_held, False), (pairs_held, True)):
            yield from added(held, pair, 0)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), _SEEN)


def _cells(pairs: DataFrame, cells) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of counts by kind and cell. cells(last, id) gives arrays of (kind, cell, which rows) of pairs; there may be as
    many cells as a small multiple of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for kind, cell, used in cells(word >> 16, word & 0xFFFF):
                own, which = np.unique(cell, return_inverse=True)
                sums = np.bincount(which, n[used], len(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own), pa.array(sums)], ["kind", "cell", "n"])

    out = {}
    found = pairs.select("word", "n").mapInArrow(run, "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    kind, cell, n = (np.asarray(found.column(c)) for c in ("kind", "cell", "n"))
    for k in range(2):
        out[k] = (cell[kind == k], n[kind == k])
    return out


def train(spark: SparkSession, seen: DataFrame, model: Attention, n_ids: int) -> Attention:
    """model with attention fitted to all training texts of seen, n_ids in all.

    Shards of about SHARD_IDS ids or more, whole partitions of seen, start from the same weights; the average
    of their weights by ids counts. Fewer ids than LEAST_IDS are one shard that is gone through several times.
    """
    held = spark.sparkContext.broadcast(pickle.dumps(model))
    rounds = max(1, -(-LEAST_IDS // max(n_ids, 1)))
    shards = max(1, min(SHARDS, n_ids // SHARD_IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Attention = pickle.loads(held.value)
        once = (group for batch in batches for group in _ids_of(batch.column(0).to_pylist()))
        if rounds > 1:
            kept = [[x.copy() for x in group] for group in once]  # fewer than LEAST_IDS ids
            once = (group for _ in range(min(rounds, 50)) for group in kept)
        n = own.learn(once)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([pickle.dumps(own.weights)], pa.binary())], ["n", "weights"])

    texts = seen.filter("key IS NOT NULL AND n = 1").select("ids")
    found = texts.coalesce(shards).mapInArrow(run, "n long, weights binary").toArrow()  # SHARDS rows at most
    if len(found):
        n = np.asarray(found.column("n"), float)
        each = [pickle.loads(x) for x in found.column("weights").to_pylist()]
        model.set_weights({k: np.average([w[k] for w in each], 0, n).astype(np.float32) for k in model.weights})
    return model


def fit(spark: SparkSession, seen: DataFrame, n_vocabulary: int) -> tuple[Attention, Within, DataFrame]:
    """The model of the training texts in seen, and the counts of pairs (word, n) that a join must add."""
    pairs = materialize(spark, seen.filter("pair").groupBy("word").agg(F.sum("n").alias("n")), "pair-counts")
    width = CONTEXTS + 1
    by_id = pairs.groupBy(F.col("word").bitwiseAND(0xFFFF).alias("id")).agg(F.sum("n").alias("n")).toArrow()  # the vocabulary at most
    counts = np.zeros(n_vocabulary)
    counts[np.asarray(by_id.column("id"))] = np.asarray(by_id.column("n"))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(n_vocabulary, np.int64)
    rank[order] = np.arange(n_vocabulary)
    context = np.minimum(rank, CONTEXTS)
    sides = _cells(pairs, lambda last, own: ((0, last * 2 * width + context[own], slice(None)), (1, own * 2 * width + width + context[last], slice(None))))
    row, klass, embedding = structure(counts, tuple(np.concatenate([sides[0][i], sides[1][i]]) for i in range(2)))
    n_rows, n_columns = min(ROWS, n_vocabulary), min(COLUMNS, n_vocabulary)

    def tables(last: np.ndarray, own: np.ndarray):
        inside = np.flatnonzero((rank[last] < n_rows) & (rank[own] < n_columns))
        return (0, last * CLASSES + klass[own], slice(None)), (1, rank[last[inside]] * n_columns + rank[own[inside]], inside)

    found = _cells(pairs, tables)
    whole, dense = np.zeros(n_vocabulary * CLASSES), np.zeros(n_rows * n_columns, np.float32)
    whole[found[0][0]], dense[found[1][0]] = found[0][1], found[1][1]
    whole = whole.reshape(-1, CLASSES)
    model = train(spark, seen, untrained(row, klass, embedding, whole), int(counts.sum()))

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = np.asarray(batch.column(0))
            yield batch.filter(pa.array((rank[word >> 16] >= n_rows) | (rank[word & 0xFFFF] >= n_columns)))

    rest = pairs.select("word", "n").mapInArrow(outside, "word long, n long")
    top = rest.orderBy(F.desc("n"), "word").limit(PAIRS + 1).toArrow()
    complete = len(top) <= PAIRS
    top = top.slice(0, PAIRS)
    keys, n = (np.asarray(top.column(c)).astype(np.int64) for c in ("word", "n"))
    return model, Within.of(klass, counts, rank, whole, dense.reshape(n_rows, n_columns), keys, n, complete), rest


def _model_scores(spark: SparkSession, seen: DataFrame, model: Attention, within: Within, rest: DataFrame) -> DataFrame:
    """key, score (log10) of each distinct text. rest: word and n of pairs whose counts within may lack."""
    held = spark.sparkContext.broadcast((model, within))  # read once by a worker, which changes neither

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, inside = held.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            scores, pairs, splits = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for streams in _ids_of(batch.column(1).to_pylist()):
                ids, filled, text = _blocks(streams)
                before, first = _before(ids, text)
                log = own.class_log(own.row[before], first, own.klass[ids])
                more, missing = inside.log(before, ids)
                log += more
                log[~filled] = 0
                scores.append(np.bincount(text, log.sum(1, dtype=np.float64), len(streams)) / np.log(10))
                missing = missing[filled.ravel()[missing]]
                pairs.append(before.ravel()[missing] << 16 | ids.ravel()[missing])
                splits.append(splits[-1][-1] + np.searchsorted(text[missing // BLOCK], np.arange(len(streams)), side="right"))
            n = batch.num_rows
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(splits).astype(np.int32)), pa.array(np.concatenate(pairs)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0), pa.array(np.concatenate(scores)), lists], ["row", "key", "score", "pairs"])
            row += n

    texts = seen.filter("key IS NOT NULL").select("key", "ids").mapInArrow(run, "row long, key binary, score double, pairs array<long>")
    if not within.complete:
        texts = materialize(spark, texts, "scored")
        share = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.exp(within.share.astype(float)))], "id long, share double")
        times = texts.select("row", F.explode("pairs").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
        found = times.join(rest, "word").withColumn("id", F.col("word").bitwiseAND(0xFFFF)).join(F.broadcast(share), "id")  # a row per id of the vocabulary
        more = found.groupBy("row").agg((F.sum(F.col("times") * F.log1p(F.col("n") / (MU * F.col("share")))) / math.log(10)).alias("more"))
        texts = texts.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return texts.groupBy("key").agg(F.max("score").alias("score"))


_LOOKED = "row long, doc_id long, key binary, held_out boolean, n_tokens long, known long, logs double, words array<long>, times array<int>"


def _look_up(spark: SparkSession, docs: DataFrame, head: tuple[np.ndarray, np.ndarray], end_count: int) -> DataFrame:
    """Per text: sums over the end and the words in head (hashes ascending, counts), and its other words."""
    held = spark.sparkContext.broadcast(pickle.dumps(head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = pickle.loads(held.value)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            for group in groups(batch.column(1).to_pylist(), GROUP_CHARS):
                n = len(group)
                words = Words(group)
                each = words.distinct_hashes()
                place = np.minimum(np.searchsorted(known, each), max(len(known) - 1, 0))
                inside = (known[place] == each) if len(known) else np.zeros(len(each), bool)
                log = np.where(inside, np.log10(counts[place] + 0.1), 0.0) if len(known) else np.zeros(len(each))
                text = np.repeat(np.arange(n), np.diff(words.offsets))
                is_known = inside[words.codes]
                logs = np.bincount(text, log[words.codes], n) + np.log10(end_count + 0.1)
                n_known = np.bincount(text[is_known], minlength=n) + (end_count > 0)
                pair, times = np.unique(text[~is_known] * len(each) + words.codes[~is_known], return_counts=True)
                splits = pa.array(np.searchsorted(pair // max(len(each), 1), np.arange(n + 1)).astype(np.int32))
                own = ids[at : at + n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        pa.array(own, pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(t) for t in group], pa.binary()),
                        pa.array([held_out(d) for d in own], pa.bool_()),
                        pa.array(np.diff(words.offsets) + 1),
                        pa.array(n_known),
                        pa.array(logs),
                        pa.ListArray.from_arrays(splits, pa.array(each[pair % max(len(each), 1)].view(np.int64))),
                        pa.ListArray.from_arrays(splits, pa.array(times.astype(np.int32))),
                    ],
                    [c.split()[0] for c in _LOOKED.split(", ")],
                )
                row += n
                at += n

    return docs.select("doc_id", "text").mapInArrow(run, _LOOKED)


def score_texts(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs (doc_id, text).

    Null texts are empty and have their end alone; repeated rows are scored alike and count again in
    training; a null doc_id is held out; other columns are ignored; an empty table gives an empty result.
    Words are told apart by a 64-bit hash. The tokenizer may have 65,536 ids at most.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_ids = TextEncoder(tokenizer).n_vocabulary
    if n_ids > 1 << 16:
        raise ValueError(f"ids must fit 16 bits, and this vocabulary has {n_ids}")
    seen = materialize(spark, _count(docs, tokenizer), "seen")
    model, within, rest_pairs = fit(spark, seen, n_ids)
    end_count = seen.filter("key IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    words = seen.filter("NOT pair").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(spark, words, "word-counts")
    totals = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_tokens, n_distinct = totals["n"] + end_count, totals["v"] + (end_count > 0)
    top = words.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    hashes = np.asarray(top.column("word")).astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    head = (hashes[order], np.asarray(top.column("n")).astype(np.float64)[order])
    looked = materialize(spark, _look_up(spark, docs, head, end_count), "looked-up")
    rest = looked.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times")
    rest = rest.join(words.withColumnRenamed("word", "words"), "words", "left")
    rest = rest.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more_logs"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    # Copies of one text share a key, so each score is there SALTS times, and rows ask for one of them.
    scores = materialize(spark, _model_scores(spark, seen, model, within, rest_pairs), "scores")
    scores = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = looked.drop("words", "times").join(rest, "row", "left").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    out = out.join(scores, ["key", "salt"], "left")
    whole = float(np.log10(n_tokens + 0.1 * (n_distinct + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        "score",
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_texts(spark, table(spark, sf_dir, "documents"), default_tokenizer())
