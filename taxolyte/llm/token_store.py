"""Token ids as directly addressable codes.

Each id is cut into 8-bit chunks. Level 0 holds the lowest chunk of every id; a bitmap says which ids
go on, and those have their next chunk in level 1, and so on. A rank directory (ones before each block
of 512 bits) maps a position to its place in the next level, so any id is read from a few bytes per
level without decoding a block.

Segment layout, little-endian: magic "DAC1", u32 number of documents, u64 number of ids, u8 number of
levels; i64 document ids with a u8 null flag each; u64 first position of each document; per level u64
number of chunks, the chunks, the bitmap (bit i in byte i // 8, low bit first), u32 rank directory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolyte.llm.common import new_path, table
from taxolyte.llm.tokens import END, PIECES, TextEncoder, default_tokenizer

MAGIC = b"DAC1"
BLOCK = 512
#: A segment is closed once it holds this many ids; one very long text may exceed it.
SEGMENT_IDS = 1 << 20
_SEGMENTS = "part int, segment int, first long, n_ids long, n_docs long, payload binary"
_DOCS = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of one segment; ids are those of all its documents in order."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        chunks, rest = (rest & 255).astype(np.uint8), rest >> 8
        on = rest > 0
        bitmap = np.packbits(on, bitorder="little")
        ones = np.add.reduceat(np.unpackbits(bitmap).astype(np.uint32), np.arange(0, len(bitmap) * 8, BLOCK)) if len(bitmap) else np.zeros(0, np.uint32)
        levels.append((chunks, bitmap, (np.cumsum(ones) - ones).astype("<u4")))
        if not on.any():
            break
        rest = rest[on]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    null = np.fromiter((d is None for d in doc_ids), np.uint8, len(doc_ids))
    out = [MAGIC, struct.pack("<IQB", len(doc_ids), len(ids), len(levels))]
    out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), starts.astype("<u8").tobytes()]
    for chunks, bitmap, ranks in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Segment:
    """Read access to the bytes of one segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        n_docs, self.n_ids, n_levels = struct.unpack_from("<IQB", data, 4)
        at = 4 + struct.calcsize("<IQB")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
        self.starts = take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            size = (n + 7) // 8
            self.levels.append((take("u1", n), take("u1", size), take("<u4", -(-size * 8 // BLOCK))))

    def token(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            base = i // BLOCK * (BLOCK // 8)
            before = np.unpackbits(bitmap[base : (i >> 3) + 1], bitorder="little")[: i - base * 8]
            i = int(ranks[i // BLOCK]) + int(before.sum())
        raise ValueError("a code goes on after the last level")

    def all(self) -> np.ndarray:
        """All ids in order."""
        above = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            on = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            value[on] |= above << 8
            above = value
        return above


def write_tokens(docs: DataFrame, path: str, tokenizer: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of all texts (doc_id, text), each followed by an end id, in ascending doc_id order.

    The result is a folder of segments with their part and their first position in it; parts are ranges
    of doc_id in order. A null text is empty, a null doc_id comes first, repeated rows are written again
    (ties by the text's hash, then the text), other columns are ignored; an empty table gives an empty folder. Texts are shuffled
    once, by range; a worker holds one segment and one batch.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # The hash is part of the key, so that rows under one doc_id spread too; the range sample stays small.
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = TextEncoder.of_worker(tokenizer, PIECES), TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        n, first, k = 0, 0, 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) for _, x in held], np.int64)
            payload = encode_segment([d for d, _ in held], lengths, np.concatenate([x for _, x in held]))
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "segment": pa.array([k], pa.int32()),
                    "first": pa.array([first], pa.int64()),
                    "n_ids": pa.array([n], pa.int64()),
                    "n_docs": pa.array([len(held)], pa.int64()),
                    "payload": pa.array([payload], pa.binary()),
                }
            )

        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(coded + END, "<u4")
                held.append((doc_id, ids))
                n += len(ids)
                if n >= segment_ids:
                    yield close()
                    held, n, first, k = [], 0, first + n, k + 1
        if held:
            yield close()

    ordered.mapInArrow(encode, _SEGMENTS).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SEGMENTS).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a folder of segments: doc_id, start, n_tokens, ids_crc32."""
    segments = read_segments(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = Segment(payload)
                data, ends = s.all().astype("<u4"), np.append(s.starts[1:], s.n_ids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * len(s.doc_ids), pa.int32()),
                        "doc_id": pa.array(s.doc_ids, pa.int64()),
                        "start": pa.array(first + s.starts, pa.int64()),
                        "n_tokens": pa.array(ends - s.starts, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(data[a:b].tobytes()) for a, b in zip(s.starts, ends, strict=True)], pa.int64()),
                    }
                )

    docs = segments.select("part", "first", "payload").mapInArrow(decode, _DOCS)
    # One row per part, that is per task of the writing stage, so a single window task and a broadcast are bounded.
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return docs.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents as directly addressable codes and reads them back."""
    path = new_path(spark, "token-store")
    write_tokens(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return read_documents(spark, path)
