"""Token ids in sorted-string-table shards (operator 5).

A shard is a run of sections, each followed by one newline byte (Spark's text writer puts it there, so that shards go
through Spark's commit protocol to any file system): data blocks, a sparse index, a Bloom filter and a footer. Keys
are order-preserving 9-byte forms of doc_id; entries of a block share key prefixes; blocks are compressed with zstd.

The footer holds the shard's number, by which readers order shards; rows are range-sorted by doc_id, a hash of the text and the
text, so even one doc_id with many texts is cut into several shards.

Null doc_id: sorts first. Null text: no ids but the end id. Repeated doc_id: all rows are kept, ordered by the text's hash, then
the text; rows that are alike in both stay in one shard. An added token spelled out in a text gets its own id. Very long texts
are one entry, in a block of its own. Empty table: no shard. Columns besides the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir, slices, written
from .tokens import library_encoder

FOOTER, ENTRY, MAGIC = struct.Struct("<QIQIIQBI8s"), struct.Struct("<9sQII"), b"QSSTBL02"
BITS_PER_KEY, PROBES = 10, 7
SHARD_BLOCK = 4_096  # shards whose sizes are summed in one window


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> Iterator[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return ((a + i * b) % bits for i in range(PROBES))


def sections(rows: Iterator[tuple[int | None, bytes]], width: int, block_bytes: int, number: int = 0) -> Iterator[bytes]:
    """The sections of shard ``number`` from (doc_id, ids as little-endian ``width``-byte integers) in ascending order."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    at = docs = tokens = 0
    index, keys, block, count, last = [], [], bytearray(), 0, b""

    def close() -> bytes:
        nonlocal at, block, count
        data = pack(bytes(block))
        index.append(ENTRY.pack(last, at, len(data), count))
        at += len(data) + 1
        block, count = bytearray(), 0
        return data

    for doc_id, ids in rows:
        key = key_of(doc_id)
        same = 0
        while count and same < 9 and key[same] == last[same]:
            same += 1
        block += bytes((same,)) + key[same:] + struct.pack("<I", len(ids)) + ids
        last, count, docs, tokens = key, count + 1, docs + 1, tokens + len(ids) // width
        keys.append(key)
        if len(block) >= block_bytes:
            yield close()
    if not docs:
        return
    if count:
        yield close()
    sparse = b"".join(index)
    index_at, at = at, at + len(sparse) + 1
    yield sparse
    bloom = np.zeros(-(-docs * BITS_PER_KEY // 8) + 8, np.uint8)
    for key in keys:
        for p in _probes(key, len(bloom) * 8):
            bloom[p >> 3] |= 1 << (p & 7)
    yield bloom.tobytes()
    yield FOOTER.pack(index_at, len(sparse), at, len(bloom), docs, tokens, width, number, MAGIC)


class Shard:
    """Reads the bytes of one shard."""

    def __init__(self, data: bytes):
        *places, self.docs, self.tokens, self.width, self.number, magic = FOOTER.unpack(data[-FOOTER.size - 1 : -1])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.data = memoryview(data)
        index = self.data[places[0] : places[0] + places[1]]
        self.index = list(ENTRY.iter_unpack(index))
        self.bloom = self.data[places[2] : places[2] + places[3]]

    def block(self, i: int) -> list[tuple[bytes, bytes]]:
        import zstandard

        _, at, size, count = self.index[i]
        raw, p, key, out = zstandard.ZstdDecompressor().decompress(self.data[at : at + size]), 0, b"", []
        for _ in range(count):
            same = raw[p]
            key = key[:same] + raw[p + 1 : p + 10 - same]
            p += 10 - same
            size = struct.unpack_from("<I", raw, p)[0]
            out.append((key, raw[p + 4 : p + 4 + size]))
            p += 4 + size
        return out

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self.block(i):
                yield id_of(key), np.frombuffer(ids, f"<u{self.width}")

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The first entry of ``doc_id``: Bloom filter, then binary searches in the index and in one block."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8)):
            return None
        i = bisect_left(self.index, key, key=lambda e: e[0])
        if i == len(self.index):
            return None
        block = self.block(i)
        j = bisect_left(block, key, key=lambda e: e[0])
        return np.frombuffer(block[j][1], f"<u{self.width}") if j < len(block) and block[j][0] == key else None


def write_shards(docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 2, width: int = 2, shard_bytes: int = 24 << 20, block_bytes: int = 64 << 10, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``text`` and write shards ordered by ``key`` to ``path``; a shard holds about ``shard_bytes`` of text."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, number = library_encoder(vocabulary), TaskContext.get().partitionId()

        def encoded():
            for part in slices(batches, "text", 4 << 20):
                ids, off = encode(part.column(1))
                if len(ids) and width < 4 and ids.max() >= 1 << 8 * width:
                    raise ValueError("token ids need a larger width")
                ids, end = ids.astype(f"<u{width}"), np.array([end_id], f"<u{width}").tobytes()
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    yield doc_id, ids[off[i] : off[i + 1]].tobytes() + end

        for section in sections(encoded(), width, block_bytes, number):
            yield pa.RecordBatch.from_arrays([pa.array([section], pa.binary())], ["section"])

    hashed = rows.withColumn("hash", F.xxhash64("text"))
    ordered = hashed.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    (ordered.mapInArrow(shard, "section binary").select(F.col("section").cast("string").alias("value"))
     .write.option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, start (within the shard), n_tokens and ids_crc32 of every document in the shards at ``path``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                if not (raw := data.as_py()):
                    continue
                shard = Shard(raw)
                ids, starts, sizes, crcs, at = [], [], [], [], 0
                for doc_id, tokens in shard:
                    ids.append(doc_id)
                    starts.append(at)
                    sizes.append(len(tokens))
                    crcs.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    at += len(tokens)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard.number] * len(ids), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write shards to the shared folder, read them back and place every document in the whole sequence of ids."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_shards(docs, path, vocabulary, **options)
    found = written(read_shards(spark, path))
    # one row for each shard; sums over blocks of shards first, so that no task orders all of them
    shards = found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.expr(f"shard div {SHARD_BLOCK}"))
    blocks = shards.groupBy("block").agg(F.sum("n").alias("m"))
    ahead = blocks.select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("ahead"))
    within = F.sum("n").over(Window.partitionBy("block").orderBy("shard")) - F.col("n")
    before = shards.withColumn("within", within).join(ahead, "block").select("shard", (F.col("ahead") + F.col("within")).alias("before"))
    return found.join(before, "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
