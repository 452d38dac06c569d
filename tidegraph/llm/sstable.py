"""Token-id shards in a sorted-string-table format.

A shard holds documents in key order in blocks.  In a block each entry has the length of the key's prefix shared with the
key before, the rest of the key, and the ids.  After the blocks come a Bloom filter, a sparse index (the last key and the
place of each block) and a footer, so one key is found by the footer, the filter, a binary search in the index and one block.

    block   entries of: shared u8, rest u8, ids u32 | rest of key | ids, little-endian, ``width`` bytes each
    bloom   bits
    index   entries of: key 8 bytes | offset u64 | length u32
    footer  bloom offset u64, bloom length u64, index offset u64, blocks u32, width u8, entries u64, ids u64, crc32 of bloom and index u32, magic 8 bytes
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import ranges_for, read, scratch_path, small_batches
from tidegraph.llm.tokens import encoder

MAGIC = b"TGSST001"
FOOTER = struct.Struct("<QQQIBQQI8s")
ENTRY, INDEX = struct.Struct("<BBI"), struct.Struct("<8sQI")
BLOCK = 64 << 10
BITS, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    """8 bytes that sort as the integers do; a null sorts first, as the smallest integer, which it stands for."""
    return ((-(1 << 63) if doc_id is None else doc_id) + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key), xxhash.xxh64_intdigest(key, 1) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Appends entries, in key order, to a binary file; holds one block, the index and the keys' hashes."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.block, self.index, self.hashes = bytearray(), bytearray(), array("Q")
        self.at = self.entries = self.ids = self.blocks = 0
        self.last = b""

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian, width bytes each."""
        shared = next((i for i in range(8) if key[i] != self.last[i]), 8) if self.block else 0
        self.block += ENTRY.pack(shared, 8 - shared, len(ids) // self.width) + key[shared:] + ids
        self.last = key
        self.entries += 1
        self.ids += len(ids) // self.width
        self.hashes.extend((xxhash.xxh64_intdigest(key), xxhash.xxh64_intdigest(key, 1) | 1))
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index += INDEX.pack(self.last, self.at, len(self.block))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.blocks += 1
            self.block.clear()

    def close(self) -> None:
        self._flush()
        bits = max(64, (self.entries * BITS + 7) // 8 * 8)
        marked = np.zeros(bits, bool)
        pairs = np.array(self.hashes, np.uint64).reshape(-1, 2)
        for i in range(PROBES):
            marked[(pairs[:, 0] % np.uint64(bits) + np.uint64(i) * (pairs[:, 1] % np.uint64(bits))) % np.uint64(bits)] = True
        bloom = np.packbits(marked, bitorder="little").tobytes()
        self.out.write(bloom + bytes(self.index))
        crc = zlib.crc32(bytes(self.index), zlib.crc32(bloom))
        self.out.write(FOOTER.pack(self.at, len(bloom), self.at + len(bloom), self.blocks, self.width, self.entries, self.ids, crc, MAGIC))


class Reader:
    """Reads a shard from a seekable binary file: one block at a time."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        self.bloom_at, bloom, index_at, self.blocks, self.width, self.entries, self.ids, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(self.bloom_at)
        self.bloom = source.read(bloom)
        raw = source.read(self.blocks * INDEX.size)
        if zlib.crc32(raw, zlib.crc32(self.bloom)) != crc or index_at != self.bloom_at + bloom:
            raise ValueError("a damaged shard")
        self.index = list(INDEX.iter_unpack(raw))

    def _block(self, i: int):
        _, at, length = self.index[i]
        self.source.seek(at)
        raw, p, key = self.source.read(length), 0, b""
        while p < length:
            shared, rest, n = ENTRY.unpack_from(raw, p)
            p += ENTRY.size
            key = key[:shared] + raw[p : p + rest]
            p += rest
            yield key, np.frombuffer(raw, f"<u{self.width}", n, p).astype("<u4")
            p += n * self.width

    def __iter__(self):
        for i in range(self.blocks):
            yield from self._block(i)

    def get(self, key: bytes) -> np.ndarray | None:
        """The ids of a key (of equal keys the first in the file), or None."""
        bits = len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits)):
            return None
        i = bisect.bisect_left(self.index, key, key=lambda e: e[0])
        return next((ids for k, ids in self._block(i) if k == key), None) if i < self.blocks else None


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 0, kind: str = "byte") -> DataFrame:
    """Encode (doc_id, text), append end_id to each, write one shard for each range of doc_id, return the manifest: shard, file, n_docs, n_tokens.

    The manifest has one row for each shard, in doc_id order.  A task writes under a name of its own and renames when done,
    so a task that runs again, or twice at once, leaves a whole file.  The folder must be one that all executors see.
    A null text is empty; a null doc_id sorts first, as the smallest integer; rows that repeat a doc_id are entries each, in
    order of their texts' hash.  Other columns are not looked at.  A table without rows has no shard.
    """

    def write(batches):
        own = encoder(path, kind)
        width = 4 if max(own.tokenizer.get_vocab_size() - 1, end_id) >= 1 << 16 else 2
        end = np.array([end_id], "<u4").tobytes()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        name, own_name = f"{root}/shard-{shard:06d}.sst", f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(own_name) as out:
            writer = Writer(out, width)
            for batch in batches:
                texts = [x or "" for x in batch.column(1).to_pylist()]
                for doc, ids in zip(batch.column(0).to_pylist(), own.encode(texts), strict=True):
                    raw = ids + end
                    writer.add(key_of(doc), raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes())
            writer.close()
        if writer.entries:
            fs.move(own_name, name)
        else:
            fs.delete_file(own_name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [name.rpartition("/")[2]], "n_docs": pa.array([writer.entries], pa.int64()), "n_tokens": pa.array([writer.ids], pa.int64())})

    spark = docs.sparkSession
    small_batches(spark)
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ranged = chosen.repartitionByRange(ranges_for(docs), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    done = ranged.mapInArrow(write, "shard bigint, file string, n_docs bigint, n_tokens bigint").collect()
    return spark.createDataFrame(sorted(r for r in done if r.n_docs), "shard bigint, file string, n_docs bigint, n_tokens bigint")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each entry, read from the shards: start counts the ids of all entries before, over all shards."""
    rows, total = [], 0
    for r in sorted(manifest.collect()):
        rows.append((r.shard, r.file, total))
        total += r.n_tokens
    files = spark.createDataFrame(rows, "shard bigint, file string, base bigint").repartition(max(1, len(rows)), "shard")

    def scan(batches):
        fs, root = _filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                file = f"{root}/{name}"
                with fs.open_input_file(file) as f:
                    out: list[tuple] = []
                    for key, ids in Reader(f, fs.get_file_info(file).size):
                        out.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    return files.mapInArrow(scan, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(folder: str, file: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document from one shard, or None: by footer, filter, binary search and one block.  Of entries with one key the first."""
    fs, root = _filesystem(folder)
    with fs.open_input_file(f"{root}/{file}") as f:
        return Reader(f, fs.get_file_info(f"{root}/{file}").size).get(key_of(doc_id))


def op5_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty; rows that repeat are entries each, in order of their texts' hash; other columns are not looked at."""
    import public_tokenizers

    folder = scratch_path(spark, "sst")
    return read_shards(spark, folder, write_shards(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json")))
