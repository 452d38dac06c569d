"""Packing along a space-filling curve: documents with similar tokens come to lie in the same training sequences.

Documents are encoded once.  Each one's token frequencies, hashed to a few dozen places with signs, make a vector; less the
mean over all documents and scaled to unit length, it is projected to few dimensions.  Each dimension is cut at its
quantiles over all documents, and the cell's place on a Hilbert curve is the sort key.  Ranges of the curve are packed
independently: documents are laid end to end and cut every ``length`` tokens, and what a range has left over is cut into
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import ranges_for, read, small_batches, table
from tidegraph.llm.tokens import encoder

#: Places that tokens are hashed to, dimensions that vectors are projected to, and bits of a coordinate.
HASHED, DIMENSIONS, BITS = 64, 4, 6
LENGTH = 4096
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, curve_key bigint"


def hashed(size: int) -> tuple[np.ndarray, np.ndarray]:
    """A fixed place and sign for each of so many token ids."""
    x = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(40)) % np.uint64(HASHED)).astype(np.int64), ((x >> np.uint64(20)) & np.uint64(1)).astype(np.float64) * 2 - 1


def directions() -> np.ndarray:
    """HASHED x DIMENSIONS: fixed directions at right angles."""
    return np.linalg.qr(np.random.default_rng(11).normal(size=(HASHED, DIMENSIONS)))[0]


def projected(vectors: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Rows less the mean, of unit length (a row equal to the mean stays zero), in DIMENSIONS dimensions."""
    rows = vectors - mean
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(size > 0, size, 1)) @ directions()


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Each row's index on the Hilbert curve of as many dimensions: undo the curve's turns and flips from the top bit down, Gray-decode, then interleave."""
    x = [points[:, i].copy() for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(len(x)):
            turned = (x[i] >> level & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(turned, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(len(points), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    index = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v ^ flip) >> level & 1
    return index


def encoded(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, vector (HASHED float16), ids (unsigned 16- or 32-bit little-endian, with the end id)."""

    def encode(batches):
        own = encoder(path, kind)
        size = own.tokenizer.get_vocab_size()
        place, sign = hashed(max(size, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = [x + end for x in own.encode([x or "" for x in batch.column(1).to_pylist()])]
            if not out:
                continue
            counts, flat = np.array([len(x) // 4 for x in out]), np.frombuffer(b"".join(out), "<u4")
            at = np.concatenate([[0], np.cumsum(counts)[:-1]])
            cell = place[flat] + np.repeat(np.arange(len(out)) * HASHED, counts)
            vectors = (np.bincount(cell, weights=sign[flat], minlength=len(out) * HASHED).reshape(-1, HASHED) / counts[:, None]).astype("<f2")
            if size <= 1 << 16:
                out = [x.tobytes() for x in np.split(flat.astype("<u2"), at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in vectors], pa.binary()), pa.array(out, pa.binary())], ["doc_id", "vector", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, "doc_id bigint, vector binary, ids binary")


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").astype(np.float64).reshape(-1, HASHED)


def _mean(ids: DataFrame) -> np.ndarray:
    """The mean vector of all documents: sums by task, added up by place on the executors."""

    def sums(batches):
        total, n = np.zeros(HASHED), 0
        for batch in batches:
            total += _vectors(batch.column(0)).sum(0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(HASHED), pa.int32()), pa.array(total), pa.array([n] * HASHED, pa.int64())], ["place", "total", "n"])

    rows = ids.select("vector").mapInArrow(sums, "place int, total double, n bigint").groupBy("place").agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).alias("mean")).collect()
    out = np.zeros(HASHED)
    for r in rows:
        out[r.place] = r["mean"]
    return out


def _cuts(ids: DataFrame, mean: np.ndarray) -> np.ndarray | None:
    """DIMENSIONS x (2**BITS - 1): where each dimension's cells end, so that each holds about as many of all documents; None without documents."""

    def project(batches):
        for batch in batches:
            found = projected(_vectors(batch.column(0)), mean)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, d]) for d in range(DIMENSIONS)], [f"x{d}" for d in range(DIMENSIONS)])

    cells = 1 << BITS
    shares = F.array(*(F.lit(i / cells) for i in range(1, cells)))
    points = ids.select("vector").mapInArrow(project, ", ".join(f"x{d} double" for d in range(DIMENSIONS)))
    found = points.agg(*(F.percentile_approx(f"x{d}", shares, F.lit(1000)).alias(f"x{d}") for d in range(DIMENSIONS))).first()
    return None if found[0] is None else np.array([list(found[d]) for d in range(DIMENSIONS)])


def keyed(ids: DataFrame) -> DataFrame:
    """doc_id, curve_key, ids of a written encoded() table."""
    mean = _mean(ids)
    cuts = _cuts(ids, mean)

    def run(batches):
        for batch in batches:
            points = projected(_vectors(batch.column(1)), mean)
            coordinates = np.stack([np.searchsorted(cuts[d], points[:, d]) for d in range(DIMENSIONS)], 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert(coordinates), pa.int64()), batch.column(2)], ["doc_id", "curve_key", "ids"])

    return ids.select("doc_id", "vector", "ids").mapInArrow(run, "doc_id bigint, curve_key bigint, ids binary")


def _pack(width: int, length: int):
    def pack(batches):
        first = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # documents of which a part isn't placed yet, each (doc_id, key, ids, start)
        size, sequence = 0, 0

        def cut(n: int, rows: list[tuple]) -> None:
            """Move n tokens from the front of what is held to a sequence of their own."""
            nonlocal size, sequence
            offset, used = 0, 0
            while n:
                doc, key, ids, start = held[used]
                take = min(n, len(ids) - start)
                rows.append((doc, start, take, zlib.crc32(ids[start : start + take].tobytes()), len(ids), first + sequence, offset, key))
                offset, n, size = offset + take, n - take, size - take
                if start + take == len(ids):
                    used += 1
                else:
                    held[used] = (doc, key, ids, start + take)
            del held[:used]
            sequence += 1

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)

        for batch in batches:
            rows: list[tuple] = []
            for doc, key, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a = np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype("<u4")
                held.append((doc, key, a, 0))
                size += len(a)
                while size >= length:
                    cut(length, rows)
            yield batch_of(rows)
        rows = []
        while size:
            cut(1 << size.bit_length() - 1, rows)
        yield batch_of(rows)

    return pack


def pack(docs: DataFrame, path: str, end_id: int = 2, kind: str = "word", length: int = LENGTH) -> DataFrame:
    """The pieces (PIECES) of all rows (doc_id, text), one row each: where a run of a document's ids lies.

    A null text is empty, so the document is its end id alone.  Rows that repeat are packed each.  Other columns are not
    looked at.  ``length`` must be a power of two.  Every sequence is full or a power of two, so nothing is padded; within
    a sequence offsets have no gaps.  Encoded documents are written once and shuffled once, by ranges of (key, doc_id), so
    equal keys spread over ranges.
    """
    ids = table(encoded(docs, path, end_id, kind), "ids")
    from tokenizers import Tokenizer

    width = 4 if Tokenizer.from_file(path).get_vocab_size() > 1 << 16 else 2
    ranged = keyed(ids).repartitionByRange(ranges_for(ids), "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id", F.xxhash64("ids"))
    return ranged.select("doc_id", "curve_key", "ids").mapInArrow(_pack(width, length), PIECES)


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
