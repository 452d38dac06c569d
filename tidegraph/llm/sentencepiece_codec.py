"""SentencePiece encoding and decoding by a forward pass over a trie of words.

A batch's distinct marked words (a word with the blanks before it, each written U+2581) are sorted, which lays out their
trie depth-first; the forward pass keeps its state for every prefix, so words that begin alike share it, and remembers each
word's ids.  For unigram models the state is the best score of a prefix and its last piece (Viterbi).  A BPE model's scores
are merge priorities, whose best sum is not the library's encoding, so there the state is the last piece of the prefix's BPE
encoding (prefix_bpe), over the same trie.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import read, small_batches
from tidegraph.llm.prefix_bpe import PrefixBpe

MARK = "▁"
#: Bytes that are no UTF-8 become a replacement character each, as the library has it.
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
#: Remembered words; beyond it, the last batch's stay.
MEMORY = 800_000
UNIGRAM, BPE = 1, 2


def fields(raw: bytes):
    """(number, value) of a protocol buffer message: integers, or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[i : i + n]
            i += n


class Viterbi:
    """The best-scored segmentation: of pieces with equal sums, the one with the longest last piece.  A character without a piece costs ``unknown``."""

    def __init__(self, scores: dict[str, float], unknown: float):
        self.scores, self.unknown = scores, unknown
        self.longest = max(map(len, scores), default=1)

    def passes(self, words: Iterable[str]):
        """(word, last pieces) of distinct words in sorted order; forward scores of common prefixes are kept."""
        before, last, best = "", [""], [0.0]
        for word in sorted(words):
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], best[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                top, piece = best[i - 1] + self.scores.get(word[i - 1], self.unknown), word[i - 1]
                for n in range(2, min(i, self.longest) + 1):
                    s = self.scores.get(word[i - n : i])
                    if s is not None and best[i - n] + s >= top:
                        top, piece = best[i - n] + s, word[i - n : i]
                best.append(top)
                last.append(piece)
            before = word
            yield word, last


class Codec:
    """encode_all(texts): little-endian unsigned 32-bit ids, as the sentencepiece library gives them; decode(ids): the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = own = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            specs = {n: dict(fields(v)) for n, v in fields(f.read()) if n in (2, 3)}
        self.kind = specs.get(2, {}).get(3, UNIGRAM)
        norm = specs.get(3, {})
        self.prefix = bool(norm.get(3, 1))
        self.as_is = not norm.get(2) and not norm.get(4, 1) and bool(norm.get(5, 1))
        size = own.get_piece_size()
        usual = [i for i in range(size) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
        self.ids = {own.id_to_piece(i): i for i in usual}
        self.raw = {p: np.uint32(i).astype("<u4").tobytes() for p, i in self.ids.items()}
        self.bytes = {int(own.id_to_piece(i)[3:5], 16): i for i in range(size) if own.is_byte(i)}
        scores = {p: own.get_score(i) for p, i in self.ids.items()}
        if self.kind == BPE:
            self.forward = PrefixBpe(lambda a, b: -s if (s := scores.get(a + b)) is not None else None, self.ids.keys(), max(map(len, scores)))
        else:
            self.forward = Viterbi(scores, min(scores.values()) - 10.0)
        #: Words are separate only if no piece spans a word's end.
        self.apart = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.table = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else b"" if own.is_control(i) else " ⁇ ".encode() if own.is_unknown(i) else own.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        self.known: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        marked = (" " * self.prefix + text).replace(" ", MARK)
        return self.word.findall(marked) if self.apart else [marked]

    def _ids(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.library.unk_id():
                out.append(self.library.unk_id())
        return np.array(out, "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.as_is or self.forward is None or self.kind not in (UNIGRAM, BPE):
            return [np.array(self.library.encode(x), "<u4").tobytes() for x in texts]
        cuts = [self._cut(x) for x in texts]
        used = set().union(*cuts)
        for word, last, *_ in self.forward.passes(used.difference(self.known)):
            pieces, i = [], len(word)
            while i:
                pieces.append(last[i])
                i -= len(last[i])
            pieces.reverse()
            try:
                self.known[word] = b"".join(map(self.raw.__getitem__, pieces))
            except KeyError:
                self.known[word] = self._ids(pieces)
        out = [b"".join(map(self.known.__getitem__, cut)) for cut in cuts]
        if len(self.known) > MEMORY:
            self.known = {w: self.known[w] for w in used if len(w) <= 64}
        return out

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "each_byte")
        return text[1:] if self.prefix and ids and self.table[ids[0]][:1] == b" " and ids[0] not in self.bytes.values() else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of each row (doc_id, text).  A null text counts as empty and has no ids."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            out = [np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode_all([x or "" for x in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each row (doc_id, ids).  Null ids give a null text."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else own.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32 and decoded_crc32 (UTF-8 of the decoded ids), round_trip of each row: both ways in one pass, so no ids are moved.  A null text counts as empty; repeated rows are rows each."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows = []
            for x, raw in zip(texts, own.encode_all(texts), strict=True):
                back = own.decode(np.frombuffer(raw, "<u4").tolist())
                rows.append((len(x.encode()), len(raw) // 4, zlib.crc32(raw), zlib.crc32(back.encode()), back == x))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean")


def op10_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
