"""Exact token counts of texts and of all their prefixes.

The tokenizer lower-cases, splits at white space and character classes, and encodes each piece by BPE with word ends.  A
forward pass over a piece (prefix_bpe) gives the last token and the count of every prefix, so a document's counts are sums
over its pieces, and a truncation or budget question is a look-up in the stored counts rather than another encoding.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import read, small_batches
from tidegraph.llm.prefix_bpe import PrefixBpe
from tidegraph.llm.tokens import word_chunks, word_pieces

#: Remembered chunks and pieces; beyond it, the last batch's stay.
MEMORY = 300_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class PrefixCounter:
    """count(text), prefixes(text), truncate(text, budget) for a tokenizers file with lower-casing word BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path) as f:
            model = json.load(f)["model"]
        ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        longest = max(len(t.removesuffix(self.end)) for t in model["vocab"])
        self.bpe = PrefixBpe(lambda a, b: ranks.get((a, b)), model["vocab"].keys(), longest, self.end)
        self.symbols = byte_symbols()
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _bytes(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)

    def _learn(self, chunks: set[str]) -> None:
        """Counts of chunks not known yet: their new words in one trie walk."""
        new = chunks.difference(self.chunks)
        split = {c: word_pieces(c) for c in new}
        fresh = {w for ws in split.values() if ws for w in ws}.difference(self.words)
        by_bytes = {self._bytes(w): w for w in fresh}
        for symbols, last, counts in self.bpe.passes(by_bytes):
            self.words[by_bytes[symbols]] = self.bpe.ended(symbols, len(symbols), last, counts)
        for c, ws in split.items():
            self.chunks[c] = sum(map(self.words.__getitem__, ws)) if ws is not None else self._library(c)

    def _library(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def count_all(self, texts: list[str]) -> list[int]:
        cuts = [word_chunks(x) for x in texts]
        used = set().union(*cuts)
        self._learn(used)
        out = [sum(map(self.chunks.__getitem__, cut)) for cut in cuts]
        if len(self.chunks) > MEMORY:
            self.chunks = {c: self.chunks[c] for c in used if len(c) <= 64}
        if len(self.words) > MEMORY:
            self.words = {w: n for w, n in self.words.items() if len(w) <= 6}
        return out

    def _chunk_prefixes(self, chunk: str) -> list[int]:
        """Tokens of chunk[:1], chunk[:2], ..."""
        words = word_pieces(chunk)
        if words is None or len("".join(words)) != len(chunk):
            return [self._library(chunk[:i]) for i in range(1, len(chunk) + 1)]
        out, before = [], 0
        for word in words:
            symbols = self._bytes(word)
            _, last, counts = next(self.bpe.passes([symbols]))
            at = 0
            for c in word:
                at += len(c.encode())
                out.append(before + self.bpe.ended(symbols, at, last, counts))
            before = out[-1]
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """int32 array: index i has the tokens of text[:i]."""
        out = np.zeros(len(text) + 1, np.int32)
        known: dict[str, list[int]] = {}
        before = at = 0
        for m in re.finditer(r"[^\x09-\x0d\x20]+", text):
            out[at : m.start() + 1] = before
            own = known.get(m[0]) or known.setdefault(m[0], self._chunk_prefixes(m[0]))
            out[m.start() + 1 : m.end() + 1] = np.array(own, np.int32) + before
            before, at = before + own[-1], m.end()
        out[at + 1 :] = before
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most so many tokens."""
        fits = np.flatnonzero(self.prefixes(text) <= budget)
        return text[: int(fits[-1])] if len(fits) else ""


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row (doc_id, text): the counts of the longest prefixes, the texts themselves.

    A null text counts as empty.  Repeated rows are counted each; other columns are not looked at.
    """

    def counted(batches):
        own = counter(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = own.count_all(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, prefix_tokens: an array whose element i is the token count of the first i code points (element 0 is 0).  Write it beside the documents to answer later questions.  A null text counts as empty; repeated rows are counted each; other columns are not looked at.  A chunk that word_pieces() can't tell goes to the library once for each of its prefixes."""

    def counted(batches):
        own = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.prefixes(x or "") for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "prefix_tokens"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(counted, "doc_id bigint, prefix_tokens array<int>")


def fit_budget(counts: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_chars_kept: the longest prefix within the budget, from stored prefix_counts, by SQL expressions alone.  Null counts give null; repeated rows are answered each."""
    fits = F.filter(F.sequence(F.lit(0), F.size("prefix_tokens") - 1), lambda i: F.element_at("prefix_tokens", i + 1) <= budget)
    return counts.select("doc_id", F.array_max(fits).alias("n_chars_kept"))


def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
