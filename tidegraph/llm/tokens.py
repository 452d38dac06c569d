"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces already encoded.

A text is cut only where the tokenizer itself always cuts, so the pieces' ids, one after another, are the library's ids of
the whole text.  Each piece goes through the library once and is then looked up; texts for which the cuts could differ go
through the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Pieces that a worker remembers; beyond it, those that were met again since the last time stay, or those of the last batch if these are over half as many.
MEMORY = 400_000


class PieceEncoder:
    """encode(texts): each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()

    def cut(self, text: str) -> list[str]:
        return [text]

    def library(self, pieces: list[str]) -> dict[str, bytes]:
        return dict(zip(pieces, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)), strict=True))

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        return self.library(pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut(x) for x in texts]
        pieces = set().union(*cuts)
        missing = list(pieces.difference(self.known))
        self.again.update(pieces.difference(missing))
        for i in range(0, len(missing), 8192):
            self.known.update(self.learn(missing[i : i + 8192]))
        out = [b"".join(map(self.known.__getitem__, cut)) for cut in cuts]
        for x in missing:
            if len(x) > 64:
                del self.known[x]
        if len(self.known) > MEMORY:
            kept = self.again if 2 * len(self.again) <= MEMORY else pieces
            self.known = {x: self.known[x] for x in kept if x in self.known}
            self.again = set()
        return out


#: Chunks between white space whose pieces word_pieces can tell: Latin, without apostrophes or the start of an added token.
PLAIN = re.compile(r"[!-&(-;=-~À-įĲ-ɏ]+")
_PIECE = re.compile(r"[^\W\d_]+|\d|(?:[^\w]|_)+")


def word_pieces(chunk: str) -> list[str] | None:
    """A chunk's pieces as the lower-casing word tokenizer splits it (letters, single digits, runs of others), or None if only the library can tell."""
    if not PLAIN.fullmatch(chunk) or not unicodedata.is_normalized("NFC", chunk):
        return None
    return _PIECE.findall(chunk.lower())


_GAP = re.compile(r"[\x09-\x0d\x20]+")
#: What texts need for lower-casing and setting stops apart to be harmless: Latin letters, no added token, no run of marks with a stop or comma inside.
_ODD, _RUN = re.compile(r"[^\n\t\r\x20-\x7e\xa1-įĲ-ɏ]"), re.compile(r"[!-/:-@\[-`{-¿×÷][.,]")


def word_chunks(text: str) -> list[str]:
    """A text cut where the lower-casing word tokenizer always cuts.

    A stop or comma after a letter starts a piece anyway, and letter case is dropped anyway; both made equal before the cut, fewer chunks are distinct.
    """
    if "<|" in text or _RUN.search(text) or _ODD.search(text):
        return [x for x in _GAP.split(text) if x]
    return text.lower().replace(".", " .").replace(",", " ,").split()


class WordEncoder(PieceEncoder):
    """For the lower-casing BPE with word ends, which drops white space: cut at ASCII white space, then into pieces."""

    def __init__(self, path: str):
        super().__init__(path)
        end = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(end.values()) + 1, bool)
        self.ends[[i for t, i in end.items() if t.endswith("</w>")]] = True

    def cut(self, text: str) -> list[str]:
        return word_chunks(text)

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        split = {c: word_pieces(c) for c in pieces}
        out = self.library([c for c, ws in split.items() if ws is None])
        fresh = list({w for ws in split.values() if ws for w in ws}.difference(self.known))
        own: dict[str, bytes] = {}
        if fresh:  # one text of all new pieces; a token with a word end ends each
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(fresh):
                raw, at = ids.tobytes(), 0
                for w, e in zip(fresh, (4 * ends).tolist(), strict=True):
                    own[w] = raw[at:e]
                    at = e
            else:
                own = self.library(fresh)
        ids_of = lambda w: own[w] if w in own else self.known[w]
        for c, ws in split.items():
            if ws is not None:
                out[c] = ids_of(ws[0]) if len(ws) == 1 else b"".join(map(ids_of, ws))
        for w, x in own.items():  # a piece is a chunk too, so one memory serves both
            if len(w) <= 64:
                out.setdefault(w, x)
        return out


class ByteLevelEncoder(PieceEncoder):
    """For byte-level BPE with the usual splitting pattern: cut by that pattern.  Texts with an added token, control characters, characters beyond Latin or numerals other than digits go to the library whole."""

    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
    odd = re.compile(r"[^\n\t\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
    word = re.compile(r" ?[^\W\d_]+")

    def __init__(self, path: str):
        super().__init__(path)
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        vocab = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocab.values()) + 1, bool)
        self.blank[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def cut(self, text: str) -> list[str]:
        if self.odd.search(text) or self.added and self.added.search(text):
            return [text]
        return self.pattern.findall(text)

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        out, words = {}, [x for x in pieces if self.word.fullmatch(x) and not self.odd.search(x)]
        # one text of all words, as each is a piece of its own there: those after a blank as they are, a token that starts with one starts each; the others a line each
        for own, between in (([x for x in words if x[0] == " "], ""), ([x for x in words if x[0] != " "], "\n")):
            if len(own) < 2:
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(own)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.append(0, np.flatnonzero(ids == self.line_end) + 1) if between else np.flatnonzero(self.blank[ids])
            if len(starts) == len(own) and starts[0] == 0:
                raw, at = ids.tobytes(), (4 * starts).tolist()
                for w, a, b in zip(own, at, [*at[1:], len(raw) + 4 * len(between)], strict=True):
                    out[w] = raw[a : b - 4 * len(between)]
        return out | self.library([x for x in pieces if x not in out])


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> PieceEncoder:
    """One for each Python worker."""
    return {"word": WordEncoder, "byte": ByteLevelEncoder, "whole": PieceEncoder}[kind](path)
