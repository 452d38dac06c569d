"""Byte-pair encodings of all prefixes at once.

In a byte-pair encoding a sequence of tokens is the encoding of its text exactly if each token encodes to itself and each
two neighbours encode to those two.  So the last token of a prefix's encoding is the one token ending there that goes with
the last token of the prefix before it, and a forward pass over a word yields the last token, its start and the token count
of every prefix.  Words that begin alike share that pass.

Which tokens end at a symbol is told by an automaton over what tokens start with, made as it is walked; whether two tokens
go together by undoing their last merges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

#: Remembered answers on pairs of tokens, and steps from a state, at most.
PAIRS, STEPS = 300_000, 200_000


class PrefixBpe:
    """rank(a, b): the merge's priority (lower first) or None.  vocabulary: the strings that can be tokens; longest: the symbols of the longest."""

    def __init__(self, rank: Callable[[str, str], float | None], vocabulary: Iterable[str], longest: int, end: str = ""):
        self.rank, self.longest, self.end = rank, longest, end
        #: For each vocabulary string whether it encodes to itself; None: not known yet.
        self._whole: dict[str, bool | None] = dict.fromkeys(vocabulary)
        #: The last merge of tokens that encode to themselves: (left, right, rank), or None if merges are not in order of their ranks.
        self._merged: dict[str, tuple[str, str, float] | None] = {}
        #: (token, its length, whether it fits behind each token before it that was met).
        self._tokens: dict[str, tuple[str, int, dict[str, bool]]] = {}
        self._pairs = 0
        #: What tokens start with, and from such a state and a symbol the next state and the tokens that can end there.
        self._starts = {""} | {t[:n] for t in self._whole if not (end and t.endswith(end)) for n in range(1, len(t) + 1)}
        self._steps: dict[str, tuple[str, tuple]] = {}

    def _merge(self, symbols: Sequence[str]) -> tuple[list[str], tuple[str, str, float] | None]:
        out, merged = list(symbols), None
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                r = self.rank(out[i], out[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            merged = (out[at], out[at + 1], best)
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out, merged

    def merge(self, symbols: Sequence[str]) -> list[str]:
        """The encoding by definition: the best merge first, of equals the leftmost."""
        return self._merge(symbols)[0]

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def whole(self, token: str) -> bool:
        """Whether a vocabulary string encodes to itself."""
        found = self._whole.get(token)
        if found is None:
            found = self._whole[token] = self.merge(self._symbols(token)) == [token]
        return found

    def _last_merge(self, token: str) -> tuple[str, str, float] | None:
        """The last merge of a token that encodes to itself, ranked -inf if it is one symbol; None if it, or one before it, is not ranked behind those before it."""
        if token not in self._merged:
            out, merged = self._merge(self._symbols(token))
            if merged is None:
                merged = (token, token, -math.inf) if out == [token] else None
            elif out != [token] or any((m := self._last_merge(x)) is None or m[2] >= merged[2] for x in merged[:2]):
                merged = None
            if token not in self._whole:  # a symbol without a token: there are many
                return merged
            self._merged[token] = merged
        return self._merged[token]

    def _apart(self, a: str, b: str) -> bool:
        """Whether the encoding of two tokens, that encode to themselves, is those two: no merge joins them at any time.

        Their merges are undone from the last on; what then meets must not merge before the one undone last.
        """
        x, y = self._last_merge(a), self._last_merge(b)
        if x is None or y is None:
            return self.merge([*self._symbols(a), *self._symbols(b)]) == [a, b]
        until, also = math.inf, False
        while True:
            r = self.rank(a, b)
            if r is not None and (r < until or also and r == until):
                return False
            if x[2] > y[2]:  # of equals the leftmost is merged first, so undone last
                until, also, a = x[2], False, x[1]
                x = self._last_merge(a)
            elif y[2] > -math.inf:
                until, also, b = y[2], True, y[0]
                y = self._last_merge(b)
            else:
                return True

    def fits(self, a: str, b: str) -> bool:
        seen = self._token(b)[2]
        found = seen.get(a)
        if found is None:
            if self._pairs >= PAIRS:
                for _, _, old in self._tokens.values():
                    old.clear()
                self._tokens = {t: x for t, x in self._tokens.items() if t in self._whole}
                self._steps.clear()
                self._pairs, seen = 0, self._token(b)[2]
            self._pairs += 1
            found = seen[a] = self._apart(a, b)
        return found

    def _token(self, token: str) -> tuple[str, int, dict[str, bool]]:
        found = self._tokens.get(token)
        if found is None:
            found = self._tokens[token] = (token, len(token), {})
        return found

    def _step(self, text: str) -> tuple[str, tuple]:
        """From a state and the next symbol (text): the longest end of it that a token starts with, and the tokens that can end there, the longest first."""
        found = self._steps.get(text)
        if found is None:
            state = text
            while state not in self._starts:
                state = state[1:]
            ends = [t for i in range(len(state) - 1) if (t := state[i:]) in self._whole and self.whole(t)]
            if len(self._steps) >= STEPS:
                self._steps.clear()
            found = self._steps[text] = (state, tuple(map(self._token, [*ends, text[-1]])))
        return found

    def passes(self, words: Iterable[str]):
        """(word, last tokens, token counts) of distinct words in sorted order, a depth-first walk of their trie: index i has the prefix of length i.  The lists are reused."""
        before, last, counts, states = "", [""], [0], [""]
        for word in sorted(words):
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], counts[same + 1 :], states[same + 1 :]
            state, steps = states[same], self._steps
            for i in range(same + 1, len(word) + 1):
                text = state + word[i - 1]
                state, tokens = steps.get(text) or self._step(text)
                for token, n, seen in tokens:
                    if n == i:
                        break
                    a = last[i - n]
                    fits = seen.get(a)
                    if fits is None:
                        fits = self.fits(a, token)
                    if fits:
                        break
                else:
                    raise ValueError(f"no encoding ends at {i} of {word!r}")
                last.append(token)
                counts.append(counts[i - n] + 1)
                states.append(state)
            before = word
            yield word, last, counts

    def ended(self, word: str, i: int, last: list[str], counts: list[int]) -> int:
        """Tokens of word[:i] as a whole word, with the end mark."""
        for n in range(min(i, self.longest), 0, -1):
            token = word[i - n : i] + self.end
            if (n == 1 or token in self._whole and self.whole(token)) and (n == i or self.fits(last[i - n], token)):
                return counts[i - n] + 1
        raise ValueError(f"no encoding ends at {i} of {word!r}")

    def tokens(self, word: str, last: list[str]) -> list[str]:
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]
