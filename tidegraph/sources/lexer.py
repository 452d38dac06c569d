"""One tokenizer for the text formats: Turtle family, N3 rules and SPARQL."""

from __future__ import annotations

import re

from tidegraph.terms import RDF_TYPE, XSD, RdfSyntaxError, Var, literal

TOKEN = re.compile(
    r"""(?P<space>[\s]+|\#[^\n]*)
    |(?P<iri><[^\x00-\x20<>"{}|^`\\]*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<var>[?$][A-Za-z0-9_]+)
    |(?P<blank>_:[A-Za-z0-9_](?:[\w.\-]*[\w\-])?)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+))
    |(?P<name>(?:[A-Za-z](?:[\w.\-]*[\w\-])?)?:(?:[\w:%](?:[\w.:%\-]*[\w:%\-])?)?)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<mark>\^\^|=>|<=|>=|!=|&&|\|\||[{}()\[\].;,=<>!*+/\-|^?])""",
    re.X | re.S,
)
ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
NAMED = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def unescape(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else NAMED.get(m[1], m[1]), text)


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise RdfSyntaxError(f"can't read {text[at:at + 30]!r} at {at}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return out


class Cursor:
    """Tokens read one by one, with the prefixes in force."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.items, self.at, self.prefixes, self.base = tokens(text), 0, dict(prefixes or {}), ""

    @property
    def kind(self) -> str:
        return self.items[self.at][0] if self.at < len(self.items) else "end"

    @property
    def text(self) -> str:
        return self.items[self.at][1] if self.at < len(self.items) else ""

    def next(self) -> tuple[str, str]:
        kind, text = self.kind, self.text
        if kind == "end":
            raise RdfSyntaxError("the text ends too early")
        self.at += 1
        return kind, text

    def take(self, *texts: str) -> str | None:
        """The next token, upper-cased words alike, if it is one of texts."""
        if self.kind in ("mark", "word", "lang") and self.text.upper() in texts:
            return self.next()[1].upper()
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise RdfSyntaxError(f"{text!r} expected, not {self.text!r}")

    def prefix(self, dotted: bool) -> None:
        kind, name = self.next()
        if kind != "name" or not name.endswith(":"):
            raise RdfSyntaxError(f"a prefix expected, not {name!r}")
        self.prefixes[name[:-1]] = self.iri()[1:-1]
        if dotted:
            self.need(".")

    def iri(self) -> str:
        kind, text = self.next()
        if kind == "iri":
            return text if ":" in text or not self.base else f"<{self.base}{text[1:]}"
        if kind == "name":
            prefix, local = text.split(":", 1)
            if prefix in self.prefixes:
                return f"<{self.prefixes[prefix]}{local}>"
            raise RdfSyntaxError(f"unknown prefix {prefix!r}")
        raise RdfSyntaxError(f"an IRI expected, not {text!r}")

    def term(self):
        kind, text = self.kind, self.text
        if kind in ("iri", "name"):
            return self.iri()
        self.next()
        if kind == "var":
            return Var(text[1:])
        if kind == "blank":
            return text
        if kind == "word" and text == "a":
            return RDF_TYPE
        if kind == "word" and text in ("true", "false"):
            return literal(text, XSD + "boolean")
        if kind == "number":
            return literal(text, XSD + ("integer" if re.fullmatch(r"[+-]?\d+", text) else "double" if "e" in text.lower() else "decimal"))
        if kind in ("string", "long"):
            value = literal(unescape(text[3:-3] if kind == "long" else text[1:-1]))
            if self.kind == "lang":
                return value + self.next()[1]
            if self.take("^^"):
                return f"{value}^^{self.iri()}"
            return value
        raise RdfSyntaxError(f"a term expected, not {text!r}")
