"""Rules in an N3 subset: ``@prefix`` lines and ``{body} => {head}.``; bodies and heads of one atom or more."""

from __future__ import annotations

from tidegraph.sources.lexer import Cursor
from tidegraph.terms import Pattern, RdfSyntaxError, Rule


def _atoms(c: Cursor) -> list[Pattern]:
    c.need("{")
    out = []
    while not c.take("}"):
        s, p = c.term(), c.term()
        out.append(Pattern(s, p, c.term()))
        while True:
            if c.take(","):
                out.append(Pattern(s, p, c.term()))
            elif c.take(";"):
                p = c.term()
                out.append(Pattern(s, p, c.term()))
            else:
                break
        if not c.take(".") and c.text != "}":
            raise RdfSyntaxError(f"'.' or '}}' expected, not {c.text!r}")
    return out


def parse_rules(text: str) -> list[Rule]:
    """The rules of a text, one for each head atom.  An unknown prefix or a rule that can't be read is an error."""
    c, out = Cursor(text), []
    while c.kind != "end":
        if c.take("@PREFIX"):
            c.prefix(True)
            continue
        if c.take("PREFIX"):
            c.prefix(False)
            continue
        body = _atoms(c)
        c.need("=>")
        heads = _atoms(c)
        if not body or not heads:
            raise RdfSyntaxError("a rule needs a body and a head")
        out += [Rule(tuple(body), h) for h in heads]
        c.take(".")
    return out
