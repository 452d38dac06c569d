"""Terms, patterns and rules.

A term is a string in N-Triples form (``<iri>``, ``"text"``, ``"1"^^<datatype>``, ``"text"@en``, ``_:node``); a variable is a
Var.  Facts are DataFrames with string columns s, p, o and, in datasets, a nullable g.
"""

from __future__ import annotations

from dataclasses import dataclass

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
XSD = "http://www.w3.org/2001/XMLSchema#"
FACT = "s string, p string, o string"
QUAD = FACT + ", g string"


class RdfSyntaxError(ValueError):
    """A document, rule set or query that can't be read; nothing of it is loaded."""


class UnsupportedQuery(ValueError):
    """A query form that this engine doesn't evaluate."""


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return "?" + self.name


Term = str | Var


@dataclass(frozen=True)
class Pattern:
    s: Term
    p: Term
    o: Term
    g: Term | None = None

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t.name for t in (self.s, self.p, self.o, self.g) if isinstance(t, Var)))

    def may_match(self, other: Pattern) -> bool:
        """Whether some fact can fit both; variables of the two are apart."""
        return all(isinstance(a, Var) or isinstance(b, Var) or a == b for a, b in zip((self.s, self.p, self.o), (other.s, other.p, other.o), strict=True))

    def __str__(self) -> str:
        return f"{self.s} {self.p} {self.o}"


@dataclass(frozen=True)
class Rule:
    body: tuple[Pattern, ...]
    head: Pattern

    def __post_init__(self):
        free = set(self.head.variables()) - {v for b in self.body for v in b.variables()}
        if free:
            raise RdfSyntaxError(f"variables of the head that the body doesn't bind: {sorted(free)}")

    def __str__(self) -> str:
        return "{" + ". ".join(map(str, self.body)) + "} => {" + str(self.head) + "}"


def literal(text: str, datatype: str | None = None) -> str:
    quoted = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{quoted}"' + (f"^^<{datatype}>" if datatype else "")


def integer(n: int) -> str:
    return literal(str(n), XSD + "integer")
