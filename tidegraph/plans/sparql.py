"""SPARQL text to an algebra of plain tuples and dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidegraph.sources.lexer import Cursor
from tidegraph.terms import Pattern, RdfSyntaxError, Term, UnsupportedQuery, Var

AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")
BUILTINS = ("STR", "LANG", "DATATYPE", "STRLEN", "SUBSTR", "UCASE", "LCASE", "CONTAINS", "STRSTARTS", "STRENDS", "REGEX", "REPLACE", "CONCAT", "ABS", "ROUND", "CEIL", "FLOOR", "YEAR", "MONTH", "DAY", "IF", "COALESCE", "BOUND", "ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "ISNUMERIC", "SAMETERM")


@dataclass(frozen=True)
class Path:
    """Steps (predicate, whether against its direction), any of which is taken, and how often: '' once, '+', '*' or '?'.  With other, any step is taken but these."""

    s: Term
    steps: tuple[tuple[str, bool], ...]
    o: Term
    kind: str = ""
    other: bool = False


@dataclass
class Group:
    """Elements in order: ('bgp', [Pattern | Path]), ('filter', expr), ('optional'|'minus', Group), ('union', [Group]), ('bind', var, expr), ('values', vars, rows), ('exists', Group, wanted), ('query', Query)."""

    items: list[tuple] = field(default_factory=list)


@dataclass
class Query:
    form: str = "SELECT"
    where: Group = field(default_factory=Group)
    columns: list[tuple[str, tuple | None]] | None = None  # None: all
    distinct: bool = False
    groups: list[tuple[str, tuple | None]] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    template: list[Pattern] = field(default_factory=list)


class _Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None):
        self.c, self.blanks = Cursor(text, prefixes), 0

    def query(self) -> Query:
        c = self.c
        while c.text.upper() in ("PREFIX", "BASE"):
            if c.take("PREFIX"):
                c.prefix(False)
            else:
                c.next()
                c.base = c.iri()[1:-1]
        q = self.body()
        if c.kind != "end":
            raise RdfSyntaxError(f"{c.text!r} after the query's end")
        return q

    def body(self) -> Query:
        c, q = self.c, Query()
        if c.take("SELECT"):
            q.distinct = bool(c.take("DISTINCT") or c.take("REDUCED"))
            if not c.take("*"):
                q.columns = []
                while c.kind == "var" or c.text == "(":
                    q.columns.append(self.column())
                if not q.columns:
                    raise RdfSyntaxError("SELECT needs variables or *")
        elif c.take("ASK"):
            q.form = "ASK"
        elif c.take("CONSTRUCT"):
            q.form = "CONSTRUCT"
            c.need("{")
            while not c.take("}"):
                q.template += self.same_subject(None)
                c.take(".")
        elif c.take("DESCRIBE"):
            q.form, q.columns = "DESCRIBE", []
            while c.kind in ("var", "iri", "name"):
                t = c.term()
                q.columns.append((t.name, None) if isinstance(t, Var) else (None, ("term", t)))
            if c.text != "{" and c.text.upper() != "WHERE":
                return q
        else:
            raise RdfSyntaxError(f"a query form expected, not {c.text!r}")
        c.take("WHERE")
        q.where = self.group(None)
        if c.take("GROUP"):
            c.need("BY")
            while c.kind == "var" or c.text == "(":
                q.groups.append(self.column())
        if c.take("HAVING"):
            while c.text == "(":
                q.having.append(self.bracketed())
        if c.take("ORDER"):
            c.need("BY")
            while c.kind == "var" or c.text == "(" or c.text.upper() in ("ASC", "DESC"):
                up = c.take("ASC", "DESC") != "DESC"
                q.order.append((self.bracketed() if c.text == "(" else ("var", c.term().name), up))
        while c.text.upper() in ("LIMIT", "OFFSET"):
            word, n = c.next()[1].upper(), int(c.next()[1])
            if word == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        return q

    def column(self):
        c = self.c
        if c.kind == "var":
            return c.term().name, None
        c.need("(")
        expr = self.expression()
        if c.take("AS"):
            name = c.term().name
        elif expr[0] == "var":
            name = expr[1]
        else:
            raise RdfSyntaxError("an expression here needs AS")
        c.need(")")
        return name, expr

    def bracketed(self):
        self.c.need("(")
        out = self.expression()
        self.c.need(")")
        return out

    def group(self, graph) -> Group:
        c, out = self.c, Group()
        c.need("{")
        if c.text.upper() == "SELECT":
            out.items.append(("query", self.body()))
            c.need("}")
            return out
        while not c.take("}"):
            if c.take("."):
                continue
            if c.take("FILTER"):
                negated = bool(c.take("NOT"))
                if c.take("EXISTS"):
                    out.items.append(("exists", self.group(graph), not negated))
                else:
                    out.items.append(("filter", self.bracketed() if c.text == "(" else self.primary()))
            elif c.take("OPTIONAL"):
                out.items.append(("optional", self.group(graph)))
            elif c.take("MINUS"):
                out.items.append(("minus", self.group(graph)))
            elif c.take("GRAPH"):
                out.items.append(("union", [self.group(c.term())]))
            elif c.take("BIND"):
                c.need("(")
                expr = self.expression()
                c.need("AS")
                out.items.append(("bind", c.term().name, expr))
                c.need(")")
            elif c.take("VALUES"):
                out.items.append(self.values())
            elif c.text.upper() == "SERVICE":
                raise UnsupportedQuery("SERVICE")
            elif c.text == "{":
                arms = [self.group(graph)]
                while c.take("UNION"):
                    arms.append(self.group(graph))
                out.items.append(("union", arms))
            else:
                found = self.same_subject(graph)
                if out.items and out.items[-1][0] == "bgp":
                    out.items[-1][1].extend(found)
                else:
                    out.items.append(("bgp", found))
        return out

    def values(self):
        c = self.c
        single = c.kind == "var"
        names = [c.term().name] if single else []
        if not single:
            c.need("(")
            while not c.take(")"):
                names.append(c.term().name)
        c.need("{")
        rows = []
        while not c.take("}"):
            if not single:
                c.need("(")
            row = tuple(None if c.take("UNDEF") else c.term() for _ in names)
            if not single:
                c.need(")")
            rows.append(row)
        return "values", names, rows

    def node(self):
        if self.c.take("["):
            self.c.need("]")
            self.blanks += 1
            return Var(f"_anon{self.blanks}")
        t = self.c.term()
        return Var("_b_" + t[2:]) if isinstance(t, str) and t.startswith("_:") else t

    def same_subject(self, graph) -> list:
        c, out, s = self.c, [], self.node()
        while True:
            arms = self.path()
            while True:
                o = self.node()
                out += self.steps(s, arms, o, graph)
                if not c.take(","):
                    break
            if not c.take(";"):
                return out
            while c.take(";"):
                pass
            if c.text in (".", "}"):
                return out

    def path(self) -> list[tuple]:
        """A sequence of (steps or a variable, how often, whether any but these)."""
        out = [self.element()]
        while self.c.take("/"):
            out.append(self.element())
        return out

    def element(self) -> tuple:
        c = self.c
        if c.kind == "var":
            return c.term(), "", False
        other = bool(c.take("!"))
        steps = self.alternatives() if c.take("(") else [self.step()]
        if c.text == "|" and not other:  # p|q without brackets
            while c.take("|"):
                steps += self.alternatives() if c.take("(") else [self.step()]
        kind = "" if other else c.take("+", "*", "?") or ""
        if c.text == "|":
            raise UnsupportedQuery("alternatives of repeated steps; write UNION")
        return tuple(steps), kind, other

    def alternatives(self) -> list[tuple[str, bool]]:
        out = [self.step()]
        while self.c.take("|"):
            out.append(self.step())
        if self.c.text in ("/", "+", "*", "?"):
            raise UnsupportedQuery("this property path")
        self.c.need(")")
        return out

    def step(self) -> tuple[str, bool]:
        back = bool(self.c.take("^"))
        p = self.c.term()
        if isinstance(p, Var) or not p.startswith("<"):
            raise RdfSyntaxError(f"a predicate expected, not {p}")
        return p, back

    def steps(self, s, arms, o, graph) -> list:
        out = []
        for i, (taken, kind, other) in enumerate(arms):
            if i + 1 < len(arms):
                self.blanks += 1
                end = Var(f"_step{self.blanks}")
            else:
                end = o
            if isinstance(taken, Var):
                out.append(Pattern(s, taken, end, graph))
            elif len(taken) == 1 and not kind and not other:
                (p, back), = taken
                out.append(Pattern(end, p, s, graph) if back else Pattern(s, p, end, graph))
            else:
                out.append(Path(s, taken, end, kind, other))
            s = end
        return out

    def expression(self):
        left = self.conjunction()
        while self.c.take("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.c.take("&&"):
            left = ("and", left, self.comparison())
        return left

    def comparison(self):
        c, left = self.c, self.sum()
        if op := c.take("=", "!=", "<", ">", "<=", ">="):
            return ("cmp", op, left, self.sum())
        negated = bool(c.take("NOT"))
        if c.take("IN"):
            c.need("(")
            found = []
            while not c.take(")"):
                found.append(self.expression())
                c.take(",")
            expr = ("in", left, found)
            return ("not", expr) if negated else expr
        return left

    def sum(self):
        c, left = self.c, self.product()
        while True:
            if op := c.take("+", "-"):
                left = ("arith", op, left, self.product())
            elif c.kind == "number" and c.text[0] in "+-":  # 1 -2 is read as a signed number
                left = ("arith", "+", left, self.product())
            else:
                return left

    def product(self):
        left = self.unary()
        while op := self.c.take("*", "/"):
            left = ("arith", op, left, self.unary())
        return left

    def unary(self):
        if self.c.take("!"):
            return ("not", self.unary())
        if self.c.take("-"):
            return ("arith", "-", ("term", '"0"^^<http://www.w3.org/2001/XMLSchema#integer>'), self.unary())
        return self.primary()

    def primary(self):
        c = self.c
        if c.text == "(":
            return self.bracketed()
        word = c.text.upper()
        if c.kind == "word" and word in AGGREGATES:
            c.next()
            c.need("(")
            distinct = bool(c.take("DISTINCT"))
            arg = None if c.take("*") else self.expression()
            separator = " "
            if c.take(";"):
                c.need("SEPARATOR")
                c.need("=")
                separator = c.term()[1:-1]
            c.need(")")
            return ("agg", word, arg, distinct, separator)
        if c.kind == "word" and word in BUILTINS:
            c.next()
            c.need("(")
            args = []
            while not c.take(")"):
                args.append(self.expression())
                c.take(",")
            return ("call", word, args)
        if c.kind == "word" and word not in ("TRUE", "FALSE"):
            raise UnsupportedQuery(f"function {c.text}")
        t = c.term()
        return ("var", t.name) if isinstance(t, Var) else ("term", t)


def parse_query(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return _Parser(text, prefixes).query()
