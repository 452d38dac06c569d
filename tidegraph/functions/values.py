"""SPARQL expressions as Columns.  A variable's column holds terms in N-Triples form; a type error is null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.sources.lexer import unescape
from tidegraph.terms import XSD, UnsupportedQuery, literal

_NUMERIC = rf'^"([^"]*)"\^\^<{XSD}(?:integer|int|long|short|byte|decimal|double|float|nonNegativeInteger|positiveInteger|unsignedInt|unsignedLong)>$'
_INTEGER = rf'^"([^"]*)"\^\^<{XSD}(?:integer|int|long|short|byte|nonNegativeInteger|positiveInteger|unsignedInt|unsignedLong)>$'
_LITERAL = r'(?s)^"(.*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9\-]+))?$'


def number(term: Column) -> Column:
    """A numeric literal's value as double, else null."""
    return F.regexp_extract(term, _NUMERIC, 1).try_cast("double")


def whole(term: Column) -> Column:
    """An integer literal's value as bigint, else null."""
    return F.regexp_extract(term, _INTEGER, 1).try_cast("bigint")


def text(term: Column) -> Column:
    """What STR() gives, without the escapes that direct mapping and the parsers write."""
    out = F.when(term.startswith("<"), F.substring(term, 2, 1 << 30).substr(F.lit(1), F.char_length(term) - 2)).when(term.startswith('"'), F.regexp_extract(term, _LITERAL, 1))
    for coded, raw in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        out = F.replace(out, F.lit(coded), F.lit(raw))
    return out


def plain(value: Column) -> Column:
    for raw, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(raw), F.lit(coded))
    return F.concat(F.lit('"'), value, F.lit('"'))


def tagged(value: Column, name: str) -> Column:
    return F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{XSD}{name}>'))


@dataclass
class Value:
    """A column of kind 'term', 'int', 'num', 'str' or 'bool', and views of it as the others."""

    column: Column
    kind: str

    def num(self) -> Column:
        return {"term": lambda: number(self.column), "int": lambda: self.column.cast("double"), "num": lambda: self.column}.get(self.kind, lambda: F.lit(None).cast("double"))()

    def int(self) -> Column:
        return whole(self.column) if self.kind == "term" else self.column if self.kind == "int" else F.lit(None).cast("bigint")

    def str(self) -> Column:
        return text(self.column) if self.kind == "term" else self.column.cast("string")

    def bool(self) -> Column:
        if self.kind == "bool":
            return self.column
        if self.kind in ("int", "num"):
            return self.column != 0
        if self.kind == "str":
            return self.column != ""
        literal_true = F.when(self.column.endswith(f"^^<{XSD}boolean>"), self.column.startswith('"true"') | self.column.startswith('"1"'))
        return F.coalesce(literal_true, number(self.column) != 0, F.when(self.column.startswith('"') & ~self.column.contains('"^^<'), text(self.column) != ""))

    def term(self) -> Column:
        return {"term": lambda: self.column, "int": lambda: tagged(self.column, "integer"), "num": lambda: tagged(self.column, "double"), "str": lambda: plain(self.column), "bool": lambda: tagged(self.column, "boolean")}[self.kind]()


def _compare(op: str, a: Value, b: Value) -> Column:
    run = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if a.kind == b.kind == "bool":
        return run(a.column, b.column)
    exact = run(a.int(), b.int()) if a.kind in ("int", "term") and b.kind in ("int", "term") else F.lit(None).cast("boolean")
    numbers = F.coalesce(exact, run(a.num(), b.num()))
    if a.kind in ("int", "num") or b.kind in ("int", "num"):
        return numbers
    if op in ("=", "!="):
        return F.coalesce(numbers, run(a.term(), b.term()))
    kind = lambda v: F.regexp_extract(v.term(), _LITERAL, 2)
    words = F.when(a.term().startswith('"') & b.term().startswith('"') & (kind(a) == kind(b)) & a.num().isNull(), run(a.str(), b.str()))
    return F.coalesce(numbers, words)


def evaluate(expr: tuple, names: dict[str, Column]) -> Value:
    """expr over the columns of names; a variable that isn't there is unbound."""
    head = expr[0]
    go = lambda e: evaluate(e, names)
    if head == "var":
        return Value(names.get(expr[1], F.lit(None).cast("string")), "term")
    if head == "value":
        return expr[1]
    if head == "term":
        return Value(F.lit(expr[1]), "term")
    if head in ("and", "or"):
        a, b = go(expr[1]).bool(), go(expr[2]).bool()
        return Value(a & b if head == "and" else a | b, "bool")
    if head == "not":
        return Value(~go(expr[1]).bool(), "bool")
    if head == "cmp":
        return Value(_compare(expr[1], go(expr[2]), go(expr[3])), "bool")
    if head == "in":
        out = F.lit(False)
        for e in expr[2]:
            out = out | _compare("=", go(expr[1]), go(e))
        return Value(out, "bool")
    if head == "arith":
        op, a, b = expr[1], go(expr[2]), go(expr[3])
        if op == "/":
            return Value(F.try_divide(a.num(), b.num()), "num")
        run = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        whole_ = run(a.int(), b.int())
        if a.kind in ("int", "term") and b.kind in ("int", "term"):
            return Value(F.coalesce(tagged(whole_, "integer"), tagged(run(a.num(), b.num()), "double")), "term")
        return Value(run(a.num(), b.num()), "num")
    if head == "call":
        return _call(expr[1], expr[2], names)
    raise UnsupportedQuery(f"{head} here")


def _call(name: str, args: list[tuple], names: dict[str, Column]) -> Value:
    v = [evaluate(a, names) for a in args]
    if name == "BOUND":
        return Value(v[0].column.isNotNull(), "bool")
    if name == "IF":
        return Value(F.when(v[0].bool(), v[1].term()).when(~v[0].bool(), v[2].term()), "term")
    if name == "COALESCE":
        return Value(F.coalesce(*(x.term() for x in v)), "term")
    if name == "SAMETERM":
        return Value(v[0].term() == v[1].term(), "bool")
    if name in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
        return Value(v[0].term().startswith({"ISLITERAL": '"', "ISBLANK": "_:"}.get(name, "<")), "bool")
    if name == "ISNUMERIC":
        return Value(v[0].num().isNotNull(), "bool")
    if name == "LANG":
        return Value(F.when(v[0].term().startswith('"'), F.regexp_extract(v[0].term(), _LITERAL, 3)), "str")
    if name == "DATATYPE":
        kind = F.regexp_extract(v[0].term(), _LITERAL, 2)
        return Value(F.when(v[0].term().startswith('"'), F.concat(F.lit("<"), F.when(kind == "", XSD + "string").otherwise(kind), F.lit(">"))), "term")
    s = [x.str() for x in v]
    strings = {"STR": lambda: s[0], "UCASE": lambda: F.upper(s[0]), "LCASE": lambda: F.lower(s[0]), "CONCAT": lambda: F.concat(*s), "REPLACE": lambda: F.regexp_replace(*s[:3])}
    if name in strings:
        return Value(strings[name](), "str")
    if name == "SUBSTR":
        length = v[2].int() if len(v) > 2 else F.lit(1 << 30)
        return Value(F.substring(s[0], v[1].int().cast("int"), length.cast("int")), "str")
    tests = {"CONTAINS": lambda: s[0].contains(s[1]), "STRSTARTS": lambda: s[0].startswith(s[1]), "STRENDS": lambda: s[0].endswith(s[1]), "REGEX": lambda: F.regexp_like(s[0], s[1] if len(s) < 3 else F.concat(F.lit("(?"), s[2], F.lit(")"), s[1]))}
    if name in tests:
        return Value(tests[name](), "bool")
    if name == "STRLEN":
        return Value(F.char_length(s[0]).cast("bigint"), "int")
    if name in ("YEAR", "MONTH", "DAY"):
        return Value(getattr(F, name.lower() if name != "DAY" else "dayofmonth")(s[0].try_cast("timestamp")).cast("bigint"), "int")
    run = {"ABS": F.abs, "ROUND": lambda x: F.floor(x + 0.5), "CEIL": F.ceil, "FLOOR": F.floor}[name]
    kept = F.when(v[0].int().isNotNull(), tagged(F.abs(v[0].int()) if name == "ABS" else v[0].int(), "integer"))
    return Value(F.coalesce(kept, tagged(run(v[0].num()).cast("double"), "double")), "term")


def aggregate(name: str, value: Value | None, distinct: bool, separator: str) -> Column:
    """An aggregate's term.  Non-numbers are left out of SUM and AVG; MIN and MAX compare numbers before other terms."""
    if name == "COUNT":
        return tagged(F.count("*") if value is None else F.count_distinct(value.term()) if distinct else F.count(value.term()), "integer")
    if name in ("SUM", "AVG"):
        total = F.sum_distinct if distinct else F.sum
        if name == "AVG":
            mean = F.sum_distinct(value.num()) / F.count_distinct(value.num()) if distinct else F.avg(value.num())
            return F.coalesce(tagged(mean, "double"), F.lit(literal("0", XSD + "integer")))
        return F.when(F.count(value.int()) == F.count(value.num()), tagged(F.coalesce(total(value.int()), F.lit(0)), "integer")).otherwise(tagged(total(value.num()), "double"))
    if name in ("MIN", "MAX"):
        pick = F.min if name == "MIN" else F.max
        extreme = F.min_by if name == "MIN" else F.max_by
        return F.coalesce(extreme(value.term(), value.num()), pick(value.term()))
    if name == "SAMPLE":
        return F.min(value.term())
    gathered = F.collect_set(value.str()) if distinct else F.collect_list(value.str())
    return plain(F.array_join(F.array_sort(gathered), unescape(separator)))
