"""SPARQL algebra to DataFrames.  Variables are string columns of terms; Catalyst does the rest."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.functions.values import Value, aggregate, evaluate, number
from tidegraph.operators.goal import closure, reach
from tidegraph.operators.patterns import KEY, Source, match, natural_join
from tidegraph.plans.sparql import Group, Path, Query, parse_query
from tidegraph.terms import Pattern, UnsupportedQuery, Var

NODE = "_node"


class Compiler:
    def __init__(self, spark: SparkSession, source: Source):
        self.spark, self.source = spark, source
        self.keyed = source.keyed is not None

    def unit(self) -> DataFrame:
        return self.source.keys if self.keyed else self.spark.range(1).select()

    # a solution is (df, loose): loose variables may be unbound

    def parts(self, left, right, shared: list[str]):
        """Ways in which the shared variables of two solutions can be bound: (rows of left, rows of right with columns _r_, variables that both bind).  Each is an equi-join."""
        (a, la), (b, lb) = left, right
        b = b.select(*(F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in b.columns))
        open_a, open_b = [c for c in shared if c in la], [c for c in shared if c in lb]
        for sides in product((True, False), repeat=len(open_a) + len(open_b)):
            bound_a, bound_b = dict(zip(open_a, sides, strict=False)), dict(zip(open_b, sides[len(open_a):], strict=True))
            rows_a, rows_b = a, b
            for c, there in bound_a.items():
                rows_a = rows_a.filter(F.col(c).isNotNull() if there else F.col(c).isNull())
            for c, there in bound_b.items():
                rows_b = rows_b.filter(F.col(f"_r_{c}").isNotNull() if there else F.col(f"_r_{c}").isNull())
            yield rows_a, rows_b, [c for c in shared if bound_a.get(c, True) and bound_b.get(c, True)]

    @staticmethod
    def meet(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        if on:
            return a.join(b, reduce(Column.__and__, [F.col(c) == F.col(f"_r_{c}") for c in on]), how)
        return a.crossJoin(b) if how == "inner" else a.join(b.limit(1).select(), F.lit(True), how)

    def join(self, left, right, how: str = "inner"):
        (a, la), (b, lb) = left, right
        shared = [c for c in a.columns if c in b.columns]
        rest = [c for c in b.columns if c not in shared]
        loose = la | lb if how == "inner" else la | lb | set(rest)
        if not set(shared) & (la | lb):
            if shared:
                return a.join(b, shared, how), loose
            if how == "left":
                return a.join(b, F.lit(True), "left"), loose
            return natural_join(a, b), loose
        if how == "left":
            return self.optional(left, right, [])
        out = reduce(DataFrame.unionByName, [self.meet(x, y, on).select(*(F.coalesce(c, f"_r_{c}").alias(c) if c in shared else F.col(c) for c in a.columns), *rest) for x, y, on in self.parts(left, right, shared)])
        return out, loose - {c for c in shared if c not in la or c not in lb}

    def path(self, path: Path, fixed: dict[str, str]) -> DataFrame:
        """Pairs that a path links; '*' and '?' hold of every node with itself too.  A path that is repeated is followed from an end that is constant, or that a filter fixes, if there is one, else by the rule engine."""
        if self.keyed:
            raise UnsupportedQuery("property paths over windows")
        facts, forth = self.source.static, [p for p, back in path.steps if not back]
        reverse = [p for p, back in path.steps if back]
        ways = []
        if forth:
            ways.append(facts.filter(~F.col("p").isin(forth) if path.other else F.col("p").isin(forth)).select("s", "o"))
        if reverse:
            ways.append(facts.filter(~F.col("p").isin(reverse) if path.other else F.col("p").isin(reverse)).select(F.col("o").alias("s"), F.col("s").alias("o")))
        pairs = reduce(DataFrame.unionByName, ways)
        ends = {place: t for place, t in (("s", path.s), ("o", path.o)) if not isinstance(t, Var)}
        start = ends | {place: fixed[t.name] for place, t in (("s", path.s), ("o", path.o)) if isinstance(t, Var) and t.name in fixed}
        if path.kind:
            pairs = pairs.distinct()
        if path.kind in ("+", "*"):
            pairs = reach(pairs, *next(iter(start.items()))) if start else closure(pairs)
        if path.kind in ("*", "?"):
            if start:
                nodes = self.spark.createDataFrame([(t,) for t in start.values()], f"{NODE} string")
            else:
                nodes = facts.select(F.explode(F.array("s", "o")).alias(NODE))
            pairs = pairs.unionByName(nodes.select(F.col(NODE).alias("s"), F.col(NODE).alias("o"))).distinct()
        for place, term in ends.items():
            pairs = pairs.filter(F.col(place) == term)
        if isinstance(path.s, Var) and path.s == path.o:
            return pairs.filter("s = o").select(F.col("s").alias(path.s.name))
        names = [F.col(place).alias(t.name) for place, t in (("s", path.s), ("o", path.o)) if isinstance(t, Var)]
        return pairs.select(*names) if names else pairs.limit(1).select()

    def group(self, group: Group):
        now, filters = (self.unit(), set()), []
        started = False
        fixed = {f[2][1]: f[3][1] for f in (i[1] for i in group.items if i[0] == "filter") if f[:2] == ("cmp", "=") and f[2][0] == "var" and f[3][0] == "term" and f[3][1].startswith("<")}
        for kind, *rest in group.items:
            if kind == "bgp":
                patterns = [p for p in rest[0] if isinstance(p, Pattern)]
                part = (match(self.source, patterns), set()) if patterns else (self.unit(), set())
                for p in rest[0]:
                    if isinstance(p, Path):
                        part = self.join(part, (self.path(p, fixed), set()))
                now = self.join(now, part) if started else part
            elif kind == "union":
                arms = [self.group(g) for g in rest[0]]
                names = list(dict.fromkeys(c for a, _ in arms for c in a.columns))
                loose = {c for c in names if any(c not in a.columns or c in lo for a, lo in arms)}
                df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [a for a, _ in arms])
                now = self.join(now, (df, loose)) if started else (df, loose)
            elif kind == "query":
                part = self.solve(rest[0])
                now = self.join(now, part) if started else part
            elif kind == "optional":
                inner = Group([i for i in rest[0].items if i[0] != "filter"])
                conditions = [i[1] for i in rest[0].items if i[0] == "filter"]
                now = self.optional(now, self.group(inner), conditions)
            elif kind == "minus":
                now = self.apart(now, self.group(rest[0]), minus=True)
            elif kind == "exists":
                filters.append(("exists", *rest))
            elif kind == "filter":
                filters.append(("filter", rest[0]))
            elif kind == "bind":
                name, expr = rest
                now = now[0].withColumn(name, evaluate(expr, self.names(now[0])).term()), now[1] | {name}
            elif kind == "values":
                names, rows = rest
                df = self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
                now = self.join(now, (df, {n for i, n in enumerate(names) if any(r[i] is None for r in rows)}))
            started = True
        for f in filters:
            if f[0] == "filter":
                now = now[0].filter(evaluate(f[1], self.names(now[0])).bool()), now[1]
            else:
                now = self.apart(now, self.group(f[1]), minus=False, wanted=f[2])
        return now

    @staticmethod
    def names(df: DataFrame) -> dict[str, Column]:
        return {c: F.col(c) for c in df.columns if c != KEY}

    def optional(self, left, right, conditions):
        (a, la), (_, lb) = left, right
        shared = [c for c in a.columns if c in right[0].columns]
        if not conditions and not set(shared) & (la | lb):
            return self.join(left, right, "left")
        marked = scratch.cut(a.withColumn("_row", F.monotonically_increasing_id()), "optional")  # row numbers must not change between uses
        inner, loose = self.join((marked, la), right)
        for c in conditions:
            inner = inner.filter(evaluate(c, self.names(inner)).bool())
        rest = marked.join(inner.select("_row"), "_row", "left_anti")
        out = inner.unionByName(rest, allowMissingColumns=True).drop("_row")
        return out, loose | la | {c for c in out.columns if c not in a.columns}

    def apart(self, left, right, minus: bool, wanted: bool = False):
        """Rows of left that agree with some row of right (wanted) or with none; for MINUS rows that bind no variable in common don't agree."""
        (a, la), (b, lb) = left, right
        shared = [c for c in a.columns if c in b.columns]
        if not [c for c in shared if c != KEY] and minus:
            return left
        b = b.select(*shared).distinct()
        if not set(shared) & (la | lb):
            (rows, others, on), = self.parts(left, (b, lb), shared)
            return self.meet(rows, others, on, "left_semi" if wanted else "left_anti"), la
        marked = scratch.cut(a.withColumn("_row", F.monotonically_increasing_id()), "apart")
        agree = [self.meet(x, y, on, "left_semi").select("_row") for x, y, on in self.parts((marked, la), (b, lb), shared) if not minus or [c for c in on if c != KEY]]
        if not agree:
            return left
        return marked.join(reduce(DataFrame.unionByName, agree), "_row", "left_semi" if wanted else "left_anti").drop("_row"), la

    def grouped(self, df: DataFrame, q: Query) -> tuple[DataFrame, Query, set[str]]:
        """Groups and aggregates; the query that is left, which refers to their columns; and those columns that are always bound."""
        for name, expr in q.groups:
            if expr is not None:
                df = df.withColumn(name, evaluate(expr, self.names(df)).term())
        keys = [*([KEY] if self.keyed else []), *(n for n, _ in q.groups)]
        found: dict[str, Column] = {}
        sure: set[str] = set()
        names = self.names(df)

        def lift(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                _, name, arg, distinct, separator = e
                column = aggregate(name, None if arg is None else evaluate(arg, names), distinct, separator)
                place = f"_agg{len(found)}"
                found[place] = column
                if name in ("COUNT", "AVG"):
                    sure.add(place)
                return ("var", place)
            if isinstance(e, tuple):
                return tuple(lift(x) for x in e)
            return [lift(x) for x in e] if isinstance(e, list) else e

        columns = [(n, lift(e)) for n, e in q.columns or []]
        having, order = [lift(e) for e in q.having], [(lift(e), up) for e, up in q.order]
        places = [c.alias(n) for n, c in found.items()]
        if places:
            out = df.groupBy(*keys).agg(*places)
        else:
            out = df.select(*keys).distinct()
        for h in having:
            out = out.filter(evaluate(h, self.names(out)).bool())
        return out, Query(columns=columns, distinct=q.distinct, order=order, limit=q.limit, offset=q.offset), sure

    @staticmethod
    def has_aggregate(e) -> bool:
        return isinstance(e, (tuple, list)) and (bool(e) and e[0] == "agg" or any(Compiler.has_aggregate(x) for x in e))

    def run(self, q: Query) -> DataFrame:
        return self.solve(q)[0]

    def solve(self, q: Query):
        """(the result, those of its variables that may be unbound)."""
        keep = [KEY] if self.keyed else []
        if q.form == "DESCRIBE":
            return self.describe(q), set()
        df, loose = self.group(q.where)
        if q.form == "ASK":
            return (df.agg((F.count("*") > 0).alias("answer")) if not self.keyed else df.select(KEY).distinct()), set()
        if q.form == "CONSTRUCT":
            made = []
            for t in q.template:
                column = lambda x: F.col(x.name) if isinstance(x, Var) else F.lit(x)
                made.append(df.select(*keep, column(t.s).alias("s"), column(t.p).alias("p"), column(t.o).alias("o")))
            return reduce(DataFrame.unionByName, made).filter("s is not null and p is not null and o is not null and not startswith(s, '\"')").distinct(), set()
        if q.groups or any(self.has_aggregate(e) for _, e in q.columns or []) or q.having:
            loose = loose | {n for n, e in q.groups if e is not None}
            df, q, sure = self.grouped(df, q)
            loose |= {c for c in df.columns if c.startswith("_agg")} - sure
        for name, expr in q.columns or []:
            if expr is not None:
                df = df.withColumn(name, evaluate(expr, self.names(df)).term())
                if expr[0] != "var" or expr[1] in loose:
                    loose = loose | {name}
        order = []
        for expr, up in q.order:
            v: Value = evaluate(expr, self.names(df))
            order += [c.asc_nulls_first() if up else c.desc_nulls_last() for c in (number(v.term()), v.str())]
        names = [n for n, _ in q.columns] if q.columns is not None else [c for c in df.columns if not c.startswith("_") and c != KEY]
        if self.keyed and (order or q.limit is not None or q.offset):
            raise UnsupportedQuery("ORDER BY, LIMIT and OFFSET over windows")
        if order and not q.distinct:
            df = df.orderBy(*order)
        loose = {n for n in names if n in loose or n not in df.columns}
        df = df.select(*keep, *(F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names))
        if q.distinct:
            df = df.distinct()
            if order:
                ranked = [evaluate(e, self.names(df)) for e, _ in q.order]
                df = df.orderBy(*(c.asc_nulls_first() if up else c.desc_nulls_last() for v, (_, up) in zip(ranked, q.order, strict=True) for c in (number(v.term()), v.str())))
        if q.offset:
            df = df.offset(q.offset)
        return (df if q.limit is None else df.limit(q.limit)), loose

    def describe(self, q: Query) -> DataFrame:
        constants = [e[1] for _, e in q.columns if e is not None]
        named = [n for n, e in q.columns if e is None]
        nodes = [self.spark.createDataFrame([(t,) for t in constants], f"{NODE} string")] if constants else []
        if named:
            df, _ = self.group(q.where)
            nodes += [df.select(F.col(n).alias(NODE)) for n in named]
        wanted = reduce(DataFrame.unionByName, nodes).distinct()
        return self.source.static.join(wanted, F.col("s") == F.col(NODE), "left_semi").select("s", "p", "o").distinct()


def select(spark: SparkSession, source: Source | DataFrame, query: str | Query, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The result of a query: SELECT gives a column of terms for each variable, ASK answer, CONSTRUCT and DESCRIBE s, p, o."""
    parsed = parse_query(query, prefixes) if isinstance(query, str) else query
    return Compiler(spark, source if isinstance(source, Source) else Source(source)).run(parsed)
