"""Graph: facts and rules in one place, with the verbs of a reasoner."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.operators import goal as goals
from tidegraph.operators import maintain
from tidegraph.operators.fixpoint import SPO, infer
from tidegraph.operators.patterns import Source, scan
from tidegraph.plans.compiler import select
from tidegraph.sources.n3 import parse_rules
from tidegraph.sources.rdf import facts, parse_lines, read_rdf, statements
from tidegraph.terms import QUAD, Pattern, Rule


class Graph:
    """Given quads, rules, and what materialize() inferred.  Sets: a quad counts once."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, rules: str | Iterable[Rule] = ()):
        self.spark = spark
        self.quads = quads if quads is not None else spark.createDataFrame([], QUAD)
        if "g" not in self.quads.columns:
            self.quads = self.quads.selectExpr("s", "p", "o", "cast(null as string) g")
        self.inferred = spark.createDataFrame([], QUAD).select(*SPO)
        self.rules: list[Rule] = []
        self.add_rules(rules)

    @classmethod
    def of_lines(cls, spark: SparkSession, text: str) -> Graph:
        """A graph of facts and rules in the short line format."""
        rows, rules = parse_lines(text)
        return cls(spark, spark.createDataFrame(rows, QUAD).distinct(), rules)

    def load(self, text: str, syntax: str = "ntriples") -> Graph:
        return self.add(facts(self.spark, text, syntax))

    def read(self, path: str, syntax: str = "ntriples") -> Graph:
        return self.add(read_rdf(self.spark, path, syntax))

    def add(self, quads: DataFrame) -> Graph:
        """Add facts; nothing is inferred until materialize() or insert()."""
        quads = quads if "g" in quads.columns else quads.selectExpr("s", "p", "o", "cast(null as string) g")
        self.quads = scratch.cut(self.quads.unionByName(quads.select("s", "p", "o", "g")).distinct(), "quads")
        return self

    def add_rules(self, rules: str | Iterable[Rule]) -> Graph:
        self.rules += parse_rules(rules) if isinstance(rules, str) else list(rules)
        return self

    def insert(self, new: DataFrame) -> Graph:
        """Add facts and what they bring about."""
        _, self.inferred = maintain.insert(self.quads, self.inferred, new, self.rules)
        self.inferred = scratch.cut(self.inferred, "inferred")
        return self.add(new)

    def remove(self, gone: DataFrame) -> Graph:
        """Remove facts from all graphs, and what only they supported."""
        left, inferred = maintain.delete(self.quads, self.inferred, gone, self.rules)
        self.inferred = scratch.cut(inferred, "inferred")
        self.quads = scratch.cut(self.quads.join(left, SPO, "left_semi"), "quads")
        return self

    def materialize(self) -> DataFrame:
        """The inferred facts, which from now on are part of the graph."""
        self.inferred = infer(self.quads, self.rules)
        return self.inferred

    def facts(self) -> DataFrame:
        return self.quads.select(*SPO).distinct().unionByName(self.inferred)

    def all_quads(self) -> DataFrame:
        return self.quads.unionByName(self.inferred.selectExpr("s", "p", "o", "cast(null as string) g"))

    def query(self, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
        return select(self.spark, Source(self.all_quads()), text, prefixes)

    def answers(self, goal: Pattern, flatten: bool = True) -> DataFrame:
        """Goal-directed: only rules that matter to the goal are run, nothing is kept."""
        return goals.answers(self.quads, self.rules, goal, flatten)

    def contains(self, s: str, p: str, o: str) -> bool:
        return not self.facts().filter((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)).isEmpty()

    def get(self, pattern: Pattern) -> DataFrame:
        """The bindings of a pattern, given facts and inferred ones together."""
        return scan(self.all_quads(), pattern).distinct()

    def clear(self) -> Graph:
        """Forget all facts, given and inferred; rules stay."""
        self.quads = self.spark.createDataFrame([], QUAD)
        self.inferred = self.quads.select(*SPO)
        return self

    def __len__(self) -> int:
        return self.facts().count()

    def dump(self) -> DataFrame:
        return statements(self.all_quads())
