"""Triple patterns and their joins as DataFrames: one string column for each variable.

A Source may hold window content beside static facts: keyed facts carry the column KEY (the firing they belong to), static
ones hold for every key.  A conjunction takes each pattern from either side in turn, joined on KEY where both have it, so
static facts are never copied per window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.terms import Pattern, Term, Var

KEY = "fire"
PLACES = ("s", "p", "o", "g")


@dataclass
class Source:
    """Facts: static (s, p, o[, g]), keyed (KEY, s, p, o) and the keys there are; keyed and keys are None outside windows.

    apart: keyed facts are a set for each key and none of them is static, so solutions come once.
    """

    static: DataFrame
    keyed: DataFrame | None = None
    keys: DataFrame | None = None
    apart: bool = False


def scan(facts: DataFrame, pattern: Pattern, keep: tuple[str, ...] = ()) -> DataFrame:
    """The variables of the facts that fit, and the columns of keep.  Constants become filters on the scan; a variable used twice must be equal; a pattern without variables gives one row without columns if it holds.

    A graph place None means the union of graphs: equal facts of several graphs count once.
    """
    used: dict[str, str] = {}
    terms: list[tuple[str, Term | None]] = [("s", pattern.s), ("p", pattern.p), ("o", pattern.o), ("g", pattern.g)]
    for place, term in terms:
        if isinstance(term, Var):
            if term.name in used:
                facts = facts.filter(F.col(place) == F.col(used[term.name]))
            else:
                used[term.name] = place
                if place == "g":
                    facts = facts.filter(F.col("g").isNotNull())
        elif term is not None:
            facts = facts.filter(F.col(place) == term)
    if not used and not keep:
        return facts.limit(1).select()
    out = facts.select(*keep, *(F.col(place).alias(v) for v, place in used.items()))
    constant = all(not isinstance(t, Var) for t in (pattern.s, pattern.p, pattern.o))
    return out.distinct() if "g" in facts.columns and pattern.g is None or constant else out


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if shared:
        return left.join(right, shared)
    return left.crossJoin(right)


def ordered(patterns: list[Pattern], first: int | None = None) -> list[int]:
    """A join order that stays connected and starts with the pattern with most constants (or with first)."""
    left, bound, out = set(range(len(patterns))), set(), []
    while left:
        def rank(i):
            v = set(patterns[i].variables())
            return (i != first if not out and first is not None else False, bool(bound) and bool(v) and not v & bound, len(v - bound), i)

        best = min(left, key=rank)
        out.append(best)
        bound |= set(patterns[best].variables())
        left.discard(best)
    return out


def join_all(scans: list[DataFrame], order: list[int]) -> DataFrame:
    out = scans[order[0]]
    for i in order[1:]:
        out = natural_join(out, scans[i])
    return out


def absorbed(scans: list[DataFrame], patterns: list[Pattern], order: list[int]) -> tuple[list[DataFrame], list[int]]:
    """scans and order after joining each pattern whose variables an earlier or later one has all of to that one, so it narrows it before others multiply it."""
    scans, left = list(scans), list(order)
    for i in order:
        for j in [x for x in left if x != i and i in left]:
            own = set(patterns[j].variables())
            if own and own <= set(patterns[i].variables()):
                scans[i] = natural_join(scans[i], scans[j])
                left.remove(j)
    return scans, left


def either(now: DataFrame, keyed: DataFrame, static: DataFrame, atoms: int) -> DataFrame:
    """Keyed solutions joined to the next pattern, from either side.  Both joins read ``now``, so beyond three patterns it is written first and the plan stays as long as the conjunction."""
    if atoms > 3:
        now = scratch.cut(now, "solutions")
    out = natural_join(now, keyed)
    return out.unionByName(natural_join(now, static).select(*out.columns))


def match(source: Source, patterns: list[Pattern]) -> DataFrame:
    """The solutions of a conjunction; with KEY if the source has keys."""
    order = ordered(patterns)
    static = join_all([scan(source.static, p) for p in patterns], order)
    if source.keyed is None:
        return static
    keyed = [scan(source.keyed, p, (KEY,)) for p in patterns]
    plain = [scan(source.static, p) for p in patterns]
    now, still = keyed[order[0]], plain[order[0]]
    for i in order[1:]:
        out = either(now, keyed[i], plain[i], len(patterns))
        now = out.unionByName(natural_join(still, keyed[i]).select(*out.columns))
        still = natural_join(still, plain[i])
    out = natural_join(source.keys, static)
    out = out.unionByName(now.select(*out.columns))
    return out if source.apart and set(source.static.columns) == {"s", "p", "o"} else out.distinct()
