"""Materializations kept up to date: insertion by semi-naive rounds, deletion by over-deleting and deriving again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tidegraph import scratch
from tidegraph.operators.fixpoint import SPO, _fed, _head, derive, infer
from tidegraph.operators.patterns import join_all, ordered, scan
from tidegraph.terms import Rule


def insert(base: DataFrame, inferred: DataFrame, new: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(base, inferred) after adding new facts: only what they bring about is computed."""
    closed = scratch.cut(base.select(*SPO).unionByName(inferred.select(*SPO)).distinct(), "closed")
    delta = scratch.cut(new.select(*SPO).distinct().join(closed, SPO, "left_anti"), "new")
    more = infer(closed.unionByName(delta), rules, delta)
    return base.select(*SPO).unionByName(new.select(*SPO)).distinct(), inferred.select(*SPO).unionByName(more)


def _again(rules: list[Rule], rest: DataFrame, over: DataFrame) -> DataFrame | None:
    """What of over the rules derive from rest: each rule starts from the facts of over that its head fits, and its body is joined to those."""
    parts = []
    for rule in rules:
        atoms = [rule.head, *rule.body]
        joined = join_all([scan(over if i == 0 else rest, a) for i, a in enumerate(atoms)], ordered(atoms, 0))
        parts.append(_head(joined, rule, ()))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def delete(base: DataFrame, inferred: DataFrame, gone: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(base, inferred) after removing facts; given facts other than those stay, whatever else derives them.  inferred is all that the rules infer from base.

    Everything that some derivation through a removed fact supports is taken out, then what other derivations still support
    is put back.  Both start from what the removal touches: each round joins the last round's facts to the rest, and a rule
    is tried again only for heads that were taken out.
    """
    spark = base.sparkSession
    closed = scratch.cut(base.select(*SPO).unionByName(inferred.select(*SPO)).distinct(), "closed")
    left = scratch.cut(base.select(*SPO).join(gone.select(*SPO), SPO, "left_anti").distinct(), "left")
    folder, n = scratch.fresh(spark, "over"), 0
    gather = lambda paths: spark.read.schema(closed.schema).parquet(*paths)
    delta, found = scratch.counted(gone.select(*SPO).distinct().join(closed, SPO, "left_semi"), f"{folder}/0")
    over, changed, active = [f"{folder}/0"], None, list(rules)
    while found and active:
        new = derive(active, closed, delta, changed)
        if new is None:
            break
        n += 1
        delta, found = scratch.counted(new.join(left, SPO, "left_anti").join(gather(over), SPO, "left_anti"), f"{folder}/{n}")
        over.append(f"{folder}/{n}")
        changed = active
        active = _fed(rules, changed)
    taken = gather(over)
    kept = scratch.cut(closed.join(taken, SPO, "left_anti").unionByName(left).distinct(), "rest")
    paths, folder = [], scratch.fresh(spark, "back")
    back = _again(rules, kept, taken)
    rest, changed, active = kept, None, list(rules)
    while back is not None:
        back = back.join(rest, SPO, "left_anti") if not paths else back.join(taken, SPO, "left_semi").join(rest, SPO, "left_anti")
        delta, found = scratch.counted(back, f"{folder}/{len(paths)}")
        if not found:
            break
        paths.append(f"{folder}/{len(paths)}")
        rest = kept.unionByName(gather(paths))
        if changed is not None:
            active = _fed(rules, changed)
        back, changed = derive(active, rest, delta, changed), active
    return left, rest.join(left, SPO, "left_anti")
