"""Goal-directed answers: rules that can't matter to a goal go, and chains of one-atom rules become single steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.operators.fixpoint import SPO, infer, spread, transitive
from tidegraph.operators.patterns import scan
from tidegraph.terms import Pattern, Rule, Var


def relevant(rules: list[Rule], goal: Pattern) -> list[Rule]:
    """The rules that some derivation of a fact fitting goal may use, in their order."""
    wanted, kept = [goal], set()
    while wanted:
        atom = wanted.pop()
        for i, rule in enumerate(rules):
            if i not in kept and rule.head.may_match(atom):
                kept.add(i)
                wanted += rule.body
    return [rules[i] for i in sorted(kept)]


def _step(rule: Rule) -> tuple[tuple, tuple] | None:
    """(from, to) of a rule {?x p a} => {?x q b} with constant p, a, q, b."""
    if len(rule.body) == 1 and isinstance(rule.head.s, Var) and rule.body[0].s == rule.head.s and not any(isinstance(t, Var) for a in (rule.body[0], rule.head) for t in (a.p, a.o)):
        return (rule.body[0].p, rule.body[0].o), (rule.head.p, rule.head.o)
    return None


def flattened(rules: list[Rule], goal: Pattern) -> list[Rule]:
    """Rules with the same answers to goal in which hierarchy steps lead straight to where they are wanted.

    A step's target is wanted if it fits the goal or an atom of a rule that isn't a step.  Each class below a wanted one gets
    one rule to it, so a hierarchy of any depth takes one round.
    """
    steps, others = [], []
    for rule in relevant(rules, goal):
        (steps if _step(rule) else others).append(rule)
    up: dict[tuple, list[tuple]] = {}
    for rule in steps:
        a, b = _step(rule)
        up.setdefault(b, []).append(a)
    atoms = [goal, *(a for r in others for a in r.body)]
    out = list(others)
    for target in up:
        if not any(Pattern(Var("x"), *target).may_match(a) for a in atoms):
            continue
        below, todo = set(), list(up[target])
        while todo:
            node = todo.pop()
            if node not in below and node != target:
                below.add(node)
                todo += up.get(node, [])
        out += [Rule((Pattern(Var("x"), *b),), Pattern(Var("x"), *target)) for b in sorted(below)]
    return out


def _asked(p: str, place: str) -> str:
    """The predicate of the facts (x, it, x) that say that facts with predicate p and x as subject ('s') or object ('o') are asked for."""
    return f"<urn:tidegraph:asked:{place}:{p.strip('<>')}>"


def seeded(rules: list[Rule], goal: Pattern) -> tuple[list[Rule], list[tuple[str, str, str]]] | None:
    """Rules that only derive what a goal with a constant subject or object asks for, and the facts that start them; None if they can't be made (no such constant, or a predicate that isn't one).

    A rule runs for the heads that are asked for.  Going through its body from what is bound on, each atom that rules can
    derive is asked for with the subject or object that is bound by then; where neither is, it is asked for whole, and
    the rules that derive it are taken as they are.
    """
    if isinstance(goal.p, Var) or any(isinstance(r.head.p, Var) or any(isinstance(a.p, Var) for a in r.body) for r in rules):
        return None
    bound_at = lambda a, known: next((n for n, t in (("s", a.s), ("o", a.o)) if not isinstance(t, Var) or t.name in known), None)
    start = bound_at(goal, set())
    if start is None:
        return None
    derived = {r.head.p for r in rules}
    out, todo, done = [], [(goal.p, start)], set()
    while todo:
        p, place = todo.pop()
        if (p, place) in done:
            continue
        done.add((p, place))
        for rule in (r for r in rules if r.head.p == p):
            if place == "":
                out.append(rule)
                todo += [(a.p, "") for a in rule.body if a.p in derived]
                continue
            end = getattr(rule.head, place)
            guard = Pattern(end, _asked(p, place), end)
            known, left, before = set(guard.variables()), list(rule.body), [guard]
            while left:
                atom = min(left, key=lambda a: (bound_at(a, known) is None, len(set(a.variables()) - known)))
                left.remove(atom)
                if atom.p in derived:
                    at = bound_at(atom, known)
                    todo.append((atom.p, at or ""))
                    if at:
                        asked = getattr(atom, at)
                        head = Pattern(asked, _asked(atom.p, at), asked)
                        if head != guard:
                            out.append(Rule(tuple(before), head))
                before.append(atom)
                known |= set(atom.variables())
            out.append(Rule((guard, *rule.body), rule.head))
    constant = getattr(goal, start)
    return list(dict.fromkeys(out)), [(constant, _asked(goal.p, start), constant)]


def answers(facts: DataFrame, rules: list[Rule], goal: Pattern, flatten: bool = True) -> DataFrame:
    """The goal's variables for every fact, given or entailed, that fits it.  A constant subject or object of the goal is where the rules start, so what it doesn't lead to is never derived."""
    chosen = flattened(rules, goal) if flatten else relevant(rules, goal)
    base = facts.select(*SPO)
    place = next((n for n in ("s", "o") if not isinstance(getattr(goal, n), Var)), None)
    if len(chosen) == 1 and place and transitive(chosen[0]) == goal.p:
        led = reach(base.filter(F.col("p") == goal.p).select("s", "o"), place, getattr(goal, place))
        return scan(base.unionByName(led.select("s", F.lit(goal.p).alias("p"), "o")), goal).distinct()
    started = seeded(chosen, goal) if chosen else None
    if started is None:
        return scan(base.unionByName(infer(base, chosen)), goal).distinct()
    more, seeds = started
    begun = base.unionByName(base.sparkSession.createDataFrame(seeds, base.schema))
    return scan(base.unionByName(infer(begun, more)), goal).distinct()


def closure(pairs: DataFrame) -> DataFrame:
    """s, o of all pairs that steps (s, o) link in one or more."""
    x, y, z, step = Var("x"), Var("y"), Var("z"), "<urn:tidegraph:step>"
    edges = pairs.select("s", F.lit(step).alias("p"), "o")
    return edges.unionByName(infer(edges, [Rule((Pattern(x, step, y), Pattern(y, step, z)), Pattern(x, step, z))])).select("s", "o")


def reach(pairs: DataFrame, place: str, term: str) -> DataFrame:
    """s, o of the pairs with term at place ('s' or 'o') that steps (s, o) link in one or more: each round goes on from the nodes found last."""
    other = "o" if place == "s" else "s"
    spark, folder = pairs.sparkSession, scratch.fresh(pairs.sparkSession, "reached")
    steps, rows = scratch.counted(pairs.select(F.col(place).alias("_from"), F.col(other).alias("node")), scratch.fresh(spark, "steps"))
    steps, rows = spread(steps, rows), 0
    new, found = scratch.counted(steps.filter(F.col("_from") == term).select("node").distinct(), f"{folder}/0")
    paths = [f"{folder}/0"]
    while found:
        rows += found
        known = spread(spark.read.schema("node string").parquet(*paths), rows)
        last = spread(new.withColumnRenamed("node", "_last"), found)
        new, found = scratch.counted(steps.join(last, F.col("_from") == F.col("_last")).select("node").distinct().join(known, "node", "left_anti"), f"{folder}/{len(paths)}")
        paths.append(f"{folder}/{len(paths)}")
    return spark.read.schema("node string").parquet(*paths).select(F.lit(term).alias(place), F.col("node").alias(other)).select("s", "o")
