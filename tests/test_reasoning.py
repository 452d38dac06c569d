import random

import pytest

from tidegraph.graph import Graph
from tidegraph.operators import goal as goals
from tidegraph.operators import maintain
from tidegraph.operators.fixpoint import advance, infer, infer_expiring
from tidegraph.sources.n3 import parse_rules
from tidegraph.sources.rdf import facts
from tidegraph.terms import FACT, Pattern, Var

IN = "{?a <u:in> ?b. ?b <u:in> ?c} => {?a <u:in> ?c}."


def frame(spark, rows):
    return spark.createDataFrame([tuple(f"<u:{x}>" for x in r) for r in rows], FACT)


def closure(rows, rules):
    """Naive evaluation in Python."""
    known = {tuple(f"<u:{x}>" for x in r) for r in rows}
    while True:
        new = set()
        for rule in rules:
            found = [{}]
            for atom in rule.body:
                step = []
                for b in found:
                    for f in known:
                        c, ok = dict(b), True
                        for t, v in zip((atom.s, atom.p, atom.o), f, strict=True):
                            ok = ok and (c.setdefault(t.name, v) == v if isinstance(t, Var) else t == v)
                        if ok:
                            step.append(c)
                found = step
            new |= {tuple(b[t.name] if isinstance(t, Var) else t for t in (rule.head.s, rule.head.p, rule.head.o)) for b in found}
        if new <= known:
            return known
        known |= new


RULES = IN + "{?x <u:is> <u:A>} => {?x <u:is> <u:B>}. {?x <u:is> <u:B>} => {?x <u:is> <u:C>}. {?x <u:is> <u:C>. ?x <u:in> ?y} => {?y <u:is> <u:A>}. {?x <u:in> ?x} => {?x <u:is> <u:Loop>}."


@pytest.mark.parametrize("seed", [1, 2])
def test_fixpoint_goal_and_deletion_are_naive(spark, seed):
    r = random.Random(seed)
    rows = sorted({(f"n{r.randrange(7)}", "in", f"n{r.randrange(7)}") for _ in range(7)} | {(f"n{r.randrange(7)}", "is", r.choice("ABC")) for _ in range(2)})
    rules, base = parse_rules(RULES), frame(spark, rows)
    inferred = infer(base, rules)
    want = closure(rows, rules)
    got = [tuple(x) for x in inferred.collect()]
    assert len(got) == len(set(got)) and set(got) == want - {tuple(f"<u:{x}>" for x in row) for row in rows}
    for target in ("A", "C", "Loop"):
        goal = Pattern(Var("x"), "<u:is>", f"<u:{target}>")
        for flat in (True, False):
            assert {x.x for x in goals.answers(base, rules, goal, flat).collect()} == {s for s, p, o in want if p == "<u:is>" and o == goal.o}
    gone = rows[:2]
    left, more = maintain.delete(base, inferred, frame(spark, gone), rules)
    assert {tuple(x) for x in left.unionByName(more).collect()} == closure(rows[2:], rules)
    left, more = maintain.insert(left, more, frame(spark, gone), rules)
    assert {tuple(x) for x in left.unionByName(more).collect()} == want


def test_sound_where_a_join_is_empty(spark):
    base = frame(spark, [("o2", "a", "B"), ("x", "in", "o1"), ("x", "a", "A")])
    assert infer(base, parse_rules("{?x <u:a> <u:A>. ?x <u:in> ?o. ?o <u:a> <u:B>} => {?x <u:a> <u:C>}.")).count() == 0


def test_ground_rules_and_no_rules(spark):
    base = frame(spark, [("a", "in", "b")])
    assert infer(base, parse_rules("{<u:a> <u:in> <u:b>} => {<u:a> <u:in> <u:c>}.")).count() == 1
    assert infer(base, []).count() == 0
    assert infer(base.limit(0), parse_rules(IN)).count() == 0


def test_hierarchy_goal_takes_one_step():
    rules = parse_rules("".join(f"{{?x <u:is> <u:{i}>}} => {{?x <u:is> <u:{i + 1}>}}." for i in range(10)))
    flat = goals.flattened(rules, Pattern(Var("x"), "<u:is>", "<u:10>"))
    assert len(flat) == 10 and all(r.head.o == "<u:10>" for r in flat)


def test_bound_goals_derive_only_what_they_ask_for(spark):
    rows = [(f"a{i}", "in", f"a{i + 1}") for i in range(12)] + [(f"z{i}", "in", f"z{i + 1}") for i in range(12)]
    rules, base = parse_rules(IN), frame(spark, rows)
    goal = Pattern(Var("x"), "<u:in>", "<u:a3>")
    more, seeds = goals.seeded(goals.relevant(rules, goal), goal)
    derived = infer(base.unionByName(spark.createDataFrame(seeds, FACT)), more).collect()
    assert derived and all("z" not in r.s + r.o for r in derived) and not any(r.o == "<u:a9>" for r in derived)
    assert {r.x for r in goals.answers(base, rules, goal).collect()} == {f"<u:a{i}>" for i in range(3)}
    assert {r.x for r in goals.answers(base, rules, Pattern("<u:z9>", "<u:in>", Var("x"))).collect()} == {f"<u:z{i}>" for i in (10, 11, 12)}
    assert goals.answers(base, rules, Pattern("<u:a0>", "<u:in>", "<u:a9>")).count() == 1
    assert goals.answers(base, rules, Pattern("<u:a0>", "<u:in>", "<u:z9>")).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_bound_goals_are_naive(spark, seed):
    r = random.Random(seed)
    rows = sorted({(f"n{r.randrange(6)}", r.choice(["in", "by"]), f"n{r.randrange(6)}") for _ in range(9)} | {(f"n{r.randrange(6)}", "is", r.choice("ABC")) for _ in range(2)})
    rules = parse_rules(RULES + "{?x <u:by> ?y. ?y <u:in> ?z. ?z <u:is> <u:A>} => {?z <u:by> ?x}. {?x <u:by> ?y} => {?y <u:knows> ?y}.")
    want, base = closure(rows, rules), frame(spark, rows)
    for p, place in (("by", "s"), ("by", "o"), ("in", "o"), ("knows", "s"), ("is", "s")):
        goal = Pattern("<u:n1>", f"<u:{p}>", Var("v")) if place == "s" else Pattern(Var("v"), f"<u:{p}>", "<u:n1>")
        found = {x.v for x in goals.answers(base, rules, goal, False).collect()}
        assert found == {(o if place == "s" else s) for s, q, o in want if q == f"<u:{p}>" and (s if place == "s" else o) == "<u:n1>"}, (p, place)


def test_time_comes_on(spark):
    quad = lambda rows: spark.createDataFrame([(f"<u:{s}>", "<u:in>", f"<u:{o}>", e) for s, o, e in rows], FACT + ", exp bigint")
    first, second, rules = [("a", "b", 5), ("b", "c", 9), ("c", "d", None)], [("d", "e", 12), ("a", "b", 11)], parse_rules(IN)
    held = infer_expiring(quad(first), rules)
    for now in (3, 5, 9):
        got = sorted(map(str, advance(held, quad(second), now, rules).collect()))
        alive = [r for r in first if r[2] is None or r[2] > now]
        assert got == sorted(map(str, infer_expiring(quad(alive + second), rules).collect())), now
        assert sorted(map(str, advance(held, quad([]), now, rules).collect())) == sorted(map(str, infer_expiring(quad(alive), rules).collect()))


def test_deletion_puts_back_what_else_holds(spark):
    rows = [("ann", "leads", "tea"), ("bob", "leads", "tea"), ("ann", "leads", "tar"), ("tea", "part", "top")]
    rules = parse_rules("{?x <u:leads> ?t} => {?t <u:is> <u:Led>}. {?t <u:is> <u:Led>. ?t <u:part> ?u} => {?u <u:is> <u:Led>}. {?u <u:is> <u:Led>. ?u <u:part> ?u} => {?u <u:is> <u:Loop>}.")
    base = frame(spark, rows)
    left, more = maintain.delete(base, infer(base, rules), frame(spark, rows[:1]), rules)
    assert {tuple(x) for x in left.unionByName(more).collect()} == closure(rows[1:], rules)
    left, more = maintain.delete(left, more, frame(spark, rows[1:2]), rules)
    assert {tuple(x) for x in left.unionByName(more).collect()} == closure(rows[2:], rules)


def test_expiry_is_longest_derivation_of_first_to_expire(spark):
    rows = [("a", "in", "b", 5), ("b", "in", "c", 9), ("a", "in", "c", 3), ("c", "in", "d", None)]
    df = spark.createDataFrame([(f"<u:{s}>", f"<u:{p}>", f"<u:{o}>", e) for s, p, o, e in rows], FACT + ", exp bigint")
    got = {(r.s[3:-1], r.o[3:-1]): r.exp for r in infer_expiring(df, parse_rules(IN)).collect()}
    assert got == {("a", "b"): 5, ("b", "c"): 9, ("a", "c"): 5, ("c", "d"): None, ("b", "d"): 9, ("a", "d"): 5}


def test_graph(spark):
    g = Graph(spark, rules=IN).load("<u:a> <u:in> <u:b> . <u:b> <u:in> <u:c> .")
    assert len(g) == 2 and g.materialize().count() == 1 and len(g) == 3
    assert g.contains("<u:a>", "<u:in>", "<u:c>")
    g.insert(facts(spark, "<u:c> <u:in> <u:d> ."))
    assert len(g) == 6
    g.remove(facts(spark, "<u:b> <u:in> <u:c> ."))
    assert len(g) == 2 and not g.contains("<u:a>", "<u:in>", "<u:c>")
    assert sorted(r.value for r in g.dump().collect()) == ["<u:a> <u:in> <u:b> .", "<u:c> <u:in> <u:d> ."]


def _walks(pairs):
    """Pairs linked in two steps or more but not in one."""
    after, out = {}, set()
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for a in after:
        seen, todo = set(), [*after[a]]
        while todo:
            for n in after.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out |= {(a, n) for n in seen - after[a]}
    return out


def test_transitive_rules_are_closed_apart(spark):
    """Rounds used to derive a pair once for each node between its ends; cycles, loops and several paths must still end and count once."""
    from tidegraph.operators.fixpoint import closed_in_keys, doubled, infer, transitive

    rules = parse_rules("{?y <p> ?z. ?x <p> ?y} => {?x <p> ?z}. {?a <p> ?b} => {?a <q> ?b}.")
    assert [transitive(r) for r in rules] == ["<p>", None]
    r = random.Random(5)
    for n, m in ((12, 9), (12, 30), (40, 45)):
        pairs = {(f"<{r.randrange(n)}>", f"<{r.randrange(n)}>") for _ in range(m)} | {(f"<c{i}>", f"<c{i + 1}>") for i in range(20)}
        edges = spark.createDataFrame(sorted(pairs), "s string, o string")
        more = _walks(pairs)
        assert sorted(map(tuple, doubled(edges).collect())) == sorted(more)
        keyed = spark.createDataFrame([(k, a, b) for k in (3, 4) for i, (a, b) in enumerate(sorted(pairs)) if k == 3 or i % 2], "fire bigint, s string, o string")
        want = sorted([(3, *x) for x in more] + [(4, *x) for x in _walks(sorted(pairs)[1::2])])
        assert sorted(map(tuple, closed_in_keys(keyed).collect())) == want
        base = edges.selectExpr("s", "'<p>' p", "o")
        assert {tuple(x) for x in infer(base, rules).collect()} == {(a, "<p>", b) for a, b in more} | {(a, "<q>", b) for a, b in more | pairs}


def test_first_round_derives_once(spark):
    """A body's solutions used to be made once for each of its atoms, then made distinct and sought among the facts."""
    from tidegraph.operators.fixpoint import infer

    rules = parse_rules('{?a <n> ?x. ?b <n> ?x. ?a <m> "B". ?b <m> "M"} => {?a <near> ?b}.')
    rows = [(f"<{i}>", "<n>", f"<n{j}>") for i in range(8) for j in range(3) if (i + j) % 3 or i == 5] + [(f"<{i}>", "<m>", '"B"' if i % 2 else '"M"') for i in range(8)]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    at = {i: {o for s, p, o in rows if s == f"<{i}>" and p == "<n>"} for i in range(8)}
    want = sorted((f"<{a}>", "<near>", f"<{b}>") for a in range(1, 8, 2) for b in range(0, 8, 2) if at[a] & at[b])
    assert sorted(map(tuple, infer(df, rules, write=False).collect())) == want
    one = df.filter("p != '<n>' or o = '<n1>'")
    found = infer(one, rules, write=False)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == len([0 for a in range(1, 8, 2) for b in range(0, 8, 2) if "<n1>" in at[a] & at[b]])


def test_goal_on_a_transitive_rule_sends_little_to_the_driver(spark, monkeypatch):
    """Tables with small files used to be broadcast whatever their number of rows."""
    from tidegraph.operators import fixpoint, goal
    from tidegraph.terms import Pattern, Var

    monkeypatch.setattr(fixpoint, "WIDE_ROWS", 10)
    rules = parse_rules("{?a <up> ?b. ?b <up> ?c} => {?a <up> ?c}.")
    df = spark.createDataFrame([(f"<{i}>", "<up>", f"<{i // 2}>") for i in range(1, 200)], "s string, p string, o string")
    monkeypatch.setattr(goal, "seeded", None)
    got = {x.a for x in goal.answers(df, rules, Pattern(Var("a"), "<up>", "<3>")).collect()}
    under = lambda i: i > 3 and (i // 2 == 3 or under(i // 2))
    assert got == {f"<{i}>" for i in range(200) if under(i)}
    plain = fixpoint.spread(df, 11).join(df.withColumnRenamed("o", "x"), "s")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plain
