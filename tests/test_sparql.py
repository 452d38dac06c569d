import pytest

from tidegraph.operators.patterns import Source
from tidegraph.plans.compiler import select
from tidegraph.sources.rdf import facts
from tidegraph.terms import RdfSyntaxError, UnsupportedQuery

X = "http://www.w3.org/2001/XMLSchema#"
TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
QUADS = f"""<b:heron> {TYPE} <k:Boat> <log:north> .
<b:heron> {TYPE} <k:Ferry> <log:south> .
<b:heron> <q:crew> "3"^^<{X}integer> <log:south> .
<b:teal> {TYPE} <k:Boat> <log:south> .
<b:teal> <q:crew> "12"^^<{X}integer> <log:south> .
<b:wren> <q:crew> "7"^^<{X}integer> <log:north> .
<b:wren> <q:home> "Tromsø"@no .
<b:wren> <q:home> "Tromsø"@no <log:north> .
<b:wren> <q:tows> <b:teal> .
<b:teal> <q:tows> <b:heron> .
<b:heron> <q:escorts> <b:wren> ."""


@pytest.fixture(scope="module")
def ask(spark):
    source = Source(facts(spark, QUADS, "nquads").cache())
    return lambda q: [tuple(r) for r in select(spark, source, q).collect()]


def whole(n):
    return f'"{n}"^^<{X}integer>'


def test_filters(ask):
    for test, n in (("> 3", 2), (">= 3", 3), ("<= 7", 2), ("= 12", 1), ("!= 12", 2), ("> 6.5", 2), ('> "a"', 0)):
        assert len(ask(f"SELECT * {{?s <q:crew> ?o FILTER(?o {test})}}")) == n, test


def test_groups(ask):
    assert sorted(ask("SELECT ?s (COUNT(?t) AS ?n) {?s a ?t} GROUP BY ?s")) == [("<b:heron>", whole(2)), ("<b:teal>", whole(1))]
    assert set(ask("SELECT ?g (SUM(?v) AS ?t) {GRAPH ?g {?s <q:crew> ?v}} GROUP BY ?g")) == {("<log:south>", whole(15)), ("<log:north>", whole(7))}
    assert ask("SELECT (COUNT(*) AS ?n) {?s <q:none> ?v}") == [(whole(0),)]
    assert ask('SELECT (GROUP_CONCAT(?s; SEPARATOR=", ") AS ?all) {?s <q:crew> ?v FILTER(?v < 10)}') == [('"b:heron, b:wren"',)]


def test_graphs(ask):
    assert len(ask("SELECT * {GRAPH <log:south> {?s ?p ?o}}")) == 4
    assert sorted(ask("SELECT ?g {GRAPH ?g {<b:heron> a <k:Boat>}}")) == [("<log:north>",)]
    assert len(ask("SELECT ?n {?s <q:home> ?n}")) == 1  # the union of graphs holds a fact once


def test_repeated_and_unbound(ask):
    assert ask("SELECT * {?x ?p ?x}") == []
    rows = ask('SELECT ?s ?n {?s <q:crew> ?v OPTIONAL {?s <q:home> ?n FILTER(LANG(?n) = "no")}}')
    assert set(rows) == {("<b:heron>", None), ("<b:teal>", None), ("<b:wren>", '"Tromsø"@no')}
    assert sorted(ask("SELECT ?s {?s <q:crew> ?v FILTER NOT EXISTS {?s <q:home> ?n}}")) == [("<b:heron>",), ("<b:teal>",)]
    assert sorted(ask("SELECT ?s {?s <q:crew> ?v MINUS {?s a <k:Boat>}}")) == [("<b:wren>",)]


def test_variables_that_may_be_unbound_join_by_what_both_bind(ask):
    towed = "?s <q:crew> ?v OPTIONAL {?s <q:tows> ?o}"
    # heron tows nothing, so any boat's crew fits there
    assert len(ask(f"SELECT * {{{towed} . ?o <q:crew> ?w}}")) == 2 + 3
    got = set(ask(f"SELECT ?s ?o ?k {{{towed} OPTIONAL {{?o a ?k FILTER(?k = <k:Ferry>)}}}}"))
    assert got == {("<b:wren>", "<b:teal>", None), ("<b:teal>", "<b:heron>", "<k:Ferry>"), ("<b:heron>", "<b:heron>", "<k:Ferry>")}
    assert set(ask(f"SELECT ?s {{{towed} MINUS {{?o a <k:Ferry>}}}}")) == {("<b:wren>",), ("<b:heron>",)}
    assert set(ask(f"SELECT ?s {{{towed} FILTER EXISTS {{?o a <k:Ferry>}}}}")) == {("<b:teal>",), ("<b:heron>",)}
    assert set(ask(f"SELECT ?s {{{towed} FILTER NOT EXISTS {{?o a <k:Ferry>}}}}")) == {("<b:wren>",)}
    assert len(ask(f"SELECT * {{{towed} {{SELECT ?o (MAX(?w) AS ?m) {{?o <q:crew> ?w}} GROUP BY ?o}}}}")) == 2 + 3


def test_plans_have_no_nested_loops(spark):
    data = facts(spark, QUADS, "nquads")
    for q in ("SELECT * {?s <q:crew> ?v {SELECT ?s (COUNT(*) AS ?n) {?s ?p ?o} GROUP BY ?s}}", "SELECT * {?s <q:crew> ?v OPTIONAL {?s <q:tows> ?o} ?s a ?t}"):
        plan = select(spark, Source(data), q)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, plan


def test_paths(ask):
    assert sorted(ask("SELECT ?o {<b:wren> <q:tows>+ ?o}")) == [("<b:heron>",), ("<b:teal>",)]
    assert sorted(ask("SELECT ?s {?s (<q:tows>|<q:escorts>)+ <b:wren>}")) == [("<b:heron>",), ("<b:teal>",), ("<b:wren>",)]
    assert len(ask("SELECT * {?s (<q:tows>|<q:escorts>)+ ?o}")) == 9
    assert sorted(ask("SELECT ?s ?o {?s <q:tows>|^<q:escorts> ?o}")) == [("<b:teal>", "<b:heron>"), ("<b:wren>", "<b:heron>"), ("<b:wren>", "<b:teal>")]
    assert sorted(ask(f"SELECT ?o {{<b:teal> !(<q:crew>|a) ?o}}")) == [("<b:heron>",)]
    assert sorted(ask("SELECT ?o {<b:heron> !^<q:escorts> ?o}")) == [("<b:teal>",)]
    assert sorted(ask("SELECT ?o {<b:none> <q:tows>* ?o}")) == [("<b:none>",)]
    assert ask("SELECT ?o {<b:teal> <q:tows>? ?o FILTER(?o = <b:heron>)}") == [("<b:heron>",)]
    assert ask("ASK {<b:wren> <q:tows>+ <b:heron>}") == [(True,)] and ask("ASK {<b:heron> <q:tows>+ <b:wren>}") == [(False,)]
    assert sorted(ask("SELECT ?o {<b:wren> <q:tows>/<q:tows>/<q:escorts> ?o}")) == [("<b:wren>",)]


def test_forms(ask):
    assert ask("ASK {?s a <k:Boat>}") == [(True,)] and ask("ASK {?s a <k:Raft>}") == [(False,)]
    assert ask("CONSTRUCT {?v <q:of> ?s. ?s <q:has> ?v} {?s <q:crew> ?v FILTER(?v > 9)}") == [("<b:teal>", "<q:has>", whole(12))]
    assert len(ask("DESCRIBE <b:heron>")) == 4
    assert ask("SELECT DISTINCT ?s {?s ?p ?o} ORDER BY DESC(?s) LIMIT 1") == [("<b:wren>",)]
    assert sorted(ask("SELECT ?o {<b:heron> <q:crew>* ?o}")) == sorted([("<b:heron>",), (whole(3),)])


def test_errors(ask):
    for bad in ("SELECT", "SELECT ?x {?x ?y}", "nonsense", "SELECT * {?s ?p ?o} more"):
        with pytest.raises(RdfSyntaxError):
            ask(bad)
    with pytest.raises(UnsupportedQuery):
        ask("SELECT * {SERVICE <a:b> {?s ?p ?o}}")
