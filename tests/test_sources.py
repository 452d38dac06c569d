import pytest

from tidegraph.sources.n3 import parse_rules
from tidegraph.__main__ import main
from tidegraph.graph import Graph
from tidegraph.sources.rdf import facts, parse, parse_lines, read_rdf, write_rdf
from tidegraph.terms import RDF_TYPE, Pattern, RdfSyntaxError, Var

TTL = '@prefix : <http://e/> .\n@prefix s: <http://s/> . # people\n:foo a s:Person ; s:name "Foo" . :bar a s:Person ; s:name "B\\"ar"@en .'


def test_turtle_abbreviations():
    rows = parse(TTL, "turtle")
    assert len(rows) == 4 and rows[0] == ("<http://e/foo>", RDF_TYPE, "<http://s/Person>", None)
    assert rows[3][2] == '"B\\"ar"@en'
    assert len(parse("@prefix : <http://e/> . :a :p ( 1 2.5 true ), [ :q :r ] .", "turtle")) == 9


def test_trig_graphs():
    rows = parse("@prefix : <http://e/> . { :a :p :b , :c . } :g { :a :q 'x' } GRAPH :h { :a :q 1 . :b :q 2 }", "trig")
    assert [r[3] for r in rows] == [None, None, "<http://e/g>", "<http://e/h>", "<http://e/h>"]


@pytest.mark.parametrize(("text", "syntax"), [("asdfadsf", "ntriples"), ("<a:b> <c:d> .", "nquads"), ('"x" <a:b> <c:d> .', "ntriples"), (":a :b :c .", "turtle"), ("<a:b> <a:b> ?x .", "turtle"), ("<a:b> <c:d> <e:f> <g:h> .", "ntriples")])
def test_errors(text, syntax):
    with pytest.raises(RdfSyntaxError):
        parse(text, syntax)


def test_empty_and_repeats(spark):
    assert facts(spark, "").count() == 0
    assert facts(spark, "<a:b> <c:d> <e:f> .\n<a:b> <c:d> <e:f> .").count() == 1


def test_files_round_trip(spark, tmp_path):
    df = facts(spark, '<a:b> <c:d> "x \\"y\\" . z"^^<t:u> <g:h> .\n_:b1 <c:d> <e:f> .\n<a:b> <c:d> "é\\n"@en-GB .', "nquads")
    write_rdf(df, str(tmp_path / "q"))
    assert sorted(map(str, read_rdf(spark, str(tmp_path / "q"), "nquads", one_document=True).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "t.ttl").write_text(TTL)
    assert read_rdf(spark, str(tmp_path / "t.ttl"), "turtle").count() == 4
    (tmp_path / "bad.nt").write_text("<a:b> <c:d> <e:f> .\nnonsense\n")
    with pytest.raises(Exception, match="not a statement"):
        read_rdf(spark, str(tmp_path / "bad.nt")).collect()


def test_rules():
    rules = parse_rules("@prefix : <http://e/> .  @prefix s: <http://s/>.\n{ ?x a :A .  ?x s:in ?y. } => { ?x a :B }.\n{?a :p ?b}=>{?b :q ?a. ?a :r 1}")
    assert len(rules) == 3 and len(rules[0].body) == 2 and rules[0].body[0].p == RDF_TYPE and rules[0].head.s == Var("x")
    assert parse_rules("") == []
    for bad in ("{?a :p ?b} => {?a :q ?b}", "{?a <p:q> ?b} => {?c <p:q> ?a}.", "{} => {<a:b> <c:d> <e:f>}", "{?a <p:q> ?b}"):
        with pytest.raises(RdfSyntaxError):
            parse_rules(bad)


def test_blank_nodes_are_their_document_s(spark, tmp_path):
    one, two = '[ <a:p> "x" ] <a:q> _:g1 . _:g1 <a:p> "y" .', '[ <a:p> "x" ] <a:q> _:g1 .'
    nodes = {r.s for r in facts(spark, one, "turtle").collect() if r.p == "<a:p>"}
    assert len(nodes) == 2  # a node without a label isn't the one labelled g1
    both = facts(spark, one, "turtle").unionByName(facts(spark, two, "turtle")).collect()
    assert len({r.s for r in both if r.p == "<a:q>"}) == 2 and len({r.o for r in both if r.p == "<a:q>"}) == 2
    assert facts(spark, one, "turtle").unionByName(facts(spark, one, "turtle")).distinct().count() == 3
    for n, text in enumerate((one, two)):
        (tmp_path / f"{n}.ttl").write_text(text)
        (tmp_path / f"{n}.nt").write_text("_:n <a:p> <a:b> .\n_:n <a:q> _:m .\n")
    turtle = read_rdf(spark, str(tmp_path / "*.ttl"), "turtle").collect()
    assert len({r.s for r in turtle if r.p == "<a:q>"}) == 2
    lines = read_rdf(spark, str(tmp_path / "*.nt")).collect()
    assert len(lines) == 4 and len({r.s for r in lines}) == 2 and len({r.o for r in lines if r.p == "<a:q>"}) == 2
    assert read_rdf(spark, str(tmp_path / "*.nt"), one_document=True).count() == 2


def test_short_lines(spark):
    rows, rules = parse_lines("a in b.1 .\nb.1 in <x:c>.\n\n{?x in ?y. ?y in ?z} => {?x in ?z}\n<x:c> says \"a b.\"@en .")
    assert rows == [("<a>", "<in>", "<b.1>", None), ("<b.1>", "<in>", "<x:c>", None), ("<x:c>", "<says>", '"a b."@en', None)] and len(rules) == 1
    assert parse_lines("") == ([], [])
    for bad in ("a b", "a b c d.", "?x in b.", "{a b c} => d"):
        with pytest.raises(RdfSyntaxError):
            parse_lines(bad)
    g = Graph.of_lines(spark, "a in b.\nb in c.\n{?x in ?y. ?y in ?z} => {?x in ?z}")
    assert g.materialize().count() == 1 and len(g) == 3
    assert sorted(r.z for r in g.get(Pattern("<a>", "<in>", Var("z"))).collect()) == ["<b>", "<c>"]
    assert len(g.clear()) == 0 and len(g.rules) == 1 and g.get(Pattern("<a>", "<in>", Var("z"))).count() == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.nt").write_text("<u:a> <u:in> <u:b> .\n<u:b> <u:in> <u:c> .\n")
    (tmp_path / "t.n3").write_text("{?a <u:in> ?b. ?b <u:in> ?c} => {?a <u:in> ?c}.")
    monkeypatch.setattr("sys.argv", ["tidegraph", "--abox", str(tmp_path / "a.nt"), "--tbox", str(tmp_path / "t.n3"), "--output", str(tmp_path / "out")])
    main()
    told = capsys.readouterr().out
    assert "loaded 2 facts and 1 rules" in told and "materialized 3 facts" in told
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["<u:a> <u:in> <u:b> .", "<u:a> <u:in> <u:c> .", "<u:b> <u:in> <u:c> ."]
