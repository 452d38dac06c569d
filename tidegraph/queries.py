"""Queries over the driver's tables and their SQL.  Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.functions.values import number, text, whole
from tidegraph.operators import goal as goals
from tidegraph.operators import maintain
from tidegraph.operators.fixpoint import advance, infer, infer_expiring
from tidegraph.operators.patterns import KEY, Source, scan
from tidegraph.plans.compiler import select
from tidegraph.sources.n3 import parse_rules
from tidegraph.sources.rdf import direct_mapping, facts, parse_lines, read_rdf, statements, write_rdf
from tidegraph.streaming import windows
from tidegraph.streaming.rsp import RSPBuilder
from tidegraph.terms import QUAD, Pattern, Var

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PREFIXES = "".join(f"PREFIX {t[0]}: <urn:t:{t}#> " for t in ("nation", "region", "customer", "orders"))
WIDTH, SLIDE = 60, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(column: str) -> Column:
    """The number at the end of a row's IRI."""
    return F.regexp_extract(column, r"/(-?\d+)>$", 1).cast("bigint")


def nations(spark, d):
    return direct_mapping(table(spark, d, "nation"), "nation", "n_nationkey", ["n_name", "n_regionkey"], {"n_regionkey": "region"}, F.concat(F.lit("<urn:t:region/"), F.col("n_regionkey").cast("string"), F.lit(">")))


def regions(spark, d):
    return direct_mapping(table(spark, d, "region"), "region", "r_regionkey", ["r_name"])


def customers(spark, d, *columns):
    return direct_mapping(table(spark, d, "customer"), "customer", "c_custkey", list(columns), {"c_nationkey": "nation"})


def parts(spark, d, *columns):
    return direct_mapping(table(spark, d, "part"), "part", "p_partkey", list(columns))


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def sparql(name: str, source: Callable, body: str, out: dict[str, Callable[[str], Column]], sql: str) -> None:
    """A SELECT over mapped tables, its variables decoded by out (variable or column name: decoder)."""

    def run(spark, d):
        found = select(spark, Source(source(spark, d)), PREFIXES + body)
        return found.select(*(f(c).alias(c) for c, f in out.items()))

    QUERIES[name], SQL[name] = run, sql


money = lambda c: F.round(number(F.col(c)), 2)
count = lambda c: whole(F.col(c))
word = lambda c: text(F.col(c))
CUST = ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")

# the eight shapes of a pattern, over nations: s, p, o as variables or as nation 6, its region and region 1
for shape in ("spo", "sp", "so", "po", "s", "p", "o", "none"):
    bound = set() if shape == "none" else set(shape)
    terms = {"s": "<urn:t:nation/6>", "p": "<urn:t:nation#n_regionkey>", "o": "<urn:t:region/1>"}
    free = [c for c in "spo" if c not in bound]

    def shaped(spark, d, bound=bound, free=free, terms=terms):
        found = scan(nations(spark, d), Pattern(*(terms[c] if c in bound else Var(c) for c in "spo")))
        return found.select(*(F.col(c) for c in free)) if free else found.agg(F.count("*").alias("n"))

    all_facts = "(SELECT '<urn:t:nation/' || n_nationkey || '>' AS s, '<urn:t:nation#n_regionkey>' AS p, '<urn:t:region/' || n_regionkey || '>' AS o FROM nation UNION ALL SELECT '<urn:t:nation/' || n_nationkey || '>', '<urn:t:nation#n_name>', '\"' || n_name || '\"' FROM nation)"
    where = " AND ".join(f"{c} = '{terms[c]}'" for c in "spo" if c in bound) or "TRUE"
    QUERIES[f"pattern_{shape}"] = shaped
    SQL[f"pattern_{shape}"] = f"SELECT {', '.join(free) or 'count(*) AS n'} FROM {all_facts} WHERE {where}"

sparql("bgp_path", lambda s, d: customers(s, d, "c_name", "c_nationkey").unionByName(nations(s, d)).unionByName(regions(s, d)), "SELECT ?c ?r WHERE {?x c:c_name ?c ; c:c_nationkey ?n . ?n n:n_regionkey ?y . ?y r:r_name ?r}", {"c": word, "r": word}, "SELECT c_name AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("bgp_star", lambda s, d: customers(s, d, *CUST), "SELECT ?name ?seg ?bal WHERE {?x c:c_name ?name ; c:c_mktsegment ?seg ; c:c_acctbal ?bal}", {"name": word, "seg": word, "bal": money}, "SELECT c_name AS name, c_mktsegment AS seg, round(c_acctbal, 2) AS bal FROM customer")
sparql("bgp_cross", lambda s, d: nations(s, d).unionByName(regions(s, d)), "SELECT ?a ?b WHERE {?x n:n_name ?a . ?y r:r_name ?b}", {"a": word, "b": word}, "SELECT n_name AS a, r_name AS b FROM nation, region")
sparql("bgp_ground", nations, "SELECT ?a WHERE {?x n:n_name ?a . <urn:t:nation/6> n:n_regionkey <urn:t:region/1>}", {"a": word}, "SELECT n_name AS a FROM nation WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 6 AND n_regionkey = 1)")
sparql("bgp_multi_shared", nations, "SELECT ?a ?b WHERE {?x n:n_name ?a ; n:n_regionkey ?r . ?y n:n_regionkey ?r ; n:n_name ?b . FILTER(?a < ?b)}", {"a": word, "b": word}, "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_name < y.n_name")
sparql("bgp_repeated_var", lambda s, d: direct_mapping(table(s, d, "nation").selectExpr("n_nationkey k", "n_regionkey r"), "node", "k", ["r"], {"r": "node"}), "SELECT ?x WHERE {?x ?p ?x}", {"x": key}, "SELECT CAST(n_nationkey AS BIGINT) AS x FROM nation WHERE n_nationkey = n_regionkey")
for op, sign in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("eq", "="), ("ne", "!=")):
    sparql(f"filter_{op}", lambda s, d: parts(s, d, "p_size"), f"SELECT ?x WHERE {{?x <urn:t:part#p_size> ?v . FILTER(?v {sign} 25)}}", {"x": key}, f"SELECT p_partkey AS x FROM part WHERE p_size {sign} 25")
sparql("filter_bool", lambda s, d: customers(s, d, "c_acctbal", "c_mktsegment"), 'SELECT ?x WHERE {?x c:c_acctbal ?b ; c:c_mktsegment ?m . FILTER((?b > 5000 && !(?m = "BUILDING")) || ?m IN ("MACHINERY", "FURNITURE"))}', {"x": key}, "SELECT c_custkey AS x FROM customer WHERE (c_acctbal > 5000 AND NOT c_mktsegment = 'BUILDING') OR c_mktsegment IN ('MACHINERY', 'FURNITURE')")
sparql("functions", lambda s, d: customers(s, d, "c_name", "c_acctbal"), 'SELECT ?x (UCASE(SUBSTR(?n, 1, 5)) AS ?u) (STRLEN(?n) AS ?l) (IF(?b > 0, "pos", "neg") AS ?sign) WHERE {?x c:c_name ?n ; c:c_acctbal ?b . FILTER(CONTAINS(?n, "1"))}', {"x": key, "u": word, "l": count, "sign": word}, "SELECT c_custkey AS x, upper(substr(c_name, 1, 5)) AS u, CAST(length(c_name) AS BIGINT) AS l, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS sign FROM customer WHERE contains(c_name, '1')")
sparql("extend", lambda s, d: parts(s, d, "p_size"), "SELECT ?x ?w WHERE {?x <urn:t:part#p_size> ?v . BIND(?v * 2 + 1 AS ?w)}", {"x": key, "w": count}, "SELECT p_partkey AS x, CAST(p_size * 2 + 1 AS BIGINT) AS w FROM part")
sparql("group_aggregates", lambda s, d: customers(s, d, "c_nationkey", "c_acctbal"), "SELECT ?n (COUNT(?b) AS ?k) (SUM(?b) AS ?t) (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) (AVG(?b) AS ?m) WHERE {?x c:c_nationkey ?n ; c:c_acctbal ?b} GROUP BY ?n", {"n": key, "k": count, "t": money, "lo": money, "hi": money, "m": money}, "SELECT CAST(c_nationkey AS BIGINT) AS n, count(*) AS k, round(sum(c_acctbal), 2) AS t, round(min(c_acctbal), 2) AS lo, round(max(c_acctbal), 2) AS hi, round(avg(c_acctbal), 2) AS m FROM customer GROUP BY 1")
sparql("group_having", lambda s, d: parts(s, d, "p_brand", "p_size"), "SELECT ?b (COUNT(DISTINCT ?z) AS ?k) (SUM(?z) AS ?t) WHERE {?x <urn:t:part#p_brand> ?b ; <urn:t:part#p_size> ?z} GROUP BY ?b HAVING(COUNT(*) > 10)", {"b": word, "k": count, "t": count}, "SELECT p_brand AS b, count(DISTINCT p_size) AS k, CAST(sum(p_size) AS BIGINT) AS t FROM part GROUP BY 1 HAVING count(*) > 10")
sparql("group_global", lambda s, d: customers(s, d, "c_name"), "SELECT (COUNT(*) AS ?k) WHERE {?x c:c_name ?n}", {"k": count}, "SELECT count(*) AS k FROM customer")
sparql("group_empty", lambda s, d: customers(s, d, "c_name"), "SELECT (COUNT(*) AS ?k) WHERE {?x c:nothing ?n}", {"k": count}, "SELECT CAST(0 AS BIGINT) AS k")
sparql("graph_constant", nations, "SELECT ?a WHERE {GRAPH <urn:t:region/2> {?x n:n_name ?a}}", {"a": word}, "SELECT n_name AS a FROM nation WHERE n_regionkey = 2")
sparql("graph_variable", nations, "SELECT ?g ?a WHERE {GRAPH ?g {?x n:n_name ?a}}", {"g": key, "a": word}, "SELECT CAST(n_regionkey AS BIGINT) AS g, n_name AS a FROM nation")
_orders = lambda s, d: direct_mapping(table(s, d, "orders"), "orders", "o_orderkey", ["o_custkey", "o_totalprice"], {"o_custkey": "customer"}).unionByName(customers(s, d, "c_name"))
sparql("optional", _orders, "SELECT ?n ?o WHERE {?x c:c_name ?n OPTIONAL {?o o:o_custkey ?x}}", {"n": word, "o": key}, "SELECT c_name AS n, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
sparql("minus", _orders, "SELECT ?n WHERE {?x c:c_name ?n MINUS {?o o:o_custkey ?x ; o:o_totalprice ?p FILTER(?p > 200000)}}", {"n": word}, "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
sparql("exists", _orders, "SELECT ?n WHERE {?x c:c_name ?n FILTER EXISTS {?o o:o_custkey ?x ; o:o_totalprice ?p FILTER(?p > 200000)}}", {"n": word}, "SELECT c_name AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
sparql("union", lambda s, d: nations(s, d).unionByName(regions(s, d)), "SELECT ?a WHERE {{?x n:n_name ?a} UNION {?x r:r_name ?a}}", {"a": word}, "SELECT n_name AS a FROM nation UNION ALL SELECT r_name FROM region")
sparql("values", nations, "SELECT ?r ?a WHERE {VALUES ?r {<urn:t:region/1> <urn:t:region/3>} ?x n:n_regionkey ?r ; n:n_name ?a}", {"r": key, "a": word}, "SELECT CAST(n_regionkey AS BIGINT) AS r, n_name AS a FROM nation WHERE n_regionkey IN (1, 3)")
sparql("distinct", lambda s, d: customers(s, d, "c_mktsegment"), "SELECT DISTINCT ?m WHERE {?x c:c_mktsegment ?m}", {"m": word}, "SELECT DISTINCT c_mktsegment AS m FROM customer")
sparql("order_limit", lambda s, d: customers(s, d, "c_acctbal", "c_name"), "SELECT ?n ?b WHERE {?x c:c_acctbal ?b ; c:c_name ?n} ORDER BY DESC(?b) ?n LIMIT 20 OFFSET 5", {"n": word, "b": money}, "SELECT c_name AS n, round(c_acctbal, 2) AS b FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20 OFFSET 5")
sparql("subquery", lambda s, d: customers(s, d, "c_nationkey").unionByName(nations(s, d)), "SELECT ?a ?k WHERE {?n n:n_name ?a {SELECT ?n (COUNT(*) AS ?k) WHERE {?x c:c_nationkey ?n} GROUP BY ?n}}", {"a": word, "k": count}, "SELECT n_name AS a, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")

sparql("functions_strings", lambda s, d: customers(s, d, "c_name", "c_mktsegment"), 'SELECT ?x (LCASE(?m) AS ?low) (CONCAT(?n, "-", ?m) AS ?both) (REPLACE(?n, "#0+", "/") AS ?short) (STRSTARTS(?m, "B") AS ?b) (STRENDS(?m, "Y") AS ?y) (REGEX(?n, "7$") AS ?seven) (SUBSTR(?m, 3) AS ?tail) WHERE {?x c:c_name ?n ; c:c_mktsegment ?m}', {"x": key, "low": word, "both": word, "short": word, "b": word, "y": word, "seven": word, "tail": word}, "SELECT c_custkey AS x, lower(c_mktsegment) AS low, c_name || '-' || c_mktsegment AS both, regexp_replace(c_name, '#0+', '/', 'g') AS short, CAST(starts_with(c_mktsegment, 'B') AS VARCHAR) AS b, CAST(ends_with(c_mktsegment, 'Y') AS VARCHAR) AS y, CAST(ends_with(c_name, '7') AS VARCHAR) AS seven, substr(c_mktsegment, 3) AS tail FROM customer")
sparql("functions_numbers", lambda s, d: customers(s, d, "c_acctbal"), 'SELECT ?x (ABS(?b) AS ?a) (CEIL(?b) AS ?up) (FLOOR(?b) AS ?down) (ROUND(?b) AS ?near) (?b / 3 AS ?q) (ISNUMERIC(?b) AS ?n) WHERE {?x c:c_acctbal ?b}', {"x": key, "a": money, "up": money, "down": money, "near": money, "q": money, "n": word}, "SELECT c_custkey AS x, round(abs(c_acctbal), 2) AS a, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, floor(c_acctbal + 0.5) AS near, round(c_acctbal / 3, 2) AS q, 'true' AS n FROM customer")
sparql("functions_terms", lambda s, d: customers(s, d, "c_nationkey", "c_acctbal"), 'SELECT ?x (ISIRI(?n) AS ?i) (ISLITERAL(?b) AS ?l) (ISBLANK(?n) AS ?k) (DATATYPE(?b) AS ?t) (LANG(?b) AS ?g) (STR(?n) AS ?s) (SAMETERM(?n, <urn:t:nation/6>) AS ?same) (COALESCE(?none, ?n) AS ?c) (BOUND(?none) AS ?there) WHERE {?x c:c_nationkey ?n ; c:c_acctbal ?b}', {"x": key, "i": word, "l": word, "k": word, "t": word, "g": word, "s": word, "same": word, "c": key, "there": word}, "SELECT c_custkey AS x, 'true' AS i, 'true' AS l, 'false' AS k, 'http://www.w3.org/2001/XMLSchema#double' AS t, '' AS g, 'urn:t:nation/' || c_nationkey AS s, CAST(c_nationkey = 6 AS VARCHAR) AS same, CAST(c_nationkey AS BIGINT) AS c, 'false' AS there FROM customer")
sparql("functions_dates", lambda s, d: direct_mapping(table(s, d, "orders"), "orders", "o_orderkey", ["o_orderdate"]), "SELECT ?x (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d) WHERE {?x o:o_orderdate ?t FILTER(YEAR(?t) > 1993)}", {"x": key, "y": count, "m": count, "d": count}, "SELECT o_orderkey AS x, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders WHERE year(o_orderdate) > 1993")
sparql("boolean_value", lambda s, d: parts(s, d, "p_size"), 'SELECT ?x WHERE {?x <urn:t:part#p_size> ?v . FILTER((?v - 25) || "" || false)}', {"x": key}, "SELECT p_partkey AS x FROM part WHERE p_size <> 25")
sparql("group_concat", lambda s, d: nations(s, d), 'SELECT ?r (GROUP_CONCAT(?a; SEPARATOR="|") AS ?all) (SAMPLE(?a) AS ?one) WHERE {?x n:n_regionkey ?r ; n:n_name ?a} GROUP BY ?r', {"r": key, "all": word, "one": word}, "SELECT CAST(n_regionkey AS BIGINT) AS r, string_agg(n_name, '|' ORDER BY n_name) AS all, min(n_name) AS one FROM nation GROUP BY n_regionkey")
sparql("group_count_distinct", lambda s, d: customers(s, d, "c_nationkey", "c_mktsegment"), "SELECT ?n (COUNT(DISTINCT ?m) AS ?k) WHERE {?x c:c_nationkey ?n ; c:c_mktsegment ?m} GROUP BY ?n", {"n": key, "k": count}, "SELECT CAST(c_nationkey AS BIGINT) AS n, count(DISTINCT c_mktsegment) AS k FROM customer GROUP BY 1")
sparql("optional_filter", _orders, "SELECT ?n ?o WHERE {?x c:c_name ?n OPTIONAL {?o o:o_custkey ?x ; o:o_totalprice ?v FILTER(?v > 300000)}}", {"n": word, "o": key}, "SELECT c_name AS n, o_orderkey AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
sparql("optional_join", _orders, "SELECT ?n ?o ?p WHERE {?x c:c_name ?n OPTIONAL {?o o:o_custkey ?x ; o:o_totalprice ?v FILTER(?v > 300000)} OPTIONAL {?x <urn:none> ?o . ?o o:o_totalprice ?p}}", {"n": word, "o": key, "p": money}, "SELECT c_name AS n, o_orderkey AS o, CAST(NULL AS DOUBLE) AS p FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
sparql("path_alternatives", lambda s, d: nations(s, d).unionByName(customers(s, d, "c_nationkey")), "SELECT ?x ?y WHERE {?x c:c_nationkey|n:n_regionkey ?y}", {"x": word, "y": word}, "SELECT 'urn:t:customer/' || c_custkey AS x, 'urn:t:nation/' || c_nationkey AS y FROM customer UNION ALL SELECT 'urn:t:nation/' || n_nationkey, 'urn:t:region/' || n_regionkey FROM nation")
sparql("path_sequence", lambda s, d: nations(s, d).unionByName(customers(s, d, "c_nationkey")), "SELECT ?x ?y WHERE {?x c:c_nationkey/n:n_regionkey/^n:n_regionkey ?y}", {"x": key, "y": key}, "SELECT c_custkey AS x, CAST(o.n_nationkey AS BIGINT) AS y FROM customer JOIN nation n ON c_nationkey = n.n_nationkey JOIN nation o ON o.n_regionkey = n.n_regionkey")
sparql("path_negated", nations, "SELECT ?x ?y WHERE {?x !(n:n_name|n:other) ?y}", {"x": key, "y": key}, "SELECT CAST(n_nationkey AS BIGINT) AS x, CAST(n_regionkey AS BIGINT) AS y FROM nation")
sparql("path_optional", lambda s, d: nations(s, d), "SELECT ?y WHERE {<urn:t:nation/6> n:n_regionkey? ?y}", {"y": word}, "SELECT 'urn:t:nation/6' AS y UNION ALL SELECT 'urn:t:region/' || n_regionkey FROM nation WHERE n_nationkey = 6")

@query("ask", "SELECT TRUE AS answer")
def ask(spark, d):
    return select(spark, Source(nations(spark, d)), PREFIXES + "ASK {?x n:n_regionkey <urn:t:region/1>}")


@query("construct", "SELECT '<urn:t:region/' || n_regionkey || '>' AS s, '<urn:holds>' AS p, '<urn:t:nation/' || n_nationkey || '>' AS o FROM nation")
def construct(spark, d):
    return select(spark, Source(nations(spark, d)), PREFIXES + "CONSTRUCT {?r <urn:holds> ?x} WHERE {?x n:n_regionkey ?r}")


@query("describe", "SELECT '<urn:t:nation/6>' AS s, '<urn:t:nation#n_name>' AS p, '\"' || n_name || '\"' AS o FROM nation WHERE n_nationkey = 6 UNION ALL SELECT '<urn:t:nation/6>', '<urn:t:nation#n_regionkey>', '<urn:t:region/' || n_regionkey || '>' FROM nation WHERE n_nationkey = 6")
def describe(spark, d):
    return select(spark, Source(nations(spark, d)), PREFIXES + "DESCRIBE <urn:t:nation/6>")

# rules: a tree over parts (k -> k div 2), a cycle over nations, class hierarchies

TRANSITIVE = "{?a <urn:up> ?b. ?b <urn:up> ?c} => {?a <urn:up> ?c}."
TREE = "WITH RECURSIVE t(a, b) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey >= 1 UNION SELECT t.a, p_partkey // 2 FROM t JOIN part ON p_partkey = t.b AND p_partkey >= 1)"


def tree(spark, d):
    k = table(spark, d, "part").filter("p_partkey >= 1").select("p_partkey", F.expr("p_partkey div 2").alias("up"))
    return k.select(F.expr("concat('<urn:t:n/', p_partkey, '>')").alias("s"), F.lit("<urn:up>").alias("p"), F.expr("concat('<urn:t:n/', up, '>')").alias("o"))


def ends(df):
    return df.select(key("s").alias("a"), key("o").alias("b"))


@query("rule_transitive", TREE + " SELECT a, b FROM t")
def rule_transitive(spark, d):
    base = tree(spark, d)
    return ends(base.unionByName(infer(base, parse_rules(TRANSITIVE))))


@query("rule_cycle", "WITH RECURSIVE e(a, b) AS (SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey + 1) % 25 AS BIGINT) FROM nation), t(a, b) AS (SELECT * FROM e UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b) SELECT a, b FROM t")
def rule_cycle(spark, d):
    base = table(spark, d, "nation").select(F.expr("concat('<urn:t:n/', n_nationkey, '>')").alias("s"), F.lit("<urn:up>").alias("p"), F.expr("concat('<urn:t:n/', (n_nationkey + 1) % 25, '>')").alias("o"))
    return ends(base.unionByName(infer(base, parse_rules(TRANSITIVE))))


@query("rule_join", "SELECT c_custkey AS a, CAST(n_regionkey AS BIGINT) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rule_join(spark, d):
    base = customers(spark, d, "c_nationkey").unionByName(nations(spark, d))
    return ends(infer(base, parse_rules("{?c <urn:t:customer#c_nationkey> ?n. ?n <urn:t:nation#n_regionkey> ?r} => {?c <urn:in> ?r}.")))


def classes(spark, d):
    return table(spark, d, "part").select(F.expr("concat('<urn:t:part/', p_partkey, '>')").alias("s"), F.lit("<urn:is>").alias("p"), F.expr("concat('<urn:c0_', p_size % 5, '>')").alias("o"))


DEPTH = 6
HIERARCHY = "".join(f"{{?x <urn:is> <urn:c{i}_{j}>}} => {{?x <urn:is> <urn:c{i + 1}_{j}>}}." for i in range(DEPTH) for j in range(3))


@query("rule_hierarchy", f"SELECT p_partkey AS x, '<urn:c' || i || '_' || (p_size % 5) || '>' AS c FROM part, generate_series(1, {DEPTH}) AS g(i) WHERE p_size % 5 < 3")
def rule_hierarchy(spark, d):
    return infer(classes(spark, d), parse_rules(HIERARCHY)).select(key("s").alias("x"), F.col("o").alias("c"))


@query("rule_ground", "SELECT 'yes' AS o WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 6 AND n_regionkey = 1)")
def rule_ground(spark, d):
    return infer(nations(spark, d), parse_rules('{<urn:t:nation/6> <urn:t:nation#n_regionkey> <urn:t:region/1>} => {<urn:t:nation/6> <urn:found> "yes"}.')).select(word("o").alias("o"))


@query("goal_hierarchy", "SELECT p_partkey AS x FROM part WHERE p_size % 5 = 1")
def goal_hierarchy(spark, d):
    return goals.answers(classes(spark, d), parse_rules(HIERARCHY), Pattern(Var("x"), "<urn:is>", f"<urn:c{DEPTH}_1>")).select(key("x").alias("x"))


@query("goal_recursive", TREE + " SELECT a FROM t WHERE b = 3")
def goal_recursive(spark, d):
    return goals.answers(tree(spark, d), parse_rules(TRANSITIVE + HIERARCHY), Pattern(Var("a"), "<urn:up>", "<urn:t:n/3>")).select(key("a").alias("a"))


@query("path_plus", TREE + " SELECT a, b FROM t WHERE b = 1")
def path_plus(spark, d):
    return select(spark, Source(tree(spark, d)), "SELECT ?a ?b WHERE {?a <urn:up>+ ?b . FILTER(?b = <urn:t:n/1>)}").select(key("a").alias("a"), key("b").alias("b"))


@query("path_star", TREE + " SELECT b AS x FROM t WHERE a = 100 UNION ALL SELECT 100")
def path_star(spark, d):
    return select(spark, Source(tree(spark, d)), "SELECT ?x WHERE {<urn:t:n/100> <urn:up>* ?x}").select(key("x").alias("x"))


@query("rule_sameorg", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'MACHINERY'")
def rule_sameorg(spark, d):
    rules = '{?a <urn:t:customer#c_nationkey> ?n. ?b <urn:t:customer#c_nationkey> ?n. ?a <urn:t:customer#c_mktsegment> "BUILDING". ?b <urn:t:customer#c_mktsegment> "MACHINERY"} => {?a <urn:near> ?b}.'
    return ends(infer(customers(spark, d, "c_nationkey", "c_mktsegment"), parse_rules(rules), write=False))


@query("expiring_advance", "SELECT a.event_id AS a, least(a.event_id, b.event_id) + 100 AS exp FROM events a JOIN events b ON b.event_id = a.event_id + 2 WHERE least(a.event_id, b.event_id) + 100 > 5000")
def expiring_advance(spark, d):
    """Half of the events first, then time comes to 5000 and the other half comes in."""
    e = table(spark, d, "events").select(F.expr("concat('<urn:e/', event_id, '>')").alias("s"), F.lit("<urn:next>").alias("p"), F.expr("concat('<urn:e/', event_id + 2, '>')").alias("o"), (F.col("event_id") + 100).alias("exp"), "event_id")
    whole = e.select("s", "p", "o", "exp", "event_id").unionByName(e.select("s", F.lit("<urn:is>").alias("p"), F.lit("<urn:event>").alias("o"), "exp", "event_id"))
    rules = parse_rules("{?a <urn:next> ?b. ?a <urn:is> <urn:event>. ?b <urn:is> <urn:event>} => {?a <urn:meets> ?b}.")
    part = lambda early: whole.filter(F.col("event_id") < 4950 if early else F.col("event_id") >= 4950).drop("event_id")
    out = advance(infer_expiring(part(True), rules), part(False), 5000, rules)
    return out.filter("p = '<urn:meets>'").select(key("s").alias("a"), "exp")

@query("dred_delete", "WITH RECURSIVE e(a, b) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey >= 1 AND p_partkey <> 3), t(a, b) AS (SELECT * FROM e UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b) SELECT a, b FROM t")
def dred_delete(spark, d):
    base, rules = tree(spark, d), parse_rules(TRANSITIVE)
    left, more = maintain.delete(base, infer(base, rules), base.filter("s = '<urn:t:n/3>'"), rules)
    return ends(left.unionByName(more))


@query("insert_incremental", TREE + " SELECT a, b FROM t")
def insert_incremental(spark, d):
    base, rules = tree(spark, d), parse_rules(TRANSITIVE)
    old, new = base.filter("s != '<urn:t:n/3>'"), base.filter("s = '<urn:t:n/3>'")
    left, more = maintain.insert(old, infer(old, rules), new, rules)
    return ends(left.unionByName(more))


@query("expiring_rules", "SELECT a.event_id AS a, b.event_id AS b, least(a.event_id + 100, b.event_id + 100) AS exp FROM events a JOIN events b ON b.event_id = a.event_id + 2 WHERE TRUE")
def expiring_rules(spark, d):
    e = table(spark, d, "events")
    base = e.select(F.expr("concat('<urn:e/', event_id, '>')").alias("s"), F.lit("<urn:next>").alias("p"), F.expr("concat('<urn:e/', event_id + 2, '>')").alias("o"), F.col("event_id").alias("exp0"))
    both = base.select("s", "p", "o", (F.col("exp0") + 100).alias("exp")).unionByName(e.select(F.expr("concat('<urn:e/', event_id, '>')").alias("s"), F.lit("<urn:is>").alias("p"), F.lit("<urn:event>").alias("o"), (F.col("event_id") + 100).alias("exp")))
    out = infer_expiring(both, parse_rules("{?a <urn:next> ?b. ?a <urn:is> <urn:event>. ?b <urn:is> <urn:event>} => {?a <urn:meets> ?b}."))
    return out.filter("p = '<urn:meets>'").select(key("s").alias("a"), key("o").alias("b"), "exp")


# windows over events, ts in minutes since the first


def stream(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("ts").alias("t0"))
    minutes = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 60_000_000).cast("bigint")
    return e.crossJoin(F.broadcast(first)).select("event_id", "user_id", "event_type", minutes.alias("ts"))


EVENTS = "e AS (SELECT event_id, user_id, event_type, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 60000000) AS BIGINT) AS t FROM events)"
TICKS = f"WITH {EVENTS}, k AS (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM (SELECT DISTINCT t FROM e))"
CLOSED = f"{TICKS}, f AS (SELECT t AS fire, CAST(least((t - 1) // {SLIDE}, (p + {WIDTH}) // {SLIDE}) * {SLIDE} AS BIGINT) AS c, p FROM k WHERE p IS NOT NULL), w AS (SELECT fire, greatest(c - {WIDTH}, 0) AS open, c AS close FROM f WHERE c >= p)"
HELD = ", h AS (SELECT DISTINCT fire, event_id, user_id, event_type FROM w JOIN e ON t BETWEEN close - 60 AND close AND t < fire)"


@query("window_firings", CLOSED + " SELECT fire, open, close FROM w")
def window_firings(spark, d):
    return windows.firings(stream(spark, d), WIDTH, SLIDE)


@query("window_content", CLOSED + HELD + " SELECT fire, event_id FROM h")
def window_content(spark, d):
    s = stream(spark, d).select("event_id", "ts")
    return windows.content(s, windows.firings(s, WIDTH, SLIDE), WIDTH, SLIDE)


@query("window_periodic", f"{TICKS} SELECT t AS fire, greatest(((t + {WIDTH}) // {SLIDE}) * {SLIDE} - {WIDTH}, 0) AS open, CAST(((t + {WIDTH}) // {SLIDE}) * {SLIDE} AS BIGINT) AS close FROM k WHERE p IS NOT NULL AND t % 7 = 0")
def window_periodic(spark, d):
    return windows.firings(stream(spark, d), WIDTH, SLIDE, ("periodic",), 7)


@query("window_non_empty", f"{TICKS} SELECT t AS fire, greatest(((p + {WIDTH}) // {SLIDE}) * {SLIDE} - {WIDTH}, 0) AS open, CAST(((p + {WIDTH}) // {SLIDE}) * {SLIDE} AS BIGINT) AS close FROM k WHERE p IS NOT NULL")
def window_non_empty(spark, d):
    return windows.firings(stream(spark, d), WIDTH, SLIDE, ("non_empty",))


TRIGGERS = f"WITH {EVENTS}, g AS (SELECT min(t) AS fire FROM e WHERE t > {WIDTH} GROUP BY (t - {WIDTH} + {SLIDE} - 1) // {SLIDE})"


@query("time_window", TRIGGERS + f" SELECT fire, event_id FROM g JOIN e ON t <= fire AND t > fire - {WIDTH}")
def time_window(spark, d):
    return windows.time_window(stream(spark, d).select("event_id", "ts"), WIDTH, SLIDE).select(KEY, "event_id")


@query("window_content_change", CLOSED + ", k2 AS (SELECT fire, lag(fire) OVER (ORDER BY fire) AS before FROM w), h AS (SELECT DISTINCT fire, event_type FROM w JOIN e ON t BETWEEN close - 60 AND close AND t < fire), x AS (SELECT fire, string_agg(event_type, ',' ORDER BY event_type) AS held FROM h GROUP BY fire) SELECT w.fire, w.open, w.close FROM w JOIN k2 USING (fire) LEFT JOIN x a ON a.fire = w.fire LEFT JOIN x b ON b.fire = before WHERE before IS NULL OR a.held IS DISTINCT FROM b.held")
def window_content_change(spark, d):
    s = stream(spark, d).select("event_type", "ts")
    fired = scratch.cut(windows.firings(s, WIDTH, SLIDE), "firings")
    return windows.changed(fired, windows.content(s, fired, WIDTH, SLIDE))


@query("window_imars", TRIGGERS + f", q AS (SELECT DISTINCT user_id, t FROM e), n AS (SELECT user_id, t, (SELECT min(fire) FROM g WHERE fire >= t) AS i, (SELECT min(fire) FROM g WHERE fire >= t + {WIDTH}) AS o, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nt FROM q), z AS (SELECT *, CASE WHEN o IS NOT NULL AND (nt IS NULL OR nt > o) THEN o END AS gone FROM n), y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k, lag(gone) OVER (PARTITION BY user_id ORDER BY t) AS was FROM z) SELECT i AS fire, user_id, 'new' AS change FROM y WHERE i IS NOT NULL AND (k = 1 OR was IS NOT NULL) UNION ALL SELECT gone, user_id, 'old' FROM y WHERE gone IS NOT NULL")
def window_imars(spark, d):
    return windows.new_and_old(stream(spark, d).select("user_id", "ts"), ["user_id"], WIDTH, SLIDE)


@query("window_diff", f"WITH {EVENTS} SELECT DISTINCT user_id, 'in' AS change FROM e WHERE t BETWEEN 30 AND 300 AND user_id NOT IN (SELECT user_id FROM e WHERE t <= 270) UNION ALL SELECT DISTINCT user_id, 'out' FROM e WHERE t <= 270 AND user_id NOT IN (SELECT user_id FROM e WHERE t BETWEEN 30 AND 300)")
def window_diff(spark, d):
    s = stream(spark, d)
    held = lambda lo, hi: s.filter(F.col("ts").between(lo, hi)).select("user_id")
    came, went = windows.diff(held(0, 270), held(30, 300))
    return came.withColumn("change", F.lit("in")).unionByName(went.withColumn("change", F.lit("out")))

def facts_of(spark, d):
    s = stream(spark, d)
    return s.select(F.expr("concat('<urn:t:customer/', user_id, '>')").alias("s"), F.lit("<urn:did>").alias("p"), F.expr("concat('\"', event_type, '\"')").alias("o"), "ts")


def continuous(spark, d, kind):
    plan = RSPBuilder(spark, WIDTH, SLIDE).add_triples(customers(spark, d, "c_mktsegment")).add_r2s(kind)
    plan.add_rules("{?c <urn:did> ?w. ?c <urn:t:customer#c_mktsegment> ?m} => {?c <urn:activeIn> ?m}.")
    found = plan.add_query("SELECT ?c ?m WHERE {?c <urn:activeIn> ?m}").build().run(facts_of(spark, d))
    return found.select(KEY, key("c").alias("c"), word("m").alias("m"))


ACTIVE = CLOSED + HELD + ", r AS (SELECT DISTINCT fire, user_id AS c, c_mktsegment AS m FROM h JOIN customer ON c_custkey = user_id), n AS (SELECT fire, lag(fire) OVER (ORDER BY fire) AS p FROM w)"
QUERIES |= {f"rsp_{k}": (lambda s, d, k=k: continuous(s, d, k)) for k in ("rstream", "istream", "dstream")}
SQL |= {
    "rsp_rstream": ACTIVE + " SELECT fire, c, m FROM r",
    "rsp_istream": ACTIVE + " SELECT fire, c, m FROM r EXCEPT SELECT n.fire, c, m FROM r JOIN n ON n.p = r.fire",
    "rsp_dstream": ACTIVE + " SELECT n.fire, c, m FROM r JOIN n ON n.p = r.fire EXCEPT SELECT fire, c, m FROM r",
}


@query("rsp_windowed_reasoning", CLOSED + ", g AS (SELECT DISTINCT fire, event_id FROM w JOIN e ON t BETWEEN close - 60 AND close AND t < fire), r AS (SELECT a.fire, a.event_id AS x, b.event_id AS y FROM g a JOIN g b ON b.fire = a.fire AND b.event_id >= a.event_id) SELECT fire, x, y + 1 AS y FROM r")
def rsp_windowed_reasoning(spark, d):
    """A recursive rule inside windows: events are edges from each to the next, windows hold runs of them, and all pairs of a run are linked."""
    edges = stream(spark, d).select(F.expr("concat('<urn:e/', event_id, '>')").alias("s"), F.lit("<urn:then>").alias("p"), F.expr("concat('<urn:e/', event_id + 1, '>')").alias("o"), "ts")
    plan = RSPBuilder(spark, WIDTH, SLIDE).add_rules("{?a <urn:then> ?b. ?b <urn:then> ?c} => {?a <urn:then> ?c}.")
    return plan.add_query("SELECT ?x ?y WHERE {?x <urn:then> ?y}").build().run(edges).select(KEY, key("x").alias("x"), key("y").alias("y"))


@query("rsp_static_join", CLOSED + HELD + " SELECT DISTINCT fire, user_id AS c, n_name AS n FROM h JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE event_type = (SELECT min(event_type) FROM events)")
def rsp_static_join(spark, d):
    kind = table(spark, d, "events").agg(F.min("event_type")).first()[0]
    plan = RSPBuilder(spark, WIDTH, SLIDE).add_triples(customers(spark, d, "c_nationkey")).add_triples(nations(spark, d))
    plan.add_query(PREFIXES + f'SELECT DISTINCT ?c ?n WHERE {{?c <urn:did> "{kind}" . ?c c:c_nationkey ?x . ?x n:n_name ?n}}')
    return plan.build().run(facts_of(spark, d)).select(KEY, key("c").alias("c"), word("n").alias("n"))


FLEET = """@prefix : <http://fleet/> . @prefix v: <http://voc/> .
:ship7 a v:Vessel , v:Ferry ; v:port "Oslo"@no ; v:crew ( "Ada" "Bo" ) .
:ship9 a v:Vessel ; v:length 41.5 ; v:sister :ship7 , [ v:port "Bergen" ] ."""
READ = "SELECT * FROM (VALUES {}) v(s, p, o)"


@query("read_turtle", READ.format("('<http://fleet/ship7>', 'type', '<http://voc/Vessel>'), ('<http://fleet/ship7>', 'type', '<http://voc/Ferry>'), ('<http://fleet/ship7>', '<http://voc/port>', '\"Oslo\"@no'), ('<http://fleet/ship7>', '<http://voc/crew>', 'node'), ('node', 'first', '\"Ada\"'), ('node', 'rest', 'node'), ('node', 'first', '\"Bo\"'), ('node', 'rest', 'nil'), ('<http://fleet/ship9>', 'type', '<http://voc/Vessel>'), ('<http://fleet/ship9>', '<http://voc/length>', '\"41.5\"^^<http://www.w3.org/2001/XMLSchema#decimal>'), ('<http://fleet/ship9>', '<http://voc/sister>', '<http://fleet/ship7>'), ('<http://fleet/ship9>', '<http://voc/sister>', 'node'), ('node', '<http://voc/port>', '\"Bergen\"')"))
def read_turtle(spark, d):
    return facts(spark, FLEET, "turtle").select(*(F.when(F.col(c).startswith("_:"), "node").when(F.col(c).contains("22-rdf-syntax-ns#"), F.regexp_extract(c, "#(.*)>$", 1)).otherwise(F.col(c)).alias(c) for c in ("s", "p", "o")))


def written(spark, d, syntax, df):
    """df written as lines and read again."""
    path = scratch.fresh(spark, "lines")
    write_rdf(df, path)
    return read_rdf(spark, path, syntax)


NAMES = "SELECT '<urn:t:nation/' || n_nationkey || '>' AS s, '<urn:t:nation#n_name>' AS p, '\"' || n_name || '\"' AS o"


@query("read_ntriples", "SELECT '<urn:t:customer/' || c_custkey || '>' AS s, '<urn:t:customer#c_name>' AS p, '\"' || c_name || '\"' AS o FROM customer")
def read_ntriples(spark, d):
    return written(spark, d, "ntriples", customers(spark, d, "c_name").select("s", "p", "o")).select("s", "p", "o")


@query("read_nquads", NAMES + ", '<urn:t:region/' || n_regionkey || '>' AS g FROM nation UNION ALL SELECT '<urn:t:nation/' || n_nationkey || '>', '<urn:t:nation#n_regionkey>', '<urn:t:region/' || n_regionkey || '>', '<urn:t:region/' || n_regionkey || '>' FROM nation")
def read_nquads(spark, d):
    return written(spark, d, "nquads", nations(spark, d))


@query("read_trig", "SELECT * FROM (VALUES ('<http://fleet/ship7>', '<http://voc/port>', '\"Oslo\"', NULL), ('<http://fleet/ship9>', '<http://voc/port>', '\"Oslo\"', '<http://fleet/log1>'), ('<http://fleet/ship9>', '<http://voc/at>', '<http://fleet/q2>', '<http://fleet/log1>'), ('<http://fleet/ship7>', '<http://voc/at>', '<http://fleet/q2>', '<http://fleet/log2>')) v(s, p, o, g)")
def read_trig(spark, d):
    return facts(spark, '@prefix : <http://fleet/> . @prefix v: <http://voc/> . { :ship7 v:port "Oslo" . } :log1 { :ship9 v:port "Oslo" ; v:at :q2 . } GRAPH :log2 { :ship7 v:at :q2 }', "trig")


@query("read_n3_rules", "SELECT * FROM (VALUES ('{?x <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://voc/Ferry>. ?x <http://voc/port> ?y} => {?y <http://voc/serves> ?x}'), ('{?x <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://voc/Ferry>. ?x <http://voc/port> ?y} => {?x <http://voc/calls> \"yes\"}'), ('{?a <http://voc/sister> ?b} => {?b <http://voc/sister> ?a}')) v(rule)")
def read_n3_rules(spark, d):
    rules = parse_rules('@prefix v: <http://voc/> . { ?x a v:Ferry ; v:port ?y . } => { ?y v:serves ?x . ?x v:calls "yes" } . {?a v:sister ?b} => {?b v:sister ?a}.')
    return spark.createDataFrame([(str(r),) for r in rules], "rule string")


@query("read_lines", "SELECT * FROM (VALUES ('<a>', '<in>', '<c>'), ('<a>', '<in>', '<d>'), ('<b.1>', '<in>', '<d>')) v(s, p, o)")
def read_lines(spark, d):
    rows, rules = parse_lines("a in b.1.\nb.1 in c.\nc in d.\n{?x in ?y. ?y in ?z} => {?x in ?z}")
    return infer(spark.createDataFrame(rows, QUAD).select("s", "p", "o"), rules)


@query("dump_nquads", "SELECT '<urn:t:nation/' || n_nationkey || '> <urn:t:nation#n_name> \"' || n_name || '\" <urn:t:region/' || n_regionkey || '> .' AS value FROM nation UNION ALL SELECT '<urn:t:nation/' || n_nationkey || '> <urn:t:nation#n_regionkey> <urn:t:region/' || n_regionkey || '> <urn:t:region/' || n_regionkey || '> .' FROM nation")
def dump_nquads(spark, d):
    return statements(nations(spark, d))
