"""DuckDB SQL for the queries that SQL can express; the others are tested against libraries and brute force."""

from __future__ import annotations

from tidegraph.llm import quality_rules, url_filter

_SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_FIVE = ", ".join(f"lead(x, {i}) OVER o AS x{i}" for i in range(1, 5))


def _rules() -> str:
    """Base measures of each document, hosts judged by failure rates shrunk with an empirical beta prior."""
    names = list(quality_rules.HOST_LIMITS)
    counts = ", ".join(f"sum(f_{r}::INT) AS k_{r}" for r in names)
    means = ", ".join(f"sum(k_{r}) / sum(n) AS m_{r}" for r in names)
    weights = ", ".join(f"CASE WHEN any_value(m_{r}) * (1 - any_value(m_{r})) = 0 THEN 2.0 ELSE least(greatest(any_value(m_{r}) * (1 - any_value(m_{r})) / greatest(avg(pow(k_{r} / n - m_{r}, 2) - m_{r} * (1 - m_{r}) / n), 1e-9) - 1, 2.0), 1000.0) END AS w_{r}, any_value(m_{r}) AS p_{r}" for r in names)
    over = " OR ".join(f"(k_{r} + p_{r} * w_{r}) / (n + w_{r}) > {limit}" for r, limit in quality_rules.HOST_LIMITS.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
q AS (SELECT r, i, x, {_FIVE} FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, x1, x2, x3, x4) AS c FROM q WHERE x4 IS NOT NULL),
a AS (SELECT r, count(DISTINCT i + j) AS again FROM k, range(0, 5) AS s(j) WHERE c > 1 GROUP BY r),
m AS (SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN a ON a.r = w.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS f_base, 10 * n_symbols > word_chars AS f_symbols, 10 * n_dup_lines > 3 * n_lines AS f_lines FROM m),
h AS (SELECT source, count(*) AS n, {counts} FROM f WHERE source IS NOT NULL GROUP BY source),
g AS (SELECT {means} FROM h),
b AS (SELECT {weights} FROM h, g),
bad AS (SELECT source AS bad_source FROM h, b WHERE {over})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed, bad_source IS NOT NULL AS host_rejected, NOT f_base AND bad_source IS NULL AS kept FROM f LEFT JOIN bad ON source = bad_source"""


VECTORS = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
r(id, reach) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^{_SPACE}]+') AS ws FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
q AS (SELECT doc_id, n, i, x, {_FIVE} FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT DISTINCT doc_id, concat_ws(' ', x, x1, x2, x3, x4) AS gram FROM q WHERE i <= greatest(n - 4, 1)),
s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 5 * common >= 4 * (x.size + y.size - common)),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT id, min(reach) AS class_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_links, class_id, doc_id = class_id AS kept FROM documents JOIN c ON c.id = doc_id LEFT JOIN n ON n.a = doc_id"""


def _urls(steps: int = 150) -> str:
    """Rules, and host verdicts by walks of up to so many steps from the seeds."""
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    node = lambda x: f"regexp_replace({x}, '^[^@]*@', '')"
    rules = sorted(url_filter.RULES, key=lambda r: (len(r.name), r.name), reverse=True)
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    chosen = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in rules)
    verdict = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in rules)
    href = url_filter.HREF.replace("'", "''")
    flow = lambda name, a, b: f"{name} AS (SELECT {a} AS src, {b} AS dst, sum(n) AS n FROM (SELECT src, dst, n FROM pairs UNION ALL SELECT src, dst, n FROM above) GROUP BY ALL), {name}_w AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM {name})"
    walk = lambda name, edges, pages: f"{name}(k, host, part) AS (SELECT 0, host, CAST({pages} AS DOUBLE) FROM hosts WHERE {pages} > 0 UNION ALL SELECT k + 1, dst, sum({url_filter.DAMPING} * weight * part) FROM {name} JOIN {edges}_w ON src = host WHERE k < {steps} GROUP BY k, dst), {name}_s AS (SELECT host, sum(part) * (SELECT sum({pages}) FROM hosts) / (SELECT sum(part) FROM {name}) AS score FROM {name} GROUP BY host)"
    return rf"""
WITH RECURSIVE named AS (SELECT page_id, html, coalesce({lower("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {chosen} END AS rule FROM named),
judged AS (SELECT *, CASE {verdict} END AS said, {node("host")} AS node FROM ruled),
hosts AS (SELECT node AS host, count(*) FILTER (said = 'allow') AS allowed, count(*) FILTER (said = 'block') AS blocked FROM judged WHERE host <> '' GROUP BY node),
targets AS (SELECT node AS src, {lower(node("unnest(regexp_extract_all(html, '" + href + "', 1))"))} AS dst FROM judged),
pairs AS (SELECT src, dst, count(*) AS n FROM targets WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
labels AS (SELECT string_split(host, '.') AS l FROM hosts WHERE NOT regexp_matches(host, '^[0-9.:\[\]]*$') AND len(string_split(host, '.')) > 2),
steps AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels)),
above AS (SELECT src, dst, 1 AS n FROM steps UNION ALL SELECT dst, src, 1 FROM steps),
{flow("forth", "src", "dst")}, {flow("back", "dst", "src")},
{walk("trust", "forth", "allowed")}, {walk("distrust", "back", "blocked")},
bad AS (SELECT h.host AS bad_host FROM hosts h LEFT JOIN trust_s t ON t.host = h.host LEFT JOIN distrust_s d ON d.host = h.host WHERE coalesce(d.score, 0) > {url_filter.SUSPECT} * (coalesce(t.score, 0) + coalesce(d.score, 0) + {url_filter.DOUBT}))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bad_host IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM judged LEFT JOIN bad ON node = bad_host"""


ORACLE_SQL = {"op1_host_quality_rules": _rules(), "op2_embedding_dedup": VECTORS, "op6_ngram_jaccard_join": JACCARD, "op7_url_filter": _urls()}
