"""RDF in and out: N-Triples, N-Quads, Turtle, TriG, and relational tables mapped to facts."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.sources.lexer import Cursor
from tidegraph.terms import QUAD, RDF_TYPE, XSD, RdfSyntaxError, Var

SYNTAXES = ("ntriples", "nquads", "turtle", "trig")
_IRI, _BLANK = r"<[^\x00-\x20<>\"{}|^`\\]*>", r"_:[A-Za-z0-9_](?:[\w.\-]*[\w\-])?"
_LITERAL = r"\"(?:[^\"\\\n\r]|\\.)*\"(?:\^\^<[^\x00-\x20<>]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?"
LINE = rf"^\s*({_IRI}|{_BLANK})\s+({_IRI})\s+({_IRI}|{_BLANK}|{_LITERAL})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"


class _Document:
    def __init__(self, text: str, syntax: str):
        self.c, self.syntax, self.rows, self.blanks = Cursor(text), syntax, [], 0
        self.written = {t for kind, t, _ in self.c.items if kind == "blank"}

    def fresh(self) -> str:
        """A label that the document doesn't use itself."""
        while True:
            self.blanks += 1
            if f"_:g{self.blanks}" not in self.written:
                return f"_:g{self.blanks}"

    def node(self, g):
        """A subject or object, with blank node property lists and collections."""
        if self.c.take("["):
            node = self.fresh()
            if not self.c.take("]"):
                self.properties(node, g)
                self.c.need("]")
            return node
        if self.c.take("("):
            items = []
            while not self.c.take(")"):
                items.append(self.node(g))
            rdf, rest = RDF_TYPE.removesuffix("type>"), RDF_TYPE.replace("type>", "nil>")
            for item in reversed(items):
                node = self.fresh()
                self.rows += [(node, rdf + "first>", item, g), (node, rdf + "rest>", rest, g)]
                rest = node
            return rest
        term = self.c.term()
        if isinstance(term, Var):
            raise RdfSyntaxError("variables have no place in data")
        return term

    def properties(self, s, g) -> None:
        while True:
            p = self.c.term()
            if isinstance(p, Var) or not p.startswith("<"):
                raise RdfSyntaxError(f"a predicate expected, not {p}")
            self.rows.append((s, p, self.node(g), g))
            while self.c.take(","):
                self.rows.append((s, p, self.node(g), g))
            if not self.c.take(";"):
                return
            while self.c.take(";"):
                pass
            if self.c.text in (".", "]", "}"):
                return

    def triples(self, g) -> None:
        bare = self.c.text == "["
        s = self.node(g)
        if s.startswith('"'):
            raise RdfSyntaxError("a literal can't be a subject")
        if not (bare and self.c.text in (".", "}")):
            self.properties(s, g)

    def read(self) -> list[tuple]:
        c = self.c
        while c.kind != "end":
            if c.take("@PREFIX"):
                c.prefix(True)
            elif c.take("PREFIX"):
                c.prefix(False)
            elif c.take("@BASE"):
                c.base = c.iri()[1:-1]
                c.need(".")
            elif self.syntax == "trig" and (c.text == "{" or c.take("GRAPH") or c.at + 1 < len(c.items) and c.items[c.at + 1][1] == "{"):
                g = None if c.text == "{" else c.term()
                c.need("{")
                while not c.take("}"):
                    self.triples(g)
                    c.take(".")
            else:
                self.triples(None)
                c.need(".")
        return self.rows


def scoped(quad: tuple, scope: str) -> tuple:
    """A quad whose blank nodes belong to the document named by scope."""
    return tuple(f"_:d{scope}_{t[2:]}" if t is not None and t.startswith("_:") else t for t in quad)


def parse(text: str, syntax: str = "ntriples", scope: str = "") -> list[tuple[str, str, str, str | None]]:
    """The quads of one document; RdfSyntaxError if any of it can't be read.  With a scope, blank nodes are told apart from those of other scopes; without, labels stay as written."""
    rows = _quads(text, syntax)
    return [scoped(r, scope) for r in rows] if scope else rows


def _quads(text: str, syntax: str) -> list[tuple[str, str, str, str | None]]:
    if syntax not in SYNTAXES:
        raise ValueError(f"syntax is one of {SYNTAXES}")
    if syntax in ("turtle", "trig"):
        return _Document(text, syntax).read()
    c, out = Cursor(text), []
    while c.kind != "end":
        terms = []
        while not c.take("."):
            if c.kind in ("name", "word", "number", "var"):
                raise RdfSyntaxError(f"{c.text!r} has no place in {syntax}")
            terms.append(c.term())
        if len(terms) not in ((3,) if syntax == "ntriples" else (3, 4)) or terms[0].startswith('"') or not terms[1].startswith("<"):
            raise RdfSyntaxError(f"not a statement: {terms}")
        out.append((*terms[:3], terms[3] if len(terms) == 4 else None))
    return out


def facts(spark: SparkSession, text: str, syntax: str = "ntriples", scope: str | None = None) -> DataFrame:
    """s, p, o, g of a document given as text; each quad once.  Blank nodes are the document's own, unless scope says otherwise ("": labels as written)."""
    own = hashlib.md5(text.encode()).hexdigest()[:16] if scope is None else scope
    return spark.createDataFrame(parse(text, syntax, own), QUAD).distinct()


def read_rdf(spark: SparkSession, path: str, syntax: str = "ntriples", one_document: bool = False) -> DataFrame:
    """s, p, o, g of the files at path; each quad once.

    Blank nodes belong to their file.  With one_document all files are parts of one, as write_rdf() leaves them, and labels
    stay as written (line formats only: a Turtle or TriG document is one file).
    The line formats are split by line and stay in the JVM; a line that isn't a statement fails the job when it is read.
    Turtle and TriG documents are parsed whole, one per task.
    """
    if syntax in ("ntriples", "nquads"):
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
        part = lambda i: F.regexp_extract("value", LINE, i)
        fits = F.col("value").rlike(LINE) & (F.lit(syntax == "nquads") | (part(4) == ""))
        bad = F.raise_error(F.concat(F.lit("not a statement: "), F.substring("value", 1, 200))).cast("string")
        scope = F.concat(F.lit("_:d"), F.substring(F.md5("file"), 1, 16), F.lit("_"))
        own = (lambda t: t) if one_document else lambda t: F.when(t.startswith("_:"), F.concat(scope, F.substring(t, 3, 1 << 30))).otherwise(t)
        return lines.select(own(F.when(fits, part(1)).otherwise(bad)).alias("s"), part(2).alias("p"), own(part(3)).alias("o"), own(F.nullif(part(4), F.lit(""))).alias("g")).distinct()
    if syntax not in SYNTAXES:
        raise ValueError(f"syntax is one of {SYNTAXES}")
    whole = spark.read.text(path, wholetext=True).select("value", F.substring(F.md5("_metadata.file_path"), 1, 16).alias("scope"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([r for text, scope in zip(frame["value"], frame["scope"], strict=True) for r in parse(text, syntax, scope)], columns=["s", "p", "o", "g"], dtype=object)

    return whole.mapInPandas(run, QUAD).distinct()


def statements(df: DataFrame) -> DataFrame:
    """value: a line for each fact, N-Triples, or N-Quads where g is there and not null."""
    g = F.col("g") if "g" in df.columns else F.lit(None).cast("string")
    return df.select(F.concat(F.concat_ws(" ", "s", "p", "o", g), F.lit(" .")).alias("value"))


def write_rdf(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    statements(df).write.mode(mode).text(path)


def typed(column: Column, kind: str) -> Column:
    """A column of a table as a literal; null stays null."""
    name = {"int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime"}.get(kind)
    if name is None and kind.startswith("decimal"):
        name = "decimal"
    text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if kind == "timestamp" else column.cast("string")
    for raw, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")) if name is None else ():
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{name}>' if name else '"'))


def direct_mapping(df: DataFrame, name: str, key: str, columns: list[str], links: dict[str, str] | None = None, graph: Column | None = None) -> DataFrame:
    """Facts of a table: row -> <urn:t:name/key>, column -> <urn:t:name#column>, value -> literal, or in links (column: table) the row it names.

    One pass over the table: each row explodes to its facts; nulls give none.
    """
    kinds, links = dict(df.dtypes), links or {}
    value = lambda c: F.concat(F.lit(f"<urn:t:{links[c]}/"), F.col(c).cast("string"), F.lit(">")) if c in links else typed(F.col(c), kinds[c])
    pairs = F.array(*(F.struct(F.lit(f"<urn:t:{name}#{c}>").alias("p"), value(c).alias("o")) for c in columns))
    subject = F.concat(F.lit(f"<urn:t:{name}/"), F.col(key).cast("string"), F.lit(">"))
    return df.select(subject.alias("s"), F.explode(pairs).alias("x"), (graph if graph is not None else F.lit(None).cast("string")).alias("g")).filter("x.o is not null").select("s", "x.p", "x.o", "g")


def parse_lines(text: str):
    """(facts as rows, rules) of the short line format: a fact or a rule a line, ``a in b.`` and ``{?x in ?y. ?y in ?z} => {?x in ?z}``.  A bare word w is the IRI ``<w>``; a dot inside one is part of it."""
    from tidegraph.terms import Pattern, Rule

    word = re.compile(r'<[^>]*>|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z\-]+)?|_:\w+|\?\w+|[^\s{}<>"?]+?(?=\.?(?:[\s}]|$))')

    def atoms(part: str) -> list[Pattern]:
        out = []
        for piece in re.split(r"\.(?=\s|$)", part.strip()):
            if piece.strip():
                found = word.findall(piece)
                if len(found) != 3 or word.sub("", piece).strip():
                    raise RdfSyntaxError(f"not three terms: {piece.strip()!r}")
                out.append(Pattern(*(Var(t[1:]) if t[0] == "?" else t if t[0] in '<"' or t[:2] == "_:" else f"<{t}>" for t in found)))
        return out

    rows, rules = [], []
    for line in text.split("\n"):
        if "=>" in line:
            m = re.fullmatch(r"\s*\{(.*)\}\s*=>\s*\{(.*)\}\s*\.?\s*", line)
            if not m:
                raise RdfSyntaxError(f"not a rule: {line.strip()!r}")
            rules += [Rule(tuple(atoms(m[1])), h) for h in atoms(m[2])]
        else:
            found = atoms(line)
            if any(a.variables() for a in found):
                raise RdfSyntaxError(f"a fact has no variables: {line.strip()!r}")
            rows += [(a.s, a.p, a.o, None) for a in found]
    return rows, rules
