"""Rules evaluated to a fixpoint, semi-naively: in each round one atom of a body reads only what the last round added.

Each round is one Spark job whose result is written, so plans stay short and a lost executor costs one round.  Rules that
cannot see what the last round's rules derive are left out on the driver, from their patterns alone.  Rules that only say
that a predicate is transitive are closed first, by doubling distances or, in windows, window by window: in rounds, such a
rule derives a pair once for each node between its ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.operators.patterns import KEY, absorbed, either, join_all, natural_join, ordered, scan
from tidegraph.terms import Pattern, Rule, Var

SPO = ["s", "p", "o"]
#: Rows from which a table is not sent to all executors by way of the driver, however small its file is.
WIDE_ROWS = 50_000
#: Pairs that a task hands on at once.
PAIRS = 50_000


def _head(joined: DataFrame, rule: Rule, keep: tuple[str, ...]) -> DataFrame:
    places = [(F.col(t.name) if isinstance(t, Var) else F.lit(t)).alias(n) for n, t in zip(SPO, (rule.head.s, rule.head.p, rule.head.o), strict=True)]
    return joined.select(*keep, *places)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df of so many rows: joined by shuffles if it is wide."""
    return df.hint("merge") if rows > WIDE_ROWS else df


def _first(rule: Rule, known: DataFrame) -> tuple[DataFrame, bool]:
    """What a rule derives from known, a set of facts, and whether that is a set.

    Where the body comes down to one join, a left side whose part of the head fixes the rest of its row makes no pair twice,
    so only rows that others share that part with are made distinct.
    """
    order = ordered(list(rule.body))
    scans, order = absorbed([scan(known, a) for a in rule.body], list(rule.body), order)
    if len(order) != 2:
        return _head(join_all(scans, order), rule, ()), len(order) == 1 and set(scans[order[0]].columns) == set(rule.head.variables())
    left, right = scans[order[0]], scans[order[1]]
    wanted = set(rule.head.variables())
    own = [c for c in left.columns if c in wanted]
    if not own or not set(right.columns) - set(left.columns) <= wanted or not set(left.columns) & set(right.columns):
        return _head(natural_join(left, right), rule, ()), False
    context = known.sparkSession.sparkContext
    right = F.broadcast(right) if right.limit(10 * WIDE_ROWS + 1).count() <= 10 * WIDE_ROWS else right
    marked = scratch.cut(left.withColumn("_n", F.count("*").over(Window.partitionBy(*own))).repartition(4 * context.defaultParallelism, *left.columns), "left")
    made = lambda part: _head(natural_join(part.drop("_n"), right), rule, ())
    once, more = made(marked.filter("_n = 1")), marked.filter("_n > 1")
    return (once if more.isEmpty() else once.unionByName(made(more).distinct())), True


def derive(rules: list[Rule], known: DataFrame, delta: DataFrame, changed: list[Rule] | None = None, static: DataFrame | None = None) -> DataFrame | None:
    """What the rules derive when at least one atom is taken from delta.  changed: the rules that made delta, if rules did.  With static, known and delta have KEY.

    If delta is known itself, each solution of a body is found once and not for each of its atoms.
    """
    if delta is known and static is None:
        parts = [_first(rule, known) for rule in rules]
        out = reduce(DataFrame.unionByName, (p for p, _ in parts))
        return out if len(parts) == 1 and parts[0][1] else out.distinct()
    keep = (KEY,) if static is not None else ()
    parts = []
    for rule in rules:
        body = list(rule.body)
        for i, atom in enumerate(body):
            if changed is not None and not any(atom.may_match(c.head) for c in changed):
                continue
            order = ordered(body, i)
            if static is None:
                joined = join_all([scan(delta if j == i else known, a) for j, a in enumerate(body)], order)
            else:
                joined = scan(delta, atom, keep)
                for j in order[1:]:
                    if delta is known and j < i:  # a keyed fact there is the part before
                        joined = natural_join(joined, scan(static, body[j]))
                        continue
                    joined = either(joined, scan(known, body[j], keep), scan(static, body[j]), len(body))
            parts.append(_head(joined, rule, keep))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def _fed(rules: list[Rule], changed: list[Rule]) -> list[Rule]:
    return [r for r in rules if any(a.may_match(c.head) for a in r.body for c in changed)]


def transitive(rule: Rule) -> str | None:
    """p of a rule {?a p ?b. ?b p ?c} => {?a p ?c}."""
    head = rule.head
    if len(rule.body) != 2 or isinstance(head.p, Var) or head.s == head.o or not isinstance(head.s, Var) or not isinstance(head.o, Var):
        return None
    for x, y in (rule.body, rule.body[::-1]):
        if x == Pattern(head.s, head.p, x.o) and y == Pattern(x.o, head.p, head.o) and isinstance(x.o, Var) and x.o not in (head.s, head.o):
            return head.p
    return None


def doubled(edges: DataFrame) -> DataFrame:
    """s, o of the pairs that edges (s, o), a set, link in two steps or more but not in one.

    With all pairs nearer than 2^k known: those 2^k apart are two of half that distance joined, those beyond, up to 2^(k+1),
    one 2^k apart and one nearer.  So a pair is made once for each node at one distance, and not for each between its ends.
    """
    spark, folder = edges.sparkSession, scratch.fresh(edges.sparkSession, "doubled")
    near, rows = scratch.counted(edges.select("s", "o"), f"{folder}/0")
    near = half = spread(near, rows)
    paths: list[str] = []

    def put(df: DataFrame) -> tuple[DataFrame, int]:
        paths.append(f"{folder}/{len(paths) + 1}")
        return scratch.counted(df, paths[-1])

    def steps(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.select("s", F.col("o").alias("_m")).join(y.select(F.col("s").alias("_m"), "o"), "_m").select("s", "o").distinct()

    while True:
        half, found = put(steps(half, half).join(near, ["s", "o"], "left_anti"))
        if not found:
            break
        half, rows = spread(half, found), rows + found
        _, found = put(steps(half, near).join(spread(near.unionByName(half), rows), ["s", "o"], "left_anti"))
        rows += found
        near = spread(spark.read.schema(edges.schema).parquet(f"{folder}/0", *paths), rows)
    return spark.read.schema(edges.schema).parquet(*paths)


def linked(pairs: list[tuple[str, str]]):
    """The nodes' names, and for each start of some pair (its place, places of the nodes that pairs link it to in two steps or more but not in one)."""
    place: dict[str, int] = {}
    after: dict[int, list[int]] = {}
    for s, o in pairs:
        after.setdefault(place.setdefault(s, len(place)), []).append(place.setdefault(o, len(place)))

    def each():
        for start, direct in after.items():
            seen, todo = set(direct), list(direct)
            while todo:
                for n in after.get(todo.pop(), ()):
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            yield start, seen.difference(direct)

    return list(place), each()


def closed_in_keys(edges: DataFrame) -> DataFrame:
    """KEY, s, o of the pairs that the edges (KEY, s, o) of one key, a set, link in two steps or more but not in one.  A task holds the edges of one key at a time and what one start leads to; pairs are not shuffled."""

    def run(batches):
        from itertools import groupby

        import numpy as np
        import pyarrow as pa

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for key, held in groupby(rows, lambda r: r[0]):
            names, found = linked([r[1:] for r in held])
            names, starts, sizes, ends = pa.array(names, pa.string()), [], [], []

            def batch():
                n = len(ends)
                out = [pa.array(np.full(n, key), pa.int64()), names.take(pa.array(np.repeat(starts, sizes))), names.take(pa.array(np.array(ends)))]
                return pa.RecordBatch.from_arrays(out, names=[KEY, "s", "o"])

            for start, reached in found:
                starts.append(start)
                sizes.append(len(reached))
                ends.extend(reached)
                if len(ends) >= PAIRS:
                    yield batch()
                    starts, sizes, ends = [], [], []
            if ends:
                yield batch()

    by_key = edges.select(F.col(KEY).cast("bigint").alias(KEY), "s", "o").repartition(KEY).sortWithinPartitions(KEY)
    return by_key.mapInArrow(run, f"{KEY} bigint, s string, o string")


def _heads(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """The facts that may equal a head, by their predicates."""
    if any(isinstance(r.head.p, Var) for r in rules):
        return facts
    return facts.filter(F.col("p").isin(sorted({r.head.p for r in rules})))


def _closed(base: DataFrame, rules: list[Rule], static: DataFrame | None) -> tuple[DataFrame | None, list[Rule]]:
    """What transitive rules add that no other rule nor static fact feeds, and the rules left."""
    fit = lambda r, o: o == r or not any(a.may_match(o.head) for a in r.body)
    chosen = {r: p for r in dict.fromkeys(rules) if (p := transitive(r)) and all(fit(r, o) or transitive(o) == p for o in rules)}
    if static is not None:
        chosen = {r: p for r, p in chosen.items() if scan(static, r.body[0]).isEmpty()}
    if not chosen:
        return None, rules
    keep = [] if static is None else [KEY]
    parts = []
    for p in dict.fromkeys(chosen.values()):
        edges = base.filter(F.col("p") == p).select(*keep, "s", "o")
        pairs = doubled(edges) if static is None else scratch.cut(closed_in_keys(edges), "closed")
        parts.append(pairs.select(*keep, "s", F.lit(p).alias("p"), "o"))
    return reduce(DataFrame.unionByName, parts), [r for r in rules if r not in chosen]


def infer(facts: DataFrame, rules: list[Rule], delta: DataFrame | None = None, static: DataFrame | None = None, write: bool = True) -> DataFrame:
    """The facts (s, p, o) that the rules add to facts; those that are there already are not returned.

    delta: the part of facts that is new, if the rest is closed under the rules already.  static: facts without KEY that hold
    for all keys and are closed under the rules; then facts have KEY and so has the result.  write: if not, what rules that
    feed no rule derive is left as a plan, for results that are read once.
    """
    columns = [KEY, *SPO] if static is not None else SPO
    spark, folder = facts.sparkSession, scratch.fresh(facts.sparkSession, "inferred")
    base, rows = scratch.counted(facts.select(*columns).distinct(), scratch.fresh(spark, "facts"))
    base = spread(base, rows)
    if delta is None:
        closed, rest = _closed(base, list(rules), static)
        if closed is not None:
            return closed.unionByName(infer(base.unionByName(closed), rest, static=static)) if rest else closed
        delta = base
    else:
        delta, found = scratch.counted(delta.select(*columns).distinct(), scratch.fresh(spark, "delta"))
        delta = spread(delta, found)
    known, paths, changed, active = base, [], None, list(rules)
    # given facts matter to what is new only if some may equal a head
    given = None if _heads(base, active).isEmpty() else base
    beside = static is not None and not _heads(static, active).isEmpty()
    while active:
        new = derive(active, known, delta, changed, static)
        if new is None:
            break
        if given is not None or paths:
            new = new.join(known if given is not None else spread(spark.read.schema(base.schema).parquet(*paths), rows), columns, "left_anti")
        if beside:
            new = new.join(static.select(*SPO), SPO, "left_anti")
        if not write and not paths and not _fed(rules, active):
            return new
        delta, found = scratch.counted(new, f"{folder}/{len(paths)}")
        if not found:
            break
        paths.append(f"{folder}/{len(paths)}")
        rows += found
        delta, known = spread(delta, found), spread(base.unionByName(spark.read.schema(base.schema).parquet(*paths)), rows)
        changed = active
        active = _fed(rules, changed)
    return spark.read.schema(base.schema).parquet(*paths) if paths else base.limit(0)


def infer_expiring(facts: DataFrame, rules: list[Rule], held: DataFrame | None = None) -> DataFrame:
    """s, p, o, exp of all facts and inferences: a derivation lasts until the first of its facts expires, a fact as long as its longest derivation.  A null exp never expires.

    held: an earlier result that facts are added to; only what they bring about is derived.
    """
    never = (1 << 63) - 1
    top = lambda df: df.groupBy(*SPO).agg(F.max("exp").alias("exp"))
    told = lambda df: df.select(*SPO, F.coalesce("exp", F.lit(never)).cast("bigint").alias("exp"))
    later = lambda found, old: found.join(old.withColumnRenamed("exp", "_old"), SPO, "left").filter("_old is null or exp > _old").select(*SPO, "exp")
    if held is None:
        state = delta = scratch.cut(top(told(facts)), "expiring")
    else:
        before = scratch.cut(told(held), "held")
        delta = scratch.cut(later(top(told(facts)), before), "new")
        state = scratch.cut(top(before.unionByName(delta)), "expiring")
    changed, active = None, list(rules)
    while active:
        parts = []
        for rule in active:
            body = list(rule.body)
            for i, atom in enumerate(body):
                if changed is not None and not any(atom.may_match(c.head) for c in changed):
                    continue
                scans = [scan(delta if j == i else state, a, ("exp",)).withColumnRenamed("exp", f"_exp{j}") for j, a in enumerate(body)]
                ends = [F.col(f"_exp{j}") for j in range(len(body))]
                joined = join_all(scans, ordered(body, i))
                parts.append(_head(joined.withColumn("exp", F.least(*ends) if len(ends) > 1 else ends[0]), rule, ("exp",)))
        if not parts:
            break
        delta, found = scratch.counted(later(top(reduce(DataFrame.unionByName, parts)), state), scratch.fresh(state.sparkSession, "delta"))
        if not found:
            break
        state = scratch.cut(top(state.unionByName(delta)), "expiring")
        changed = active
        active = _fed(rules, changed)
    return state.withColumn("exp", F.nullif("exp", F.lit(never)))


def advance(held: DataFrame, new: DataFrame, now: int, rules: list[Rule]) -> DataFrame:
    """s, p, o, exp after time has come to now: what expires by then goes, with all that rested on it, new facts come in, and only what they bring about is derived.

    held: the result of infer_expiring() or of this.  What lasts needs no second look: a fact's exp is the time until which
    some derivation of it holds whole.
    """
    return infer_expiring(new, rules, held.filter(F.col("exp").isNull() | (F.col("exp") > now)))
