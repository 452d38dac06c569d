import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegraph.operators.patterns import KEY
from tidegraph.streaming import windows
from tidegraph.streaming.rsp import MODES, R2S, RSPBuilder, result_stream, rsp_engine
from tidegraph.terms import FACT, UnsupportedQuery

EVENT = FACT + ", ts bigint"
IN = "{?a <u:in> ?b. ?b <u:in> ?c} => {?a <u:in> ?c}."


def chain(spark, times):
    return spark.createDataFrame([(f"<u:{i}>", "<u:in>", f"<u:{i + 1}>", t) for i, t in enumerate(times)], EVENT)


def replay(times, width, slide):
    """The windows that an event-by-event run reports on close: {time: (close, indexes)}."""
    held, now, out = {}, 0, {}
    for i, t in enumerate(times):
        closes = [c for c in range((t // slide) * slide, t + width + slide + 1, slide) if c - width <= t <= c]
        if t > now:
            done = [c for c in held if c < t]
            if done:
                out[t] = (max(done), set(held[max(done)]))
            now = t
        held = {c: held.get(c, set()) for c in set(held) | set(closes) if max(0, c - width) <= t <= c}
        for c in held:
            held[c] = held[c] | {i}
    return out


def test_fixture(spark):
    e = chain(spark, range(10))
    fired = windows.firings(e, 10, 2)
    assert sorted((r.fire, r.close) for r in fired.collect()) == [(1, 0), (3, 2), (5, 4), (7, 6), (9, 8)]
    assert sorted((r.fire, r["count"]) for r in windows.content(e, fired, 10, 2).groupBy(KEY).count().collect()) == [(1, 1), (3, 3), (5, 5), (7, 7), (9, 9)]


@pytest.mark.parametrize(("width", "slide", "seed"), [(10, 2, 1), (5, 3, 2), (4, 6, 3)])
def test_windows_are_event_by_event(spark, monkeypatch, width, slide, seed):
    monkeypatch.setattr(windows, "BUCKET", 8)
    r = random.Random(seed)
    times, t = [], 0
    for _ in range(60):
        t += r.choice([0, 0, 1, 1, 2, 7, 20])
        times.append(t)
    e = chain(spark, times)
    fired = windows.firings(e, width, slide)
    got = defaultdict(set)
    for x in windows.content(e, fired, width, slide).collect():
        got[x.fire].add(int(x.s[3:-1]))
    assert {x.fire: (x.close, got[x.fire]) for x in fired.collect()} == replay(times, width, slide)


def test_time_windows(spark):
    e = spark.createDataFrame([(100 + i, i) for i in range(4)], "item int, ts bigint")
    assert sorted(r.item for r in windows.time_window(e, 2, 2).collect()) == [102, 103]
    found = {(r.fire, r.item, r.change) for r in windows.new_and_old(e, ["item"], 2, 2).collect()}
    assert found == {(3, 100 + i, "new") for i in range(4)} | {(3, 100, "old"), (3, 101, "old")}
    again = spark.createDataFrame([(100 + i, i) for i in range(4)] + [(100, 4)], "item int, ts bigint")
    assert {r.item: r.ts for r in windows.alive(again, ["item"], 4, 4).collect()} == {100: 4, 101: 1, 102: 2, 103: 3}


def test_streams_of_results(spark):
    fired = spark.createDataFrame([(1, ), (2, )], "fire bigint")
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, None), (2, "b")], "fire bigint, x string")
    get = lambda k: sorted(((r.fire, r.x) for r in result_stream(rows, fired, k).collect()), key=str)
    assert len(get("rstream")) == 5
    assert get("istream") == sorted([(1, None), (1, "a"), (2, "b"), (2, "b")], key=str)
    assert get("dstream") == [(2, "a")]


def expected(n):
    return n * (n + 1) // 2


def test_replay_with_rules_and_static_facts(spark):
    plan = RSPBuilder(spark, 10, 2).add_rules(IN).add_query("SELECT ?a ?b WHERE {?a <u:in> ?b}").build()
    got = {r.fire: r["count"] for r in plan.run(chain(spark, range(20))).groupBy(KEY).count().collect()}
    assert got == {t: expected(min(t, 11)) for t in range(1, 20, 2)}
    berths = "<q:pier4> <q:part> <q:harbour> ."
    docked = spark.createDataFrame([(f"<b:{i}>", "<q:docks>", "<q:pier4>", i) for i in range(8)], EVENT)
    plan = RSPBuilder(spark, 4, 2).add_triples(berths).add_rules("{?x <q:docks> ?p. ?p <q:part> ?w} => {?x <q:calls> ?w}.").add_query("SELECT ?x ?w WHERE {?x <q:calls> ?w}").build()
    assert {r.fire: r["count"] for r in plan.run(docked).groupBy(KEY).count().collect()} == {1: 1, 3: 3, 5: 5, 7: 5}


def test_long_conjunctions_take_each_pattern_from_either_side(spark):
    static = "<p:1> <q:a> <p:2> . <p:2> <q:b> <p:3> . <p:3> <q:c> <p:4> . <p:4> <q:d> <p:5> ."
    rows = [("<p:1>", "<q:a>", "<p:2>", 0), ("<p:2>", "<q:b>", "<p:9>", 1), ("<p:9>", "<q:c>", "<p:4>", 2), ("<p:7>", "<q:x>", "<p:7>", 9)]
    plan = RSPBuilder(spark, 20, 3).add_triples(static).add_query("SELECT * {?v <q:a> ?w . ?w <q:b> ?x . ?x <q:c> ?y . ?y <q:d> ?z}").build()
    got = {(r.fire, r.x) for r in plan.run(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {(1, "<p:3>"), (9, "<p:3>"), (9, "<p:9>")}


def test_state_of_a_set_window(spark):
    frame = lambda rows: spark.createDataFrame(rows, "item int, ts bigint")
    told = lambda df: {r.item: r.ts for r in df.collect()}
    state, one = frame([(1, 3), (2, 5)]), frame([(1, 0)])
    assert told(windows.add(state, frame([(1, 7), (2, 4), (3, 6)]))) == {1: 7, 2: 5, 3: 6}
    assert told(windows.add_without_update(state, frame([(1, 7), (3, 6), (3, 8)]))) == {1: 3, 2: 5, 3: 8}
    assert told(windows.add_after(state, one, frame([(4, 0), (2, 0)]))) == {1: 3, 2: 5, 4: 3}
    assert told(windows.add_after(state, frame([(9, 0)]), frame([(4, 0)]))) == {1: 3, 2: 5}
    assert told(windows.add_in_between(state, frame([(5, 4)]))) == {1: 3, 2: 5, 5: 4}
    assert windows.time_stamp(state, one) == 3 and windows.time_stamp(state, frame([(9, 0)])) is None
    assert told(windows.remove_old(state, 2, 6)) == {2: 5}
    came, went = windows.diff(state.select("item"), frame([(2, 0), (3, 0), (3, 1)]).select("item"))
    assert [r.item for r in came.collect()] == [3] and [r.item for r in went.collect()] == [1]


@pytest.mark.parametrize("mode", MODES)
def test_events_pushed_one_by_one(spark, mode):
    out = []
    plan = RSPBuilder(spark, 6, 2).set_operation_mode(mode).add_query("SELECT ?a WHERE {?a <u:in> ?b}").add_consumer(lambda df, n: out.extend(map(tuple, df.collect()))).build()
    times = [0, 1, 2, 2, 5, 9, 9, 15]
    push = plan.push()
    for i, t in enumerate(times):
        push.add(f"<u:{i}> <u:in> <u:{i + 1}>." if i % 2 else (f"<u:{i}>", "<u:in>", f"<u:{i + 1}>"), t)
        push.add("<u:late> <u:in> <u:x>", -1)
    push.stop()
    assert sorted(out) == sorted(map(tuple, plan.run(chain(spark, times)).collect())) and out


def test_callbacks_relations_and_ticks(spark):
    told = []
    push = rsp_engine(spark, 4, 2, "{?x <q:docks> ?p. ?p <q:part> ?w} => {?x <q:calls> ?w}.", "<q:pier4> <q:part> <q:harbour> .", "SELECT ?x {?x <q:calls> ?w}", told.append)
    for i in range(4):
        push.add(f"<b:{i}> <q:docks> <q:pier4> .", i)
    push.stop()
    assert [sorted(r.x for r in rows) for rows in told] == [["<b:0>"], ["<b:0>", "<b:1>", "<b:2>"]]
    counts = RSPBuilder(spark, 10, 2).add_r2r(lambda fired, held, static: held.groupBy(KEY).count()).build().run(chain(spark, range(6)))
    assert sorted(map(tuple, counts.collect())) == [(1, 1), (3, 3), (5, 5)]
    out = []
    plan = RSPBuilder(spark, 10, 2).add_tick("batch").add_query("SELECT ?a {?a <u:in> ?b}").add_consumer(lambda df, n: out.extend(r.fire for r in df.select(KEY).distinct().collect())).build()
    push = plan.push()
    push.held = [(f"<u:{i}>", "<u:in>", "<u:x>", i) for i in range(8)]
    push.stop()
    assert out == [7]
    same = RSPBuilder(spark, 10, 2).add_tick("tuple").add_query("SELECT ?a {?a <u:in> ?b}").build().run(chain(spark, [0, 1, 1, 3]))
    assert sorted({r.fire for r in same.collect()}) == [1, 3]
    with pytest.raises(UnsupportedQuery):
        RSPBuilder(spark, 10, 2, ("periodic",)).add_tick("tuple").add_query("SELECT ?a {?a <u:in> ?b}").build()


def test_a_streaming_source(spark, tmp_path):
    """start() on a file stream, a file a batch, gives what replay gives."""
    out, times = [], [0, 1, 2, 2, 5, 6, 9, 15, 16]
    whole = chain(spark, times)
    rows = whole.collect()
    for n, part in enumerate((rows[:3], rows[3:7], rows[7:])):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    plan = RSPBuilder(spark, 6, 2).add_query("SELECT ?a WHERE {?a <u:in> ?b}").add_consumer(lambda df, n: out.extend(map(tuple, df.collect()))).build()
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = plan.start(events, str(tmp_path / "state"), str(tmp_path / "checkpoint"), availableNow=True)
    assert query.awaitTermination(120)
    assert sorted(out) == sorted(map(tuple, plan.run(whole).collect()))


def test_content_change(spark):
    e = spark.createDataFrame([("a", 0), ("a", 2), ("a", 4), ("b", 6), ("b", 8), ("b", 20)], "x string, ts bigint")
    fired = windows.firings(e, 2, 2)
    held = {r.fire: r.held for r in windows.content(e, fired, 2, 2).groupBy(KEY).agg(F.array_sort(F.collect_set("x")).alias("held")).collect()}
    got, before = [], None
    for t in sorted(r.fire for r in fired.collect()):
        if held.get(t, []) != before:
            got.append(t)
        before = held.get(t, [])
    assert sorted(r.fire for r in windows.changed(fired, windows.content(e, fired, 2, 2)).collect()) == got and len(got) < fired.count()


@pytest.mark.parametrize("kind", R2S)
def test_micro_batches_give_what_replay_gives(spark, tmp_path, kind):
    out = []
    plan = RSPBuilder(spark, 6, 2).add_query("SELECT ?a WHERE {?a <u:in> ?b}").add_r2s(kind).add_consumer(lambda df, n: out.extend(map(tuple, df.collect()))).build()
    times = [0, 1, 2, 2, 5, 6, 9, 15, 16]
    whole = chain(spark, times)
    for n, (lo, hi) in enumerate(((0, 3), (3, 7), (7, 9))):
        plan.step(whole.filter(f"cast(substring(s, 4, length(s) - 4) as int) >= {lo} and cast(substring(s, 4, length(s) - 4) as int) < {hi}"), n, str(tmp_path))
    assert sorted(out) == sorted(map(tuple, plan.run(whole).collect()))


def test_content_that_shares_no_predicate_with_static_facts_is_not_sought_among_them(spark):
    """All content used to be shuffled to find what is static, and solutions that can't repeat were made distinct."""
    static = spark.createDataFrame([("<a>", "<is>", "<x>"), ("<b>", "<is>", "<x>")], "s string, p string, o string")
    engine = RSPBuilder(spark, 10, 5).add_triples(static).add_query("SELECT ?c ?m WHERE {?c <did> ?m}").build()
    held = spark.createDataFrame([(3, "<a>", "<did>", "<y>"), (4, "<c>", "<did>", "<y>")], "fire bigint, s string, p string, o string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(engine.apart(held)) and engine.apart(held).count() == 2
    both = held.unionByName(spark.createDataFrame([(3, "<a>", "<is>", "<x>"), (3, "<c>", "<is>", "<x>")], held.schema))
    assert sorted(map(tuple, engine.apart(both).collect())) == [(3, "<a>", "<did>", "<y>"), (3, "<c>", "<is>", "<x>"), (4, "<c>", "<did>", "<y>")]
    fired = spark.createDataFrame([(3,), (4,)], "fire bigint")
    out = engine.evaluate(fired, held)
    assert "Aggregate" not in plan(out) and sorted(map(tuple, out.collect())) == [(3, "<a>", "<y>"), (4, "<c>", "<y>")]
