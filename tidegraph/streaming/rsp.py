"""Continuous queries: windows over a stream, rules and a query over window content and static facts, and result streams.

run() replays a whole stream in one plan: every firing is a value of KEY, rules and the query run for all firings at once.
RSPEngine.start() does the same for what each micro-batch of a streaming source makes fire.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from queue import Queue
from threading import Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import scratch
from tidegraph.operators.fixpoint import SPO, infer
from tidegraph.operators.patterns import KEY, Source
from tidegraph.plans.compiler import select
from tidegraph.plans.sparql import Query, parse_query
from tidegraph.sources.n3 import parse_rules
from tidegraph.sources.rdf import facts, parse
from tidegraph.streaming import windows
from tidegraph.terms import FACT, Rule, UnsupportedQuery

R2S = ("rstream", "istream", "dstream")
#: Predicates of static facts that are looked at one by one.
STATIC_PREDICATES = 200
TICKS, MODES = ("time", "tuple", "batch"), ("single_thread", "multi_thread")


def result_stream(results: DataFrame, fired: DataFrame, kind: str = "rstream", before: DataFrame | None = None) -> DataFrame:
    """KEY and rows: all results of each firing, those that the firing before didn't have (istream), or those of the firing before that are gone (dstream, each once).

    before: results of a firing that came earlier than all of fired, without KEY.
    """
    if kind not in R2S:
        raise ValueError(f"kind is one of {R2S}")
    if kind == "rstream":
        return results
    rows = [c for c in results.columns if c != KEY]
    order = windows.previous_ticks(fired, KEY).select(F.col("prev").alias("_now"), F.col("t").alias("_next"))
    shifted = results.join(order, F.col(KEY) == F.col("_now")).select(F.col("_next").alias(KEY), *rows)
    if before is not None:
        shifted = shifted.unionByName(before.crossJoin(fired.agg(F.min(KEY).alias(KEY))).select(KEY, *rows))
    new, old = (results, shifted) if kind == "istream" else (shifted.distinct(), results)
    other = old.select(*(F.col(c).alias(f"_r_{c}") for c in old.columns)).distinct()
    same = F.lit(True)
    for c in new.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return new.join(other, same, "left_anti")


@dataclass
class RSPBuilder:
    """A continuous query; window and query are needed, the rest has defaults."""

    spark: SparkSession
    width: int
    slide: int
    strategies: tuple[str, ...] = ("window_close",)
    period: int = 1
    static: DataFrame | None = None
    rules: list[Rule] = field(default_factory=list)
    text: str | None = None
    stream: str = "rstream"
    consumer: Callable[[DataFrame, int], None] | None = None
    tick: str = "time"
    syntax: str = "ntriples"
    mode: str = "single_thread"
    relation: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None

    def add_report_strategy(self, *names: str, period: int = 1) -> RSPBuilder:
        self.strategies, self.period = names, period
        return self

    def add_tick(self, tick: str) -> RSPBuilder:
        """'time': a time reports when it first arrives; 'tuple': each event may report; 'batch': each micro-batch reports its last window only."""
        if tick not in TICKS:
            raise ValueError(f"tick is one of {TICKS}")
        self.tick = tick
        return self

    def add_syntax(self, syntax: str) -> RSPBuilder:
        """The syntax of static facts given as text from now on."""
        self.syntax = syntax
        return self

    def set_operation_mode(self, mode: str) -> RSPBuilder:
        """Of push(): 'single_thread' evaluates in add(), 'multi_thread' in a thread of its own."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        self.mode = mode
        return self

    def add_r2r(self, relation: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> RSPBuilder:
        """In place of rules and query: (firings, window content, static facts) to a DataFrame with KEY."""
        self.relation = relation
        return self

    def add_triples(self, data: str | DataFrame, syntax: str | None = None) -> RSPBuilder:
        new = (facts(self.spark, data, syntax or self.syntax) if isinstance(data, str) else data).select(*SPO)
        self.static = new if self.static is None else self.static.unionByName(new)
        return self

    def add_rules(self, rules: str | list[Rule]) -> RSPBuilder:
        self.rules += parse_rules(rules) if isinstance(rules, str) else rules
        return self

    def add_query(self, text: str) -> RSPBuilder:
        self.text = text
        return self

    def add_r2s(self, kind: str) -> RSPBuilder:
        self.stream = kind
        return self

    def add_consumer(self, consumer: Callable[[DataFrame, int], None]) -> RSPBuilder:
        self.consumer = consumer
        return self

    def build(self) -> RSPEngine:
        if self.text is None and self.relation is None:
            raise ValueError("a query is needed")
        if self.tick == "tuple" and "window_close" not in self.strategies:
            raise UnsupportedQuery("ticks by tuple without reports on window close")
        return RSPEngine(self, parse_query(self.text) if self.text is not None else None)


class RSPEngine:
    def __init__(self, plan: RSPBuilder, query: Query | None):
        self.plan, self.query = plan, query
        base = plan.static.distinct() if plan.static is not None else plan.spark.createDataFrame([], FACT)
        if plan.rules:
            base = base.unionByName(infer(base, plan.rules))
        self.static = scratch.cut(base, "static")
        #: Predicates of static facts, or None if they are very many.
        found = self.static.select("p").distinct().limit(STATIC_PREDICATES + 1).collect()
        self.static_predicates = sorted(r.p for r in found) if len(found) <= STATIC_PREDICATES else None

    def apart(self, held: DataFrame) -> DataFrame:
        """held without the static facts; what shares no predicate with them isn't looked for among them."""
        if self.static_predicates is None:
            return held.join(self.static, SPO, "left_anti")
        if not self.static_predicates:
            return held
        may = F.col("p").isin(self.static_predicates)
        among = held.filter(may)
        return held if among.isEmpty() else held.filter(~may).unionByName(among.join(self.static, SPO, "left_anti"))

    def fired(self, events: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(firings, content) of a stream of s, p, o, ts."""
        p = self.plan
        fired = windows.firings(events, p.width, p.slide, p.strategies, p.period)
        held = windows.content(events.select(*SPO, F.col("ts").cast("bigint").alias("ts")), fired, p.width, p.slide)
        if "non_empty" in p.strategies:
            fired = fired.join(held, KEY, "left_semi")
        if "content_change" in p.strategies:
            held = scratch.cut(held, "content")
            fired = windows.changed(fired, held)
            held = held.join(fired, KEY, "left_semi")
        return fired, held

    def evaluate(self, fired: DataFrame, held: DataFrame) -> DataFrame:
        """KEY and the query's columns, for each firing; what rules infer in a window ends with it."""
        if self.plan.relation is not None:
            return self.plan.relation(fired, held, self.static)
        held = scratch.cut(held.select(KEY, *SPO), "content")
        if self.plan.rules:
            held = self.apart(held).unionByName(infer(held, self.plan.rules, static=self.static))
        else:
            held = self.apart(held)
        return select(self.plan.spark, Source(self.static, held, fired.select(KEY), True), self.query)

    def run(self, events: DataFrame) -> DataFrame:
        """KEY and the query's columns for a whole stream (s, p, o, ts).  The last open windows don't report."""
        fired, held = self.fired(events)
        fired = scratch.cut(fired, "firings")
        return result_stream(self.evaluate(fired, held), fired, self.plan.stream)

    def start(self, events: DataFrame, state: str, checkpoint: str, **trigger):
        """A streaming query over a streaming DataFrame (s, p, o, ts); each batch's result goes to the consumer as (DataFrame, batch id).

        What later windows can still need lies in a folder for each batch under state, which must be shared; a batch that is
        run again reads the one before it and gives the same result.  Events older than the newest of the batches before are
        dropped, as windows that held them have reported.
        """
        return events.writeStream.foreachBatch(lambda df, n: self.step(df, n, state)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()

    def step(self, batch: DataFrame, number: int, state: str) -> None:
        p, spark = self.plan, batch.sparkSession
        new = batch.select(*SPO, F.col("ts").cast("bigint").alias("ts"))
        schema = FACT + ", ts bigint"
        held = spark.read.schema(schema).parquet(f"{state}/{number - 1}/events") if number else spark.createDataFrame([], schema)
        last = held.agg(F.max("ts")).first()[0]
        new = new if last is None else new.filter(F.col("ts") >= last)
        stream = scratch.cut(held.unionByName(new).distinct(), "stream")
        fired, content = self.fired(stream)
        fired = fired if last is None else fired.filter(F.col(KEY) > last)
        if p.tick == "batch":
            fired = fired.join(fired.agg(F.max(KEY).alias(KEY)), KEY, "left_semi")
        fired = scratch.cut(fired, "firings")
        results = scratch.cut(self.evaluate(fired, content.join(fired.select(KEY), KEY, "left_semi")), "results")
        names = [c for c in results.columns if c != KEY]
        shape = ", ".join(f"`{c}` {results.schema[c].dataType.simpleString()}" for c in names)
        before = spark.read.schema(shape).parquet(f"{state}/{number - 1}/last") if number else None
        out = result_stream(results, fired, p.stream, before)
        if p.consumer is not None:
            p.consumer(out, number)
        top, end = stream.agg(F.max("ts")).first()[0], fired.agg(F.max(KEY)).first()[0]
        stream.filter(F.col("ts") >= (top or 0) - p.width - 2 * p.slide).write.mode("overwrite").parquet(f"{state}/{number}/events")
        final = results.filter(F.col(KEY) == end).select(*names) if end is not None else before if before is not None else results.select(*names)
        final.write.mode("overwrite").parquet(f"{state}/{number}/last")
        if number > 1:  # the batch before may run again, and then reads the one before it
            scratch.delete(spark, f"{state}/{number - 2}")

    def push(self) -> Push:
        """A stream that events are added to one by one."""
        return Push(self)


class Push:
    """Events added one by one, in order of time; each new time makes what lies before it report to the consumer.

    For feeds that a driver can take in; start() is for the others.  Events of one time go to the engine together.
    """

    def __init__(self, engine: RSPEngine):
        self.engine, self.state = engine, scratch.fresh(engine.plan.spark, "push")
        self.held: list[tuple[str, str, str, int]] = []
        self.now: int | None = None
        self.batches = 0
        self.queue: Queue | None = None
        self.failed: BaseException | None = None
        if engine.plan.mode == "multi_thread":
            self.queue = Queue()
            self.thread = Thread(target=self._work, daemon=True)
            self.thread.start()

    def add(self, triple: str | tuple[str, str, str], ts: int) -> None:
        """triple: terms, or a statement as text, with or without its dot.  An event older than the last is dropped."""
        if self.failed is not None:
            raise self.failed
        s, p, o = parse(triple.rstrip().removesuffix(".") + " .")[0][:3] if isinstance(triple, str) else triple
        if self.now is not None and ts < self.now:
            return
        advanced = self.now is not None and ts > self.now
        self.now = ts
        self.held.append((s, p, o, ts))
        if advanced:
            self.flush()

    def flush(self) -> None:
        rows, self.held = self.held, []
        if rows and self.queue is not None:
            self.queue.put(rows)
        elif rows:
            self._step(rows)

    def _step(self, rows: list[tuple]) -> None:
        self.engine.step(self.engine.plan.spark.createDataFrame(rows, FACT + ", ts bigint"), self.batches, self.state)
        self.batches += 1

    def _work(self) -> None:
        while (rows := self.queue.get()) is not None:
            try:
                self._step(rows)
            except BaseException as e:  # noqa: BLE001  told to the caller by the next add() or stop()
                self.failed = e
                return

    def stop(self) -> None:
        """Evaluate what was added and end; windows that are still open don't report."""
        self.flush()
        if self.queue is not None:
            self.queue.put(None)
            self.thread.join()
        if self.batches:
            scratch.delete(self.engine.plan.spark, self.state)
        if self.failed is not None:
            raise self.failed


def rsp_engine(spark: SparkSession, width: int, slide: int, rules: str, abox: str, query: str, callback: Callable[[list], None]) -> Push:
    """A stream with the usual choices (N-Triples, reports on window close, all results): the callback gets each report's rows."""
    plan = RSPBuilder(spark, width, slide).add_triples(abox).add_rules(rules).add_query(query)

    def tell(df: DataFrame, _: int) -> None:
        rows = df.orderBy(KEY).drop(KEY).collect()
        if rows:
            callback(rows)

    return plan.add_consumer(tell).build().push()
