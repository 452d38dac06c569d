"""Sliding windows over logical integer time, as closed forms rather than an event loop.

Events have ts (bigint, in order) and any other columns.  Neighbouring ticks are found per bucket of time: only one row for
each bucket meets in one task, not one for each tick.  Content is an equi-join on the closing time, not a range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.patterns import KEY

#: Ticks to a bucket.
BUCKET = 4096
STRATEGIES = ("window_close", "non_empty", "content_change", "periodic")


def previous_ticks(events: DataFrame, column: str = "ts") -> DataFrame:
    """t, prev of each distinct time but the first: the time before it."""
    ticks = events.select(F.col(column).cast("bigint").alias("t")).filter("t is not null").distinct().withColumn("_b", F.floor(F.col("t") / BUCKET))
    last = ticks.groupBy("_b").agg(F.max("t").alias("_last"))
    last = last.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_last"))
    inside = ticks.withColumn("_prev", F.lag("t").over(Window.partitionBy("_b").orderBy("t")))
    return inside.join(last, "_b").select("t", F.coalesce("_prev", "_last").alias("prev")).filter("prev is not null")


def _down(x, step: int):
    return (F.floor(x / F.lit(step)) * step).cast("bigint")


def firings(events: DataFrame, width: int, slide: int, strategies: tuple[str, ...] = ("window_close",), period: int = 1) -> DataFrame:
    """fire, open, close: the window that each arriving time reports, if any.  Windows close at multiples of slide and include both ends; the arriving time's own events are not in.

    All strategies must hold: window_close (the window lies behind), non_empty, content_change (content differs from the last
    report's, see content()), periodic (the time is a multiple of period).
    """
    if not strategies or set(strategies) - set(STRATEGIES):
        raise ValueError(f"strategies are some of {STRATEGIES}")
    t, p = F.col("t"), F.col("prev")
    ticks = previous_ticks(events)
    if "window_close" in strategies:
        close, holds = F.least(_down(t - 1, slide), _down(p + width, slide)), F.col("close") >= F.col("prev")
    elif "non_empty" in strategies:
        close, holds = _down(p + width, slide), F.col("close") >= F.col("prev")
    else:
        close, holds = _down(t + width, slide), F.lit(True)
    if "periodic" in strategies:
        holds = holds & (F.pmod(t, F.lit(period)) == 0)
    found = ticks.withColumn("close", close).filter(holds)
    return found.select(F.col("t").alias(KEY), F.greatest(F.col("close") - width, F.lit(0)).cast("bigint").alias("open"), F.col("close"))


def content(events: DataFrame, fired: DataFrame, width: int, slide: int) -> DataFrame:
    """KEY and the events' columns but ts: what each reported window holds, as a set."""
    rest = [c for c in events.columns if c != "ts"]
    first = F.ceil(F.col("ts") / F.lit(slide)) * slide
    closes = F.sequence(first.cast("bigint"), _down(F.col("ts") + width, slide), F.lit(slide).cast("bigint"))
    placed = events.filter(first <= _down(F.col("ts") + width, slide)).select(F.explode(closes).alias("close"), "ts", *rest)
    return placed.join(fired.select(KEY, "close"), "close").filter(F.col("ts") < F.col(KEY)).select(KEY, *rest).distinct()


def changed(fired: DataFrame, held: DataFrame) -> DataFrame:
    """The firings whose content differs from that of the firing before."""
    rest = [c for c in held.columns if c != KEY]
    mark = held.groupBy(KEY).agg(F.count("*").alias("_n"), F.expr(f"bit_xor(xxhash64({', '.join(rest)}))").alias("_h"))
    order = previous_ticks(fired, KEY).withColumnsRenamed({"t": KEY, "prev": "_before"})
    both = fired.join(order, KEY, "left").join(mark, KEY, "left")
    before = mark.select(F.col(KEY).alias("_before"), F.col("_n").alias("_m"), F.col("_h").alias("_g"))
    same = F.col("_before").isNotNull() & F.col("_n").eqNullSafe(F.col("_m")) & F.col("_h").eqNullSafe(F.col("_g"))
    return both.join(before, "_before", "left").filter(~same).select(*fired.columns)


def diff(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what came in, what went) between two contents with the same columns; nulls are equal to nulls, repeats count once."""
    return after.subtract(before.select(*after.columns)), before.select(*after.columns).subtract(after)


def triggers(events: DataFrame, width: int, slide: int) -> DataFrame:
    """KEY: the times at which a time window reports, each the first to pass another multiple of slide behind width."""
    step = F.ceil((F.col("ts") - width) / F.lit(slide))
    return events.filter(F.col("ts") > width).groupBy(step.alias("_b")).agg(F.min("ts").cast("bigint").alias(KEY)).select(KEY)


def time_window(events: DataFrame, width: int, slide: int) -> DataFrame:
    """KEY and the events' columns: at each trigger the events of the last width ticks, its own among them, repeats kept."""
    fired = triggers(events, width, slide).withColumn("_c", F.floor(F.col(KEY) / F.lit(width)))
    cell = F.floor(F.col("ts") / F.lit(width))
    placed = events.withColumn("_c", F.explode(F.array(cell, cell + 1)))
    return placed.join(fired, "_c").filter((F.col("ts") <= F.col(KEY)) & (F.col("ts") > F.col(KEY) - width)).select(KEY, *events.columns)


def alive(events: DataFrame, items: list[str], width: int, now: int) -> DataFrame:
    """items, ts of the items whose last insertion is within width of now."""
    return events.filter(F.col("ts") <= now).groupBy(*items).agg(F.max("ts").alias("ts")).filter(F.col("ts") > now - width)


# the state of a set window: items and ts, the time of an item's last insertion


def _later(df: DataFrame, items: list[str]) -> DataFrame:
    return df.groupBy(*items).agg(F.max("ts").alias("ts"))


def add(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state after inserting; an item that is held gets the later time."""
    return _later(state.unionByName(new.select(*state.columns)), [c for c in state.columns if c != "ts"])


def add_without_update(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state after inserting the items that aren't held; those that are keep their time."""
    items = [c for c in state.columns if c != "ts"]
    return state.unionByName(_later(new.select(*state.columns), items).select(*state.columns).join(state, items, "left_anti"))


def add_after(state: DataFrame, anchor: DataFrame, new: DataFrame) -> DataFrame:
    """The state after inserting items at the time of an item that is held; where it isn't, nothing comes in.  anchor: one row with the item's columns; new: rows with them."""
    items = [c for c in state.columns if c != "ts"]
    time = state.join(anchor.select(*items), items, "left_semi").agg(F.max("ts").alias("ts")).filter("ts is not null")
    return add(state, new.select(*items).crossJoin(F.broadcast(time)))


def add_in_between(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state after inserting items whose times lie between those held; items that are held keep the later time."""
    return add(state, new)


def time_stamp(state: DataFrame, item: DataFrame) -> int | None:
    """When an item (one row) was last inserted, or None."""
    items = [c for c in state.columns if c != "ts"]
    row = state.join(item.select(*items), items, "left_semi").agg(F.max("ts").alias("ts")).first()
    return row.ts


def remove_old(state: DataFrame, width: int, now: int) -> DataFrame:
    """The state without what was inserted width or more before now."""
    return state.filter(F.col("ts") > now - width)


def new_and_old(events: DataFrame, items: list[str], width: int, slide: int) -> DataFrame:
    """KEY, items, change: at each trigger the items that came in since the last one ('new') and those that expired at it ('old').

    An insertion of an item that is still held refreshes it and isn't new; held means inserted within width of the last
    trigger or after it.
    """
    fired = triggers(events, width, slide)
    by = Window.partitionBy(*items).orderBy("ts")
    rows = events.select(*items, F.col("ts").cast("bigint").alias("ts")).distinct().withColumn("_next", F.lead("ts").over(by))

    # the trigger of an insertion: the first at or after it; of an expiry: the first at or after ts + width
    def first_at(df: DataFrame, time, name: str) -> DataFrame:
        points = df.select(time.alias("_t")).distinct().unionByName(fired.select(F.col(KEY).alias("_t"))).distinct().withColumn("_b", F.floor(F.col("_t") / BUCKET))
        own = points.join(fired.select(F.col(KEY).alias("_t"), F.col(KEY).alias("_f")), "_t", "left")
        here = own.withColumn("_at", F.min("_f").over(Window.partitionBy("_b").orderBy("_t").rowsBetween(0, Window.unboundedFollowing)))
        heads = own.groupBy("_b").agg(F.min("_f").alias("_h"))
        heads = heads.select("_b", F.min("_h").over(Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("_h"))
        found = here.join(heads, "_b").select(F.col("_t"), F.coalesce("_at", "_h").alias(name))
        return df.withColumn("_t", time).join(found, "_t").drop("_t")

    out = first_at(first_at(rows, F.col("ts"), "_in"), F.col("ts") + width, "_out")
    went = F.col("_out").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("_out")))
    out = out.withColumn("_gone", F.when(went, F.col("_out"))).withColumn("_fresh", F.lag(F.struct("_gone")).over(by))
    fresh = F.col("_fresh").isNull() | F.col("_fresh._gone").isNotNull()
    return out.filter(fresh & F.col("_in").isNotNull()).select(F.col("_in").alias(KEY), *items, F.lit("new").alias("change")).unionByName(out.filter("_gone is not null").select(F.col("_gone").alias(KEY), *items, F.lit("old").alias("change")))
