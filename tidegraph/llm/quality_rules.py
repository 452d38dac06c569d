"""Quality rules by document and by host.

Documents are measured where they lie; only failure counts by host are shuffled.  Each rule's failure rate of a host is
shrunk towards the rate of all hosts by a beta prior fitted to the hosts' rates, and hosts whose shrunk rate of a rule is
over its limit lose all their documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import bounded, read, small_batches, table, unwrapped, wrapped

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: The rules, and the share of a host's documents that may fail each.
HOST_LIMITS = {"base": 0.5, "symbols": 0.5, "lines": 0.5}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[str]) -> int:
    """Words inside 5-word windows that the text has twice or more.  Windows are compared exactly: ranks of pairs, of pairs of pairs, and of those with a fifth word."""
    n = len(words) - 4
    if n < 2:
        return 0
    if n < 200:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) == n:
            return 0
    seen: dict[str, int] = {}
    one = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    rank = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
    two = rank(one[:-1], one[1:])
    five = rank(rank(two[:-2], two[2:])[:n], one[4:])
    often = np.bincount(five)[five] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + 5, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a text; null counts as empty."""
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(map((text or "").count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(words)


def _measured(batches):
    for batch in batches:
        i = batch.schema.get_field_index("_text")
        found = list(zip(*map(measure, batch.column(i).to_pylist()), strict=True)) or [()] * len(MEASURES)
        kept = [j for j in range(batch.num_columns) if j != i]
        yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in kept), *(pa.array(x, pa.int64()) for x in found)], [*(batch.schema.names[j] for j in kept), *(f"_{m}" for m in MEASURES)])


def measured(docs: DataFrame, *columns: Column) -> DataFrame:
    """The given columns and the MEASURES of column text, with a leading underscore."""
    small_batches(docs.sparkSession)
    chosen = docs.select(*columns, F.col("text").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name != "_text"), *(f"_{m} bigint" for m in MEASURES)])
    return chosen.mapInArrow(_measured, schema)


def failures() -> dict[str, Column]:
    c = {m: F.col(f"_{m}") for m in MEASURES}
    return {"base": (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"]), "symbols": 10 * c["n_symbols"] > c["word_chars"], "lines": 10 * c["n_dup_lines"] > 3 * c["n_lines"]}


def rejected_hosts(rows: DataFrame, limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """_bad_host of the hosts over a limit.  rows: _host and the measures.  Rows without a host belong to none.

    The prior of a rule is a beta distribution with the mean of the pooled rate and the variance of the hosts' rates less
    what sampling alone would give (weights of at least 2 and at most 1000 documents).
    """
    fails = failures()
    hosts = table(rows.filter(F.col("_host").isNotNull()).groupBy("_host").agg(F.count("*").alias("n"), *(F.sum(F.when(fails[r], 1).otherwise(0)).alias(f"k_{r}") for r in limits)), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"k_{r}").alias(f"k_{r}") for r in limits)).first()
    over = F.lit(False)
    if total["n"]:
        means = {r: total[f"k_{r}"] / total["n"] for r in limits}
        spread = hosts.agg(*(F.avg(F.pow(F.col(f"k_{r}") / F.col("n") - means[r], 2) - means[r] * (1 - means[r]) / F.col("n")).alias(r) for r in limits)).first()
        for r, limit in limits.items():
            own = means[r] * (1 - means[r])
            weight = min(max(own / max(spread[r], 1e-9) - 1, 2.0), 1000.0) if own else 2.0
            over = over | ((F.col(f"k_{r}") + means[r] * weight) / (F.col("n") + weight) > limit)
    return table(hosts.filter(over).select(F.col("_host").alias("_bad_host")), "rejected_hosts")


def judge(docs: DataFrame, limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, kept of each row of documents (doc_id, text, source).

    A null text counts as empty, so it fails.  A null source is no host.  Repeated rows count and are judged each.  Other
    columns are not looked at.  The measured rows (without texts) are written once and joined to the rejected hosts, which
    are broadcast if they are few and else shuffled, where Spark splits a host with many rows.
    """
    rows = table(measured(docs, F.col("doc_id").alias("_doc"), F.col("source").alias("_host")), "measures")
    bad = rejected_hosts(rows, limits)
    joined = rows.join(bounded(bad), F.col("_host") == F.col("_bad_host"), "left")
    base, host = failures()["base"], F.col("_bad_host").isNotNull()
    return joined.select(F.col("_doc").alias("doc_id"), *(F.col(f"_{m}").alias(m) for m in MEASURES if m != "n_lines"), base.alias("base_failed"), host.alias("host_rejected"), (~base & ~host).alias("kept"))


def _passing(batches):
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = [(len(words := WORD.findall(x or "")), repeat_words(words)) for x in texts]
        yield batch.filter(pa.array([n >= 10 and 100 * again <= 20 * n for n, again in found], pa.bool_()))


def keep_good(docs: DataFrame, limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """The rows of docs, with all their columns, that pass; judged as in judge().  Texts are read twice and never shuffled, unless there are too many rejected hosts to broadcast."""
    bad = rejected_hosts(table(measured(docs, F.col("source").alias("_host")), "measures"), limits)
    rows = wrapped(docs, host=F.col("source")).join(bounded(bad), F.col("host") == F.col("_bad_host"), "left_anti")
    return unwrapped(rows.select("row")).mapInArrow(_passing, docs.schema)


def op1_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))
