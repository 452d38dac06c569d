"""Jaccard similarity self-join on word n-grams by MinHash banding.

1. Each text becomes a set of hashed n-grams; texts with equal sets are one class.
2. Each class is sketched; bands of the sketch are shuffled as (band hash, class), and classes in one bucket are chained to
   the bucket's smallest, which gives groups of candidates without listing their pairs.
3. The full sets of a group's classes are shipped once and compared in blocks of bounded size, each pair of blocks in one
   task; a task returns link counts and a spanning forest, never pairs.
4. Connected components of the forests are the classes of the result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.blocks import batch_of, groups, links_of
from tidegraph.llm.common import bounded, drop, partitions, read, sieve, sift, small_batches, table, unwrapped, wrapped
from tidegraph.llm.components import components

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: A block has at most about so many classes, and so many n-grams.
BLOCK_CLASSES, BLOCK_GRAMS = 1024, 400_000
WORD_MEMORY = 300_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, stray: float = 0.15) -> tuple[int, int]:
    """(bands, rows): the fewest rows for which pairs at the threshold meet in a band with probability ``recall`` and those at half of it with at most ``stray``."""
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= stray:
            break
    return bands, rows


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a text of fewer words, but one at least, has one n-gram of all its words."""

    def __init__(self, n: int = N):
        self.n = n
        self.words: dict[str, int] = {}
        self.powers = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(n)], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > WORD_MEMORY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        x = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            x += h[i : len(h) - n + 1 + i] * self.powers[i]
            x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return np.unique(x)


def sketch(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """For each non-empty set its band hashes (bands columns, the band's number mixed in)."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.empty((len(sets), bands), np.uint64)
    i = 0
    while i < len(sets):
        j, size = i + 1, len(sets[i])
        while j < len(sets) and size + len(sets[j]) <= 32_768:
            size += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64)
        for k in range(bands):
            h = np.full(j - i, k + 1, np.uint64)
            for m in range(k * rows, (k + 1) * rows):
                low = np.minimum.reduceat((x * a[m] + b[m]) >> np.uint64(32), at)
                h = (h ^ low) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[i:j, k] = h
        i = j
    return out.view(np.int64)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the n-grams that two sets or more have, in slices of bounded width."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1] if shared.any() else column[:0]
    out = np.zeros((n, n), np.float64)
    width = max(256, 4_000_000 // n)
    top = int(column.max()) + 1 if len(column) else 0
    for lo in range(0, top, width):
        part = (column >= lo) & (column < lo + width)
        m = np.zeros((n, min(width, top - lo)), np.float32)
        m[owner[part], column[part] - lo] = 1
        out += m @ m.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _sketched(n: int, bands: int, rows: int):
    def run(batches):
        own = Shingler(n)
        for batch in batches:
            sets = [own(x) for x in batch.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            found = iter(sketch(full, bands, rows)) if full else iter(())
            rows_of = [(xxhash.xxh3_128_digest(s.tobytes()), len(s), next(found)) if len(s) else (None, 0, None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows_of, strict=True) if rows_of else [[]] * 3, (pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True))], ["doc_id", "sum", "digest", "grams", "bands"])

    return run


def _sets(n: int):
    def run(batches):
        own = Shingler(n)
        for batch in batches:
            sets = [own(x).tobytes() for x in batch.columns[-1].to_pylist()]
            same = [xxhash.xxh3_128_digest(x) == d for x, d in zip(sets, batch.columns[-2].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sets, pa.binary())], [*batch.schema.names[:-2], "grams"]).filter(pa.array(same, pa.bool_()))

    return run


def _verify(threshold: float):
    least = Fraction(str(threshold))

    def run(batches):
        out: list[tuple] = []
        for (_, i, j), rows in groups(batches, 3):
            rows.sort(key=lambda r: (r[0] != i, r[1]))
            ids, sets = [r[1] for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows]
            both = intersections(sets)
            size = np.array([len(s) for s in sets], np.float64)
            linked = both * least.denominator >= (size[:, None] + size[None, :] - both) * least.numerator
            np.fill_diagonal(linked, False)
            if i != j:
                first = np.array([r[0] == i for r in rows])
                linked &= first[:, None] != first[None, :]
            out += links_of(ids, np.array([r[2] for r in rows], np.int64), linked)
            if len(out) > 10_000:
                yield batch_of(out, ["node", "links", "root"], [pa.int64()] * 3)
                out = []
        yield batch_of(out, ["node", "links", "root"], [pa.int64()] * 3)

    return run


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, sum (a hash of text), n_links, class_id, kept of each document (doc_id, text); see jaccard_join()."""
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = bands_for(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("sum"), "text")
    marked = table(texts.mapInArrow(_sketched(n, bands, rows), "doc_id bigint, sum bigint, digest binary, grams bigint, bands array<bigint>"), "sketches")
    usable = marked.filter("digest is not null and doc_id is not null")
    first = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "sum", "grams", "bands")).alias("m"), F.count("*").alias("n"))
    # a class is known by its place in this table, as two of them can stand for texts of one doc_id
    classes = table(first.select("digest", F.col("m.doc_id").alias("rep"), F.col("m.sum").alias("rep_sum"), "n", F.col("m.grams").alias("n_grams"), F.col("m.bands").alias("bands"), F.monotonically_increasing_id().alias("node")), "classes")

    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = table(banded.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("size")).filter("size > 1").select(F.col("band").alias("bucket"), "head"), "buckets")
    banded = sift(banded, "band", sieve(buckets, "bucket"))
    chained = banded.join(buckets.hint("merge"), banded.band == buckets.bucket).filter("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    found = table(components(chained), "candidates")
    members = found.select(F.col("id").alias("member"), "component").unionByName(found.select(F.col("component").alias("member"), "component").distinct())
    weighed = table(members.join(classes.hint("merge"), members.member == classes.node).select("node", "rep", "rep_sum", "component", "n", "digest", "n_grams"), "members")
    sizes = table(weighed.groupBy(F.col("component").alias("of")).agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks")), "sizes")
    placed = weighed.join(bounded(sizes.filter("blocks > 1")), F.col("component") == F.col("of"), "left").select("node", "rep", "rep_sum", "component", "n", "digest", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    placed = table(placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "placed")

    # one text for each class, however often its row is repeated
    texts = sift(texts, "doc_id", sieve(placed, "rep"))
    own = texts.join(placed.hint("merge"), (texts.doc_id == placed.rep) & (texts["sum"] == placed.rep_sum))
    own = own.groupBy("rep", "rep_sum", "node", "component", "blocks", "block", "n", "digest").agg(F.first("text").alias("text"))
    sets = own.select("component", "blocks", "block", "node", "n", "digest", "text").mapInArrow(_sets(n), "component bigint, blocks int, block int, node bigint, n bigint, grams binary")
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "grams")
    tasks = paired.repartition(partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = table(tasks.mapInArrow(_verify(threshold), "node bigint, links bigint, root bigint"), "links")

    joined = table(components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("member"), F.col("component").alias("into")), "joined")
    counts = links.groupBy(F.col("node").alias("of")).agg(F.sum("links").alias("links"))
    placed_in = classes.select("digest", "node", "rep", "rep_sum", "n").join(counts.hint("merge"), F.col("node") == F.col("of"), "left").join(joined.hint("merge"), F.col("node") == F.col("member"), "left")
    placed_in = table(placed_in.select("digest", "rep", "rep_sum", F.coalesce("into", "node").alias("into"), F.col("of").isNotNull().alias("met"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "grouped")
    heads = table(placed_in.filter("met").groupBy(F.col("into").alias("head")).agg(F.min(F.struct("rep", "rep_sum")).alias("best")), "heads")
    labelled = placed_in.join(heads.hint("merge"), F.col("met") & (F.col("into") == F.col("head")), "left").withColumn("best", F.coalesce("best", F.struct("rep", "rep_sum")))
    labelled = table(labelled.select(F.col("digest").alias("of"), F.col("best.rep").alias("class_id"), F.col("best.rep_sum").alias("class_sum"), "n_links"), "labelled")
    drop(buckets, found, weighed, sizes, placed, links, joined, classes, placed_in, heads)
    together = usable.select("doc_id", "sum", "digest").join(labelled.hint("merge"), F.col("digest") == F.col("of"))
    together = together.select("doc_id", "sum", "n_links", "class_id", ((F.col("doc_id") == F.col("class_id")) & (F.col("sum") == F.col("class_sum"))).alias("kept"))
    alone = marked.filter("digest is null or doc_id is null").select("doc_id", "sum", F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return together.unionByName(alone)


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, n_links, class_id, kept of each row (doc_id, text).

    Words are what white space separates, as they stand.  n_links: the other rows whose n-gram sets have a Jaccard
    similarity of at least ``threshold``, copies counted each; class_id: the smallest doc_id reachable by links; kept: it is
    the document's own, and of several texts with that doc_id in the class this is the one with the smallest hash.  A text
    that is null or has no word links with nothing; one with fewer than n words counts as one n-gram.  Rows with a null
    doc_id are returned unlinked.  Rows that share a doc_id but not the text are documents each; rows that share both
    count each and are judged alike.  Other columns are not looked at.
    """
    return linked(docs, n, threshold, recall).drop("sum")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class; rows equal in doc_id and text stay or go together.  Only rows that go, and the few that the sieve can't tell from them, are shuffled."""
    gone = table(linked(docs).filter("not kept").select(F.col("doc_id").alias("doc"), F.col("sum").alias("of"), F.xxhash64("doc_id", "sum").alias("mark")).distinct(), "gone")
    among = sieve(gone, "mark")
    rows = wrapped(docs, id=F.col("doc_id").cast("bigint"), sum=F.xxhash64("text")).withColumn("key", F.xxhash64("id", "sum"))
    hit = sift(rows, "key", among).join(gone.hint("merge"), (F.col("id") == F.col("doc")) & (F.col("sum") == F.col("of")), "left_anti")
    return unwrapped(hit.select("row").unionByName(sift(rows, "key", among, inside=False).select("row")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))
