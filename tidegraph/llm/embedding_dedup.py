"""Near-duplicate vectors: spherical k-means cells, cosine products in blocks within cells, one vector kept of each group.

Equal vectors of one label are one class first.  Centroids are fitted on a bounded sample; then every class goes to its
nearest centroid's cell and visits each lower-numbered cell whose border is nearer than the link angle, so no linked pair is
missed whatever the centroids.  Cells are compared in pairs of blocks; a task returns link counts and a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.blocks import batch_of, groups, links_of
from tidegraph.llm.common import bounded, drop, partitions, read, small_batches, table
from tidegraph.llm.components import components

COSINE = 0.98
#: Distinct vectors of the largest label to a cell, on average; cells at most (two at least); bytes of the sample that their centroids are fitted on, or one row for each, if that is more.  More cells would have a vector visit more of them.
CELL, MOST_CELLS, SAMPLE_BYTES = 1024, 1024, 16 << 20
BLOCK = 1024


def fit(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows: k centroids (fewer if there are fewer rows), started from evenly spaced rows."""
    k = max(1, min(k, len(vectors)))
    centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(vectors[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(vectors), 8192)])
        total = np.zeros_like(centres)
        np.add.at(total, home, vectors)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centres)
    return centres


def cells(vectors: np.ndarray, centres: np.ndarray, cosine: float) -> list[list[int]]:
    """For each unit row its home cell and then the lower cells to visit.

    If u lives in cell c, v in d and their angle is at most t, then v's distance from the plane between c and d is at most
    sin t: v visits every c for which that holds.
    """
    near = vectors @ centres.T
    home = near.argmax(1)
    apart = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2) if len(centres) <= 512 else np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    gap = near[np.arange(len(near)), home][:, None] - near
    reach = math.sqrt(max(0.0, 1 - cosine * cosine)) if cosine > 0 else 2.0
    visits = (gap <= reach * apart[home] + 1e-9) & (np.arange(len(centres))[None, :] < home[:, None])
    return [[int(h), *map(int, np.flatnonzero(v))] for h, v in zip(home, visits, strict=True)]


def _unit(rows) -> np.ndarray:
    a = np.array(rows, np.float64)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _placed(centres: dict[int, np.ndarray], cosine: float):
    def run(batches):
        for batch in batches:
            ids, labels, counts, vectors = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            by: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by.setdefault(len(v), []).append(i)
            for dim, own in by.items():
                x = np.array([vectors[i] for i in own], np.float64)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                near = cells(unit, centres[dim], cosine) if dim in centres else [[0]] * len(own)
                for i, row, where in zip(own, x, near, strict=True):
                    out += [(labels[i], dim, c, c == where[0], ids[i], counts[i], row.tobytes()) for c in where]
            yield batch_of(out, ["label", "dim", "cell", "home", "node", "n", "vector"], [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()])

    return run


def _compare(cosine: float):
    def run(batches):
        out: list[tuple] = []
        for key, rows in groups(batches, 6):
            guests, i, j = key[3:]
            rows.sort(key=lambda r: (r[0], r[1], r[2]))
            x = np.stack([np.frombuffer(r[4], np.float64) for r in rows])
            size = np.linalg.norm(x, axis=1)
            linked = (x @ x.T) / (size[:, None] * size[None, :]) >= cosine
            linked |= linked.T
            np.fill_diagonal(linked, False)
            if guests or i != j:
                side = np.array([not r[0] if guests else r[1] == i for r in rows])
                linked &= side[:, None] != side[None, :]
            out += links_of([r[2] for r in rows], np.array([r[3] for r in rows], np.int64), linked)
            if len(out) > 10_000:
                yield batch_of(out, ["node", "links", "root"], [pa.int64()] * 3)
                out = []
        yield batch_of(out, ["node", "links", "root"], [pa.int64()] * 3)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row (vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine, in double precision, is at least ``cosine``.  Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different
    lengths.  Rows that repeat a vec_id are vectors each, linked by what they hold and not by their id; a null vec_id links
    with nothing.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("bigint").alias("label"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # doubles beside the key would double its size: equal vectors are told by their digest
    rows = rows.withColumn("digest", F.unhex(F.md5(F.to_json(F.struct("label", F.transform("v", lambda x: x + 0.0).alias("v"))))))
    first = rows.filter("usable").groupBy("digest").agg(F.min(F.struct("vec_id", "label", "v")).alias("m"), F.count("*").alias("n"))
    # a class is known by its place in this table, as two of them can hold vectors of one vec_id
    classes = table(first.select("digest", F.col("m.vec_id").alias("rep"), F.col("m.label").alias("label"), "n", F.col("m.v").alias("v"), F.monotonically_increasing_id().alias("node")), "classes")

    centres: dict[int, np.ndarray] = {}
    for r in classes.groupBy("label", F.size("v").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("most")).collect():
        k = max(2, min(MOST_CELLS, math.ceil(r.most / CELL)))
        size = max(k, min(64 * k, SAMPLE_BYTES // (8 * r.dim)))
        sample = classes.filter(F.size("v") == r.dim).select("v").orderBy(F.xxhash64("digest"), "digest").limit(size).collect()
        centres[r.dim] = fit(_unit([x.v for x in sample]), k)
    placed = table(classes.select("node", "label", "n", "v").mapInArrow(_placed(centres, cosine), "label bigint, dim int, cell int, home boolean, node bigint, n bigint, vector binary"), "cells")
    keys = ["label", "dim", "cell"]
    blocks = lambda c: F.ceil(F.sum(F.when(c, 1).otherwise(0)) / BLOCK).cast("int")
    sizes = table(placed.groupBy(*keys).agg(blocks(F.col("home")).alias("homes"), blocks(~F.col("home")).alias("guests")).filter("homes > 0"), "sizes")
    dealt = placed.join(bounded(sizes), keys)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda guest, i, j: F.struct(guest.alias("guest"), i.alias("i"), j.alias("j"))
    own = F.transform(upto(F.col("homes")), lambda j: pair(F.lit(False), F.least(F.col("block"), j), F.greatest(F.col("block"), j)))
    met = F.transform(upto(F.col("guests")), lambda j: pair(F.lit(True), F.col("block"), j))
    visited = F.transform(upto(F.col("homes")), lambda i: pair(F.lit(True), i, F.col("block")))
    tasks = dealt.withColumn("t", F.explode(F.when(F.col("home"), F.concat(own, met)).otherwise(visited)))
    tasks = tasks.select(*keys, "t.guest", "t.i", "t.j", "home", "block", "node", "n", "vector")
    keys += ["guest", "i", "j"]
    compared = tasks.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    links = table(compared.mapInArrow(_compare(cosine), "node bigint, links bigint, root bigint"), "links")

    joined = table(components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("member"), F.col("component").alias("into")), "joined")
    counts = links.groupBy(F.col("node").alias("of")).agg(F.sum("links").alias("links"))
    grouped = classes.select("digest", "node", "rep", "n").join(counts, F.col("node") == F.col("of"), "left").join(joined, F.col("node") == F.col("member"), "left")
    grouped = table(grouped.select("digest", "rep", F.coalesce("into", "node").alias("into"), F.col("of").isNotNull().alias("met"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "grouped")
    heads = table(grouped.filter("met").groupBy(F.col("into").alias("head")).agg(F.min("rep").alias("least")), "heads")
    labelled = grouped.join(heads, F.col("met") & (F.col("into") == F.col("head")), "left")
    labelled = table(labelled.select(F.col("digest").alias("of"), F.coalesce("least", "rep").alias("component_id"), "n_links"), "labelled")
    drop(classes, placed, sizes, links, joined, grouped, heads)
    linked = rows.filter("usable").select("vec_id", "digest").join(labelled, F.col("digest") == F.col("of")).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
