"""Quality and toxicity classifier from weak labels.

Heuristic labellers vote on every document, and so does the ``labels`` table where it has the document.  How often each
combination of votes occurs over all documents is all that expectation-maximisation needs to estimate each labeller's
accuracies, that table's among them; the number of combinations is bounded by the labellers.  Posterior labels of a bounded
sample, one half of it rows that the table doesn't have, train two hashed linear scorers (junk, toxic), which then score every
document.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import drop, read, small_batches, table

#: Log odds above which a document is rejected, as junk and as toxic: a toxic one that stays costs twice a clean one that goes.
REJECT_ABOVE = (0.0, -0.7)
#: Hash buckets of the scorers.
BUCKETS = 1 << 20
#: Rows with labels, and as many without, that the scorers are fitted on at most (chosen by a hash of doc_id among those that docs holds), and bytes of their features.
SAMPLE_ROWS, SAMPLE_BYTES = 8000, 96 << 20
#: Minima in a sketch, and how many must agree with those of one row kept before for a row to be its near copy.
SKETCH, ALIKE = 8, 5
#: Pseudo-counts of votes (good, bad) from which expectation-maximisation starts: a heuristic's on good documents, on those bad in the way it looks for, and on other bad ones; and those of the labels table on good and on bad documents.
SOUND, OWN, OTHER, GIVEN = (19.8, 0.2), (3.0, 7.0), (9.0, 1.0), ((98.0, 2.0), (2.0, 98.0))
GOOD, BAD, NONE = 0, 1, 2
WORD = re.compile(r"\w+")
JUNK = ("symbols", "bars", "shouting", "stutter", "loops", "lines", "short", "label")
#: Shape features have buckets of their own behind the hashed ones, and this value.
SHAPE_VALUE = 6.0
SHAPES = tuple(f"{k}{i}" for k in JUNK[:-1] for i in range(10))
TOXIC = ("lexicon", "lexicon_twice", "label")
MEMORY = 400_000


def shape(text: str) -> tuple[dict[str, int], list[str]]:
    """Votes of the junk heuristics, and the text's shape features."""
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    share = {
        "symbols": sum(map(text.count, "#*$%&<>")) / n,
        "bars": text.count("|") / n,
        "shouting": sum(w.isupper() and len(w) > 2 for w in words) / n,
        "stutter": sum(a == b for a, b in pairwise(words)) / n,
        "loops": 1 - len(set(pairwise(words))) / (n - 1) if n >= 10 else 0.0,
        "lines": 1 - len(set(lines)) / len(lines) if len(lines) > 1 else 0.0,
        "short": 1.0 if len(words) < 10 else 0.0,
    }
    bounds = {"symbols": (0.05, 0.3), "bars": (0.05, 0.2), "shouting": (0.1, 0.3), "stutter": (0.1, 0.3), "loops": (0.3, 0.5), "lines": (0.1, 0.3), "short": (0.5, 0.5)}
    votes = {k: GOOD if v < bounds[k][0] else BAD if v >= bounds[k][1] else NONE for k, v in share.items()}
    if len(words) >= 10:
        votes["short"] = NONE
    return votes, [f"{k}{min(9, int(10 * v))}" for k, v in share.items() if v >= 0.05]


_SHAPE = {f: BUCKETS + i for i, f in enumerate(SHAPES)}


def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) & (BUCKETS - 1)


def code(votes: dict[str, int], names: tuple[str, ...]) -> int:
    out = 0
    for k in names:
        out = out * 3 + votes.get(k, NONE)
    return out


def decode(patterns: np.ndarray, m: int) -> np.ndarray:
    return np.stack([patterns // 3 ** (m - 1 - i) % 3 for i in range(m)], 1)


def shares(votes: np.ndarray, prior: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    """How likely each class is for rows of votes.  prior[class], accuracy[labeller, class, vote]: abstaining says nothing."""
    logs = np.log(np.clip(accuracy, 1e-9, 1))
    total = np.log(prior)[None, :].repeat(len(votes), 0)
    for i in range(votes.shape[1]):
        cast = votes[:, i] != NONE
        total[cast] += logs[i][:, votes[cast, i]].T
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


def posterior(votes: np.ndarray, prior: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    """P(bad) of rows of votes: of any class but the first."""
    return 1 - shares(votes, prior, accuracy)[:, 0]


def weighed(patterns: np.ndarray, counts: np.ndarray, m: int) -> tuple[np.ndarray, float]:
    """(counts, how many the labels table votes on): documents that it doesn't vote on weigh as much together as those it does, at most, or what they have in common would outweigh what labels say."""
    voted = decode(patterns, m)[:, -1] != NONE
    given, rest = float(counts[voted].sum()), float(counts[~voted].sum())
    return np.where(voted, counts, counts * (min(1.0, given / rest) if given and rest else 1.0)), given


def pseudo_counts(m: int, trust: float) -> np.ndarray:
    """[labeller, class, vote]: class 0 is good, class k bad in the way that the k-th heuristic looks for; the last labeller is the labels table."""
    out = np.empty((m, m, 2))
    for i in range(m - 1):
        out[i] = OTHER
        out[i, 0], out[i, i + 1] = SOUND, OWN
    out[-1], out[-1, 0] = np.array(GIVEN[1]) * (trust / 100), np.array(GIVEN[0]) * (trust / 100)
    return out


def fit_labels(patterns: np.ndarray, counts: np.ndarray, m: int, trust: float = 100.0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: (prior[class], accuracy[labeller, class, vote]).

    There is one class of good documents and one of bad ones for each heuristic, as junk of one sort seldom shows the signs of
    another.  pseudo_counts() are where it starts and are added to the counts; nothing else holds an accuracy.  The labels
    table, whose prior is worth ``trust`` documents, knows good and bad only, so it is as accurate for one bad class as another.
    """
    votes = decode(patterns, m)
    pseudo = pseudo_counts(m, trust)
    accuracy, prior = pseudo / pseudo.sum(2, keepdims=True), np.array([0.9] + [0.1 / (m - 1)] * (m - 1))
    cast = [[votes[:, i] == v for v in (GOOD, BAD)] for i in range(m)]
    for _ in range(rounds):
        weight = counts[:, None] * shares(votes, prior, accuracy)
        hits = np.stack([np.stack([weight[c].sum(0) for c in own], 1) for own in cast])
        hits[-1, 1:] = hits[-1, 1:].sum(0)
        hits += pseudo
        old, accuracy = accuracy, hits / hits.sum(2, keepdims=True)
        prior = (weight.sum(0) + 1 / m) / (counts.sum() + 1)
        if np.abs(accuracy - old).max() < 1e-7:
            break
    return prior, accuracy


def parts(rows: list[np.ndarray], size: int = 256):
    """(first place, rows in one, which row each is of) of so many rows at a time, so that arrays as long as all rows together are never made."""
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield i, np.concatenate(part), np.repeat(np.arange(i, i + len(part)), [len(r) for r in part])


def totals(rows: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """For each bucket the weight of the rows that have it."""
    out = np.zeros(BUCKETS + len(SHAPES))
    for _, flat, owner in parts(rows):
        out += np.bincount(flat, weights=weight[owner], minlength=len(out))
    return out


def fit_scorer(rows: list[np.ndarray], target: np.ndarray, weight_l1: float = 5e-5, rounds: int = 400) -> tuple[dict[int, float], float]:
    """L1 logistic regression on sets of buckets with targets in [0, 1], by accelerated proximal gradient: ({bucket: weight}, bias).  Words whose share of rows doesn't differ clearly between the classes (7 standard errors, 5 rows) are left out."""
    often, bad = totals(rows, np.ones(len(rows))), totals(rows, target)
    names = np.flatnonzero(often)
    often, bad, mass = often[names], bad[names], max(1e-9, float(target.sum()))
    rest = max(1e-9, len(rows) - mass)
    even = often / max(1, len(rows))
    z = (bad / mass - (often - bad) / rest) / np.sqrt(np.maximum(1e-12, even * (1 - even) * (1 / mass + 1 / rest)))
    told = (names >= BUCKETS) | (often >= 5) & (np.abs(z) >= 7)
    names = names[told]
    place = np.full(BUCKETS + len(SHAPES), -1, np.int32)
    place[names] = np.arange(len(names))
    columns, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, flat, of in parts(rows):
        at = place[flat]
        columns.append(at[at >= 0].astype(np.int64))
        owners.append(of[at >= 0])
    column, owner = np.concatenate(columns), np.concatenate(owners)
    value = np.where(names >= BUCKETS, SHAPE_VALUE, 1.0)
    n = max(1, len(rows))
    size = np.bincount(owner, weights=value[column], minlength=n)
    row_weight = np.ones(n)
    scale = value / np.sqrt(np.maximum(1, np.bincount(column, minlength=len(names))))
    step = 4 * n / max(1e-9, float((np.bincount(column, weights=(row_weight * size)[owner], minlength=len(names)) * scale**2).max(initial=1.0)) + row_weight.sum())
    w, b, v, c, t = np.zeros(len(names)), 0.0, np.zeros(len(names)), 0.0, 1.0
    for _ in range(rounds):
        z = np.bincount(owner, weights=(v * scale)[column], minlength=n) + c
        g = row_weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / n
        new = v - step * np.bincount(column, weights=g[owner], minlength=len(names)) * scale
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * weight_l1)
        bias, after = c - step * g.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / after * (new - w), bias + (t - 1) / after * (bias - b)
        w, b, t = new, bias, after
    return {int(k): float(x) for k, x in zip(names, w * scale, strict=True) if x}, float(b)


@dataclass
class Model:
    """What goes to the executors; its size depends on the sample's bound only."""

    junk: dict[int, float] = field(default_factory=dict)
    junk_bias: float = -1.0
    toxic: dict[int, float] = field(default_factory=dict)
    toxic_bias: float = -1.0
    lexicon: frozenset[int] = frozenset()


class Scorer:
    """score(text): (junk, toxic) log odds; keeps the weights of words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[float, float] | None] = {}

    def __call__(self, text: str) -> tuple[float, float]:
        m, known = self.model, self.known
        words = set(WORD.findall(text.lower()))
        if len(known) > MEMORY:
            known.clear()
        for w in words.difference(known):
            k = bucket(w)
            known[w] = (m.junk.get(k, 0.0), m.toxic.get(k, 0.0)) if k in m.junk or k in m.toxic else None
        junk, toxic = m.junk_bias, m.toxic_bias
        for pair in filter(None, map(known.__getitem__, words)):
            junk += pair[0]
            toxic += pair[1]
        for f in shape(text)[1]:
            junk += m.junk.get(_SHAPE[f], 0.0)
            toxic += m.toxic.get(_SHAPE[f], 0.0)
        return junk, toxic


def _features(batches):
    """doc_id, buckets (sorted int32), junk votes, sketch (SKETCH minima of hashed word triples, by which near copies are told)."""
    for batch in batches:
        out = []
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            votes, extra = shape(text)
            words = WORD.findall(text.lower())
            found = np.array(sorted({bucket(x) for x in set(words)} | {_SHAPE[x] for x in extra}), np.int32)
            triples = np.array(sorted({xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))}), np.uint64)
            sketch = b"".join((triples * np.uint64(0x9E3779B97F4A7C15 + 2 * seed) ^ triples >> np.uint64(7 + seed)).min().tobytes() for seed in range(SKETCH))
            out.append((doc, found.tobytes(), code(votes, JUNK), sketch))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "buckets", "votes", "sketch"])


def apart(sketches: list[bytes]) -> list[int]:
    """The places of those that are no near copy of one kept before."""
    holders: dict[bytes, list[int]] = {}
    kept = []
    for n, sketch in enumerate(sketches):
        parts = [bytes([i]) + sketch[8 * i : 8 * i + 8] for i in range(SKETCH)]
        met = Counter(k for p in parts for k in holders.get(p, ()))
        if not met or met.most_common(1)[0][1] < ALIKE:
            kept.append(n)
            for p in parts:
                holders.setdefault(p, []).append(n)
    return kept


def _votes(lexicon: frozenset[int]):
    def run(batches):
        known: dict[str, int | None] = {}
        for batch in batches:
            junk, toxic = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                junk.append(code(shape(text)[0], JUNK))
                words = set(WORD.findall(text.lower()))
                if len(known) > MEMORY:
                    known.clear()
                for w in words.difference(known):
                    k = bucket(w)
                    known[w] = k if k in lexicon else None
                hits = len({k for k in map(known.__getitem__, words) if k is not None})
                toxic.append(code(lexicon_votes(hits) if lexicon else {}, TOXIC))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(junk, pa.int64()), pa.array(toxic, pa.int64())], ["doc_id", "junk", "toxic"])

    return run


def lexicon_votes(hits: int) -> dict[str, int]:
    return {"lexicon": BAD if hits else GOOD, "lexicon_twice": BAD if hits > 1 else NONE}


def lexicon_of(rows: list[np.ndarray], toxic: np.ndarray) -> frozenset[int]:
    """Buckets in at least 5 toxic rows whose smoothed odds there are 20 times those elsewhere."""
    if not toxic.any() or toxic.all():
        return frozenset()
    bad, good = totals(rows, toxic.astype(float)), totals(rows, (~toxic).astype(float))
    odds = ((bad + 0.5) / (toxic.sum() + 1)) / ((good + 0.5) / ((~toxic).sum() + 1))
    return frozenset(np.flatnonzero((bad >= 5) & (odds >= 20)).tolist())


def _sample(texts: DataFrame, known: DataFrame, rows: int) -> list:
    """Features of at most so many documents that known has and as many others, by a hash of doc_id, with what known says: doc_id, buckets, votes, sketch, _quality, _toxic.  Of rows that share a doc_id one counts.  Beyond SAMPLE_BYTES the last go."""
    ids = texts.select("doc_id").filter("doc_id is not null").distinct()
    labelled = ids.join(known, ids.doc_id == known["_doc"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    others = ids.join(known, ids.doc_id == known["_doc"], "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = table(labelled.select("doc_id", "_quality", "_toxic").unionByName(others, allowMissingColumns=True).withColumnRenamed("doc_id", "_chosen"), "sample_ids")
    sampled = texts.join(F.broadcast(chosen.select("_chosen")), texts.doc_id == F.col("_chosen"), "left_semi")
    found = sampled.mapInArrow(_features, "doc_id bigint, buckets binary, votes bigint, sketch binary").groupBy("doc_id").agg(F.min(F.struct("buckets", "votes", "sketch")).alias("f"))
    found = table(found.join(F.broadcast(chosen), F.col("doc_id") == F.col("_chosen")).select("doc_id", "f.*", "_quality", "_toxic", F.length("f.buckets").alias("size")), "sample")
    sizes = sorted((r._quality is None and r._toxic is None, r.doc_id, r["size"]) for r in found.select("doc_id", "_quality", "_toxic", "size").collect())
    total, last = 0, len(sizes)
    for i, (_, _, size) in enumerate(sizes):
        total += size
        if total > SAMPLE_BYTES:
            last = i
            break
    if last < len(sizes):
        spark = texts.sparkSession
        found = found.join(F.broadcast(spark.createDataFrame([(i,) for _, i, _ in sizes[:last]], "_kept bigint")), F.col("doc_id") == F.col("_kept"), "left_semi")
    rows_ = sorted(found.collect(), key=lambda r: (r._quality is None and r._toxic is None, r.doc_id))
    return [rows_[i] for i in apart([r.sketch for r in rows_])]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit label models on all documents' votes, scorers on the sample.  Rows of labels that repeat a doc_id count as bad if one of them is; null labels abstain.  Without labels the heuristics' votes alone decide; without toxic ones there is no lexicon, and nothing is toxic."""
    small_batches(docs.sparkSession)
    known = table(labels.select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("quality").cast("int").alias("_quality"), F.col("toxic").cast("int").alias("_toxic")).filter("_doc is not null").groupBy("_doc").agg(F.min("_quality").alias("_quality"), F.max("_toxic").alias("_toxic")), "labels")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kept = _sample(texts, known, sample_rows)
    buckets = [np.frombuffer(r.buckets, np.int32) for r in kept]
    judged = [i for i, r in enumerate(kept) if r._toxic is not None]
    lexicon = lexicon_of([buckets[i] for i in judged], np.array([kept[i]._toxic == 1 for i in judged], bool)) if judged else frozenset()

    votes = table(texts.mapInArrow(_votes(lexicon), "doc_id bigint, junk bigint, toxic bigint"), "votes")
    cast = lambda c, bad: F.when(F.col(c).isNull(), NONE).when(F.col(c) == bad, BAD).otherwise(GOOD)
    both = votes.join(known.hint("merge"), votes.doc_id == F.col("_doc"), "left").select((F.col("junk") - NONE + cast("_quality", 0)).alias("junk"), (F.col("toxic") - NONE + cast("_toxic", 1)).alias("toxic"))
    model = Model(lexicon=lexicon)
    given = lambda value, bad: NONE if value is None else BAD if value == bad else GOOD
    for name, labellers in (("junk", JUNK), ("toxic", TOXIC)):
        tally = both.groupBy(name).count().collect()
        patterns, counts = np.array([r[name] for r in tally], np.int64), np.array([r["count"] for r in tally], float)
        if not len(patterns) or not kept or name == "toxic" and not lexicon:
            continue
        counts, given_ = weighed(patterns, counts, len(labellers))
        prior, accuracy = fit_labels(patterns, counts, len(labellers), max(100.0, given_))
        if name == "junk":
            own = np.array([r.votes - NONE + given(r._quality, 0) for r in kept])
        else:
            own = np.array([code(lexicon_votes(sum(int(k) in lexicon for k in b)), TOXIC) - NONE + given(r._toxic, 1) for r, b in zip(kept, buckets, strict=True)])
        weights, bias = fit_scorer(buckets, posterior(decode(own, len(labellers)), prior, accuracy))
        setattr(model, name, weights)
        setattr(model, f"{name}_bias", bias)
    drop(votes, known)
    return model


def _scored(model: Model):
    def run(batches):
        own = Scorer(model)
        for batch in batches:
            scores = np.array([own(x or "") for x in batch.column(1).to_pylist()], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores[:, 0]), pa.array(scores[:, 1]), pa.array((scores <= REJECT_ABOVE).all(1))], ["doc_id", "junk_score", "toxic_score", "kept"])

    return run


def _accepted(model: Model):
    def run(batches):
        own = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([all(np.array(own(x or "")) <= REJECT_ABOVE) for x in texts], pa.bool_()))

    return run


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, junk_score, toxic_score (log odds), kept (neither above REJECT_ABOVE) of each row (doc_id, text).  A null text counts as empty; repeated rows score alike; other columns are not looked at."""
    model = train(docs, labels, sample_rows)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id bigint, junk_score double, toxic_score double, kept boolean")


def keep_accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that classify() keeps; texts are not shuffled."""
    model = train(docs, labels, sample_rows)
    return docs.mapInArrow(_accepted(model), docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
