"""The pipeline's stages against brute force, each on what the stage before kept; the trained classifier's verdicts are taken from classify(), and of line dedup only exact repeats are checked."""

import re
import zlib

import numpy as np
import public_tokenizers
from test_pairs import brute as classes
from tokenizers import Tokenizer

import corpus_pipeline
from tidegraph.llm import quality_classifier, quality_rules

D = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(rows):
    """Documents that pass the rules, hosts judged by shrunk failure rates."""
    fails, hosts = {}, {}
    for i, t, h in rows:
        words, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        at = {}
        for k in range(len(words) - 4):
            at.setdefault(tuple(words[k : k + 5]), []).append(k)
        again = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
        fails[i] = (len(words) < 10 or 100 * len(again) > 20 * len(words), 10 * sum((t or "").count(c) for c in "#*$%&|<>") > sum(map(len, words)), 10 * (len(lines) - len(set(lines))) > 3 * len(lines))
        if h is not None:
            hosts.setdefault(h, []).append(fails[i])
    bad, n = set(), sum(map(len, hosts.values()))
    for rule, limit in enumerate(quality_rules.HOST_LIMITS.values()):
        mean = sum(f[rule] for v in hosts.values() for f in v) / n
        spread = np.mean([(sum(f[rule] for f in v) / len(v) - mean) ** 2 - mean * (1 - mean) / len(v) for v in hosts.values()])
        weight = min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 2.0), 1000.0) if mean * (1 - mean) else 2.0
        bad |= {h for h, v in hosts.items() if (sum(f[rule] for f in v) + mean * weight) / (len(v) + weight) > limit}
    return {i for i, _, h in rows if not fails[i][0] and h not in bad}


def test_stages_are_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{D}/labels.parquet")
    verdict = {r.doc_id for r in quality_classifier.classify(docs, labels).filter("kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = corpus_pipeline.table(stage(spark, docs, D), name)
        if name == "hilbert_packing":
            break
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        texts = {i: t for i, t, _ in before}
        if name == "quality_classifier":
            want = {i: texts[i] for i in verdict}
        elif name == "quality_rules":
            want = {i: texts[i] for i in good(before)}
        elif name == "line_dedup":
            # near copies of lines are held against brute force in test_lines; all pairs of this table's lines are too many here
            long = [x.strip(" ") for v in got.values() for x in (v or "").split("\n") if len(x.strip(" ")) >= 40]
            assert len(long) == len(set(long)) and set(got) <= set(texts)
            assert all(set((v or "").split("\n")) <= set((texts[i] or "").split("\n")) for i, v in got.items())
            continue
        else:
            want = {i: texts[i] for i, (_, _, kept) in classes(list(texts.items())).items() if kept}
        assert got == want, name
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = dict(zip((i for i, *_ in before), ([*e.ids, 2] for e in tokenizer.encode_batch([t or "" for _, t, _ in before], add_special_tokens=False)), strict=True))
    total = {}
    for r in docs.collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(x) for i, x in ids.items()}
