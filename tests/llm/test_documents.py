"""Operators on single documents and hosts against the libraries and brute force."""

import itertools
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegraph.llm import curve_packing, prefix_bpe, quality_classifier, quality_rules, sentencepiece_codec, sstable, token_counts, tokens, url_filter

DOCS = "doc_id bigint, text string, source string, n_words string, ids string"
WORDS, BYTES, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [None, "", " \n\t", "Hello, World! it's 2024... <|endoftext|> x", "été ÀÉ naïve 日本語 🙂 ﬁ", "a\r\nb c d", "'s 't'll ..,, --== ½ x²", "word " * 3000, "nul\x00 and \x7f", "İstanbul ǅ ß", "same", "same"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "h", "w", "i") for i, t in enumerate(texts)], DOCS).repartition(3)


def library(path, texts):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts_are_the_library_s(spark):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs(spark), WORDS).collect()}
    assert got == {i: (len((t or "").encode()), len(x), len(x) > 2048) for i, (t, x) in enumerate(zip(TEXTS, library(WORDS, TEXTS), strict=True))}
    assert token_counts.count_tokens(docs(spark).limit(0), WORDS).count() == 0


def test_prefixes_are_the_library_s(spark):
    own = token_counts.counter(WORDS)
    for text in ["Hello, World! it's 2024", "unbelievably   été", "日本 ab"]:
        assert own.prefixes(text).tolist() == [len(x) for x in library(WORDS, [text[:i] for i in range(len(text) + 1)])]


def test_budgets_are_answered_from_stored_counts(spark):
    texts = [None, "", "Hello, World! it's 2024", "unbelievably   été", "日本 ab", "a.b,c " * 30]
    counts = token_counts.prefix_counts(docs(spark, texts), WORDS).cache()
    own = token_counts.counter(WORDS)
    for budget in (0, 1, 3, 40):
        got = {r.doc_id: r.n_chars_kept for r in token_counts.fit_budget(counts, budget).collect()}
        for i, t in enumerate(texts):
            fits = [n for n in range(len(t or "") + 1) if len(library(WORDS, [(t or "")[:n]])[0]) <= budget]
            assert got[i] == max(fits) and own.truncate(t or "", budget) == (t or "")[: max(fits)]


def test_encoder_remembers_each_piece_once(monkeypatch):
    """Pieces inside chunks used to be held a second time, up to MEMORY of them beside MEMORY chunks, and all chunks but the last batch's were forgotten at once."""
    monkeypatch.setattr(tokens, "MEMORY", 400)
    own, r = tokens.WordEncoder(WORDS), random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8)))
    for n in range(40):
        texts = [f"often {word()} ({word()}) {word()}-{word()}, Often." for _ in range(20)] + TEXTS[1:]
        if n % 5 == 4:
            texts = [word()]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == library(WORDS, texts)
        assert sum(len(v) for v in vars(own).values() if isinstance(v, dict)) <= 400
        assert "often" in own.known


def test_packing_covers_each_id_once(spark):
    rows = curve_packing.pack(docs(spark), WORDS).collect()
    ids = [x + [2] for x in library(WORDS, TEXTS)]
    seen = {i: [] for i in range(len(TEXTS))}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        seen[r.doc_id].append((r.start, r.length))
    for i, parts in seen.items():
        assert [x for s, n in sorted(parts) for x in range(s, s + n)] == list(range(len(ids[i])))
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in by.values())


def test_neighbours_on_the_curve_are_alike(spark):
    r = random.Random(9)
    topics = [["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)] for _ in range(8)]
    texts = [" ".join(r.choice(topics[i % 8]) for _ in range(r.choice([20, 200, 1500]))) for i in range(160)]
    rows = sorted((x.curve_key, x.doc_id) for x in curve_packing.pack(docs(spark, texts), WORDS).filter("start = 0").collect())
    assert len({k for k, _ in rows}) > 100
    same = sum(a % 8 == b % 8 for (_, a), (_, b) in zip(rows, rows[1:], strict=False)) / (len(rows) - 1)
    assert same > 0.5  # an eighth if the order were random


def test_hilbert_steps_to_neighbours():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
        order = curve_packing.hilbert(points, bits)
        assert sorted(order.tolist()) == list(range(len(points)))
        walk = points[np.argsort(order)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shards_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = sstable.write_shards(docs(spark), folder, BYTES)
    got = sorted(map(tuple, sstable.read_shards(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    want, at = [], 0
    for i, x in enumerate(library(BYTES, TEXTS)):
        want.append((i, at, len(x) + 1, crc([*x, 0])))
        at += len(x) + 1
    assert got == want
    files = [r.file for r in manifest.collect()]
    for i, x in enumerate(library(BYTES, TEXTS)):
        found = [y.tolist() for y in (sstable.lookup(folder, f, i) for f in files) if y is not None]
        assert found == [[*x, 0]]
    assert all(sstable.lookup(folder, f, i) is None for f in files for i in (-5, 99, 1 << 40))


def test_shards_of_repeated_and_null_ids(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [(7, "b"), (7, "a"), (None, "c"), (3, None), (7, "a"), *((i, "some words " * 40) for i in range(100, 900))]
    df = spark.createDataFrame([(i, t, "h", "w", "i") for i, t in rows], DOCS).repartition(3)
    manifest = sstable.write_shards(df, folder, BYTES)
    got = sorted(sstable.read_shards(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [-(1 << 63), 3, 7, 7, 7, *range(100, 900)] and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert sstable.write_shards(df.limit(0), folder + "/none", BYTES).count() == 0
    # blocks, the sparse index and the filter of a shard with several blocks
    import io

    out = io.BytesIO()
    writer = sstable.Writer(out, 2)
    for i in range(0, 6000, 2):
        writer.add(sstable.key_of(i), np.arange(i % 90, dtype="<u2").tobytes())
    writer.close()
    reader = sstable.Reader(out, len(out.getvalue()))
    assert reader.blocks > 3 and all(reader.get(sstable.key_of(i)).tolist() == list(range(i % 90)) for i in range(0, 6000, 2))
    assert all(reader.get(sstable.key_of(i)) is None for i in range(1, 6001, 2))
    passed = sum(all(reader.bloom[p >> 3] >> (p & 7) & 1 for p in sstable._probes(sstable.key_of(i), len(reader.bloom) * 8)) for i in range(1, 6001, 2))
    assert passed < 150  # the filter stops nearly all


def hosts_by_hand(rows):
    """The hosts that judge() rejects, from its rows."""
    limits, per = quality_rules.HOST_LIMITS, {}
    for r, host, lines in rows:
        per.setdefault(host, []).append((r.base_failed, 10 * r.n_symbols > r.word_chars, 10 * r.n_dup_lines > 3 * lines))
    bad, n = set(), sum(map(len, per.values()))
    for k, limit in enumerate(limits.values()):
        mean = sum(f[k] for v in per.values() for f in v) / n
        spread = np.mean([(sum(f[k] for f in v) / len(v) - mean) ** 2 - mean * (1 - mean) / len(v) for v in per.values()])
        weight = min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 2.0), 1000.0) if mean * (1 - mean) else 2.0
        bad |= {h for h, v in per.items() if (sum(f[k] for f in v) + mean * weight) / (len(v) + weight) > limit}
    return bad


def test_bad_hosts_go(spark):
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    junk = lambda: "buy # $ % now ## $$ %% " * 2 + good()
    rows = [(i, junk() if i % 6 else good(), "spam.biz") for i in range(60)] + [(100 + i, good() if i % 10 else "short", "fine.org") for i in range(60)]
    rows += [(200, junk(), "one.net"), (201, good(), None), (202, good() + "\n" + "same line\n" * 5, "lines.com")]
    names = ("_bad_host", "row", "host", "_host", "_doc", "_text")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({n: quality_rules.F.lit(n) for n in names})
    got = quality_rules.judge(df).collect()
    source, texts = {i: h for i, _, h in rows}, {i: t for i, t, _ in rows}
    lines = lambda i: len([x for x in texts[i].split("\n") if x.strip()])
    bad = hosts_by_hand([(x, source[x.doc_id], lines(x.doc_id)) for x in got if source[x.doc_id]])
    assert "spam.biz" in bad and "fine.org" not in bad
    for x in got:
        t = texts[x.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert (x.word_chars, x.n_symbols) == (sum(map(len, words)), sum(c in "#*$%&|<>" for c in t))
        assert x.host_rejected == (source[x.doc_id] in bad) and x.kept == (not x.base_failed and not x.host_rejected)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in got if x.kept}


def test_pieces_are_the_library_s(spark):
    import sentencepiece

    library_ = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec, texts = sentencepiece_codec.codec(PIECES), [t or "" for t in TEXTS]
    for text, raw in zip(texts, codec.encode_all(texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == library_.encode(text) and codec.decode(ids) == library_.decode(ids), text


def test_decoding_any_ids_is_the_library_s():
    import sentencepiece

    library_ = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec, r = sentencepiece_codec.codec(PIECES), random.Random(3)
    for _ in range(3000):
        ids = [r.choice([r.randrange(3, 259), r.randrange(0, 32000)]) for _ in range(r.randrange(0, 12))]
        assert codec.decode(ids) == library_.decode(ids), ids


def test_viterbi_is_the_best_segmentation():
    """Scores over the shared trie against every segmentation of short words."""
    r = random.Random(2)
    scores = {x: -r.random() * 5 - 1 for x in "abcd"} | {"".join(r.choice("abcd") for _ in range(r.randrange(2, 5))): -r.random() * 8 for _ in range(40)}
    own = sentencepiece_codec.Viterbi(scores, -20.0)

    def best(word):
        if not word:
            return 0.0
        return max((scores.get(word[:n]) if word[:n] in scores else -20.0 if n == 1 else -1e9) + best(word[n:]) for n in range(1, len(word) + 1))

    words = {"".join(r.choice("abcde") for _ in range(r.randrange(1, 10))) for _ in range(300)}
    for word, last in own.passes(words):
        total, i = 0.0, len(word)
        while i:
            total += scores.get(last[i], -20.0)
            i -= len(last[i])
        assert abs(total - best(word)) < 1e-9
    # of two segmentations with equal sums the one with the longest last piece
    tie = sentencepiece_codec.Viterbi({"a": -1.0, "b": -1.0, "ab": -2.0}, -9.0)
    assert [list(last) for _, last in tie.passes(["ab"])] == [["", "a", "ab"]]


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert curve_packing.pack(none, WORDS).count() == 0 and url_filter.filter_urls(pages).count() == 0
    assert sentencepiece_codec.digest(none, PIECES).count() == 0 and quality_classifier.classify(none, labels).count() == 0


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(words), len(again)


def test_quality_rules(spark):
    r = random.Random(1)
    texts = [*TEXTS, *(" ".join(r.choice("abc") for _ in range(r.randrange(0, 60))) for _ in range(60))]
    texts += ["\n".join(f"line {i} of a text that is fine as it stands, with words" for i in range(3))] * 2
    got = {x.doc_id: x for x in quality_rules.judge(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        n, again = measures(text)
        assert (got[i].n_words, got[i].n_repeat_words, got[i].base_failed) == (n, again, n < 10 or 100 * again > 20 * n)
        assert not (got[i].base_failed and got[i].kept)
    assert quality_rules.judge(docs(spark).limit(0)).count() == 0


def test_url_rules_and_links(spark):
    link = '<a href="http://bad.net/x">x</a>'
    rows = [(1, None, None), (2, "no host", ""), (3, "http://A.Example.NET/en/x?q", ""), (4, "https://x.net/de", ""), (5, "http://www.example.com/de/", ""), (6, "http://a.org/fr/#f", ""), (7, "http://spam.biz/", link), (8, "http://good.biz/", ""), (9, "http://bad.net/", ""), (10, "http://net", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4] == ("x.net", "/de", "net/", "block")
    assert got[5][2:] == ("example.com/de/", "block") and got[6] == ("a.org", "/fr/", "org/fr/", "allow")
    assert got[7][2:] == (None, "allow") and got[8][2:] == (None, "allow") and got[10] == ("net", "", None, "allow")


def walks(nodes, edges, seeds, damping=0.85):
    """Personalised PageRank by power iteration to the end; what can't flow on starts again at the seeds."""
    at = {h: i for i, h in enumerate(nodes)}
    move, start = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
    for h, s in seeds.items():
        start[at[h]] = s
    start /= start.sum()
    for a, b, w in edges:
        move[at[b], at[a]] += w
    x = start
    for _ in range(2000):
        y = damping * move @ x
        x = y + (1 - y.sum()) * start
    return dict(zip(nodes, x, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_is_power_iteration(spark, seed):
    r = random.Random(seed)
    nodes = [f"h{i}" for i in range(40)]
    pairs = {(r.choice(nodes[:30]), r.choice(nodes)) for _ in range(90)} | {("h0", h) for h in nodes[1:]} | {(f"h{i}", f"h{i + 1}") for i in range(20, 39)}
    pairs = {(a, b) for a, b in pairs if a != b and a != "h35"}  # h35 leads nowhere, h0 everywhere
    out = {a: sum(x == a for x, _ in pairs) for a, _ in pairs}
    edges = [(a, b, 1 / out[a]) for a, b in pairs]
    seeds = {"h20": 3.0, "h7": 1.0} if seed == 1 else {"h35": 1.0, "h20": 2.0}
    got = {x.host: x["rank"] for x in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(list(seeds.items()), "host string, seed double"), rest=1e-9).collect()}
    want = walks(nodes, edges, seeds)
    assert all(abs(got.get(h, 0.0) - want[h]) < 1e-7 for h in nodes)
    assert url_filter.propagate(spark.createDataFrame([], "src string, dst string, weight double"), spark.createDataFrame([("a", 0.0)], "host string, seed double")).count() == 0


def test_distrust_comes_from_far_and_one_page_decides_nothing(spark):
    link = lambda h: f'<a data-href="http://no.biz/" class=x href=\'//user@{h}/\'>x</a>'
    rows = [(i, f"http://c{i}.biz/", link(f"c{i + 1}.biz")) for i in range(20)] + [(50 + i, f"http://c20.biz/{i}", link("evil.net") * 3) for i in range(3)]
    rows += [(100 + i, f"http://evil.net/{i}", "") for i in range(400)] + [(600, "http://mixed.org/a", ""), (601, "http://x.mixed.org/", ""), (602, "http://lone.net/", ""), (603, "http://a.lone.biz", ""), (604, "http://no.biz/", "")]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in (19, 15, 5)] == ["block"] * 3  # links lead them to evil.net, 2 to 16 steps on
    assert [got[i] for i in (600, 601, 603, 604)] == ["allow"] * 4


def test_hosts_above(spark):
    got = {tuple(r) for r in url_filter.domains(spark.createDataFrame([("a.b.c.d",), ("b.c.d",), ("x.y",), ("10.0.0.1",), ("",)], "host string")).collect()}
    assert got == {("a.b.c.d", "b.c.d"), ("b.c.d", "a.b.c.d"), ("b.c.d", "c.d"), ("c.d", "b.c.d")}


def naive_em(votes, counts, rounds=200):
    """The same model row by row, in plain Python."""
    q, m = quality_classifier, len(votes[0])
    pseudo = [[q.SOUND if c == 0 else q.OWN if c == i + 1 else q.OTHER for c in range(m)] for i in range(m - 1)] + [[q.GIVEN[0]] + [q.GIVEN[1]] * (m - 1)]
    acc = [[[v / sum(row) for v in row] for row in table] for table in pseudo]
    prior = [0.9] + [0.1 / (m - 1)] * (m - 1)
    for _ in range(rounds):
        share = []
        for row in votes:
            like = list(prior)
            for i, v in enumerate(row):
                if v != q.NONE:
                    like = [x * acc[i][c][v] for c, x in enumerate(like)]
            share.append([x / sum(like) for x in like])
        seen = [[[sum(n * s[c] for row, n, s in zip(votes, counts, share, strict=True) if row[i] == v) for v in (0, 1)] for c in range(m)] for i in range(m)]
        pooled = [sum(seen[-1][c][v] for c in range(1, m)) for v in (0, 1)]
        seen[-1] = [seen[-1][0]] + [pooled] * (m - 1)
        new = [[[pseudo[i][c][v] + seen[i][c][v] for v in (0, 1)] for c in range(m)] for i in range(m)]
        new = [[[v / sum(row) for v in row] for row in table] for table in new]
        change = max(abs(new[i][c][v] - acc[i][c][v]) for i in range(m) for c in range(m) for v in (0, 1))
        prior = [(sum(n * s[c] for n, s in zip(counts, share, strict=True)) + 1 / m) / (sum(counts) + 1) for c in range(m)]
        acc = new
        if change < 1e-7:
            break
    return prior, acc


def test_label_model_is_naive_em_and_finds_what_is_bad():
    """Junk of three sorts, each with a sign of its own, and a labels table that has a tenth of the documents and is right on 19 of 20."""
    r, q = random.Random(4), quality_classifier
    tally, bad = {}, {}
    for _ in range(20000):
        sort = r.choice([1, 2, 3]) if r.random() < 0.2 else 0
        row = tuple(q.BAD if r.random() < (0.01 if sort == 0 else 0.85 if sort == i + 1 else 0.05) else q.GOOD for i in range(3))
        row += (q.NONE if r.random() < 0.9 else q.BAD if (sort > 0) != (r.random() < 0.05) else q.GOOD,)
        tally[row] = tally.get(row, 0) + 1
        bad[row] = bad.get(row, 0) + (sort > 0)
    votes, counts = list(tally), list(tally.values())
    patterns = np.array([sum(v * 3 ** (3 - i) for i, v in enumerate(row)) for row in votes])
    prior, acc = q.fit_labels(patterns, np.array(counts, float), 4)
    want_prior, want = naive_em(votes, counts)
    assert np.abs(prior - np.array(want_prior)).max() < 1e-6 and np.abs(acc - np.array(want)).max() < 1e-6
    assert abs(1 - prior[0] - 0.2) < 0.03
    assert acc[3, 0, q.GOOD] > 0.92 and acc[3, 1, q.BAD] > 0.9 and all(acc[i, i + 1, q.BAD] > 10 * acc[i, 0, q.BAD] for i in range(3))
    found = q.posterior(q.decode(patterns, 4), prior, acc) > 0.5
    right = sum(bad[v] if f else tally[v] - bad[v] for v, f in zip(votes, found, strict=True))
    assert right > 0.95 * 20000


def test_near_copies_are_told_by_most_of_a_sketch():
    one, other = [bytes([i] * 8) for i in range(8)], [bytes([40 + i] * 8) for i in range(8)]
    rows = [b"".join(one), b"".join(one[:5] + other[5:]), b"".join(one[:4] + other[4:]), b"".join(other)]
    assert quality_classifier.apart(rows) == [0, 2, 3]


@pytest.mark.parametrize("fold", [0, 1])
def test_classifier_on_held_out_labels(spark, fold):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.doc_id: r.kept for r in quality_classifier.classify(table, labels.filter(f"doc_id % 2 = {fold}")).collect()}
    held = labels.filter(f"doc_id % 2 = {1 - fold}").collect()
    clean = [kept[r.doc_id] for r in held if r.quality == 1 and r.toxic == 0]
    junk = [kept[r.doc_id] for r in held if r.quality == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_scorer_is_fitted_in_bounded_memory():
    """Whole-sample arrays of every feature took some ten times the features' bytes in the driver."""
    import tracemalloc

    import numpy as np

    from tidegraph.llm import quality_classifier as qc

    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 1 << 16, 250)).astype(np.int32) for _ in range(16000)]
    target = (r.random(16000) < 0.3).astype(float)
    rows = [np.append(x, 70000).astype(np.int32) if t else x for x, t in zip(rows, target, strict=True)]
    tracemalloc.start()
    weights, _ = qc.fit_scorer(rows, target, rounds=20)
    lexicon = qc.lexicon_of(rows, target == 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(weights) == {70000} and 70000 in lexicon and peak < 100 << 20, peak


def test_words_after_a_blank_take_no_line_each():
    """Words used to be learned a line each, which made the library encode a line's end beside every word."""
    own, seen = tokens.ByteLevelEncoder(BYTES), []
    real = own.tokenizer
    own.tokenizer = SimpleNamespace(encode_batch_fast=lambda x, **k: seen.extend(x) or real.encode_batch_fast(x, **k))
    texts = [t or "" for t in TEXTS] + ["one two three four", "Été naïve words\nnext line of words", " a", " b c"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == library(BYTES, texts)
    assert any(" two" in x and " three" in x and "\n" not in x for x in seen) and not any("\n two" in x for x in seen)


def test_forward_pass_merges_no_pair_again():
    """Each new pair of neighbouring tokens used to be merged anew from its symbols; now their last merges are undone."""
    r, forward = random.Random(9), sentencepiece_codec.Codec(PIECES).forward
    usual = [t for t in sorted(forward._whole) if forward.whole(t)]
    words = {"▁" + "".join(r.choice(usual).strip("▁") for _ in range(3)) for _ in range(2000)}
    merged, merge = [], forward.merge
    forward.merge = lambda symbols: merged.append(symbols) or merge(symbols)
    got = {word: forward.tokens(word, last) for word, last, _ in forward.passes(words)}
    assert len(merged) < 100
    assert all(got[w] == merge(w) for w in words)
    # tokens cut out of tokens, so that merges across are likely
    for t in r.sample(usual, 3000):
        for i in range(1, len(t)):
            a, b = t[:i], t[i:]
            if forward._whole.get(a) and forward._whole.get(b):
                assert forward.fits(a, b) == (merge(t) == [a, b])
    # ranks out of order, and equal ranks
    ranks = {("a", "b"): 3, ("ab", "a"): 1, ("a", "a"): 2, ("b", "a"): 2, ("aa", "a"): 2, ("aa", "b"): 4, ("ab", "ab"): 4}
    small = prefix_bpe.PrefixBpe(lambda a, b: ranks.get((a, b)), ["a", "b", *(a + b for a, b in ranks)], 4)
    for word, last, counts in small.passes("".join(x) for n in range(1, 9) for x in itertools.product("ab", repeat=n)):
        assert small.tokens(word, last) == small.merge(word) and counts[-1] == len(small.merge(word))
