"""Pair operators against brute force."""

import numpy as np

from tidegraph.llm import components, embedding_dedup, ngram_join

DOCS = "doc_id bigint, text string, source string, n bigint"


def closure(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components_chain_star_and_loops(spark):
    rng = np.random.default_rng(3)
    chain = [int(x) for x in rng.permutation(200)]
    edges = list(zip(chain, chain[1:], strict=False)) + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (7, 3), (3, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: r for i, r in closure({x for e in edges for x in e}, edges).items() if i != r}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def grams(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: grams(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = closure(sets, linked)
    return {i: (sum(i in e for e in linked), root[i], root[i] == i) for i in sets}


def test_jaccard_join_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 16)
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    base = [word() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "one two"), (5, "a b c d e"), (6, "a b c d e"), (7, "é ü 日本 x y z")]
    for i in range(10, 90):  # near copies of one text: a word changed in most
        w = list(base)
        w[int(rng.integers(0, 60))] = word()
        rows.append((i, " ".join(base if i % 9 == 0 else w)))
    for i in range(100, 140):
        rows.append((i, " ".join(word() for _ in range(int(rng.integers(1, 80))))))
    rows.append((200, " ".join(base) * 300))
    df = spark.createDataFrame([(i, t, None, 1) for i, t in rows], DOCS).repartition(5)
    got = {r.doc_id: (r.n_links, r.class_id, r.kept) for r in ngram_join.jaccard_join(df).collect()}
    assert got == brute(rows)


def test_jaccard_join_on_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_links, r.class_id, r.kept) for r in ngram_join.jaccard_join(df).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_jaccard_join_counts_rows_that_share_a_doc_id(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "quite another text with as many words as the other one has here"
    near = a + " thirteen"
    rows = [(1, a), (1, a), (1, b), (2, near), (2, b + " x y"), (5, near + " z"), (5, near)]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], DOCS).repartition(3)
    link = [[5 * len(grams(x) & grams(y)) >= 4 * len(grams(x) | grams(y)) for _, y in rows] for _, x in rows]
    root = closure(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(len(rows)) if link[i][j]])
    least = {r: min(rows[i][0] for i in root if root[i] == r) for r in set(root.values())}
    got = sorted((r.doc_id, r.n_links, r.class_id) for r in ngram_join.jaccard_join(df).collect())
    assert got == sorted((rows[i][0], sum(link[i]) - 1, least[root[i]]) for i in range(len(rows)))
    assert sorted(map(tuple, ngram_join.keep_one(df).select("doc_id", "text").collect())) == sorted([(1, a), (1, a), (1, b)] + [(2, b + " x y")] * (not link[2][4]))


def test_jaccard_columns_that_clash(spark):
    names = ("gone", "row", "id", "sum", "key", "doc", "of", "mark", "_word", "_bits", "_at", "_bit", "node", "digest")
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "doc_id bigint, text string").withColumns({n: ngram_join.F.lit(n) for n in names})
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.gone) for r in out.collect()) == [(1, "gone"), (3, "gone")]


def test_jaccard_join_edges(spark):
    assert ngram_join.jaccard_join(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (None, "a b c d e f", "x", 1), (2, None, None, None)]
    got = sorted(map(tuple, ngram_join.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True), (2, 0, 2, True)], key=str)
    wide = spark.createDataFrame(rows, DOCS).withColumns({c: ngram_join.F.lit(1) for c in ("digest", "bands", "grams", "rep", "component", "kept", "n_links")})
    assert ngram_join.jaccard_join(wide).count() == 4
    kept = ngram_join.keep_one(spark.createDataFrame([(1, "a b c", "s", 1), (2, "a b c", "s", 2), (3, None, None, 3)], DOCS))
    assert kept.columns == ["doc_id", "text", "source", "n"] and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and 1 - (1 - 0.4**rows) ** bands <= 0.15


VECTORS = "vec_id bigint, embedding array<float>, label int, kept string"


def brute_vectors(rows):
    ok = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab, _ in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    linked = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and cos(ok[a][0], ok[b][0]) >= 0.98]
    root = closure([r[0] for r in rows], linked)
    return {r[0]: (sum(r[0] in e for e in linked), root[r[0]], root[r[0]] == r[0]) for r in rows}


def test_vectors_are_brute_force(spark, monkeypatch):
    for name, value in (("CELL", 20), ("BLOCK", 16)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        v = rng.normal(size=8) if i % 3 else np.ones(8) + rng.normal(size=8) * 0.15
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2), "x"))
    rows += [(400 + i, rows[0][1], 0, "x") for i in range(30)] + [(450, [2 * x for x in rows[0][1]], 0, "x")]
    rows += [(500, None, 0, None), (501, [], 0, None), (502, [0.0] * 8, 0, None), (503, [None, 1.0], 0, None), (504, [float("nan")] * 8, 0, None), (505, [float("inf")] * 8, 0, None), (506, rows[0][1], None, None), (507, [1.0, 0.0], 0, None), (508, [1.0, 0.01], 0, None)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()}
    assert got == brute_vectors(rows)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0, "x"), (1, [0.0, 1.0], 0, "x"), (2, [1.0, 0.01], 0, "x"), (2, [1.0, 0.01], 0, "x"), (3, [0.0, 1.0], 1, "x")]
    got = sorted(map(tuple, embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()))
    assert got == sorted([(1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True)])


def test_cells_miss_no_pair():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    x = np.concatenate([x, x[:100] + rng.normal(size=(100, 6)) * 0.1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in (1, 2, 7, 40):
        at = embedding_dedup.cells(x, embedding_dedup.fit(x, k), 0.98)
        for i, j in zip(*np.nonzero(x @ x.T >= 0.98), strict=True):
            assert at[i][0] == at[j][0] or at[min((i, j), key=lambda n: at[n][0])][0] in at[max((i, j), key=lambda n: at[n][0])][1:]


def test_vectors_on_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute_vectors([(r.vec_id, list(r.embedding), r.label, "") for r in df.collect()])
