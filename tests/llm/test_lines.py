"""Line dedup against brute force."""

import random

from tidegraph.llm import common, line_dedup
from tidegraph.llm.line_dedup import F

DOCS = "doc_id bigint, text string, n_chars bigint, key string, removed string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(rows, edits, least):
    spots = sorted((i, n, x.strip(" ")) for i, t in rows if t is not None and i is not None for n, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= least)
    kinds = sorted({x for *_, x in spots})
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                root[find(b)] = find(a)
    seen, gone = set(), {}
    for i, n, x in spots:
        if find(x) in seen:
            gone.setdefault(i, []).append(n)
        seen.add(find(x))
    return gone


def words_near(a, b):
    """Whether two lines are within the limit in words."""
    a, b = a.split(" "), b.split(" ")
    n = max([e for k, e in line_dedup.WORD_LIMITS if min(len(a), len(b)) >= k], default=0)
    return n and abs(len(a) - len(b)) <= n and distance(a, b) <= n


def chars_near(a, b):
    n = max([e for k, e in line_dedup.LIMITS if min(len(a), len(b)) >= k], default=0)
    return n and min(a.count(" "), b.count(" ")) + 1 < line_dedup.WORDS_ONLY and abs(len(a) - len(b)) <= n and distance(a, b) <= n


def edited(r, a, n):
    a = list(a)
    for _ in range(n):
        i = r.randrange(len(a))
        k = r.random()
        if k < 0.4:
            a[i] = r.choice("abcé ")
        elif k < 0.7:
            a.insert(i, r.choice("abcé"))
        else:
            del a[i]
    return "".join(a)


def test_lines_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    r = random.Random(4)
    base = ["".join(r.choice("abcdefé ") for _ in range(r.randrange(12, 40))) for _ in range(12)]
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(r.choice([base[0], edited(r, r.choice(base), r.randrange(0, 5)), "", "ab", "  " + r.choice(base) + " "]) for _ in range(r.randrange(0, 6)))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, base[0]), (103, base[1] * 50)]
    df = spark.createDataFrame([(i, t, 0, "k", "x") for i, t in rows], DOCS).repartition(3)
    got = {x.doc_id: x.removed_lines for x in line_dedup.dedup_report(df, 2, 10).collect() if x.n_removed}
    assert got == brute(rows, 2, 10)
    counts = {x.doc_id: x.n_lines for x in line_dedup.dedup_report(df, 2, 10).collect()}
    assert counts == {i: 0 if t is None else len(t.split("\n")) for i, t in rows}


def test_lines_dropped(spark):
    a, b = "a line that is long enough to be looked at, here", "another line that is long enough to be looked at"
    rows = [(1, f"{a}\nshort\n{b}", 0, "k", "x"), (2, f"{a}!\nown line", 0, "k", "x"), (3, b, 0, "k", "x"), (4, None, 0, "k", "x"), (5, "", 0, "k", "x"), (6, f"{b}\n \n{b}", 0, "k", "x")]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "n_chars", "key", "removed"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "own line", 4: None, 5: ""}
    assert next(r.n_chars for r in out.collect() if r.doc_id == 2) == 8
    assert line_dedup.drop_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_bit_vectors_are_levenshtein(spark):
    r = random.Random(5)
    pairs = []
    for n in (0, 1, 2, 8, 20, 57, 58, 59, 60, 61, 62, 118, 119, 120, 121, 122, 180, 300) * 40:
        a = "".join(r.choice("abcé日🙂 ") for _ in range(n))
        pairs.append(sorted((a, edited(r, a, r.randrange(0, 6)) if n > 3 else a + r.choice(["", "a", "é", "ab"])), key=len))
    for e in (1, 2, 3, 4):
        df = spark.createDataFrame([tuple(x) for x in pairs if len(x[1]) - len(x[0]) <= e], "a string, b string").select("a", "b", line_dedup.planes(F.col("a")).alias("x"), line_dedup.planes(F.col("b")).alias("y")).cache()
        rows, longer, close = F.char_length("a"), F.char_length("b") - F.char_length("a"), F.levenshtein("a", "b") <= e
        found = line_dedup.within(F.col("x"), F.col("y"), rows, longer, e)
        assert df.filter(close & ~found).count() == 0 and df.filter(close).count() > 100
        line = lambda c, v: F.struct(F.col(c).alias("line"), F.col(v).alias("planes"), F.char_length(c).alias("size"))  # noqa: B023, E731
        for x, y in ((line("a", "x"), line("b", "y")), (line("b", "y"), line("a", "x"))):
            assert df.select("a", "b", x.alias("p"), y.alias("q")).filter(line_dedup.near(F.col("p"), F.col("q"), e) != close).count() == 0


def test_rows_that_share_a_doc_id(spark):
    a, b = "a line that is long enough to be looked at, here", "an unrelated unique line of another document, kept"
    rows = [(1, a), (2, a), (2, b), (2, a), (3, f"{b}\n{a}x\nown words"), (None, a), (None, b)]
    df = spark.createDataFrame([(i, t, 0, "k", "x") for i, t in rows], DOCS).repartition(3)
    out = sorted(((r.doc_id, r.text) for r in line_dedup.drop_lines(df).collect()), key=str)
    assert out == sorted([(1, a), (2, b), (3, "own words"), (None, a), (None, b)], key=str)
    report = [(r.doc_id, r.n_lines, r.removed_lines) for r in line_dedup.dedup_report(df).collect()]
    assert sorted(map(str, report)) == sorted(map(str, [(1, 1, []), (2, 1, [0]), (2, 1, []), (2, 1, [0]), (3, 3, [0, 1]), (None, 1, []), (None, 1, [])]))
    same = spark.createDataFrame([(1, a, 0, "k", "x")] * 2 + [(4, a, 0, "k", "x")], DOCS)
    assert [(r.doc_id, r.text) for r in line_dedup.drop_lines(same).collect()] == [(1, a)] * 2


def test_columns_that_clash(spark):
    a = "a line that is long enough to be looked at, here"
    names = ("_doc", "_removed", "_key", "row", "id", "sum", "key", "doc", "of", "left", "_at", "_bit", "_word", "_bits", "line", "digest", "gone")
    df = spark.createDataFrame([(1, a), (2, f"{a}\nown")], "doc_id bigint, text string").withColumns({n: F.lit(n) for n in names})
    out = line_dedup.drop_lines(df)
    assert out.columns == df.columns and {r.doc_id: (r.text, r["left"], r["_bits"]) for r in out.collect()} == {1: (a, "left", "_bits"), 2: ("own", "left", "_bits")}
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_report(df).collect()} == {1: 0, 2: 1}


def test_long_lines_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_CHARS", 4000)
    r = random.Random(8)
    base = "".join(r.choice("abcdef ") for _ in range(3000))
    rows = [(i, edited(r, base, i % 3)) for i in range(12)] + [(99, base * 70)]
    df = spark.createDataFrame([(i, t, 0, "k", "x") for i, t in rows], DOCS)
    assert {x.doc_id for x in line_dedup.dedup_report(df).collect() if not x.n_removed} == {0, 99}


def test_short_repeats_go(spark):
    rows = [(1, "Les.\n\n\t\nAnd ornd.\nOf.\n\t"), (2, "By.\nAnd ornd.\n\nLes.  \nOn."), (3, "a line of thirty-nine characters, as it\nAnd ornb."), (4, "a line of forty characters, as it is, ok\na line of thirty-nine characters, az it\na line of forty characters, as it is, oku")]
    df = spark.createDataFrame([(i, t, 0, "k", "x") for i, t in rows], DOCS)
    assert {r.doc_id: r.removed_lines for r in line_dedup.dedup_report(df).collect()} == {1: [], 2: [1, 3], 3: [], 4: [1, 2]}


def test_limits_are_brute_force(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcdefé ") for _ in range(n)) for n in (3, 9, 18, 19, 20, 21, 38, 39, 40, 41, 42, 60)]
    rows = [(i, "\n".join(edited(r, r.choice(base), r.randrange(0, 3)) for _ in range(4))) for i in range(50)]
    df = spark.createDataFrame([(i, t, 0, "k", "x") for i, t in rows], DOCS)
    kinds = sorted({x.strip(" ") for _, t in rows for x in t.split("\n")} - {""})
    root = {x: {x} for x in kinds}
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if root[a] is not root[b] and (chars_near(a, b) or words_near(a, b)):
                root[a] |= root[b]
                root |= dict.fromkeys(root[b], root[a])
    seen, gone = set(), {}
    for i, t in rows:
        for n, x in enumerate(x.strip(" ") for x in t.split("\n")):
            if x and id(root[x]) in seen:
                gone.setdefault(i, []).append(n)
            if x:
                seen.add(id(root[x]))
    assert {x.doc_id: x.removed_lines for x in line_dedup.dedup_report(df).collect() if x.n_removed} == gone


def test_changed_words_are_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(r.randrange(3, 9)))
    base = [[word() for _ in range(n)] for n in (9, 10, 19, 20, 37, 99, 101, 199, 201, 205, 207, 300)]
    rows = []
    for i in range(96):
        words = list(base[i % len(base)])
        for _ in range(r.randrange(0, 6) if i >= len(base) else 0):
            k = r.randrange(len(words))
            words[k : k + r.randrange(2)] = r.choice([[], [word()]])
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(i, t, 0, "k", "x") for i, t in rows], DOCS)
    near = lambda a, b: chars_near(a, b) or words_near(a, b)
    group = {i: {i} for i, _ in rows}
    for i, a in rows:
        for j, b in rows[:i]:
            if group[i] is not group[j] and near(a, b):
                group[i] |= group[j]
                group |= dict.fromkeys(group[j], group[i])
    gone = {i for i in group if min(group[i]) < i}
    assert {x.doc_id for x in line_dedup.dedup_report(df).collect() if x.n_removed} == gone and 10 < len(gone) < 80


def test_long_line_with_a_changed_word_goes(spark):
    a = " ".join(f"word{i}" for i in range(30))
    rows = [(1, a), (2, a.replace("word14", "something-else")), (3, a.replace("word3 ", "x ").replace("word8 ", "y ").replace("word15 ", "z ")), (4, a.replace("word8 ", "").replace("word20 ", "word20 more "))]
    df = spark.createDataFrame([(i, t, 0, "k", "x") for i, t in rows], DOCS)
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_report(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}


def test_keys_are_shuffled_once_without_a_sieve(spark, monkeypatch):
    """With more shared keys than a sieve serves, all keys used to go through a second shuffle."""
    monkeypatch.setattr(common, "SIEVE_BITS", (2, 2))
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(30)) + " end" * (i % 2)) for i in range(600)]
    df = spark.createDataFrame([(i, t, 0, "k", "x") for i, t in rows], DOCS)
    hub = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, hub.new_array(hub.jvm.double, 0), hub.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    made = []
    monkeypatch.setattr(line_dedup, "components", lambda edges: made.append(line_dedup.table(edges.distinct(), "edges").count()) or edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0))
    before = written()
    line_dedup.line_classes(df)
    after = written()
    assert made[0] >= 300 and sum(n for k, n in after.items() if k not in before) < 12 * len(rows)


def test_lines_of_a_large_group_are_shuffled_by_parts(spark, monkeypatch):
    """Unlike lines that share a segment: each used to be shuffled once for each block of its group, 12 800 rows here."""
    monkeypatch.setattr(line_dedup, "BLOCK", 2)
    r = random.Random(12)
    shared = " ".join(f"s{i}" for i in range(10))
    texts = [f"{shared} " + " ".join(f"w{r.randrange(10**6)}" for _ in range(14)) for _ in range(130)]
    texts += [" ".join([*t.split(" ")[:-1], "other"]) for t in texts[::4][:30]]
    df = spark.createDataFrame([(i, t, 0, "k", "x") for i, t in enumerate(texts)], DOCS)
    hub = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, hub.new_array(hub.jvm.double, 0), hub.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    got = {x.doc_id for x in line_dedup.dedup_report(df).collect() if x.n_removed}
    assert got == {i for i, t in enumerate(texts) if any(words_near(t, u) for u in texts[:i])} and len(got) == 30
    assert max(n for k, n in written().items() if k not in before) < 4 * len(texts) * line_dedup.PARTS


def test_keys_do_not_scan_a_line_for_each_place(spark, monkeypatch):
    """Each place used to look for its words in the whole line, and blanks were counted in it once more."""
    plans = []
    monkeypatch.setattr(line_dedup, "components", lambda edges: plans.append(edges._jdf.queryExecution().optimizedPlan().toString()) or edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0))
    line_dedup.line_classes(spark.createDataFrame([(1, "a b " * 20, 0, "k", "x")], DOCS))
    assert "slice(" in plans[0] and not any(x in plans[0] for x in ("substring_index(", "replace(", "btrim("))


def test_values_of_a_line_are_made_once(spark):
    """Places that a line has no key of its own at used to be walked for each line, and codes were cut twice for its bit vectors."""
    lines = spark.createDataFrame([(" ".join(["word"] * n),) for n in range(1, 260)], "line string").withColumns({"size": F.char_length("line"), "n_words": F.size(F.split("line", " "))})
    found = lines.select(line_dedup.placed(line_dedup.LIMITS, True).alias("p"), "size", "n_words")
    kept = found.select(F.size("p").alias("all"), F.size(F.filter("p", line_dedup.counts)).alias("own")).collect()
    assert all(x["all"] == x["own"] for x in kept) and max(x["all"] for x in kept) > 8
    plan = lines.select(line_dedup.planes(F.col("line")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_lines_of_a_long_chain_meet_those_they_share_keys_with(spark, monkeypatch):
    """Lines chained by segments of which each is shared by few: all used to meet each other, on disk too, in a group of 615 blocks here."""
    monkeypatch.setattr(line_dedup, "BLOCK", 2)
    half = lambda name, i: " ".join(f"{name}{i}x{j}" for j in range(12))
    texts = [half("a", (i + 1) // 2) + " " + half("b", i // 2) for i in range(1200)]
    texts += [t + " more" for t in texts[::40]]
    df = spark.createDataFrame([(i, t, 0, "k", "x") for i, t in enumerate(texts)], DOCS)
    seen, paired = [], line_dedup._paired
    monkeypatch.setattr(line_dedup, "_paired", lambda told: seen.append(told.agg(F.max("blocks")).first()[0]) or paired(told))
    got = {x.doc_id for x in line_dedup.dedup_report(df).collect() if x.n_removed}
    assert got == set(range(1200, 1230)) and seen[0] <= line_dedup.LARGE
