"""Near-duplicate lines by a segment-partition edit-distance join, in DataFrame expressions only.

A line within ``edits`` edits of another keeps one of that line's ``edits + 1`` segments, near its place.  Lines of nearly
one length have their segments at the same places, so each line is indexed by (length band, segment number, piece of the
segment), see key().  This is done twice: with characters as the units that are edited, and with words.
Keys that two lines share chain those lines; the lines of each chained group are compared in blocks of bounded size, which
are shuffled by larger parts, by banded bit-parallel edit distance, and linked lines form classes of which the first
occurrence stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import BROADCAST_ROWS, drop, read, sieve, sift, table, unwrapped, wrapped
from tidegraph.llm.components import components

#: (characters, edits): lines from so many characters on are joined by so many edits, a twentieth of the length at least.  Shorter ones go as exact repeats only.
LIMITS = ((20, 1), (40, 2))
#: (words, edits): lines from so many words on are also joined by so many words changed, put in or left out.
WORD_LIMITS = ((10, 1), (20, 2), (100, 3), (200, 4))
#: In lines from so many words on only words are edited, not characters.
WORDS_ONLY = 20
#: Lines to a block, and bytes of their characters.
BLOCK, BLOCK_CHARS = 64, 1 << 16
#: Into how many parts the blocks of a group are put, and of how many blocks a part is at most: a line is shuffled once for each part and not for each block.
PARTS, PART_BLOCKS = 8, 16
#: Groups of more blocks than this are told apart by their keys: see _by_keys().
LARGE = 8
#: Rows of the edit matrix that one word of a bit vector stands for; its other bits reach into the neighbours.
ROWS = 57
#: Bits of a unit that the vectors compare: all of an ASCII character's.
PLANES = 7


def characters(at: Column, size: Column, from_end: Column) -> Column:
    """So many characters that leave out ``at`` at the start, or at the end."""
    return F.substring("line", F.when(from_end, F.col("size") - at - size).otherwise(at) + 1, size)


def words(at: Column, size: Column, from_end: Column) -> Column:
    """So many words of ``parts`` that leave out ``at`` at the start, or at the end."""
    return F.slice("parts", F.when(from_end, F.col("n_words") - at - size).otherwise(at) + 1, size)


def slacks(edits: int) -> list[int]:
    """By how many units each of the edits + 1 segments can have moved, counted from the end of the line that is nearer to it."""
    return [min(i, edits - i) for i in range(edits + 1)]


def places(least: int, edits: int, by_words: bool) -> list[tuple]:
    """Where the keys of a line of ``least`` units or more are: (words, edits, least, back, i, from_end, many, more), see key()."""
    slack = slacks(edits)
    found = []
    for i, s in enumerate(slack):
        nth = min(i, edits - i)
        found += [(i, i > edits - i, nth, sum(slack[:nth]) + moved) for moved in range(s + 1)]
    return [(by_words, edits, least, back, *x) for back in (0, edits) for x in found]


PLACE = "struct<words:boolean,edits:int,least:int,back:int,i:int,from_end:boolean,many:int,more:int>"


def _band(n: Column, least: Column, edits: Column) -> Column:
    """The fewest units of the lines that have their segments at the same places as one of n units: bands are never under ``edits`` wide."""
    over, near_ = n - least, (least < 8 * edits) & (n - least < 8 * edits)
    return n - F.when(near_, F.pmod(over, edits)).otherwise(F.pmod(over, 4 * edits))


def band(p: Column) -> Column:
    """The band that a place p is of: that of the line's size, or of the size ``back`` less, as the shorter line of a pair may be in the band below."""
    n = F.when(p["words"], F.col("n_words")).otherwise(F.col("size"))
    return _band(F.greatest(n - p["back"], p["least"]), p["least"], p["edits"])


def counts(p: Column) -> Column:
    """Whether the place p has a key that no other place of the line has: not, if the band below is the line's own."""
    n = F.when(p["words"], F.col("n_words")).otherwise(F.col("size"))
    return (p["back"] == 0) | (band(p) != _band(n, p["least"], p["edits"]))


def key(p: Column, let=lambda value, body: body(value)) -> Column:
    """The key of column ``line``, of ``size`` characters and ``n_words`` words (``parts``, split at each blank), at one of its places.  Two lines within so many edits share one.

    All lines of a band have edits + 1 segments at the same places, the first ones counted from the start and the others from
    the end; what is longer than the band's shortest line lies between.  If two lines are within so many edits, some segment
    number i, from 0, is not edited, with i edits before it and at most edits - i behind: so it has moved by at most i from the start,
    or edits - i from the end.  A segment that can move by s has s units more than the others, and a key for each of the s + 1
    pieces of it that are s units shorter: whichever way it moved, one piece of either line is the same text.  ``let`` is _let() where functions of arrays are at work anyway, so the band is told once.
    """
    e = p["edits"]
    slack = F.floor(e * e / 4).cast("int")  # the sum of slacks()

    def of(low: Column, size: Column) -> Column:
        own = lambda gram: F.xxhash64(low, p["i"], e, p["words"], gram(p["many"] * size + p["more"], size, p["from_end"]))
        return F.when(p["words"], own(words)).otherwise(own(characters))

    return let(band(p), lambda low: let(F.greatest(F.lit(0), F.floor((low - slack) / (e + 1)).cast("int")), lambda size: of(low, size)))


def _limits(edits: int | None, min_chars: int) -> tuple[tuple[int, int], ...]:
    """LIMITS, or the one limit asked for."""
    if edits is None:
        return LIMITS
    if min_chars <= edits:
        raise ValueError("lines must be longer than the edits allowed")
    return ((min_chars, edits),)


def placed(limits: tuple[tuple[int, int], ...], by_words: bool) -> Column:
    """The places of the keys of each limit that can link a line (line, size, n_words): those of its class, and of the class below if its edits reach it.  Places whose keys the line has anyway (see counts()) are left out here, once for all of a limit's places."""
    found = []
    for unit, chosen in (("size", limits), ("n_words", WORD_LIMITS if by_words else ())):
        for n, (least, edits) in enumerate(chosen):
            fits = F.col(unit) >= least if n + 1 == len(chosen) else F.col(unit).between(least, chosen[n + 1][0] + edits - 1)
            if by_words and unit == "size":  # the other line has so many blanks more at most
                fits = fits & (F.col("n_words") < WORDS_ONLY + edits)
            for back in (0, edits):
                told = counts({"words": F.lit(unit == "n_words"), "edits": F.lit(edits), "least": F.lit(least), "back": F.lit(back)})
                own = F.array(*(F.struct(*map(F.lit, x)) for x in places(least, edits, unit == "n_words") if x[3] == back)).cast(f"array<{PLACE}>")
                found.append(F.when(fits & told, own).otherwise(F.array().cast(f"array<{PLACE}>")))
    return F.concat(*found)


def coded(seed: int) -> Column:
    """A line's words as a text of one character each, by 20 bits of a hash."""
    return F.decode(F.unhex(F.array_join(F.transform(F.split("line", " "), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w, F.lit(seed)), F.lit(1 << 20)) + 0x10000), 8, "0")), "")), "UTF-32")


def planes(line: Column) -> Column:
    """A line as bit vectors: for each ROWS characters PLANES + 1 longs, bit t of the j-th being bit j of the low bits of the character at ROWS * word + t - 2, and of the last whether there is such a character.

    The bits are cut out of the last byte of each character's code, all at once, so no expression looks at single characters.
    """
    lows = F.regexp_replace(F.decode(F.encode(line, "UTF-32"), "ISO-8859-1"), "(?s)...(.)", "$1")
    bit = lambda low, j: F.translate(low, "".join(map(chr, range(256))), "".join(str(x >> j & 1) for x in range(256)))
    size = F.char_length(line)
    word = lambda own, x: F.conv(F.reverse(F.substring(F.get(own, F.pmod(x, F.lit(PLANES + 1))), F.floor(x / (PLANES + 1)).cast("int") * ROWS + 1, F.lit(64))), 2, -10).cast("bigint")
    count = (F.floor(size / ROWS).cast("int") + 1) * (PLANES + 1)
    padded = lambda row: F.concat(F.lit("00"), row, F.repeat(F.lit("0"), F.lit(64)))
    rows = lambda low: F.array(*(padded(bit(low, j)) for j in range(PLANES)), padded(F.repeat(F.lit("1"), size)))
    return _let(lows, lambda low: _let(rows(low), lambda own: F.transform(F.sequence(F.lit(0), count - 1), lambda x: word(own, x))))


def within(a: Column, b: Column, rows: Column, longer: Column, edits: int) -> Column:
    """Whether two lines, given by planes(), are within so many edits by the bits compared: of two lines within them always true.

    a is the shorter, of ``rows`` units, b is ``longer`` units longer, at most ``edits``, which is 4 at most.  The edit matrix
    is walked along the diagonals of the band that edits can reach, ROWS rows at a time.  Bit t of a vector r[e][d] stands
    for row ROWS * word + t - 2 and says whether that row's cell on diagonal d can be reached with e edits: from a cell with
    one edit less on this diagonal or a neighbouring one, and then along equal units, which an addition carries through a
    whole run of them at once.  Bit ROWS + 2 is carried to the next word.
    """
    if not 1 <= edits <= 4:
        raise ValueError("1 to 4 edits")
    long = lambda x: F.lit(x).cast("bigint")
    payload, kept, wide = long(((1 << ROWS) - 1) << 2), long(((1 << ROWS + 1) - 1) << 2), PLANES + 1
    up = lambda x: F.call_function("shiftleft", x, F.lit(1))
    least = -F.floor((F.lit(edits) - longer) / 2).cast("int")
    diagonals = F.sequence(least, longer - least)
    at = lambda vectors, i: F.coalesce(F.get(vectors, i), long(0))

    def equal(w: Column, d: Column) -> Column:
        """The rows whose units on diagonal d are equal."""
        other = lambda j: _shifted(F.get(b, w * wide + j), d)
        differ = F.get(a, w * wide).bitwiseXOR(other(0))
        for j in range(1, PLANES):
            differ = differ.bitwiseOR(F.get(a, w * wide + j).bitwiseXOR(other(j)))
        return F.get(a, w * wide + PLANES).bitwiseAND(other(PLANES)).bitwiseAND(F.bitwise_not(differ)).bitwiseAND(payload)

    def along(seeds: Column, runs: Column) -> Column:
        return _let(seeds.bitwiseAND(kept), lambda s: s.bitwiseOR((s.bitwiseAND(runs) + runs).bitwiseXOR(runs)).bitwiseAND(kept))

    def level(e: int, found: list[Column], state: Column, runs: Column, w: Column) -> Column:
        """The vectors of e to edits edits, all of them in one array of arrays; found: those of fewer."""
        before = lambda i: F.shiftrightunsigned(at(F.get(state, F.lit(e)), i), ROWS).bitwiseAND(4)

        def own(d: Column, i: Column) -> Column:
            if e == 0:
                return F.when(d == 0, along(F.when(w == 0, long(4)).otherwise(before(i)), at(runs, i))).otherwise(long(0))
            last = found[-1]
            return along(_let(at(last, i), lambda same: same.bitwiseOR(up(same))).bitwiseOR(at(last, i - 1)).bitwiseOR(up(at(last, i + 1))).bitwiseOR(before(i)), at(runs, i))

        made = F.transform(diagonals, own)
        return _let(made, lambda r: F.array(*found, r) if e == edits else level(e + 1, [*found, r], state, runs, w))

    none = F.transform(diagonals, lambda _: long(0))
    step = lambda state, w: _let(F.transform(diagonals, lambda d: equal(w, d)), lambda runs: level(0, [], state, runs, w))
    last = F.aggregate(F.sequence(F.lit(0), F.floor(rows / ROWS).cast("int")), F.array(*([none] * (edits + 1))), step, lambda s: at(F.get(s, F.lit(edits)), longer - least))
    return F.call_function("shiftrightunsigned", last, F.pmod(rows, F.lit(ROWS)) + 2).bitwiseAND(1) == 1


def _shifted(vector: Column, d: Column) -> Column:
    return F.when(d >= 0, F.call_function("shiftrightunsigned", vector, d)).otherwise(F.call_function("shiftleft", vector, -d))


def near(x: Column, y: Column, edits: int, size: str = "size", vectors: str = "planes", texts: tuple[str, ...] = ("line",)) -> Column:
    """Whether two lines (structs) are within so many edits: by the bit vectors, and what they let pass by the texts in full."""
    pair = F.when(x[size] <= y[size], F.struct(x[vectors].alias("a"), y[vectors].alias("b"), x[size].alias("rows"))).otherwise(F.struct(y[vectors].alias("a"), x[vectors].alias("b"), y[size].alias("rows")))
    out = F.abs(x[size] - y[size]) <= edits
    if edits <= 4:
        out = out & _let(pair, lambda p: within(p["a"], p["b"], p["rows"], F.abs(x[size] - y[size]), edits))
    for t in texts:
        out = out & (F.levenshtein(x[t], y[t], edits) >= 0)
    return out


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, if body is asked for at all."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, sum (a hash of text, by which rows of one doc_id are told apart), line_no (from 0), line (blanks around it dropped) of each line of text."""
    cut = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("sum"), F.split("text", "\n").alias("parts"))
    return cut.select("doc_id", "sum", F.posexplode("parts").alias("line_no", "line")).select("doc_id", "sum", "line_no", F.trim("line").alias("line"))


def _links(limits: tuple[tuple[int, int], ...], by_words: bool) -> Column:
    """From an array of lines (id, block, own, by, size, keys, n_words, planes, line, word_planes, code1, code2) and blocks i and j: links (a, b) that connect what the links between the blocks' lines (or within one if i = j) connect, those between two lines without ``own`` aside.

    Lines are taken one by one.  A line is compared only with such earlier ones as are not yet in a group that it was linked
    to, so a group of lines that are all alike takes one comparison for each line and not one for each pair.
    """
    def linked(x: Column, y: Column) -> Column:
        by_characters, by_word = F.lit(False), F.lit(False)
        for least, edits in limits:
            by_characters = F.when(F.least(x["size"], y["size"]) >= least, near(x, y, edits)).otherwise(by_characters)
        for least, edits in WORD_LIMITS if by_words else ():
            by_word = F.when(F.least(x["n_words"], y["n_words"]) >= least, near(x, y, edits, "n_words", "word_planes", ("code1", "code2"))).otherwise(by_word)
        if by_words:
            by_characters = (F.least(x["n_words"], y["n_words"]) < WORDS_ONLY) & by_characters
        # sizes tell most pairs apart at less cost than keys
        alike = F.abs(x["size"] - y["size"]) <= max(e for _, e in limits)
        if by_words:
            alike = alike | (F.abs(x["n_words"] - y["n_words"]) <= max(e for _, e in WORD_LIMITS))
        # two lines of a group that one key makes are compared there only if it is the least key that they share
        shared = F.when(x["by"].isNull() | (x["by"] != y["by"]), F.arrays_overlap(x["keys"], y["keys"])).otherwise(F.array_min(F.array_intersect(x["keys"], y["keys"])) == x["by"])
        return alike & shared & (by_characters | by_word)

    line = lambda n: F.get(F.col("lines"), n)
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def meets(groups: Column, n: Column) -> Column:
        """Places of earlier lines that the n-th is linked to, one of each group."""
        def one(found: Column, m: Column) -> Column:
            apart = (line(n)["own"] | line(m)["own"]) & ((F.col("i") == F.col("j")) | (line(n)["block"] != line(m)["block"]))
            new = ~F.exists(found, lambda z: F.get(groups, z) == F.get(groups, m))
            return F.when(apart & new & (line(n)["id"] != line(m)["id"]), F.when(_let(F.struct(line(n).alias("x"), line(m).alias("y")), lambda p: linked(p["x"], p["y"])), F.concat(found, F.array(m))).otherwise(found)).otherwise(found)

        before = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(before, F.array().cast("array<int>"), one)

    def step(state: Column, n: Column) -> Column:
        groups = state["groups"]

        def joined(found: Column) -> Column:
            merged = F.transform(groups, lambda g: F.when(F.exists(found, lambda z: F.get(groups, z) == g) | (g == n), n).otherwise(g))
            more = F.transform(found, lambda m: F.struct(line(n)["id"].alias("a"), line(m)["id"].alias("b")))
            return F.struct(F.when(F.size(found) > 0, merged).otherwise(groups).alias("groups"), F.concat(state["links"], more).alias("links"))

        return _let(meets(groups, n), joined)

    places = F.sequence(F.lit(0), F.size("lines") - 1)
    return F.aggregate(places, F.struct(places.alias("groups"), empty.alias("links")), step, lambda s: s["links"])


def _part_size(blocks: Column) -> Column:
    """Blocks to a part, of a group of so many blocks."""
    return F.least(F.ceil(blocks / PARTS), F.lit(PART_BLOCKS)).cast("int")


def _paired(told: DataFrame) -> DataFrame:
    """i, j and lines (the members, in order) of each two blocks i <= j of a component (component, blocks, block, member) that have lines to compare.

    Members meet by parts, one row for each two parts; the blocks of these are paired behind the shuffle, where copies need no disk.
    """
    part, parts = F.floor(F.col("block") / _part_size(F.col("blocks"))).cast("int"), F.ceil(F.col("blocks") / _part_size(F.col("blocks"))).cast("int")
    spread = told.select("component", "blocks", part.alias("part"), "member", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    met = spread.groupBy("component", "blocks", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")).agg(F.array_sort(F.collect_list("member")).alias("members"))
    held = lambda p: F.sequence(p * _part_size(F.col("blocks")), F.least((p + 1) * _part_size(F.col("blocks")), F.col("blocks")) - 1)
    two = F.flatten(F.transform(held(F.col("p")), lambda i: F.transform(F.filter(held(F.col("q")), lambda j: i <= j), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    each = met.filter(F.size("members") > 1).select("members", F.explode(two).alias("at")).select("members", "at.i", "at.j")
    lines = F.filter("members", lambda x: (x["block"] == F.col("i")) | (x["block"] == F.col("j")))
    return each.select("i", "j", lines.alias("lines")).filter(F.size("lines") > 1)


def _sizes(groups: DataFrame) -> DataFrame:
    """of, blocks of the groups of lines (component, size, own) that have lines to compare."""
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("bytes") / BLOCK_CHARS)).cast("int")
    counted = groups.groupBy(F.col("component").alias("of")).agg(F.count("*").alias("many"), F.sum("size").alias("bytes"), F.max("own").alias("any"))
    return table(counted.filter("many > 1 and any").select("of", blocks.alias("blocks")), "sizes")


def _firsts(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """d, s, l, id and places (component, blocks, block, own, by) of each line of groups that sizes names."""
    found = groups.join(sizes.hint("merge"), F.col("component") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return table(found.groupBy(F.col("doc_id").alias("d"), F.col("sum").alias("s"), F.col("line_no").alias("l"), "id").agg(F.collect_list(F.struct("component", "blocks", "block", "own", "by")).alias("places")), "firsts")


def _by_keys(groups: DataFrame, sizes: DataFrame, keyed) -> tuple[DataFrame, DataFrame]:
    """groups and sizes with each large group replaced by those that its lines' keys make.

    Chains of shared keys can run through very many lines of which each shares keys with few.  As one group such lines would
    all meet each other, on disk too; as groups by key each has a copy for each of its keys, whatever number of lines are
    chained.  keyed: from _firsts() to those lines' columns, their texts' ``keys`` and ``place``.
    """
    large = sizes.filter(F.col("blocks") > LARGE)
    if large.isEmpty():
        return groups, sizes
    firsts = _firsts(groups, large)
    lines = keyed(firsts).select("doc_id", "sum", "line_no", "id", "size", "place", F.explode(F.array_distinct("keys")).alias("by"))
    split = table(lines.select("doc_id", "sum", "line_no", "id", "size", F.xxhash64("place.component", "by").alias("component"), "place.own", "by"), "keyed")
    more = _sizes(split)
    kept = table(sizes.filter(F.col("blocks") <= LARGE).unionByName(more), "sizes")
    both = table(groups.unionByName(split), "banded")
    drop(firsts, split, more, groups, sizes)
    return both, kept


def _frequent(distinct: DataFrame) -> int:
    """From how many copies on (2 at least, a power of two) lines are few enough to be broadcast."""
    bits = distinct.filter("n > 1").groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).count().collect()
    least, held = 1, sum(r["count"] for r in bits)
    while held > BROADCAST_ROWS:
        held -= sum(r["count"] for r in bits if r.bits == least)
        least += 1
    return 1 << least


def line_classes(docs: DataFrame, edits: int | None = None, min_chars: int = 1) -> DataFrame:
    """doc_id, sum, line_no of every line that repeats an earlier one: an occurrence, other than the first, of a class of lines linked by equality or few edits.

    Edits are at most ``edits`` characters; or if that is not given, the limit in LIMITS, for lines under WORDS_ONLY words, or
    in words that in WORD_LIMITS, as the shorter line has it.  Order is (doc_id, sum, line_no), sum being a hash of the document's text: rows that share a doc_id
    but not the text are documents each, and rows that share both are one.
    Blank lines and lines under ``min_chars`` characters, blanks around them not counted, are left alone, as are null texts
    and null doc_ids.
    """
    limits = _limits(edits, min_chars)
    docs, by_words, spot = docs.filter("doc_id is not null"), edits is None, ["doc_id", "sum", "line_no"]
    # characters are counted only where it matters: that, and trimming at the right, takes as long as all else that is done with a line
    looked_at = F.ltrim("line", F.lit(" \t\r")) != ""
    if min_chars > 1:
        looked_at = looked_at & (F.octet_length("line") >= min_chars) & (F.char_length("line") >= min_chars)
    lines = lines_of(docs).filter(looked_at)
    n_words = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    digest = F.unhex(F.md5("line"))
    marked = table(lines.select(*spot, digest.alias("digest"), F.xxhash64("line").alias("id"), F.octet_length("line").alias("size"), n_words.alias("n_words")), "marked")
    distinct = table(marked.groupBy("digest").agg(F.min(F.struct(*spot, "id", "size", "n_words")).alias("first"), F.count("*").alias("n")).select("digest", "first.id", *(f"first.{c}" for c in spot), "first.size", "first.n_words", "n"), "lines")

    # candidates: ids chained by shared keys.  An id is a 64-bit hash; two lines that share one are compared all the same.  Of the most frequent lines the first occurrence only makes keys
    often = table(distinct.filter(F.col("n") >= _frequent(distinct)).select(F.col("id").alias("of"), F.col("digest").alias("same"), F.struct(*spot).alias("first")), "often")
    long_enough = lines.filter(F.octet_length("line") >= limits[0][0]).withColumn("id", F.xxhash64("line"))
    once = long_enough.join(F.broadcast(often), F.col("id") == F.col("of"), "left").filter(F.col("first").isNull() | (F.col("first") == F.struct(*spot)) | (F.col("same") != digest))
    # the keys go through one shuffle, whatever share of them is met again: places are walked by explode(), as functions of arrays are not compiled
    split = {"size": F.char_length("line"), "parts": F.split("line", " ")}
    at = F.when(F.col("size") >= limits[0][0], placed(limits, by_words))
    walked = once.select("id", "line").withColumns(split).withColumn("n_words", F.size("parts")).select("id", "line", "size", "parts", "n_words", F.explode(at).alias("p"))
    pairs = walked.select("id", key(F.col("p")).alias("key"))
    chained = pairs.withColumn("head", F.min("id").over(Window.partitionBy("key"))).filter("id != head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    found = table(components(chained), "candidates")
    members = table(found.select(F.col("id").alias("member"), "component").unionByName(found.select(F.col("component").alias("member"), "component").distinct()), "members")
    # a line meets those of its component in two bands of word counts, its own and the next: counts of linked lines are a band apart at most.  Two lines of the band before have met there
    slack = max(e for _, e in (*limits, *WORD_LIMITS))
    span = F.floor(F.log(F.col("n_words") + 20) / math.log1p(slack / 21)).cast("int")
    banded = distinct.join(members.hint("merge"), distinct.id == members.member).select(*spot, "id", "size", F.explode(F.array(*(F.struct((span + n).alias("band"), F.lit(n == 0).alias("own")) for n in (0, 1)))).alias("b"), "component")
    banded = table(banded.select(*spot, "id", "size", F.xxhash64("component", "b.band").alias("component"), "b.own", F.lit(None).cast("bigint").alias("by")), "banded")

    # the text of each distinct candidate line: where it first occurs
    def texts(firsts: DataFrame) -> DataFrame:
        holders = sift(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("key")), "key", sieve(firsts.select(F.xxhash64("d", "s").alias("key")), "key"))
        found = sift(lines_of(holders).filter(looked_at).withColumn("at", F.xxhash64(*spot)), "at", sieve(firsts.select(F.xxhash64("d", "s", "l").alias("at")), "at"))
        found = found.join(firsts.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("sum") == F.col("s")) & (F.col("line_no") == F.col("l")) & (F.xxhash64("line") == F.col("id")))
        found = found.select(*spot, "places", "id", "line").withColumns(split).withColumn("n_words", F.size("parts"))
        return found.withColumn("keys", F.transform(placed(limits, by_words), lambda p: key(p, _let)))

    banded, sizes = _by_keys(banded, _sizes(banded), lambda firsts: texts(firsts).withColumn("size", F.octet_length("line")).withColumn("place", F.explode("places")))
    # what a line is compared by is made once, whatever number of groups it is in
    firsts = _firsts(banded, sizes)
    told = texts(firsts)
    told = told.withColumns({f"code{seed}": F.when(F.lit(by_words) & (F.col("n_words") >= WORD_LIMITS[0][0]), coded(seed)) for seed in (1, 2)})
    # characters are compared in lines of few words only, so the others do without
    few = F.lit(not by_words) | (F.col("n_words") < WORDS_ONLY + limits[-1][1])
    told = told.withColumns({"planes": F.when(few, planes(F.col("line"))), "word_planes": F.when(F.col("code1").isNotNull(), planes(F.col("code1"))), "line": F.when(few, F.col("line"))})
    told = told.withColumn("place", F.explode("places"))
    member = F.struct("id", "place.block", "place.own", "place.by", "size", "keys", "n_words", "planes", "line", "word_planes", "code1", "code2")
    held = _paired(told.select("place.component", "place.blocks", "place.block", member.alias("member")))
    compared = table(held.select(F.explode_outer(_links(limits, by_words)).alias("l")).filter("l is not null").select("l.a", "l.b"), "compared")
    joined = table(components(compared), "classes")
    drop(often, found, members, banded, sizes, firsts, compared)

    # first occurrence of each class, then every other occurrence
    labelled = distinct.join(joined.withColumnRenamed("id", "node").hint("merge"), F.col("id") == F.col("node"), "left").select("digest", *spot, "n", F.coalesce("component", "id").alias("root"))
    roots = table(joined.select("component").distinct(), "roots")
    labelled = table(labelled.join(roots.withColumnRenamed("component", "linked").hint("merge"), F.col("root") == F.col("linked"), "left"), "labelled")
    classes = table(labelled.filter("linked is not null").groupBy("linked").agg(F.min(F.struct(*spot)).alias("best")).select(F.col("linked").alias("class"), "best"), "first_lines")
    linked = labelled.filter("linked is not null").join(classes.hint("merge"), F.col("linked") == F.col("class")).select("digest", "best")
    copied = labelled.filter("linked is null and n > 1").select("digest", F.struct(*spot).alias("best"))
    repeated = table(linked.unionByName(copied).withColumnRenamed("digest", "of"), "repeated")
    drop(distinct, joined, roots, labelled, classes)
    spots = sift(marked.withColumn("h", F.xxhash64("digest")), "h", sieve(repeated.select(F.xxhash64("of").alias("h")), "h"))
    hits = spots.join(repeated.hint("merge"), F.col("digest") == F.col("of"))
    return hits.filter(F.struct(*spot) != F.col("best")).select(*spot).distinct()


def removed_lines(docs: DataFrame, edits: int | None = None, min_chars: int = 1) -> DataFrame:
    """doc, of (the hash of the text), removed (sorted line numbers) of the documents that lose lines."""
    return table(line_classes(docs, edits, min_chars).groupBy(F.col("doc_id").alias("doc"), F.col("sum").alias("of")).agg(F.array_sort(F.collect_list("line_no")).alias("removed")), "removed")


def dedup_report(docs: DataFrame, edits: int | None = None, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines of each row (doc_id, text); a null text has no lines.  Rows equal in doc_id and text lose the same lines; rows that share only the doc_id are judged apart.  Other columns are not looked at."""
    removed = removed_lines(docs, edits, min_chars)
    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("sum"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("bigint").alias("n_lines"))
    joined = counted.join(removed.hint("merge"), (F.col("doc_id") == F.col("doc")) & (F.col("sum") == F.col("of")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))


def drop_lines(docs: DataFrame, edits: int | None = None, min_chars: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, texts without the lines that repeat earlier ones.

    A document that loses lines and has nothing but blanks left goes; one that had none to lose stays as it is, as do null
    texts.  Rows equal in doc_id and text are cut alike.  Only documents that lose lines, and the few that the sieve can't
    tell from them, are shuffled.
    """
    types = dict(docs.dtypes)
    removed = removed_lines(docs, edits, min_chars)
    among = sieve(removed.select(F.xxhash64("doc", "of").alias("key")), "key")
    rows = wrapped(docs, id=F.col("doc_id").cast("bigint"), sum=F.xxhash64("text")).withColumn("key", F.xxhash64("id", "sum"))
    hit = sift(rows, "key", among).join(removed.hint("merge"), (F.col("id") == F.col("doc")) & (F.col("sum") == F.col("of")), "left")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(F.split("row.text", "\n"), lambda x, n: ~F.array_contains("removed", n)), "\n"))
    cut = hit.withColumn("left", text).filter("removed is null or trim(left) != ''")
    new = F.col("row").withField("text", F.col("left"))
    if "n_chars" in types:
        new = new.withField("n_chars", F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(F.char_length("left").cast(types["n_chars"])))
    return unwrapped(cut.select(new.alias("row")).unionByName(sift(rows, "key", among, inside=False).select("row")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(read(spark, sf_dir, "documents"))
