"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are equal or near: at most `edits(length)` insertions, deletions and substitutions apart, by the
length of the shorter line (none below 20 code points, 1 below 40, else 2). Equal lines are one line of
the join. A line is split into threshold + 1 even segments, which are indexed by (length, number,
content). A line that is as long or up to threshold longer probes the index with those of its substrings
that a segment could have become, and no others: the edits to the left and to the right of a segment are
bounded by its number. A shared segment makes a candidate, and a bit-parallel edit distance within a
band of 2 * threshold + 1 diagonals decides, after common ends are trimmed.

A list of the index with more than `HOT` lines (of a template with a number or a name in it, say) gives
no pairs by itself: that would be all pairs. Its lines and those that probe it are joined in a finer way,
whose candidates are links, or few for each line. With common ends stripped, two lines that are one or two edits apart
differ in their first and in their last character. So, for two edits, lines meet that are equal but for the
block of the first difference and the block of the last one, coarse blocks first, and only where both blocks
differ within the group; where many lines meet the blocks are cut in four, down to single characters.
For one edit the character at each place is left out, and what stays is the key.

Lines that are linked over any number of links are one class. Each class keeps its first line (by
doc_id, then place), wherever it is; all other lines of the class go.

Work is spread by content hashes: equal lines are merged by partial aggregation before any shuffle, so a
line that a third of all documents have is one row afterwards, and joins on a segment can be split as
they are plain joins. As an edit changes the counts of characters by two at most, the joins only give
pairs whose counts of twelve letters differ by 2 * threshold at most; that loses no link. Candidates are
pairs of 64-bit hashes; lines are told apart by 128 bits from the verification on.

Edge cases: a null or empty text has no lines that count and stays as it is; lines of white space only
are neither joined nor removed; very long lines are whole; a null doc_id comes last, and rows that repeat
a doc_id (or have none) are one document in the order, so of equal lines at equal places in them none
goes; an empty table gives an empty result; further columns stay, whatever their names are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_row, cut, of_row, release, table
from .components import components

#: (least length, edits), the longest first.
EDITS = ((40, 2), (20, 1))


def _place(doc_id: Column, line: Column) -> Column:
    """The order of lines: by doc_id, null last, then by place."""
    doc = F.coalesce(doc_id, F.lit(2**63 - 1)).cast("decimal(38,0)")
    return doc * F.lit(2**32).cast("decimal(11,0)") + line.cast("decimal(10,0)")


def _key(line: Column) -> Column:
    """64 bits, by which candidates are found."""
    return F.xxhash64(line)


def _wide(line: Column) -> Column:
    """128 bits, by which lines are told apart."""
    return F.unhex(F.md5(line))


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, at and line of all lines with a word."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return docs.select("doc_id", F.posexplode(lines).alias("at", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def different(docs: DataFrame) -> DataFrame:
    """key, line, size and counts of each different line; the last two are counted before the shuffle, as two joins need them after it."""
    lines = exploded(docs).select("line", F.length("line").alias("size"))
    return lines.withColumn("counts", counts()).distinct().select(_key(F.col("line")).alias("key"), "line", "size", "counts")


#: Frequent and less frequent letters, of one byte each; a text without them only has more candidates.
LETTERS = "aeioslhkdmcp"


def counts() -> Column:
    """How often a line has each of twelve letters, modulo 16, as one number. Bytes are counted, which is quicker than code points."""
    each = [(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(15).cast("long")) for c in LETTERS]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(c, 4 * i) for i, c in enumerate(each)])


def _count_distance(a: Column, b: Column) -> Column:
    part = lambda x, i: F.shiftrightunsigned(x, 4 * i).bitwiseAND(F.lit(15).cast("long"))
    apart = [(part(a, i) - part(b, i)).bitwiseAND(F.lit(15).cast("long")) for i in range(len(LETTERS))]
    return reduce(lambda x, y: x + y, [F.least(d, 16 - d) for d in apart])


def _segment(length: int | Column, parts: int, i: int) -> tuple[Column, Column]:
    """Begin (from 0) and length of segment i of parts; the last ones are one longer where it doesn't divide."""
    short, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    ahead = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - longer))
    return short * i + ahead, short + (F.lit(i) >= F.lit(parts) - longer).cast("int")


def _hash(threshold: int, length: Column, i: int, text: Column) -> Column:
    return F.xxhash64(F.lit(threshold), length, F.lit(i), text)


def segments(threshold: int) -> Column:
    """Hashes of a line's segments, with its size."""
    n = F.col("size")
    out = []
    for i in range(threshold + 1):
        begin, size = _segment(n, threshold + 1, i)
        out.append(_hash(threshold, n, i, F.substr("line", begin + 1, size)))
    return F.array(*out)


def probes(threshold: int) -> Column:
    """Hashes of the substrings that may be segments of lines up to threshold shorter, but for a line's own segments."""
    n = F.col("size")
    out = []
    for shorter in range(threshold + 1):
        m = n - shorter
        for i in range(threshold + 1):
            begin, size = _segment(m, threshold + 1, i)
            # i edits at most to the left if it is the first match, and threshold - i to the right of the last.
            left = range(-i, i + 1)
            right = range(shorter - (threshold - i), shorter + (threshold - i) + 1)
            for move in sorted(set(left) & set(right)):
                if not shorter and not move:
                    continue
                # Always inside the line, as the shortest lines' segments are longer than any move.
                out.append(_hash(threshold, m, i, F.substr("line", begin + move + 1, size)))
    return F.array(*out)


#: A list of the index that is longer is joined in a finer way.
HOT = 32


def candidates(lines: DataFrame) -> DataFrame:
    """Pairs a, b of keys whose lines share a segment of at most HOT lines, and alike counts; with a null, b is a line of longer lists.

    lines: as different() gives them. The third column is the threshold.
    """
    n, found = F.col("size"), []
    counted = lines.filter(n >= min(least for least, _ in EDITS))
    upper = None
    for least, threshold in EDITS:
        # A line is indexed under the threshold of its own length; longer ones probe under that too.
        mine = n >= least if upper is None else (n >= least) & (n < upper)
        asks = n >= least if upper is None else (n >= least) & (n < upper + threshold)
        index = counted.filter(mine).select("key", "counts", F.explode(segments(threshold)).alias("h"))
        probe = counted.filter(asks).select("key", "counts", F.explode(probes(threshold)).alias("h"))
        # Of a longer list one line is enough to tell who asks for it.
        w = Window.partitionBy("h")
        lists = index.withColumn("hot", F.count("*").over(w) > HOT).withColumn("least", F.min("key").over(w)).filter(~F.col("hot") | (F.col("key") == F.col("least")))
        hot = F.col("i.hot")
        # Segments at the same place are shared by the index with itself, whose exchange is used twice.
        for other, order in ((index, F.col("i.key") < F.col("p.key")), (probe, F.col("i.key") != F.col("p.key"))):
            alike = order & (_count_distance(F.col("i.counts"), F.col("p.counts")) <= 2 * threshold)
            pairs = lists.alias("i").join(other.alias("p"), (F.col("i.h") == F.col("p.h")) & (hot | alike))
            found.append(
                pairs.select(
                    F.when(~hot, F.least("i.key", "p.key")).alias("a"),
                    F.when(hot, F.col("p.key")).otherwise(F.greatest("i.key", "p.key")).alias("b"),
                    F.when(hot, threshold).otherwise(0).alias("threshold"),
                )
            )
        upper = least
    return reduce(DataFrame.union, found).distinct()


#: So many keys, or removed lines, are broadcast at most (16 to 40 bytes each); beyond that joins are shuffled.
SMALL = 1_000_000


def _bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def _without(text: Column, *places: Column) -> Column:
    """text without the characters at the places (from 0, ascending)."""
    out, at = [], F.lit(0)
    for p in places:
        out.append(F.substr(text, at + 1, p - at))
        at = p + 1
    return F.concat(*out, F.substr(text, at + 1))


def _pairs_of(rows: DataFrame, by: str) -> DataFrame:
    """Pairs a < b of keys of rows that are equal in `by`."""
    one, other = rows.select(by, F.col("key").alias("a")), rows.select(F.col(by).alias("_by"), F.col("key").alias("b"))
    return one.join(other, (F.col(by) == F.col("_by")) & (F.col("a") < F.col("b"))).select("a", "b")


def one_edit(lines: DataFrame) -> DataFrame:
    """Pairs a < b of keys of all lines (key, line, size) that are one edit apart, which is at the same place in both."""
    places = F.sequence(F.lit(0), F.col("size"))
    whole = F.transform(places, lambda p: F.xxhash64(p, "line"))
    less = F.transform(places, lambda p: F.when(p < F.col("size"), F.xxhash64(p, _without(F.col("line"), p))))
    rows = lines.select("key", F.explode(F.array_compact(F.concat(whole, less))).alias("h"))
    return _pairs_of(rows, "h").distinct()


#: Lines in a group that are paired at once, and how many blocks make one of the level before.
FEW, PARTS = 8, 4


def two_edits(lines: DataFrame) -> DataFrame:
    """Pairs a < b of keys of all lines (key, line, size) that are one or two edits apart, and of others in small groups of near ones.

    Two lines are equal but for the block in which their first difference lies and the block of their last one.
    Blocks begin at an eighth of a line or more and are cut in four where more than FEW lines meet, down to one character.
    """
    bits = lambda n: F.length(F.bin(F.greatest(n, F.lit(8)) - 1))
    size = F.col("size")
    # Lines that are up to two longer meet in blocks of the shorter one's length.
    blocks = F.array_distinct(F.transform(F.array(size, size - 1, size - 2), lambda n: F.pow(F.lit(float(PARTS)), F.ceil((bits(n) - 3) / 2)).cast("int")))
    zero = F.lit(0)
    rows = lines.select("key", zero.alias("front"), zero.alias("end"), F.explode(blocks).alias("block"), F.lit(0).cast("long").alias("tag"))
    found, parts = [], 2 * PARTS
    while True:
        met = cut(_met(_outer_blocks(rows, lines, parts)))
        small = met.filter((F.col("n") <= FEW) | (F.col("block") == 1))
        one = small.filter("base").select("meets", "block", "short", F.col("key").alias("x"), F.col("left").alias("left_x"))
        other = small.select(F.col("meets").alias("m"), F.col("key").alias("y"), F.col("left").alias("left_y"))
        # Lines of which less than two blocks are left meet whatever these are; longer ones have met by what is between.
        fits = (F.col("x") != F.col("y")) & (~F.col("short") | (F.least("left_x", "left_y") <= 2 * F.col("block")))
        found.append(one.join(other, (F.col("meets") == F.col("m")) & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        many = met.filter((F.col("n") > FEW) & (F.col("block") > 1))
        if many.isEmpty():
            return reduce(DataFrame.union, found).distinct()
        rows, parts = many.select("key", "front", "end", (F.col("block") / PARTS).cast("int").alias("block"), "tag").distinct(), PARTS


def _outer_blocks(rows: DataFrame, lines: DataFrame, parts: int) -> DataFrame:
    """For each choice of a first and a last block among the outermost ones: the hash of all but these blocks, `meets`.

    One edit in a block may move what is between the blocks by one: `base` are rows without such a move, and
    the others are for the other line of a pair.
    """
    some = F.sequence(F.lit(0), F.lit(parts - 1))
    chosen = F.flatten(F.transform(some, lambda u: F.transform(some, lambda v: F.struct(u.alias("u"), v.alias("v")))))
    size, block, line = F.col("size"), F.col("block"), F.col("line")
    rows = rows.join(_bounded(lines.withColumnRenamed("key", "k")), F.col("key") == F.col("k")).select("key", "line", "size", "front", "end", "block", "tag", F.inline(chosen))
    u, v = F.col("u") * block, F.col("v") * block
    rows = rows.filter(F.col("front") + F.col("end") + u + v <= size)
    tag = F.xxhash64("tag", "block", "u", "v", F.substr(line, F.col("front") + 1, u), F.substr(line, size - F.col("end") - v + 1, v))
    rows = rows.select("key", "line", "size", (F.col("front") + u).alias("front"), (F.col("end") + v).alias("end"), "block", tag.alias("tag"))
    rows = rows.withColumn("left", size - F.col("front") - F.col("end"))
    left, front = F.col("left"), F.col("front")
    moves = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(g).alias("g")) for f in (-1, 0, 1) for g in (-1, 0, 1)])

    def met(m: Column) -> Column:
        first, last = block + m.f, block + m.g
        between = F.substr(line, front + first + 1, left - first - last)
        return F.struct(
            F.xxhash64("tag", between).alias("meets"), ((m.f == 0) & (m.g == 0)).alias("base"), F.lit(False).alias("short"),
            F.xxhash64(F.substr(line, front + 1, first)).alias("first"), F.xxhash64(F.substr(line, front + left - last + 1, last)).alias("last"),
        )

    edge = F.least(block, left)
    short = F.struct(
        F.xxhash64("tag", F.lit("short"), F.lit("")).alias("meets"), F.lit(True).alias("base"), F.lit(True).alias("short"),
        F.xxhash64(F.substr(line, front + 1, edge)).alias("first"), F.xxhash64(F.substr(line, front + left - edge + 1, edge)).alias("last"),
    )
    long_ones = F.filter(moves, lambda m: (left > 2 * block) & (left - 2 * block - m.f - m.g >= 0))
    each = F.concat(F.transform(long_ones, met), F.when(left <= 2 * block + 2, F.array(short)).otherwise(F.filter(F.array(short), lambda x: F.lit(False))))
    return rows.select("key", "front", "end", "block", "tag", "left", F.inline(each))


def _met(rows: DataFrame) -> DataFrame:
    """Rows of groups in which a pair may differ in both blocks, with the group's size n.

    The last blocks may be equal where the ends of the shorter line meet, which leaves less than two blocks of it.
    """
    w = Window.partitionBy("meets")
    told = rows.select(
        "key", "front", "end", "block", "tag", "left", "meets", "base", "short",
        F.count("*").over(w).alias("n"),
        (F.min("first").over(w) < F.max("first").over(w)).alias("firsts"),
        (F.col("short") | (F.min("last").over(w) < F.max("last").over(w))).alias("lasts"),
    )
    return told.filter("firsts and lasts").drop("firsts", "lasts")


def links(docs: DataFrame) -> DataFrame:
    """Pairs a < b of wide keys of near lines."""
    found = cut(candidates(different(docs)))
    pairs = found.filter(F.col("a").isNotNull()).select("a", "b")
    keys = _bounded(cut(found.select(F.explode(F.array_compact(F.array("a", "b"))).alias("k")).distinct()))
    texts = exploded(docs).select(_key(F.col("line")).alias("key"), "line").join(keys, F.col("key") == F.col("k"), "left_semi")
    texts = cut(texts.withColumn("wide", _wide(F.col("line"))).dropDuplicates(["wide"]).withColumn("size", F.length("line")))
    hot = found.filter(F.col("a").isNull()).select(F.col("b").alias("k"), "threshold")
    if not hot.isEmpty():
        for threshold, join in ((1, one_edit), (2, two_edits)):
            members = texts.join(_bounded(hot.filter(F.col("threshold") == threshold).select("k")), F.col("key") == F.col("k"), "left_semi").select("key", "line", "size")
            pairs = pairs.union(join(members))
        pairs = pairs.distinct()
    of = lambda side: texts.select(F.col("key").alias(side), F.col("line").alias(f"line_{side}"), F.col("wide").alias(f"wide_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").filter(near(F.col("line_a"), F.col("line_b")))
    return both.select(F.least("wide_a", "wide_b").alias("a"), F.greatest("wide_a", "wide_b").alias("b"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, at, key (wide), class (a key), first (the class's first place), n_links of the line, and removed, for each line with a word."""
    found = cut(links(docs))
    classes = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = _bounded(cut(classes.join(degree, "node")))
    place = _place(F.col("doc_id"), F.col("at"))
    lines = exploded(docs).select("doc_id", "at", _wide(F.col("line")).alias("key")).join(known, F.col("key") == F.col("node"), "left")
    lines = cut(lines.select("doc_id", "at", "key", F.coalesce("component", "key").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    # Written before it is joined, so that the join's exchanges are its own and a class of very many lines can be split.
    first = cut(lines.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("class").alias("c"), "first"))
    mine = F.coalesce("first", place)
    return lines.join(_bounded(first), F.col("class") == F.col("c"), "left").select("doc_id", "at", "key", "class", mine.alias("first"), "n_links", (place != mine).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that go; a document of which every line with a word goes is left out."""
    gone = cut(judged(docs.select("doc_id", "text")).filter("removed").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("at", "key")).alias("gone")))
    if (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= SMALL:
        gone = F.broadcast(gone)
    lines = F.split("text", "\n", -1)
    stays = F.filter(lines, lambda x, i: ~F.array_contains("gone", F.struct(i.alias("at"), _wide(x).alias("key"))))
    joined = as_row(docs, "doc_id", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("id")), "left").withColumn("stays", F.when(F.col("gone").isNotNull(), stays))
    some = F.col("stays").isNull() | F.exists("stays", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.col("stays").isNotNull(), F.array_join("stays", "\n")).otherwise(F.col("text"))
    return joined.filter(some).select(*[text.alias("text") if name == "text" else c for name, c in zip(docs.columns, of_row(docs))])


def query(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, links of its lines, the smallest doc_id of its lines' classes, and a hash of what is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.when(~F.col("removed"), F.xxhash64("at", "key"))
    first_doc = F.floor(F.col("first") / F.lit(2**32).cast("decimal(11,0)")).cast("long")
    sums = judged(docs).groupBy(F.col("doc_id").alias("id")).agg(
        F.count("*").alias("n_lines"), F.sum(F.col("removed").cast("long")).alias("n_removed"), F.sum("n_links").alias("n_links"), F.min(first_doc).alias("class_id"), F.bit_xor(kept).alias("kept_hash")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select("doc_id").join(sums, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", zero("n_lines"), zero("n_removed"), zero("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"), zero("kept_hash"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(a: Column, b: Column) -> Column:
    """Both texts without common ends, nearly; what stays of the ends doesn't change the distance."""
    x = F.struct(a.alias("a"), b.alias("b"))
    for size in (512, 256, 128, 64, 32, 16):
        x = _let(x, _without_end(size, F.left, lambda t, k: F.substr(t, F.lit(k + 1))))
        x = _let(x, _without_end(size, F.right, lambda t, k: F.left(t, F.length(t) - k)))
    return x


def _without_end(size: int, end, rest):
    def body(p: Column) -> Column:
        long = (F.length(p.a) > size) & (F.length(p.b) > size)
        same = end(p.a, F.lit(size)) == end(p.b, F.lit(size))
        return F.when(long & same, F.struct(rest(p.a, size).alias("a"), rest(p.b, size).alias("b"))).otherwise(p)

    return body


def banded(a: Column, b: Column, k: int) -> Column:
    """Edit distance of a and b if that is k at most, else some larger number. Lengths may differ by k.

    Bit v of the vectors is row j - k + v of column j; after each column the band moves down by one row,
    so vertical differences move by one bit. The distance is followed along the band's lower edge until
    that meets the last row, and along the last row from there.
    """
    band = (1 << (2 * k + 1)) - 1
    top = 1 << (2 * k)
    lit = lambda v: F.lit(v).cast("long")

    def step(p: Column, t: Column, rows: Column):
        def column(s: Column, j: Column) -> Column:
            here = F.get(t, j)
            match = reduce(lambda x, y: x.bitwiseOR(y), [F.when((j - k + v >= 0) & (F.get(p, j - k + v) == here), lit(1 << v)).otherwise(lit(0)) for v in range(2 * k + 1)])

            def after_match(m):
                sum_ = (m.bitwiseAND(s.vp) + s.vp).bitwiseAND(lit(band))
                d0 = sum_.bitwiseXOR(s.vp).bitwiseOR(m).bitwiseOR(s.vn)

                def after_d0(d):
                    hp = s.vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(s.vp)).bitwiseAND(lit(band)))
                    hn = d.bitwiseAND(s.vp)

                    def after_h(h):
                        down = F.shiftright(d, 1)
                        edge = j < rows - k
                        # Along the last row: the bit below the top, then one lower for each column.
                        bit = F.greatest(F.lit(2 * k) - 1 - (j - (rows - k)), F.lit(0)).cast("int")
                        along = h.hp.bitwiseAND(_power(bit, 2 * k)).cast("boolean").cast("int") - h.hn.bitwiseAND(_power(bit, 2 * k)).cast("boolean").cast("int")
                        return F.struct(
                            h.hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(h.hp)).bitwiseAND(lit(band))).alias("vp"),
                            down.bitwiseAND(h.hp).alias("vn"),
                            (s.dist + F.when(edge, (d.bitwiseAND(lit(top)) == 0).cast("int")).otherwise(along)).alias("dist"),
                        )

                    return _let(F.struct(hp.alias("hp"), hn.alias("hn")), after_h)

                return _let(d0, after_d0)

            return _let(match, after_match)

        return column

    def run(x: Column) -> Column:
        start = F.struct(lit(band & ~((1 << k) - 1)).alias("vp"), lit(0).alias("vn"), F.lit(k).alias("dist"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x.t) - 1), start, step(x.p, x.t, F.size(x.p)), lambda s: s.dist)

    short = F.greatest(F.length(a), F.length(b))
    chars = F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t"))
    return (
        F.when(F.abs(F.length(a) - F.length(b)) > k, F.lit(k + 1))
        .when((F.length(a) <= k) | (F.length(b) <= k), F.levenshtein(a, b))
        .otherwise(_let(chars, run))
    )


def _power(bit: Column, most: int) -> Column:
    return F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(most + 1)]), bit + 1)


def near(a: Column, b: Column) -> Column:
    """Whether two different lines are near."""
    shorter = F.least(F.length(a), F.length(b))
    out = F.lit(False)
    for least, k in reversed(EDITS):
        out = F.when(shorter >= least, _let(trimmed(a, b), _within(k))).otherwise(out)
    return out


def _within(k: int):
    return lambda p: banded(p.a, p.b, k) <= k
