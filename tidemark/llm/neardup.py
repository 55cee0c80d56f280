"""MinHash near-dedup with an LSH forest.

A document's set is that of its 5-word shingles. Documents with equal sets are one class, told by 128
bits of set fingerprint, and only the class's first document goes on. The forest has `TREES` orders of
signatures: each is the documents sorted by `DEPTH` minimum hashes of its own and then by a sketch of
all (one byte for each of `SKETCH` minimum hashes). Candidates are neighbours in an order that share a
long enough prefix. How long adapts to the region: the shortest prefix, of 2 values at least, whose run
has at most `RUN` documents. Where all `DEPTH` values are shared by more, a document's only candidate is
the one of its `RUN` neighbours on either side whose sketch is most like its own. Candidates whose
sketches agree on less than `ALIKE` bytes are let go.

Candidates are then confirmed on the full sets, in work units of bounded size: a document's set is sent
once for each unit it is in, not for each pair, and a pair that is already connected within its unit is
not compared again, as it would add nothing to the components.

What adapting hid is joined exactly: all documents that share 2 values with more than `RUN` others in
some tree (and a pair that adapting hid shares such a run) are joined by prefix filter, rarest shingles
first, where their parts are still different. Keys there hold classes of sizes, so that boilerplate that
is too short for a link stays outside the prefixes, and a key of many documents is cut into pairs of
blocks. So a group of copies costs in proportion to its size, and rows grow with the square of a group
only where that many documents of different parts share a shingle of their prefixes, that is, where they
are all close to the limit.

No task holds a group: orders are range-partitioned by the whole signature, units are cut by their
number of pairs, and components come from star contraction.

A link of similarity 0.75 is a candidate of a tree with probability 0.56 (missed by all 20 trees with
7e-8) and passes the sketch filter but for 2e-6. A pair that the edge of a range partition parts is lost
to that one tree only.

Edge cases: null and empty texts have no words: n_shingles 0, their own component, kept; fewer than five
words are one shingle; long texts are whole; doc_id is the key: rows that repeat it are one document in
the links, a null doc_id has a null component and is kept; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, table
from .components import components
from .packing import chunks
from .substrings import Unit, _mix, _multipliers

WORDS, PERCENT = 5, 75
TREES, DEPTH, SKETCH, RUN = 20, 4, 64, 32
LEAST_DEPTH = 2
#: Pairs that are confirmed in one work unit, about.
UNIT_PAIRS = 500
#: So many rows of a few numbers are broadcast at most; beyond that the join is shuffled.
SMALL = 1_000_000
#: Bytes of the sketch that candidates share at least: 4.6 standard deviations below the limit's 48.
ALIKE = 32
#: Buckets in which shingles are counted for the exact remainder, a power of two, and documents in a block of one key.
TALLY_BITS, BLOCK = 21, 1024
#: Least sizes of the classes of set sizes, a twentieth apart.
CLASSES = [1]
while CLASSES[-1] < 1 << 31:
    CLASSES.append(max(CLASSES[-1] + 1, CLASSES[-1] * 21 // 20))


def shingle_sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Each text's set, as sorted 64-bit hashes."""
    u = Unit(pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.ascii_lower(batch.column("text"))], ["doc_id", "text"]))
    long = np.flatnonzero(u.n >= WORDS)
    span = u.n[long] - WORDS + 1
    upto = np.cumsum(span)
    at = np.repeat(u.begin[long], span) + np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - span, span)
    h = u._sum(at, WORDS, 5)
    out: list = [np.zeros(0, np.uint64)] * len(u.n)
    for i, a, b in zip(long.tolist(), (upto - span).tolist(), upto.tolist()):
        out[i] = np.unique(h[a:b])
    for n in range(1, WORDS):
        rows = np.flatnonzero(u.n == n)
        for i, x in zip(rows.tolist(), u._sum(u.begin[rows], n, 20 + n)):
            out[i] = np.array([x], np.uint64)
    return out


class Hashes:
    """n hash functions, and the least value of each over a set."""

    def __init__(self, n: int, salt: int):
        self.factors = _multipliers(salt, n).astype(np.uint32) | np.uint32(1)
        self.flips = (_multipliers(salt + 1, n) >> np.uint64(32)).astype(np.uint32)

    def least(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set; none may be empty."""
        sizes = np.array([len(s) for s in sets], np.int64)
        short = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        begin = np.cumsum(sizes) - sizes
        out = np.empty((len(sets), len(self.factors)), np.uint32)
        for k, (flip, factor) in enumerate(zip(self.flips, self.factors)):
            x = (short ^ flip) * factor
            x ^= x >> np.uint32(15)
            out[:, k] = np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), begin)
        return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, mins (TREES * DEPTH minimum hashes, big-endian) and sketch; the last four null for an empty set."""
    n_hashes = TREES * DEPTH
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("mins", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        hashes = Hashes(n_hashes, 7)
        for batch in batches:
            for part in chunks(batch, most=1 << 20):
                sets = shingle_sets(part)
                n = np.array([len(s) for s in sets], np.int64)
                there = np.flatnonzero(n)
                f1 = f2 = mins = sketch = []
                if len(there):
                    every = np.concatenate([sets[i] for i in there])
                    begin = np.cumsum(n[there]) - n[there]
                    f1 = np.add.reduceat(_mix(every + np.uint64(1)), begin).astype(np.int64).tolist()
                    f2 = np.add.reduceat(_mix(every ^ np.uint64(0x5851F42D4C957F2D)), begin).astype(np.int64).tolist()
                    m = hashes.least([sets[i] for i in there])
                    raw = m.astype(">u4").tobytes()
                    mins = [raw[i * 4 * n_hashes : (i + 1) * 4 * n_hashes] for i in range(len(there))]
                    # One byte of each minimum, from all its bits.
                    low = ((m[:, :SKETCH] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()
                    sketch = [low[i * SKETCH : (i + 1) * SKETCH] for i in range(len(there))]
                wide = lambda values: [None if at < 0 else values[at] for at in place]
                place = np.full(len(n), -1)
                place[there] = np.arange(len(there))
                place = place.tolist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *[pa.array(wide(v), f.type) for v, f in zip((f1, f2, mins, sketch), list(schema)[2:])]], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, mins binary, sketch binary")


def candidates(reps: DataFrame, partitions: int) -> DataFrame:
    """Pairs a < b of neighbours in some tree, and whether a region of theirs holds more than RUN documents (crowd).

    A document of such a region that has no pair there is given as a pair of itself. reps: rep, mins, sketch.
    """
    turned = lambda t: t * SKETCH // TREES
    key = lambda t: F.concat(F.substring("mins", 1 + 4 * DEPTH * t, 4 * DEPTH), F.substring("sketch", 1 + turned(t), SKETCH), F.substring("sketch", 1, turned(t)))
    keys = [F.struct(F.lit(t).alias("tree"), key(t).alias("key")) for t in range(TREES)]
    rows = reps.select("rep", F.explode(F.array(*keys)).alias("x")).select("rep", "x.tree", "x.key")
    ordered = rows.repartitionByRange(partitions, "tree", "key").sortWithinPartitions("tree", "key")

    def neighbours(batches):
        tail = None
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(batch.num_rows, 4 * DEPTH + SKETCH)
            now = (batch.column("rep").to_numpy(zero_copy_only=False), batch.column("tree").to_numpy(zero_copy_only=False), raw)
            if tail is not None:
                now = tuple(np.concatenate([a, b]) for a, b in zip(tail, now))
            # A run that goes on in the next batch is seen there with as many rows as it takes to be crowded.
            tail = tuple(x[-4 * RUN :] for x in now)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs(*now)], ["a", "b", "crowd"])

    return ordered.mapInArrow(neighbours, "a long, b long, crowd boolean").groupBy("a", "b").agg(F.max("crowd").alias("crowd"))


def _runs(shared, depth):
    """The number of the run of `depth` shared values that each row is in, and how many rows that has. shared: with the next row."""
    run = np.concatenate([[0], np.cumsum(shared < depth)])
    return run, np.bincount(run)[run]


def _pairs(rep, tree, raw):
    """a, b and crowd of the rows of one window, which are sorted by tree and raw."""
    n = len(rep)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    same = (raw[1:, : 4 * DEPTH] == raw[:-1, : 4 * DEPTH]).reshape(n - 1, DEPTH, 4).all(axis=2) & (tree[1:] == tree[:-1])[:, None]
    shared = np.where(same.all(axis=1), DEPTH, np.argmin(same, axis=1))
    # The depth of each row's region; crowded where even whole prefixes are shared by too many.
    need, crowded = np.full(n, DEPTH), np.ones(n, bool)
    for d in range(DEPTH, LEAST_DEPTH - 1, -1):
        small = _runs(shared, d)[1] <= RUN
        need[small], crowded[small] = d, False
    crowd = _runs(shared, LEAST_DEPTH)[1] > RUN
    sketch = raw[:, 4 * DEPTH :]
    left, right = [], []
    mate, likeness = np.full(n, -1), np.zeros(n, np.int64)
    least = np.full(n, DEPTH)  # what a row shares with the row `step` on
    for step in range(1, min(RUN, n)):
        least = np.minimum(least[: n - step], shared[step - 1 :])
        i = np.flatnonzero(least >= np.minimum(need[: n - step], need[step:]))
        if not len(i):
            break
        alike = (sketch[i] == sketch[i + step]).sum(axis=1)
        i, alike = i[alike >= ALIKE], alike[alike >= ALIKE]
        dense = crowded[i]
        left.append(i[~dense])
        right.append(i[~dense] + step)
        i, alike = i[dense], alike[dense]
        for one, other in ((i, i + step), (i + step, i)):
            better = alike > likeness[one]
            mate[one[better]], likeness[one[better]] = other[better], alike[better]
    left.append(np.flatnonzero(mate >= 0))
    right.append(mate[left[-1]])
    x, y = np.concatenate(left), np.concatenate(right)
    alone = crowd.copy()
    alone[x] = alone[y] = False
    alone = np.flatnonzero(alone)
    x, y = np.concatenate([x, alone]), np.concatenate([y, alone])
    a, b, crowd = np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y]), crowd[x]
    order = np.lexsort((~crowd, b, a))
    a, b, crowd = a[order], b[order], crowd[order]
    first = np.append(np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return a[first], b[first], crowd[first]


def confirm(docs: DataFrame, pairs: DataFrame, partitions: int) -> DataFrame:
    """Links u, v that are confirmed on full sets and connect all that pairs confirm."""
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    # The smallest document that either side is paired with: near copies mostly share it, and so a unit.
    near = ends.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("near"))
    of = lambda side: near.select(F.col("x").alias(f"x_{side}"), F.col("near").alias(f"near_{side}"))
    labelled = cut(pairs.join(of("a"), F.col("a") == F.col("x_a")).join(of("b"), F.col("b") == F.col("x_b")).select("a", "b", F.least("near_a", "near_b").alias("label")))
    sizes = cut(labelled.groupBy("label").count().filter(F.col("count") > UNIT_PAIRS).select(F.col("label").alias("l"), F.ceil(F.sqrt(F.col("count") / UNIT_PAIRS)).alias("many")))
    sizes = F.broadcast(sizes) if sizes.count() <= SMALL else sizes
    # A grid of both sides: a document is in at most 2 * cuts units of its label.
    cuts = F.coalesce("many", F.lit(1).cast("long"))
    unit = F.xxhash64("label", F.pmod(F.xxhash64("a"), cuts), F.pmod(F.xxhash64("b"), cuts))
    units = cut(labelled.join(sizes, F.col("label") == F.col("l"), "left").select("a", "b", unit.alias("unit")))
    needed = cut(units.select(F.col("a").alias("id"), "unit").union(units.select(F.col("b").alias("id"), "unit")).distinct().groupBy("id").agg(F.collect_list("unit").alias("units")))
    n = needed.agg(F.sum(F.size("units"))).first()[0] or 0
    if n <= SMALL:
        needed = F.broadcast(needed)

    def to_sets(batches):
        for batch in batches:
            for part in chunks(batch):
                sets = [s.tobytes() for s in shingle_sets(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("units"), pa.array(sets, pa.binary())], ["id", "units", "set"])

    sets = docs.select("doc_id", "text").join(needed, F.col("doc_id") == F.col("id")).select("doc_id", "text", "units").mapInArrow(to_sets, "id long, units array<long>, set binary")
    rows = sets.select(F.explode("units").alias("unit"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "set").union(
        units.select("unit", "a", "b", F.lit(None).cast("binary").alias("set"))
    )

    def compare(batches):
        now, sets, root = None, {}, {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            out = ([], [])
            for unit, a, b, raw in zip(*[batch.column(c).to_pylist() for c in ("unit", "a", "b", "set")]):
                if unit != now:
                    now, sets, root = unit, {}, {}
                if b is None:
                    sets[a] = np.frombuffer(raw, np.uint64)
                    continue
                x, y = sets.get(a), sets.get(b)
                if x is None or y is None or find(a) == find(b):
                    continue
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < PERCENT * len(y):
                    continue
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * common >= PERCENT * (len(x) + len(y) - common):
                    root[find(a)] = find(b)
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["u", "v"])

    return rows.repartition(partitions, "unit").sortWithinPartitions("unit", F.col("b").isNotNull(), "a", "b").mapInArrow(compare, "u long, v long")


def _held_sets(part: pa.RecordBatch):
    """All shingles of a slice, the row of each and the sizes of the sets."""
    sets = shingle_sets(part)
    sizes = np.array([len(x) for x in sets], np.int64)
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes


#: A bucket of a group: shingles, a part that holds them and whether others do too.
TALLY = np.dtype([("bucket", "<u2"), ("n", "<u4"), ("part", "<i8"), ("mixed", "?")])
#: Buckets are summed in so many groups; a task sends a row for each.
TALLY_GROUPS = 64
TALLY_SIZE = (1 << TALLY_BITS) // TALLY_GROUPS


class Tally:
    """Shingles of each of `size` buckets, a part that holds them, and whether parts differ."""

    def __init__(self, size: int):
        self.n, self.part, self.mixed = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)

    def add(self, bucket, n, part, mixed=False) -> None:
        fresh = self.n[bucket] == 0
        self.part[bucket[fresh]] = part[fresh]
        self.mixed[bucket[mixed | (self.part[bucket] != part)]] = True
        np.add.at(self.n, bucket, n)

    def rows(self, group: int):
        """A batch of one row for each group of buckets that has any, the first being `group`: tasks hold one at a time."""
        for k in range(0, len(self.n), TALLY_SIZE):
            there = np.flatnonzero(self.n[k : k + TALLY_SIZE])
            if len(there):
                out = np.empty(len(there), TALLY)
                out["bucket"], out["n"], out["part"], out["mixed"] = there, np.minimum(self.n[k + there], 0xFFFFFFFF), self.part[k + there], self.mixed[k + there]
                yield pa.RecordBatch.from_arrays([pa.array([group + k // TALLY_SIZE], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["group", "data"])


def tally(held: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket of shingles how many there are, and whether documents of different parts hold them. held: text, rep, part."""

    def count(batches):
        counted = Tally(1 << TALLY_BITS)
        for batch in batches:
            for slice_ in chunks(batch, most=1 << 20):
                every, row, _ = _held_sets(slice_)
                bucket = (_mix(every) >> np.uint64(64 - TALLY_BITS)).astype(np.int64)
                counted.add(bucket, 1, slice_.column("part").to_numpy(zero_copy_only=False)[row])
        yield from counted.rows(0)

    def add(batches):
        groups: dict[int, Tally] = {}
        for batch in batches:
            for group, data in zip(batch.column("group").to_pylist(), batch.column("data")):
                x = np.frombuffer(data.as_buffer(), TALLY)
                groups.setdefault(group, Tally(TALLY_SIZE)).add(x["bucket"], x["n"], x["part"], x["mixed"])
        for group, counted in groups.items():
            yield from counted.rows(group)

    schema = "group int, data binary"
    summed = held.mapInArrow(count, schema).repartition(TALLY_GROUPS, "group").mapInArrow(add, schema).toArrow()
    n, mixed = np.zeros(1 << TALLY_BITS, np.uint32), np.zeros(1 << TALLY_BITS, bool)
    for group, data in zip(summed.column("group").to_pylist(), summed.column("data")):
        x = np.frombuffer(data.as_buffer(), TALLY)
        at = group * TALLY_SIZE + x["bucket"].astype(np.int64)
        n[at], mixed[at] = x["n"], x["mixed"]
    return n, mixed


def remainder(docs: DataFrame, ids: DataFrame, partitions: int) -> DataFrame:
    """All pairs a < b of different parts that may be links, by prefix filter. ids: rep, part.

    With shingles in one order for all, sets of n and m shingles whose first common one is the i-th of one (from
    0) have n - i in common at most, and links have 3/7 of n + m at least. So i allows partners of up to `most`
    = 7/3 of (n - i) - n shingles.
    """
    few = F.broadcast(ids) if ids.count() <= SMALL else ids
    held = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("rep")).select("doc_id", "text", "rep", "part")
    counted = tally(held)
    least = np.array(CLASSES, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(counted)

    def prefixes(batches):
        count, mixed = shared.value
        for batch in batches:
            for slice_ in chunks(batch, most=1 << 20):
                every, row, sizes = _held_sets(slice_)
                bucket = (_mix(every) >> np.uint64(64 - TALLY_BITS)).astype(np.int64)
                order = np.lexsort((every, count[bucket], row))
                n = sizes[row]
                i = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                most = 7 * (n - i) // 3 - n
                low, high = (3 * n + 3) // 4, np.minimum(most, 4 * n // 3)
                at = np.flatnonzero((high >= low) & mixed[bucket[order]])
                first = np.searchsorted(least, low[at], "right")
                span = np.searchsorted(least, high[at], "right") - first + 1
                other = np.repeat(first, span) + np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
                at = np.repeat(at, span)
                own = np.searchsorted(least, n[at], "right")
                both = np.minimum(own, other).astype(np.uint64) << np.uint64(32) | np.maximum(own, other).astype(np.uint64)
                key = _mix(every[order][at] ^ _mix(both * np.uint64(0x9E3779B97F4A7C15)))
                ids_of = [slice_.column(c).to_numpy(zero_copy_only=False)[row[at]] for c in ("rep", "part")]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *map(pa.array, ids_of), pa.array(n[at]), pa.array(most[at]), pa.array(other)], ["key", "rep", "part", "n", "most", "other"])

    rows = held.mapInArrow(prefixes, "key long, rep long, part long, n long, most long, other long")
    keys = cut(rows.groupBy("key").agg(F.count("*").alias("n"), (F.min("part") < F.max("part")).alias("mixed")).filter("mixed").select(F.col("key").alias("k"), F.ceil(F.col("n") / BLOCK).alias("blocks")))
    keys = F.broadcast(keys) if keys.count() <= SMALL else keys
    dealt = rows.join(keys, F.col("key") == F.col("k")).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    unit = F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with"))
    dealt = dealt.select(unit.alias("unit"), "rep", "part", "n", "most", "other", "block", (F.col("block") == F.col("with")).alias("alone"))

    def meet(batches):
        tail = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names]
            if tail is not None:
                now = [np.concatenate(x) for x in zip(tail, now)]
            # The last unit may go on in the next batch.
            whole = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            tail = [x[whole:] for x in now]
            yield from met(*[x[:whole] for x in now])
        if tail is not None:
            yield from met(*tail)

    def met(unit, rep, part, n, most, other, block, alone):
        own = np.searchsorted(least, n, "right")
        at = np.arange(len(unit))
        for step in range(1, len(unit)):
            at = at[at < len(unit) - step]
            at = at[unit[at] == unit[at + step]]
            if not len(at):
                break
            x, y = at, at + step
            good = (part[x] != part[y]) & (n[x] <= most[y]) & (n[y] <= most[x]) & (own[x] == other[y]) & (own[y] == other[x])
            good &= alone[x] | (block[x] != block[y])
            x, y = rep[x[good]], rep[y[good]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return dealt.repartition(partitions, "unit").sortWithinPartitions("unit").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = cut(signatures(docs))
    there = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(there.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "mins", "sketch")).alias("x")).select("f1", "f2", "n_shingles", F.col("x.doc_id").alias("rep"), "x.mins", "x.sketch"))
    near = cut(candidates(classes, parts))
    found = components(confirm(docs, near.filter("a < b").select("a", "b"), parts))
    # What adapting to crowded regions may have hidden, exactly.
    crowd = near.filter("crowd").select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    crowd = cut(crowd.join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("part")))
    if not crowd.isEmpty():
        rest = cut(remainder(docs, crowd, parts))
        if not rest.isEmpty():
            found = components(confirm(docs, rest, parts).union(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        release(rest)
    release(near, crowd)
    roots = classes.select("f1", "f2", F.col("n_shingles").alias("n"), "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "n", F.coalesce("component", "rep").alias("root"))
    joined = signed.select("doc_id", "n_shingles", "f1", "f2").join(roots, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_shingles") == F.col("n")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
