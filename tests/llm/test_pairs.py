"""Near duplicates, repeated passages and near lines, against brute force."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from conftest import DATA
from llm.conftest import LONG, SCHEMA, clashing
from tidemark.llm import components, lines, neardup, queries, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 75 * (len(x) + len(y) - n):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies():
    """Groups of near copies around the limit of 0.75."""
    r, docs = random.Random(4), []
    for g in range(12):
        base = [f"{r.choice('abcdefgh')}{r.randrange(4000)}" for _ in range(r.choice([6, 40, 150, 400]))]
        for _ in range(r.choice([2, 3, 25])):
            own = [w if r.random() > r.choice([0, 0.01, 0.03, 0.06]) else f"x{r.randrange(10**6)}" for w in base]
            docs.append((len(docs), " ".join(own).upper() if r.random() < 0.2 else "  ".join(own)))
    return docs


def test_near_duplicates(spark):
    docs = copies()
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = queries.queries()["op3_neardup"](spark, f"{DATA}/sf0.001").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_near_duplicates_of_odd_documents(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(clashing(odd)).collect()]
    assert len(got) == 10
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (6, 1, 6, True), (None, 2, None, True)} <= set(got)
    assert [g[2:] for g in sorted(got, key=str) if g[0] in (4, 5)] == [(4, True), (4, False)]
    assert neardup.near_duplicates(empty).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for n in root} and len(got) == len(root)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(docs):
    first, out = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = (t or "").encode().split()
        for s in range(len(w) - 12):
            first.setdefault(tuple(w[s : s + 13]), i)
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < i:
                gone[s : s + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark):
    r, docs = random.Random(1), []
    passages = [[f"p{k}_{j}" for j in range(n)] for k, n in enumerate([12, 13, 14, 30, 80])]
    for i in range(60):
        w = []
        for _ in range(r.randrange(8)):
            w += [f"u{r.randrange(10**9)}" for _ in range(r.randrange(9))]
            p = r.choice(passages)
            a = r.randrange(len(p))
            w += p[a:] if r.random() < 0.3 else p
        docs.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = substrings.remove_repeats(df, partitions=3, text=True).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in got} == brute_repeats(docs)
    assert all(sum(s.length for s in x.removed) == x.n_removed and hashlib.sha256(x.text.encode()).hexdigest() == x.kept_sha256 for x in got)


def test_repeats_of_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = queries.queries()["op4_substrings"](spark, f"{DATA}/sf0.001").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeats(docs)


def test_repeats_of_odd_documents(odd, empty):
    got = sorted(((str(r.doc_id), r.n_words, r.n_removed) for r in substrings.remove_repeats(clashing(odd)).collect()))
    assert got == sorted([("1", 0, 0), ("2", 0, 0), ("3", 0, 0), ("4", 30000, 0), ("5", 30000, 30000), ("6", 3, 0), ("6", 3, 0), ("7", 12, 0), ("None", 6, 0), ("8", 4, 0)])
    assert substrings.remove_repeats(empty).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        i, how = r.randrange(len(out)), r.random()
        if how < 0.3:
            out[i] = r.choice("abcé")
        elif how < 0.6:
            out.insert(i, r.choice("abcé "))
        else:
            del out[i]
    return "".join(out)


def test_banded_distance(spark):
    r, rows = random.Random(9), []
    for _ in range(300):
        a = "".join(r.choice("abé ") for _ in range(r.choice([4, 8, 20, 45, 90])))
        rows.append((a, edited(r, a, r.randrange(4)) or "a"))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2):
        for x in df.select("a", "b", lines.banded(F.col("a"), F.col("b"), k).alias("d"), lines._let(lines.trimmed(F.col("a"), F.col("b")), lines._within(k)).alias("near")).collect():
            d = distance(x.a, x.b)
            assert (x.d == d if d <= k else x.d > k) and x.near == (d <= k)


def brute_lines(docs):
    seen = [(i, n, x) for i, t in docs for n, x in enumerate((t or "").split("\n")) if WORDS.search(x)]
    kinds = sorted({x for _, _, x in seen})
    root, links = {x: x for x in kinds}, dict.fromkeys(kinds, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(kinds):
        for b in kinds[k + 1 :]:
            most = next((e for least, e in lines.EDITS if min(len(a), len(b)) >= least), 0)
            if most and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    first = {}
    for i, n, x in seen:
        first.setdefault(find(x), (i, n))
    return {i: [(n, first[find(x)] != (i, n), links[x], first[find(x)][0]) for j, n, x in seen if j == i] for i, _ in docs}


def line_docs():
    r, docs = random.Random(6), []
    bases = ["".join(r.choice("abcdeé fgh") for _ in range(n)) for n in (5, 19, 20, 21, 39, 40, 41, 42, 80, 150) for _ in range(2)]
    for i in range(40):
        own = [edited(r, r.choice(bases), r.choice([0, 0, 1, 1, 2, 3])) for _ in range(r.randrange(5))]
        docs.append((i, "\n".join([*own, *[""] * r.randrange(2)])))
    return docs


def test_lines(spark, folder):
    docs = line_docs()
    want = brute_lines(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in queries.queries()["op8_lines"](spark, folder(documents=df)).collect()}
    assert sum(x[2] for v in want.values() for x in v) > 20
    for i, own in want.items():
        assert (got[i].n_lines, got[i].n_removed, got[i].n_links) == (len(own), sum(x[1] for x in own), sum(x[2] for x in own))
        assert got[i].class_id == min([x[3] for x in own], default=i)
    kept = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    for i, t in docs:
        gone = {n for n, removed, _, _ in want[i] if removed}
        text = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        assert kept.get(i) == (text if WORDS.search(text) or not gone else None)


def test_lines_of_odd_documents(odd, empty, spark, folder):
    got = lines.dedup_lines(clashing(odd))
    assert got.columns == clashing(odd).columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts == {1: None, 2: "", 3: " \n\t ", 4: LONG, 6: "one two three", 7: "Der Hund läuft über die Straße.", None: "one two three four five six", 8: "123 456 !!! 789"}
    assert lines.dedup_lines(empty).count() == 0


def texts_of(spark, texts):
    return spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "key long, line string, size int")


def test_lines_of_long_lists(spark):
    """The finer join alone, with groups that are cut down to single characters, against all pairs."""
    r = random.Random(5)
    bases = ["".join(r.choice("abé ") for _ in range(n)) for n in (40, 41, 64, 65, 90, 130)]
    texts = sorted({edited(r, r.choice(bases), r.randrange(4)) for _ in range(150)} | {"a" * n for n in range(40, 50)} | {f"Invoice number {i:04d} was paid on the first day of may" for i in range(40)})
    near = {(i, j) for i, a in enumerate(texts) for j in range(i + 1, len(texts)) if abs(len(a) - len(texts[j])) <= 2 and distance(a, texts[j]) <= 2}
    had, lines.FEW = lines.FEW, 2
    try:
        got = {(x.a, x.b) for x in lines.two_edits(texts_of(spark, texts)).collect()}
    finally:
        lines.FEW = had
    assert near <= got and len(near) > 500
    short = sorted({edited(r, b, r.randrange(3)) for b in ("".join(r.choice("abé ") for _ in range(n)) for n in (20, 30, 39)) for _ in range(40)})
    near = {(i, j) for i, a in enumerate(short) for j in range(i + 1, len(short)) if abs(len(a) - len(short[j])) <= 1 and distance(a, short[j]) <= 1}
    assert {(x.a, x.b) for x in lines.one_edit(texts_of(spark, short)).collect()} == near and near


def test_lines_of_a_template(spark):
    """Lines that differ in a number only: candidates stay near the links and the lines, not all pairs, and no link is lost."""
    for n in (1500, 4000):
        texts = [f"Invoice number {i * 7919 % 1000003:06d} was paid on the first day of may" for i in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert lines.candidates(lines.different(docs)).filter("a is not null").count() <= lines.HOT * n
        numbers = np.array([[int(c) for c in t[15:21]] for t in texts])
        # Links by substitutions; moved digits make some more.
        links = sum(((numbers[i + 1 :] != numbers[i]).sum(axis=1) <= 2).sum() for i in range(n))
        if n < 2000:
            assert links <= lines.links(docs).count() <= 1.5 * links
        else:
            assert lines.two_edits(texts_of(spark, texts)).count() <= 8 * (links + n)


def test_lines_use_no_python(spark):
    plan = lines.links(spark.createDataFrame([(1, "a" * 50)], SCHEMA.split(", lang")[0]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_neighbours_stay_inside_trees():
    raw = np.zeros((4, 4 * neardup.DEPTH + neardup.SKETCH), np.uint8)
    a, b, crowd = neardup._pairs(np.arange(4), np.array([0, 0, 1, 1]), raw)
    assert list(zip(a.tolist(), b.tolist())) == [(0, 1), (2, 3)] and not crowd.any()


def test_depth_adapts_to_the_region():
    """Of 60 documents that share 3 values, in runs of 20 that share all 4, each meets all of its own run."""
    rep, raw = np.arange(60), np.zeros((60, 4 * neardup.DEPTH + neardup.SKETCH), np.uint8)
    raw[:, 4 * neardup.DEPTH - 1] = rep // 20
    a, b, crowd = neardup._pairs(rep, np.zeros(60, int), raw)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(60) for j in range(i + 1, 60) if i // 20 == j // 20} and crowd.all()


def test_crowded_prefixes_give_linear_pairs():
    """Each of 500 documents that share whole prefixes meets the one whose sketch is most alike, and is known to be crowded."""
    rep, raw = np.arange(500), np.zeros((500, 4 * neardup.DEPTH + neardup.SKETCH), np.uint8)
    raw[:, 4 * neardup.DEPTH :] = np.repeat(np.arange(250), 2)[:, None] % 200
    raw[:, -1] = rep % 2
    a, b, crowd = neardup._pairs(rep, np.zeros(500, int), raw)
    assert {(2 * i, 2 * i + 1) for i in range(250)} <= set(zip(a.tolist(), b.tolist())) and len(a) <= 500 and crowd.all()


def crowd_of_boilerplate(n_docs, n_planted):
    """Documents of mutual similarity 0.739 (102 of 120 shingles in common), and copies that have one more in common with theirs: 0.752."""
    docs = [[f"b{i}" for i in range(106)] + [f"d{k}_{j}" for j in range(18)] for k in range(n_docs)]
    docs += [docs[k * 7][:107] + [f"p{k}_{j}" for j in range(17)] for k in range(n_planted)]
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


def test_links_within_a_crowd(spark):
    docs = crowd_of_boilerplate(2000, 40)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i if i < 2000 else (i - 2000) * 7 for i in range(2040)}


def test_large_groups_of_near_copies(spark):
    """Groups of 300 and of 3,000 copies of one text, each with some words of its own: similarities lie on both sides of the limit."""
    r, docs, sets = random.Random(12), [], []
    for g, n in enumerate((300, 3000)):
        for k in range(n):
            own = [f"g{g}_{j}" for j in range(120)]
            for _ in range(r.choice([0, 1, 2, 3, 3, 4, 5])):
                own[r.randrange(120)] = f"x{len(docs)}_{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
            sets.append([g * 116 + j for j in range(116) if all(w.startswith("g") for w in own[j : j + 5])])
    has = np.zeros((len(docs), 232), np.float32)
    for i, own in enumerate(sets):
        has[i, own] = 1
    # Shingles with an own word are in one text only.
    common = has @ has.T
    linked = 100 * common >= 75 * (2 * 116 - common)
    root = np.arange(len(docs))
    while True:
        least = np.where(linked, root[None, :], len(docs)).min(axis=1)
        least = np.minimum(least, root)
        if (least == root).all():
            break
        root = least
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(root.tolist())) and len(set(root.tolist())) > 20


def test_remainder_is_exact(spark):
    """No link is missed, blocks and classes of sizes included."""
    docs = copies() + [(1000 + i, t) for i, t in crowd_of_boilerplate(60, 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ids = df.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("part"))
    had, neardup.BLOCK = neardup.BLOCK, 8
    try:
        pairs = neardup.remainder(df, ids, 4)
        found = {r.node: r.component for r in components.components(neardup.confirm(df, pairs, 4)).collect()}
    finally:
        neardup.BLOCK = had
    assert {i: found.get(i, i) for i, _ in docs} == {i: c for i, (_, c) in brute_components(docs).items()}


def test_tally_sends_small_batches():
    """Counts against plain ones, in batches of one group, whatever order parts come in; a group adds up to the same."""
    rng = np.random.default_rng(3)
    size = 1 << neardup.TALLY_BITS
    bucket, part = rng.integers(0, size, 300_000), rng.integers(-4, 3, 300_000)
    counted = neardup.Tally(size)
    for k in range(0, len(bucket), 70_000):
        counted.add(bucket[k : k + 70_000], 1, part[k : k + 70_000])
    batches = list(counted.rows(0))
    assert len(batches) == neardup.TALLY_GROUPS and all(b.num_rows == 1 and b.nbytes < 600_000 for b in batches)
    low, high = np.full(size, 9), np.full(size, -9)
    np.minimum.at(low, bucket, part)
    np.maximum.at(high, bucket, part)
    for g, batch in enumerate(batches):
        x = np.frombuffer(batch.column("data")[0].as_py(), neardup.TALLY)
        again = neardup.Tally(neardup.TALLY_SIZE)
        for half in (x[1::2], x[::2], x):
            again.add(half["bucket"], half["n"], half["part"], half["mixed"])
        own = slice(g * neardup.TALLY_SIZE, (g + 1) * neardup.TALLY_SIZE)
        assert batch.column("group")[0].as_py() == g
        assert (again.n == 2 * np.bincount(bucket, minlength=size)[own]).all() and (again.mixed == (low < high)[own]).all()
    assert not neardup.Tally(size).n.any() and not list(neardup.Tally(size).rows(0))
