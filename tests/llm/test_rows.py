"""Quality rules, packing, mixing, URLs and languages, against brute force, exact round trips and held-out accuracy."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import DATA
from llm.conftest import LONG, SCHEMA, clashing
from tidemark.llm import langid, mixing, packing, quality, queries, urls
from tidemark.llm.common import words

SF = f"{DATA}/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


def brute_features(t):
    t = t or ""
    w = WORDS.findall(t)
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    repeated = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    rows = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(rows) - len(set(rows)), len(repeated)


def test_features(spark, odd):
    extra = ["a b c a b c", "x x x x", "a b c d a b c", "#a <|> b\n#a <|> b\n \n \n", " ".join(f"{i} {i}x y" for i in range(200)) * 2, " ".join(str(i) for i in range(300)) * 2]
    df = odd.unionByName(spark.createDataFrame([(100 + i, t, None, None, None) for i, t in enumerate(extra)], SCHEMA))
    got = quality.with_features(clashing(df)).collect()
    assert len(got) == 16
    for r in got:
        assert tuple(r[f] for f in quality.FEATURES) == brute_features(r.text), r.text[:50]


def test_learned_list(spark):
    """Two kinds of bad rows, told apart by a conjunction and by a single threshold."""
    rows = []
    for i in range(3000):
        symbols, long = i % 3 == 0, i % 2 == 0
        n = 200 if long else 80
        bad = symbols and long or i % 17 == 0
        rows.append((i, int(not bad), n, n * (9 if i % 17 == 0 else 5), n if symbols else 0, 0, 0))
    df = spark.createDataFrame(rows, "doc_id long, quality int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    rules = quality.learn(df)
    assert 2 <= len(rules) <= 4 and any(len(r) == 2 for r in rules)
    got = df.withColumn("kept", quality.conditional(rules))
    assert got.filter(F.col("kept") != (F.col("quality") == 1)).count() == 0
    assert quality.learn(df.filter("quality = 1")) == [] and quality.learn(df.limit(0)) == []


def test_quality_query(spark):
    q = queries.queries()["op5_quality_rules"](spark, SF)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in q.collect():
        f = brute_features(texts[r.doc_id])
        assert tuple(r[x] for x in quality.FEATURES) == f
        assert r.base_failed == (f[0] < 50 or 2 * f[4] > f[0]) and not (r.base_failed and r.kept)


def test_rules_on_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn_from(docs, labels.filter("doc_id % 4 <> 0"))
    rest = labels.filter("doc_id % 4 = 0")
    got = quality.judge(docs.join(F.broadcast(rest), "doc_id"), rules).filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] > 0.98 and share[0] < 0.6


# ---------------------------------------------------------------- packing


SHARED = packing.WordTokenizer(TOKENIZER)


@pytest.fixture(scope="module")
def tokenizer():
    return SHARED


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(st.sampled_from("aAbéÉßİ'.,!? \n\x0b\x1c\x85’s<|endoftext|>ﬁ́1")), st.sampled_from(["<|endoftext|>.", "<|ENDOFTEXT|>", "don't. I'VE", "K. k"])), max_size=6))
def test_ids_are_the_tokenizers(texts):
    t = SHARED
    ids, starts = packing.tokenize(t, pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == [*t.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(pieces, texts, tokenizer):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    padding = total = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        n = 0
        for p in own:
            assert p.offset == n and p.length > 0
            n += p.length
        assert n <= packing.WINDOW
        padding += 0 if n & (n - 1) == 0 else packing.WINDOW - n
        total += n
    for doc, text in texts.items():
        ids = np.array([*tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    return padding / (padding + total)


def test_packing_query(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packing(queries.queries()["op6_packing"](spark, SF).collect(), texts, tokenizer) < 0.02


def test_windows_close_and_merge(spark, tokenizer):
    """More documents than open windows, over several partitions."""
    docs = [(i, " ".join(["word"] * (1 + i * 37 % 5000))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = packing.pack(df, TOKENIZER, keep_ids=True).collect()
    assert check_packing(got, dict(docs), tokenizer) < 0.02
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    cuts = Counter(r.doc_id for r in got)
    assert sum(n > 1 + len(docs[i][1].split()) // packing.WINDOW for i, n in cuts.items()) < 40


def test_words_are_remembered_in_few_bytes(monkeypatch):
    """Words that come again in other cases, with marks or among others are encoded once, and 50,000 take some bytes each."""
    asked = []
    t = packing.WordTokenizer(TOKENIZER)
    for name in ("_pieces", "encode"):
        monkeypatch.setattr(t, name, lambda words, f=getattr(t, name): asked.extend(words) or f(words))
    letters = "abcdefghijklmnopqrst"
    words = ["".join(letters[i // 20**k % 20] for k in range(4)) for i in range(50_000)]
    texts = [" ".join(words), " ".join(w.title() + ".,"[len(w) % 2] for w in words), " ".join(f"x1{w}" for w in words[:500]) + " don't"]
    for _ in range(2):
        for text in texts:
            ids, _ = packing.tokenize(t, pa.array([text]))
            assert ids.tolist() == [*t.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert len(asked) == len(set(asked)) == len(words) + 502
    held = [x for x in vars(t).values() if isinstance(x, (pa.Array, np.ndarray, dict))]
    assert not any(isinstance(x, dict) and len(x) > 256 for x in held) and sum(x.nbytes for x in held if not isinstance(x, dict)) < 60 * len(asked)
    # What is remembered is bounded, by words and by bytes.
    for name, least in (("KNOWN", 100), ("KNOWN_BYTES", 1000)):
        monkeypatch.setattr(packing, name, least)
        ids, _ = packing.tokenize(t, pa.array(["Zzyzx! of the"]))
        assert ids.tolist() == [*t.tokenizer.encode("Zzyzx! of the", add_special_tokens=False).ids, 2] and len(t.known) < 10
        packing.tokenize(t, pa.array(texts[:1]))


def test_packing_odd_documents(odd, empty):
    got = packing.pack(clashing(odd), TOKENIZER).collect()
    assert {r.doc_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert sum(r.length for r in got if r.doc_id == 6) == 8
    assert packing.pack(empty, TOKENIZER).count() == 0


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in capped)
        share = sum(w[s] for s in order if s not in capped)
        target = {s: epochs * sizes[s] if s in capped else left * w[s] / share for s in order}
        over = {s for s in order if target[s] > epochs * sizes[s]} - capped
        if not over:
            return target
        capped |= over


def test_mixing_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.queries()["op7_mixing"](spark, SF).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(WORDS.findall(docs[r.doc_id].text)) and 0 <= r.taken <= 3 * r["size"]
        sizes[docs[r.doc_id].source] += r["size"]
        taken[docs[r.doc_id].source] += r.taken
    want = brute_targets(sizes)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    again = queries.queries()["op7_mixing"](spark, SF).collect()
    assert sorted(rows) == sorted(again)


def test_water_filling_rounds(spark):
    sizes = {None: 50, "a": 1, "b": 10, "c": 1000, "d": 3, "é": 400}
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    want = brute_targets(sizes)
    assert {r.source: r.target for r in mixed.collect()} == pytest.approx(want)
    real = mixing.realize(mixed).select("source", F.size(words(F.col("text"))).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert {r.source: r.n for r in real} == {s: int(t + 1e-9) for s, t in want.items()}


def test_mixing_odd_documents(odd, empty):
    got = mixing.mix(clashing(odd))
    assert got.count() == 10 and {"host", "whole"} <= set(got.columns)
    assert mixing.realize(got).columns == [c for c in clashing(odd).columns if c not in mixing.ADDED]
    assert mixing.mix(empty).count() == 0


def test_parts_are_prefixes(spark):
    """A part keeps line feeds and spacing, and ends with its last word."""
    text = " a\n\nb  c\td\x0b e f \n"
    df = spark.createDataFrame([(t, n) for t in (text, text.strip()) for n in range(1, 7)], "text string, n int")
    for t, n, first in df.select("text", "n", mixing.first_words(F.col("text"), F.col("n"))).collect():
        assert t.startswith(first) and WORDS.findall(first) == WORDS.findall(t)[:n] and first.endswith("abcdef"[n - 1])
    docs = spark.createDataFrame([(i, text * (1 + i % 3), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    whole = {r.doc_id: r.text for r in docs.collect()}
    rows = mixing.realize(mixing.mix(docs, weights=(3, 7))).collect()
    assert all(whole[r.doc_id].startswith(r.text) for r in rows) and sum(whole[r.doc_id] != r.text for r in rows) in (1, 2)


# ---------------------------------------------------------------- URLs


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in urls.RULES if (host == r.host or host.endswith(f".{r.host}")) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(str(r)), default=None)


def test_url_query(spark):
    texts = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.queries()["op9_urls"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        host, path, rule = brute_rule(texts[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, str(rule) if rule else None)
        assert r.verdict == (rule.verdict if rule else r.method_verdict)


def test_odd_urls(spark):
    bad = [None, "", "x", "http://", "HTTP://A.Example.COM/en/7?x", "http://com/en/", "http://xcom/en/", "http://Éa.net/de/8#q", "http://example.net?/de/8", "a://b://c.org/es/", "http://x.org/es/" + "y" * 50_000]
    df = spark.createDataFrame(list(enumerate(bad)) + [(None, "http://a.com/en/1")], "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("probability", F.lit(1))
    rows = urls.filter_urls(df).collect()
    assert len(rows) == 12
    for r in rows:
        host, path, rule = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, str(rule) if rule else None) and r.verdict in ("allow", "block")
    assert urls.filter_urls(df.limit(0)).count() == 0
    # Rows that are there twice are judged twice, alike.
    twice = urls.filter_urls(df.unionByName(df)).collect()
    by = {}
    for r in twice:
        by.setdefault((r.page_id, r.url), []).append((r.host, r.path, r.rule, r.verdict))
    assert len(twice) == 24 and all(len(v) == 2 and v[0] == v[1] for v in by.values())


def test_trees_on_labels_held_out(spark):
    parts = urls.with_rule(urls.with_parts(spark.read.parquet(f"{DATA}/sf0.1/pages.parquet").select("page_id", "url")))
    known = parts.filter("rule is not null").withColumn("label", (F.col("verdict") == "block").cast("int"))
    learned = urls.Filter(known.filter("page_id % 3 <> 0").select("page_id", "url", "host", "path", "label"))
    # No feature tells the first digit of a path, which the two longer rules are about; a ninth of their hosts' URLs.
    right = (F.col("method_verdict") == F.col("verdict")).cast("int")
    rest, all_ = (learned.judge(known.filter("page_id % 3 = 0").filter(c)).select(F.avg(right)).first()[0] for c in (r"rule not rlike '[0-9]$'", "true"))
    assert rest > 0.93 and all_ > 0.8


# ---------------------------------------------------------------- languages


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.queries()["op10_langid"](spark, f"{DATA}/sf0.01").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.99 and all(0 <= r.score <= 1 for r in rows)


def test_mixtures(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    text = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", "n_chars").alias("text")).collect()}
    part = lambda lang, n: " ".join(text[lang].split()[:n])
    mixed = spark.createDataFrame([(1, part("de", 300) + " " + part("fr", 100)), (2, part("en", 200)), (3, "123 !"), (4, None), (5, "é")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(mixed, model).collect()}
    shares = {x.lang: x.proportion for x in got[1].languages}
    assert shares.keys() == {"de", "fr"} and abs(shares["de"] - 0.75) < 0.08 and got[1].lang_pred == "de"
    assert [x.lang for x in got[2].languages] == ["en"]
    assert [(got[i].lang_pred, got[i].score) for i in (3, 4)] == [("und", 0.0)] * 2 and got[5].lang_pred != "und"


def test_language_of_odd_documents(odd, empty):
    model = langid.learn(odd)
    got = langid.identify(clashing(odd), model)
    assert got.count() == 10 and got.filter("lang_pred = 'und'").count() == 4
    assert langid.identify(empty, model).count() == 0
    none = langid.learn(empty)
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def made_up(n_languages=5):
    """Words of languages with letters of their own."""
    r = np.random.default_rng(8)
    letters = ["abcdefg", "hijklmn", "opqrstu", "äöüßéèà", "абвгдеж"][:n_languages]
    return {f"l{k}": lambda n, own=own: " ".join("".join(r.choice(list(own), 4)) for _ in range(n)) for k, own in enumerate(letters)}


def test_more_than_three_languages(spark):
    speak = made_up()
    model = langid.learn(spark.createDataFrame([(i, f(400), lang) for i, (lang, f) in enumerate(list(speak.items()) * 3)], "doc_id long, text string, lang string"))
    texts = [" ".join(f(80) for f in list(speak.values())[:n]) for n in (1, 3, 4, 5)]
    r = np.random.default_rng(9)
    junk = " ".join("".join(r.choice(list("vwxyzкхцчшщ"), 6)) for _ in range(320))
    for n, found in zip((1, 3, 4, 5), model.predict(pa.array(texts))):
        assert len(found) == n and all(abs(p - 1 / n) < 0.03 for _, p in found)
    # A hash that a made-up word has in common with a learned one may give a language some hundredths.
    (main, *_), alone = model.predict(pa.array([texts[0] + " " + junk, junk]))
    assert main[0] == "l0" and abs(main[1] - 0.2) < 0.05 and sum(p for _, p in alone) < 0.2


def test_proportions_against_plain_expectation_maximisation():
    """For a fixed set of languages, against a loop over words; and the set, against all sets."""
    from itertools import combinations

    r = np.random.default_rng(3)
    model = langid.Model(list("abc"), r.integers(0, 30, (langid.BUCKETS, 3)).astype(float))
    speak = [f"w{x}" for x in "qwertzuiop"]
    texts = [" ".join(r.choice(["".join(r.choice(list("abcdefgh"), 5)) for _ in range(6)] + [speak[i][1:] * 4], n)) for i, n in enumerate((1, 5, 30, 200))]

    def plain(p, shares):
        for _ in range(langid.ROUNDS):
            new = [sum(s * x / sum(a * b for a, b in zip(shares, w)) for w in p for x in [w[k]]) / len(p) for k, s in enumerate(shares)]
            moved, shares = max(abs(a - b) for a, b in zip(new, shares)), new
            if moved <= langid.STEADY:
                break
        return shares, sum(np.log(sum(a * b for a, b in zip(shares, w))) for w in p)

    for text in texts:
        words_, which, _ = langid.split(pa.array([text]))
        bucket, word, _ = langid.trigrams(words_)
        log = np.concatenate([model.log, np.full((langid.BUCKETS, 1), model.background)], axis=1).astype(float)
        score = np.stack([log[bucket[word == i]].sum(axis=0) for i in range(len(words_))])
        p = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -60))[which] + 1e-12
        for m in (2, 3):
            got, fit = langid.Model._shares(p[:, :m].astype(np.float32), np.array([0]), np.array([len(p)]), np.full((1, m), 1 / m, np.float32))
            want, want_fit = plain(p[:, :m].tolist(), [1 / m] * m)
            assert np.abs(got[0] - want).max() < 5e-3 and abs(fit[0] - want_fit) < 0.05
        best = max((plain(p[:, c].tolist(), [1 / m] * m)[1] - 0.5 * m * np.log(max(2, len(p))) for m in range(1, 5) for c in combinations(range(4), m)))
        (found,) = model.predict(pa.array([text]))
        chosen = [model.languages.index(x) for x, _ in found] + ([3] if sum(s for _, s in found) < 1 - 1e-6 or not found else [])
        own = plain(p[:, chosen].tolist(), [1 / len(chosen)] * len(chosen))[1] - 0.5 * len(chosen) * np.log(max(2, len(p)))
        assert own > best - 1


def test_long_text_is_whole(spark, odd):
    r = next(r for r in quality.with_features(odd.filter("doc_id = 4")).collect())
    assert r.n_words == 30_000 == len(LONG.split())
