from collections import Counter

from conftest import DATA
from llm.conftest import LONG, clashing
from llm.test_pairs import brute_components, brute_lines
from llm.test_rows import WORDS, brute_targets

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    """Each stage against a brute-force version, on what its predecessor kept."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, f"{DATA}/sf0.001")
        out.write.parquet(f"{tmp_path}/{name}")
        got, before = spark.read.parquet(f"{tmp_path}/{name}"), [(r.doc_id, r.text, r.source) for r in docs.collect()]
        texts = {r.doc_id: r.text for r in got.collect()} if name != "packing" else {}
        if name != "packing":
            assert got.columns == docs.columns
        if name == "language":
            assert len(texts) >= 0.99 * len(before)
        elif name == "lines":
            want = brute_lines_fast([(i, t) for i, t, _ in before])
            assert texts == want
        elif name == "neardup":
            assert set(texts) == {i for i, (_, c) in brute_components([(i, t) for i, t, _ in before]).items() if i == c}
        elif name == "mixing":
            sizes, taken = Counter(), Counter()
            for _, t, s in before:
                sizes[s] += len(WORDS.findall(t))
            for r in got.collect():
                taken[r.source] += len(WORDS.findall(r.text))
            assert all(abs(taken[s] - t) < 1 for s, t in brute_targets(sizes).items())
        else:
            assert got.groupBy("sequence_id").sum("length").collect() and sum(r.length for r in got.collect() if r.start == 0) > 0
        docs = got


def brute_lines_fast(docs):
    """In this table all links are of equal lines."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        own, removed = [], False
        for x in t.split("\n"):
            if WORDS.search(x) and x in seen:
                removed = True
                continue
            seen.add(x)
            own.append(x)
        text = "\n".join(own)
        if WORDS.search(text) or not removed:
            out[i] = text
    return out


def test_run(spark):
    assert pipeline.run(spark, f"{DATA}/sf0.001").count() > 0 and pipeline.ORACLE_SQL is None and brute_lines and LONG


def test_odd_documents(spark, odd, empty, tmp_path):
    for k, start in enumerate((clashing(odd), clashing(empty))):
        docs = start
        for name, stage in pipeline.STAGES:
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}/{name}")
            if name != "packing":
                assert docs.columns == start.columns
        assert (docs.count() > 0) == (k == 0)


def test_language_stage_rejects(spark):
    """Documents of four and more equal languages, and letter junk, go; those with a main language stay."""
    from llm.test_rows import made_up

    speak = made_up()
    rows = [(i, f(400), lang) for i, (lang, f) in enumerate(list(speak.items()) * 3)]
    rows += [(100 + n, " ".join(f(80) for f in list(speak.values())[:n]), None) for n in (1, 2, 4, 5)]
    rows += [(200, "".join("вxzяw"[i % 5] + " жzyхv"[i * i % 6] for i in range(600)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in pipeline.language(spark, docs, "").collect()} == {*range(15), 101, 102}


def test_batches_are_bounded_in_bytes(spark):
    """3,000 texts of 10 kB are no longer one batch of 30 MB; a lower bound of the session's own stays."""
    import pyarrow as pa

    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('word ', 2000) text", "'en' lang", "'a' source", "10000L n_chars")
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    try:
        for stage in (f for _, f in pipeline.STAGES):
            spark.conf.set(key, before)
            stage(spark, docs.limit(0), "")
            got = docs.mapInArrow(sizes, "size long, n long").collect()
            assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 1.5 * pipeline.BATCH
        spark.conf.set(key, "1000000")
        pipeline.bounded_batches(spark)
        assert spark.conf.get(key) in ("1000000", "1000000b")
    finally:
        spark.conf.set(key, before)
