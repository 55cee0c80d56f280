from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import DATA, rows_of
from tidemark.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_gives_what_sql_gives(spark, duck):
    got = queries.op1_chat_prefix(spark, f"{DATA}/sf0.001").toPandas()
    assert rows_of(got) == rows_of(duck.sql(chat.SQL).df())


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (1, 4, "assistant", "b"), (1, 5, "user", "tail")]
    got = chat.prefix_examples(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    assert [r.text.count(chat.START) for r in got] == [3, 5, 6]
    assert [r.text[r.loss_start - 1 : r.loss_start - 1 + r.loss_length] for r in got] == ["a", "b", ""]
    assert [r.last for r in got] == [False, False, True]


def test_odd_rows(spark):
    rows = [(None, 0, "assistant", "x"), (1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (2, 0, "us\ner<|", "<|im_end|>\n<|im_start|>"), (3, 0, "assistant", "y" * 200_000)]
    got = {r.conv_id: r for r in chat.digest(chat.prefix_examples(spark.createDataFrame(rows, SCHEMA).withColumn("example", F.lit(1)))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {None: (1, 1), 1: (3, 0), 2: (1, 0), 3: (1, 200_000)}
    assert chat.prefix_examples(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\n<|n>"]), st.text(st.sampled_from("<|>im_endstar\n ab"), max_size=30)), min_size=1, max_size=30))
def test_texts_come_back(spark, turns):
    import hashlib

    df = spark.createDataFrame([(i % 4, i, r, t) for i, (r, t) in enumerate(turns)], SCHEMA)
    for r in chat.digest(chat.prefix_examples(df)).collect():
        own = [x for i, x in enumerate(turns) if i % 4 == r.conv_id]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(b for a, b in own if a == "assistant").encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    plan = queries.op1_chat_prefix(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
