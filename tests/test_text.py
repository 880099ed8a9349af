import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import tokens


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_detokenize(spark):
    words = "A ( method ) , does n't fail .".split()
    assert one(spark, tokens.detokenize(F.col("x")), words, "array<string>") == "A (method), doesn't fail."
    rows = tokens.detokenized(spark.createDataFrame([(1, words)], "id int, w array<string>"), "id", "w").collect()
    assert all("A (method), doesn't fail."[r.start_char : r.end_char] == r.text for r in rows) and len(rows) == len(words)


def test_tag_runs(spark):
    def spans(words, tags, **k):
        rows = [(1, i, w, t) for i, (w, t) in enumerate(zip(words, tags, strict=True))]
        own = tokens.tag_runs(spark.createDataFrame(rows, "d int, i int, w string, t int"), ["d"], ["i"], "w", "t", **k)
        return sorted((r.text, r.start, r.stop, r.label) for r in own.collect())

    assert spans("She traveled from New York to Boston .".split(), [0, 0, 0, 4, 4, 0, 4, 0], only=4) == [("Boston", 6, 6, 4), ("New York", 3, 4, 4)]
    assert spans("a b c d".split(), [1, 1, 2, 0]) == [("a b", 0, 1, 1), ("c", 2, 2, 2)]


def test_fences_and_objects(spark):
    assert one(spark, T.strip_fences(F.col("x")), "```JSON\n{\"a\": 1}\n```") == '{"a": 1}'
    assert one(spark, T.object_slice(F.col("x")), 'so: {"a": {"b": 2}} ok') == '{"a": {"b": 2}}'
    assert one(spark, T.object_slice(F.col("x")), "none") is None


def test_strict_json(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 1} trailing',), ("",), (None,)], "x string").select(T.strict_json("x").alias("y")).collect()
    assert [r.y.valid for r in rows] == [True, False, False, False]


def test_rounding(spark):
    values = [0.03125, 0.00015, 0.00625, 0.12345, None]
    got = [r.y for r in spark.createDataFrame([(v,) for v in values], "x double").select(T.exact_round(4)("x").alias("y")).collect()]
    assert got == [round(v, 4) if v is not None else None for v in values]


def test_scalars(spark):
    assert one(spark, T.canonical_label(F.col("x")), "Material") == one(spark, T.canonical_label(F.col("x")), "Dataset") == "dataset"
    assert one(spark, T.model_name(F.col("x")), "hosted:m:1") == "m:1" and one(spark, T.model_name(F.col("x")), "m") == "m"
    assert one(spark, T.clean_pdf(F.col("x")), " split-\nword  a\tb\n\n\n\nc ") == "splitword a b\n\nc"
    assert one(spark, T.is_noisy_tag(F.col("x")), "a,b,c") and one(spark, T.is_noisy_tag(F.col("x")), None) and not one(spark, T.is_noisy_tag(F.col("x")), "VPN")
    assert one(spark, T.contains_evidence(F.lit("  Big   DOG "), F.col("x")), "a big dog") and not one(spark, T.contains_evidence(F.lit(" "), F.col("x")), "a")
    assert one(spark, T.casefold(F.col("x")), "Straße") == "strasse"
    assert one(spark, tokens.parse_string_array(F.col("x")), "['New', \"York's\", 'x']") == ["New", "York's", "x"]
    assert one(spark, tokens.parse_int_array(F.col("x")), "[1, -2  30]") == [1, -2, 30]
    assert one(spark, tokens.indexed(F.col("x")), ["a", "b"], "array<string>") == "0: a\n1: b"
    assert one(spark, tokens.find_phrase(F.col("x"), F.array(F.lit("b"), F.lit("c"))), ["a", "b", "c", "b", "c"], "array<string>") == (1, 2)
    assert one(spark, tokens.find_phrase(F.col("x"), F.array(F.lit("z"))), ["a"], "array<string>") is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .!?\n-'é_(\u00a0\u2003\x85\x1c", max_size=60), min_size=1, max_size=20))
def test_tokens_and_sentences_as_stated(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("t", tokens.tokenize("t").alias("k"), tokens.split_sentences("t").alias("s"), tokens.sentence_texts(F.col("t")).alias("n")).collect():
        assert [(k.text, k.start, k.stop) for k in r.k] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\w+(?:[-']\w+)*|[^\w\s]", r.t)]
        assert all(r.t[s.start : s.stop] == s.text for s in r.s)
        parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])|\n+", r.t)]
        assert [s.text for s in r.s] == r.n == [p for p in parts if p]


def test_touched_tokens(spark):
    own = spark.createDataFrame([("New York is big",)], "x string").withColumn("t", tokens.tokenize("x"))
    got = own.select(tokens.touched(F.col("t"), F.lit(5), F.lit(10)).alias("a"), tokens.touched(F.col("t"), F.lit(3), F.lit(4)).alias("b"), tokens.span_of(F.col("t"), F.lit(0), F.lit(1)).alias("c"), tokens.span_of(F.col("t"), F.lit(2), F.lit(9)).alias("d")).first()
    assert got.a == (1, 2) and got.b == (-10_000, -10_000) and got.c == (0, 8) and got.d is None


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab <&é🙂", max_size=30), st.lists(st.tuples(st.integers(-2, 32), st.integers(0, 34)), max_size=6))
def test_spans_are_rewritten_by_a_cursor(text, spans):
    from pyspark.sql import SparkSession

    out, at = [], 0
    for start, stop in sorted((s for s in spans if s[0] >= 0 and s[1] > s[0]), key=lambda s: (s[0], -s[1])):
        if start >= at:
            out.append(text[at:start] + "[" + text[start:stop] + "]")
            at = stop
    own = SparkSession.getActiveSession().createDataFrame([(text, spans), (text, None)], "t string, s array<struct<start:int,stop:int>>")
    got = own.select(T.rewritten(F.col("t"), F.col("s"), lambda s, x: F.concat(F.lit("["), x, F.lit("]"))).alias("r")).collect()
    assert [r.r for r in got] == ["".join(out) + text[at:], text]


def test_highlighted(spark):
    own = spark.createDataFrame([("a<b & c", [(0, 3, "X"), (1, 5, "Y"), (6, 7, "Y")])], "t string, s array<struct<start:int,stop:int,label:string>>")
    got = own.select(T.highlighted(F.col("t"), F.col("s"), ["X", "Y"]).alias("h")).first().h
    assert got == f'<mark style="background:{T.PALETTE[0]}" title="X">a&lt;b</mark> &amp; <mark style="background:{T.PALETTE[1]}" title="Y">c</mark>'


def test_find_all(spark):
    texts = ["", "aa1bb22", "é11🙂2 3", "1" * 100, "x" * 1000 + "7", *(" ".join(str(i) for i in range(n)) for n in (31, 32, 33, 500))]
    own = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for r in own.select("t", T.find_all(F.col("t"), "[0-9]+").alias("m")).collect():
        assert r.m == r.t == None if r.t is None else [(m.start, m.stop, m.match) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", r.t)]  # noqa: E711


def test_a_phrase_is_sought_in_tokens_that_are_made_once(spark):
    rows = spark.createDataFrame([("x of the of the",), ("of x the",), ("of the",), ("",)], "t string").repartition(2)
    own = rows.select(tokens.find_phrase(F.split("t", " "), F.array(F.lit("of"), F.lit("the"))).alias("p"))
    assert own._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {tuple(r.p) if r.p else None for r in own.collect()} == {(1, 2), (0, 1), None}


def test_texts_are_cut_a_piece_at_a_time(monkeypatch):
    texts = pa.array(["one two. Three", None, "", "x" * 3_000_000, *["a b. C d"] * 400_000, "end"])
    seen = []
    for name in ("_tokenize", "_split_sentences"):
        monkeypatch.setattr(tokens, name, lambda x, of=getattr(tokens, name): (seen.append(sum(map(len, filter(None, x.to_pylist())))), of(x))[1])
    for udf, alone in ((tokens.tokenize, tokens._tokenize), (tokens.split_sentences, tokens._split_sentences)):
        assert udf.func(texts).equals(alone(texts))
        assert sorted(seen)[-3] < 1 << 21  # the whole, the longest text, and no other
        seen.clear()


def test_sentence_count(spark):
    """The number of sentences that the splitter makes, for all mixtures of blanks, line ends, full stops and letters."""
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\u00a0.!aA9\"\x1c\u2003") for _ in range(rng.randint(0, 14))) for _ in range(2000)] + [None, "", " \n", "A. B\n\n c.  D"]
    own = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.sentence_count(F.col("t")).alias("n"), F.size(tokens.split_sentences("t")).alias("m"))
    assert [(r.t, r.n, r.m) for r in own.collect() if r.n != r.m] == []


def test_documents_without_tokens_have_no_row(spark, tmp_path):
    """As in the SQL: neither null, empty and blank texts nor those of other white space; the rest has its tokens once."""
    import duckdb

    from spanloom.plans import text_queries

    rows = [(1, "a b-c, d"), (2, ""), (3, None), (4, " \n\t "), (5, "."), (6, "é\n"), (7, "  \x1f")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = text_queries.tokenize_offsets(spark, f"file://{tmp_path}")
    assert own._jdf.queryExecution().executedPlan().toString().count("tokenize(") == 1
    got = sorted(map(tuple, own.collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet') where doc_id < 7")
    assert got == sorted(con.execute(text_queries.TOKENIZE_SQL).fetchall()) and [r[0] for r in got] == [1, 5, 6]
