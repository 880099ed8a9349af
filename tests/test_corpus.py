import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import corpus, labels, tokens, validate
from spanloom.sources import readers, writers

BOUNDS = [("short", 1, 1), ("medium", 2, 2), ("long", 3, 3), ("very_long", 4, None)]


def raw(spark, sizes):
    rows = []
    for d, n in sizes:
        words = [w for i in range(n) for w in ("Method", str(i), ".")]
        rows.append((d, "dev", words, [[3 * i, 3 * i + 3] for i in range(n)], [[0, 3 * n]], [(3 * i, 3 * i + 1, "Method") for i in range(n)]))
    return spark.createDataFrame(rows, "doc_id string, source_split string, words array<string>, sentences array<array<int>>, sections array<array<int>>, ner array<struct<start:int,stop:int,label:string>>")


def test_documents_and_windows(spark):
    docs = corpus.documents(raw(spark, [("a", 2), ("b", 5)]))
    a = docs.filter("doc_id = 'a'").first()
    assert a.text == "Method 0. Method 1." and a.sentences[0].text == "Method 0." and a.sentences[0].token_end_exclusive == 3 and a.entities[0].text == "Method"
    assert a.entities[1].entity_id == "a__entity_000001"
    assert validate.document_violations(docs).count() == 0
    broken = docs.withColumn("text", F.concat(F.lit("x"), "text"))
    assert {r.rule for r in validate.document_violations(broken).collect()} >= {"token_text", "sentences_boundary"}
    with pytest.raises(ValueError, match="token_text"):
        validate.require(validate.document_violations(broken))
    plan = spark.createDataFrame([("b", "long", 1, 4)], "doc_id string, bucket string, sentence_start int, sentence_stop int")
    w = corpus.windows(docs, plan).first()
    assert w.example_id == "b__sent_000001_000004" and w.text == "Method 1. Method 2. Method 3." and len(w.entities) == 3 and w.sections[0].clipped_by_window
    own = corpus.windows(docs, plan)
    assert validate.example_violations(own, docs, {n: (a, b) for n, a, b in BOUNDS}, {"long": 1}).count() == 0
    assert [r.rule for r in validate.example_violations(own, docs, {n: (a, b) for n, a, b in BOUNDS}, {"long": 2}).collect()] == ["bucket_count"]
    back, bad = writers.reassembled(*(writers.flattened(own)[n] for n in ("examples", "sentences", "entities")))
    assert bad.count() == 0 and back.first().entities[0].text == "Method"
    _, bad = writers.reassembled(writers.flattened(own)["examples"].limit(0), *(writers.flattened(own)[n] for n in ("sentences", "entities")))
    assert {r.rule for r in bad.collect()} == {"orphan_sentence", "orphan_entity"}


def test_documents_are_laid_out_in_their_rows(spark):
    """The same offsets as by a row a token, without a shuffle; records without words give no document."""
    kinds = ["Method", "(", ")", ".", "it", "'s", "-", "é", "𝒳y", "'", ",", "["]
    rng = random.Random(1)
    rows = [(f"d{i}", [rng.choice(kinds) for _ in range(rng.randint(0, 12))]) for i in range(60)] + [("none", None)]
    own = spark.createDataFrame(rows, "doc_id string, words array<string>")
    raw = own.select("doc_id", F.lit("dev").alias("source_split"), "words", *(F.array().cast(t).alias(n) for n, t in (("sentences", "array<array<int>>"), ("sections", "array<array<int>>"), ("ner", "array<struct<start:int,stop:int,label:string>>"))))
    docs = corpus.documents(raw)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    by_row = {(r.doc_id, r.token_index): (r.text, r.start_char, r.end_char) for r in tokens.detokenized(own, "doc_id", "words").collect()}
    found = docs.collect()
    assert {(r.doc_id, t.token_index): (t.text, t.start_char, t.end_char) for r in found for t in r.tokens} == by_row
    assert {r.doc_id: r.text for r in found} == {r.doc_id: r.text for r in own.filter("size(words) > 0").select("doc_id", tokens.detokenize(F.col("words")).alias("text")).collect()}
    assert all(t.text == r.text[t.start_char : t.end_char] for r in found for t in r.tokens) and len(found) < 61


def test_document_violations_read_documents_once(spark):
    one = raw(spark, [("a", 2), ("b", 1), ("a", 3), (None, 1), (None, 1)])
    docs = corpus.documents(one).withColumn("token_count", F.when(F.col("doc_id") == "a", 1).otherwise(F.col("token_count")))
    found = validate.document_violations(docs)
    assert found._jdf.queryExecution().executedPlan().toString().count("laid_out(") == 1
    got = sorted((r.rule, r.key or "") for r in found.collect() if r.rule in ("duplicate_id", "token_count", "missing_id"))
    assert got == [("duplicate_id", ""), ("duplicate_id", "a"), ("missing_id", ""), ("missing_id", ""), ("token_count", "a"), ("token_count", "a")]


def test_slices_of_odd_spans(spark):
    rows = [("a", "é𝒳yz", [(0, 2, "é𝒳"), (2, 4, "yz")]), ("b", "é𝒳yz", [(0, 2, "é𝒳"), (2, 4, "yy")]), ("c", "ab", [(0, 3, "ab")]), ("d", "ab", [(1, 1, "")]), ("e", "ab", [(None, 1, "a")]), ("f", "ab", [(0, 1, None)]), ("g", None, []), ("h", None, [(0, 1, "a")]), ("i", "ab", None), ("j", "ab", [(0, 1, "ab")]), ("k", "ab", [(0, 2, "ab")])]
    own = spark.createDataFrame(rows, "k string, text string, s array<struct<start_char:int,end_char:int,text:string>>").coalesce(1)
    got = own.select("k", validate.bad_spans(F.col("text"), F.col("s")).alias("x"), validate.bad_spans(F.col("text"), F.col("s"), False).alias("y")).collect()
    assert "".join(r.k for r in got if r.x) == "bcdefhj" and "".join(r.k for r in got if r.y) == "cdeh"


def test_buckets(spark):
    got = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 0)], "n int").select(corpus.length_bucket(F.col("n"), BOUNDS).alias("b")).collect()
    assert [r.b for r in got] == ["short", "medium", "long", "very_long", None]


def test_sampler():
    lengths = [(f"d{i}", 6) for i in range(4)]
    buckets = {n: {"min_sentences": a, "max_sentences": b, "target": 1} for n, a, b in BOUNDS}
    plan = corpus.sample_plan(lengths, buckets)
    assert plan == corpus.sample_plan(lengths, buckets) and len(set(plan)) == 4 and [p[1] for p in plan] == list(reversed(corpus.BUCKETS))
    assert all(p[3] - p[2] == 4 for p in plan if p[1] == "very_long")
    order = lengths[:]
    random.Random(42).shuffle(order)
    assert plan[0][0] == order[0][0]
    with pytest.raises(ValueError, match="very_long"):
        corpus.sample_plan([("d", 1)], buckets)


def test_pilot(spark):
    rows = spark.createDataFrame([(f"{b}{d}", f"doc{d}", b) for b in ("s", "m") for d in range(5)], "example_id string, doc_id string, length_bucket string")
    got = corpus.pilot(rows, 2, ["s", "m"]).collect()
    assert [r.example_id for r in got] == ["s0", "s1", "m2", "m3"] and len({r.doc_id for r in got}) == 4


def test_tickets(spark):
    rows = spark.createDataFrame([(3, " a ", "x", "t", None, "t"), (1, None, "x", "t", "u", "u"), (2, "", " y", " ", "u ", "u")], "n int, ` Subject` string, Body string, tag_1 string, tag_2 string, TAG_3 string")
    got = labels.clean_tickets(rows, "n").orderBy("ticket_id").collect()
    assert [(r.ticket_id, r.text, r.tags) for r in got] == [(1, "\n\ny", ["u"]), (2, "a\n\nx", ["t"])]


def test_raw_records_and_splits(spark, tmp_path):
    for split in ("train", "dev", "test"):
        (tmp_path / split).mkdir()
        (tmp_path / split / f"{split}.jsonl").write_text('{"doc_id": "a", "words": ["x"], "sentences": [[0, 1]], "sections": [[0, 1]], "ner": [[0, 1, "Task"]]}\n\nnot json\n{"doc_id": "b"}\n')
    paths = [r.path for r in readers.split_files(spark, str(tmp_path)).collect()]
    good, bad = readers.raw_records(spark, paths)
    assert {(r.doc_id, r.source_split) for r in good.collect()} == {("a", s) for s in readers.SPLITS} and good.first().ner[0].label == "Task"
    assert bad.filter("key = 'json'").count() == 3 and bad.filter("key like 'words%'").count() == 3
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "dev.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="dev"):
        readers.split_files(spark, str(tmp_path))


def test_files(spark, tmp_path):
    assert readers.jsonl_lenient(spark, str(tmp_path / "no"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.jsonl_lenient(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    (tmp_path / "t.txt").write_bytes(b"ok \xff")
    assert readers.texts(spark, str(tmp_path / "t.txt")).first().text == "ok �"
    digests = readers.file_digests(spark, str(tmp_path / "t.txt")).first()
    assert digests.bytes == 4 and len(digests.sha256) == 64
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.json").write_text('{"doc_name": "d",\n "n": 1}')
    (tmp_path / "e" / "b.json").write_text("{broken")
    assert [r.doc_name for r in readers.exports(spark, str(tmp_path / "e"), "doc_name string, n int").collect()] == ["d"]
    assert readers.template_config({"runner": {"name": "x", "labels": ["A", "A", " B "]}})["labels"] == ["A", "B"]
    with pytest.raises(ValueError, match="labels"):
        readers.template_config({"name": "x"})
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.mapped(spark.range(1), {"id": "id"}, ["z"])


def test_vector_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0])], "ticket_id long, embedding array<float>")
    about = writers.write_index(rows, str(tmp_path / "i"))
    assert about["dimension"] == 2 and writers.open_index(spark, str(tmp_path / "i")).count() == 2
    spark.createDataFrame([(9, [1.0, 0.0])], "ticket_id long, embedding array<double>").write.mode("append").parquet(str(tmp_path / "i" / "vectors"))
    with pytest.raises(ValueError, match="manifest"):
        writers.open_index(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError, match="indexed"):
        writers.write_index(spark.createDataFrame([(1, [0.0, 0.0])], "ticket_id long, embedding array<float>"), str(tmp_path / "z"))


def test_splits(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, s string")
    assert validate.same_rows(a, a.repartition(3)) and not validate.same_rows(a, a.distinct())
    assert [r.s for r in validate.split_leaks(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "s string, p int"), "s", "p").collect()] == ["a"]


def test_line_numbers_over_ranges(spark, tmp_path):
    """Files of many ranges, of one, and without a line end, with blank lines and lines longer than a range."""
    rng = random.Random(2)
    files = {f"f{i}.txt": ["x" * rng.choice([0, 1, 5, 90, 700]) + f" {i} {j}" for j in range(n)] for i, n in enumerate((400, 1, 37))}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "f2.txt" else ""))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("512", "4096", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = readers.numbered_lines(spark, f"file://{tmp_path}/*.txt").collect()
            got = {name: [r.value for r in sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.line)] for name in files}
            assert got == files and all(sorted(r.line for r in rows if r.path.endswith(n)) == list(range(1, len(lines) + 1)) for n, lines in files.items())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_candidate_tags_of_a_large_schema(spark):
    """100,000 tags through the inverted index; and the same rows as the array where both can be had."""
    many = spark.range(100_000).selectExpr("concat('tag', id, case when id % 3 = 0 then ' red' else '' end) as tag", "cast(id as int) as pos", "id % 7 as frequency")
    texts = spark.createDataFrame([(1, "the tag99999 red and tag5"), (2, "nothing"), (3, None), (4, "RED tag12")], "id int, text string")
    got = labels.candidate_tags(texts, "id", "text", many, 6, 2)
    first = {k: [r.tag for r in sorted(got.collect(), key=lambda r: r.place) if r.id == k][:2] for k in range(1, 5)}
    assert first[1][0] == "tag99999 red" and first[4][0] == "tag12 red" and got.count() == 24
    few = spark.createDataFrame([("VPN", 0, 5), ("Access", 1, 0), ("in", 2, 3), ("a b c", 3, 1), ("st", 4, 9), ("long phrase here", 5, 0), ("x, y, z", 6, 99), ("ß", 7, 1), ("-", 8, 50)], "tag string, pos int, frequency long")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["vpn access down", "a long phrase here", "string", "", None, "ß", "C b a -", "phrase"])], "id int, text string")
    for most, fallback in ((4, 1), (3, 0), (9, 9), (2, 5)):
        rows = [sorted(map(tuple, labels.candidate_tags(asked, "id", "text", few, most, fallback, small).collect())) for small in (2000, 0)]
        assert rows[0] == rows[1]


def test_settings_and_benchmark(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("runner:\n  name: n\n  labels: [x, y, x]\n")
    (tmp_path / "b.yaml").write_text("- 1\n")
    assert readers.template_config(readers.config(spark, f"file://{tmp_path}/a.yaml"))["labels"] == ["x", "y"]
    with pytest.raises(ValueError, match="no settings"):
        readers.config(spark, f"file://{tmp_path}/b.yaml")
    (tmp_path / "c.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2}\n')
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(Exception, match="line 3 lacks t"):
        readers.benchmark(spark, f"file://{tmp_path}/c.jsonl", "none", "id long, t string", ["id", "t"]).collect()
    assert readers.benchmark(spark, f"file://{tmp_path}/empty.jsonl", f"file://{tmp_path}/c.jsonl", "id long, t string", ["id"]).count() == 2


def test_empty_answers_and_strict_spans(spark):
    from spanloom.operators import parsing, tokens

    got = spark.range(1).select(parsing.empty_answer("classification").alias("c"), parsing.empty_answer("extraction").alias("e")).first()
    assert got.c.type.label == "" and got.c.tags == [] and got.e.entities == []
    own = spark.createDataFrame([("a b",)], "t string").select(tokens.tokenize("t").alias("k"))
    assert own.select(tokens.span_between(F.col("k"), F.lit(0), F.lit(2), True).alias("s")).first().s == (0, 3)
    with pytest.raises(Exception, match=r"no token span \[1, 3\) of 2"):
        own.select(tokens.span_between(F.col("k"), F.lit(1), F.lit(3), True).alias("s")).collect()
    rows = spark.createDataFrame([("it", "", "x")], "department string, evidence string, text string")
    assert parsing.routed(rows, ["IT", "Sales", "It"]).first().department == "It"


def test_slices_are_compared_some_rows_at_a_time():
    import pyarrow as pa

    class Column:
        def __init__(self, values):
            self.array, self.most = pa.array(values), 0

        def __len__(self):
            return len(self.array)

        def slice(self, at, n):
            own = Column([])
            own.array, self.most = self.array.slice(at, n), max(self.most, n)
            return own

        def to_pylist(self):
            assert len(self.array) <= 64
            return self.array.to_pylist()

    n = 200
    columns = [Column(["abc"] * n), Column([[0, 1]] * n), Column([[1, 3]] * n), Column([["a", "bc" if i % 3 else "x"] for i in range(n)])]
    assert validate._slices_differ.func(*columns).to_pylist() == [i % 3 == 0 for i in range(n)]


def test_documents_leave_python_in_pieces_and_are_checked_by_column(spark):
    """No batch of laid out documents is held, and no rows wait for the answer of a function of columns."""
    import pyarrow as pa

    x = pa.array([["a", "bc"] * 10_000] * 40 + [None, []])
    pieces = list(tokens.laid_out.func(iter([x, x.slice(39)])))
    assert sum(map(len, pieces)) == 45 and max(len(p.flatten().field("tokens").flatten()) for p in pieces) <= 1 << 18
    docs = corpus.documents(raw(spark, [("a", 2), ("b", 3), ("c", 1)]))
    plan = validate.document_violations(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" in plan
    first = lambda c, field, value: F.transform(c, lambda s, i: F.when(i == 0, s.withField(field, value(s))).otherwise(s))
    longer = lambda s: s["end_char"] + F.lit(1)
    own = docs.withColumn("sections", F.when(F.col("doc_id") == "a", first("sections", "end_char", longer)).otherwise(F.col("sections")))
    own = own.withColumn("entities", F.when(F.col("doc_id") == "b", first("entities", "text", lambda s: F.lit("other"))).when(F.col("doc_id") == "c", F.lit(None)).otherwise(F.col("entities")))
    own = own.withColumn("tokens", F.when(F.col("doc_id") == "c", first("tokens", "text", lambda s: F.lit("mEthod"))).otherwise(F.col("tokens")))
    own = own.withColumn("text", F.when(F.col("doc_id") == "c", F.concat("text", F.lit("more"))).otherwise(F.col("text")))
    assert sorted(map(tuple, validate.document_violations(own).collect())) == [("entities_boundary", "b"), ("sections_boundary", "a"), ("token_text", "c")]


def test_documents_are_dealt_into_parts_of_bounded_size(spark):
    """By the number of documents, not by the files: 10,000 go into five parts on four cores."""
    from spanloom.plans import io_queries

    plan = io_queries._raw(spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id#" in plan and "], 5" in plan
