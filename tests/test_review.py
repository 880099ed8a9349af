import math

import pytest
from pyspark.sql import functions as F

from spanloom.operators import labels, parsing, retrieval, review, votes

SPAN = "doc int, run string, start int, stop int, type string, text string"


def vote(spark, runs):
    rows = [(1, name, *s, "LOC", "t") for name, found in runs for s in found]
    order = spark.createDataFrame([(name, i) for i, (name, _) in enumerate(runs)], "run string, pos int")
    return votes.aggregate_votes(spark.createDataFrame(rows, SPAN), order, ["doc"]).orderBy("confidence", "start").collect(), spark.createDataFrame(rows, SPAN), order


def test_votes(spark):
    got, *_ = vote(spark, [("run 1", [(0, 6), (10, 16)]), ("run 2", [(0, 6)]), ("run 3", [(0, 6), (10, 16)])])
    assert [(r.start, r.confidence, r.voters) for r in got] == [(10, 2 / 3, ["run 1", "run 3"]), (0, 1.0, ["run 1", "run 2", "run 3"])]
    got, *_ = vote(spark, [("run 1", [(0, 6), (0, 6)]), ("run 2", [])])
    assert [(r.votes, r.confidence) for r in got] == [(1, 0.5)]
    got, *_ = vote(spark, [("a", [(10, 16)]), ("b", [(99, 105)])])
    assert [r.confidence for r in got] == [0.5, 0.5]


def test_agreement(spark):
    _, rows, order = vote(spark, [("A", [(0, 6), (10, 16)]), ("B", [(0, 6), (20, 23)])])
    pair, whole = votes.agreement(rows, order, ["doc"]).first(), votes.unanimous(rows, order, ["doc"]).first()
    assert (pair.n_a, pair.n_b, pair.shared, pair.only_a, pair.only_b) == (2, 2, 1, 1, 1) and pair.jaccard == pytest.approx(1 / 3)
    assert (whole.n_union, whole.n_unanimous) == (3, 1)
    assert votes.agreement(rows.limit(0), order, ["doc"]).first().jaccard == 1.0


def logprob(spark, toks, needle):
    return spark.createDataFrame([(toks, needle)], "t array<struct<token:string,logprob:double>>, n string").select(votes.logprob_confidence(F.col("t"), F.col("n")).alias("c")).first().c


def test_logprobs(spark):
    toks = [('{"text": "', -0.1), ("Mun", math.log(0.9)), ("ich", math.log(0.8)), ('"}', -0.1)]
    assert logprob(spark, toks, "Munich") == pytest.approx(math.exp((math.log(0.9) + math.log(0.8)) / 2))
    assert logprob(spark, toks, "Paris") is None and logprob(spark, [], "x") is None and logprob(spark, toks, " ") is None
    assert logprob(spark, [("Mun", 1e-5), ("ich", 2e-5)], "Munich") == 1.0


def flags(spark, values, **k):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "doc int, i int, confidence double")
    own = review.flag_by_budget(rows, ["doc"], **k) if "budget" in k else review.flag_by_threshold(rows, **k)
    return {r.i for r in own.collect() if r.flagged}


def test_flags(spark):
    assert flags(spark, [1.0, 0.4, 0.6, None], threshold=0.80) == {1, 2, 3}
    assert flags(spark, [0.80], threshold=0.80) == set() and flags(spark, [0.7999], threshold=0.80) == {0}
    assert flags(spark, [0.80, 0.95, 1.0, 1.0], budget=0.25) == {0}
    near = [0.9999771, 0.99999, 1.0000496, 0.99998, 1.0, 1.00001, 0.99999, 1.0]
    assert flags(spark, near, budget=0.2) == set() and flags(spark, [1.0] * 4, budget=0.2) == set()
    assert flags(spark, [None], budget=0.2) == {0} and flags(spark, [0.5, 0.5, 0.5, 0.9], budget=0.25) == {0, 1, 2}


def test_queue_and_numbers(spark):
    rows = spark.createDataFrame([(1, 0, 50, 0.99, "pending"), (1, 1, 10, 0.20, "deleted"), (1, 2, 30, None, "confirmed")], "doc int, pos int, start int, confidence double, status string")
    assert [r.confidence for r in review.queue(rows, ["doc"]).orderBy("place").collect()] == [None, 0.20, 0.99]
    assert {r.pos: r.num for r in review.numbered(rows, ["doc"]).collect()} == {0: 2, 1: None, 2: 1}


def test_diagnostics(spark):
    log = [("edited", 0.2), ("deleted", 0.3), ("confirmed", 0.4), ("confirmed", 0.9), ("confirmed", 0.95), ("confirmed", 0.99)]
    got = review.confidence_diagnostics(spark.createDataFrame([(1, "model", s, c) for s, c in log], "doc int, source string, status string, confidence double"), ["doc"]).first()
    assert got.n_flagged == 3 and got.flag_precision == pytest.approx(2 / 3) and got.flag_recall == 1.0 and got.lift == float("inf")


def test_edits(spark):
    rows = spark.createDataFrame([(i, "A", "pending") for i in range(5)], "id int, type string, status string")
    edits = spark.createDataFrame([(0, "B", True, True), (1, "B", True, False), (2, "A", True, False), (3, "A", False, False), (99, "A", True, False)], "id int, new_type string, confirmed boolean, delete boolean")
    got = {r.id: (r.type, r.status) for r in review.apply_edits(rows, edits).collect()}
    assert got == {0: ("A", "deleted"), 1: ("B", "edited"), 2: ("A", "confirmed"), 3: ("A", "pending"), 4: ("A", "pending")}
    assert {r.status for r in review.confirm_pending(rows).collect()} == {"confirmed"}


def test_neighbours(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0], "t"), (2, [0.0, 1.0], "u"), (3, [0.8, 0.2], "v")], "vec_id long, embedding array<float>, text string")
    got = retrieval.top_k(index.filter("vec_id = 1"), retrieval.normalised(index, "embedding"), 2, extra=("text",)).orderBy("rank").collect()
    assert [(r.vec_id, r.text) for r in got] == [(3, "v"), (2, "u")]


@pytest.mark.parametrize(("hits", "winner", "share"), [([("IT", 0.80), ("Billing", 0.70), ("Billing", 0.65), ("Unknown", 0.99)], "Billing", 1.35 / 2.15), ([("A", 0.0), ("B", -0.2)], "A", 2 / 3)])
def test_weighted_vote(spark, hits, winner, share):
    rows = spark.createDataFrame([(1, i + 1, label if label != "Unknown" else None, s) for i, (label, s) in enumerate(hits)], "query_id long, rank int, label string, similarity double")
    got = retrieval.weighted_vote(rows, "label").first()
    assert got.label == winner and got.confidence == pytest.approx(share)


def test_candidate_tags(spark):
    tags = spark.createDataFrame([("VPN", 0, 0), ("Access", 1, 0), ("Other", 2, 0)], "tag string, pos int, frequency long")
    texts = spark.createDataFrame([(1, "vpn access down")], "id int, text string")
    got = labels.candidate_tags(texts, "id", "text", tags, most=2, fallback=1).orderBy("place").collect()
    assert [r.tag for r in got] == ["Access", "VPN"]


def test_clean_prediction(spark):
    lit = lambda xs: F.array(*map(F.lit, xs))
    rows = spark.createDataFrame([({"label": "z", "evidence": "e"}, None, [{"label": x, "evidence": ""} for x in ("A", "A ", "C", "D", "")])], "type struct<label:string,evidence:string>, queue struct<label:string,evidence:string>, tags array<struct<label:string,evidence:string>>")
    got = parsing.clean_prediction(rows, lit("xy"), lit("q"), lit("ABD"), lit("AB"), 2).first()
    assert [t.label for t in got.tags] == ["A", "D"] and got.invalid_tags == ["C"] and got.tags_outside_candidates == ["D"]
    assert (got.type.label, got.invalid_type, got.queue.label, got.invalid_queue, got.has_invalid_labels) == ("", "z", "", None, True)


def test_entity_reasons(spark):
    rows = spark.createDataFrame([(("x", "location", 0, 5),), (("a b", "location", 0, 1),), (("", "place", None, 1),), (("b", "location", 0, 0),)], "e struct<text:string,type:string,start:int,stop:int>")
    got = [r.r for r in rows.select(parsing.entity_reasons(F.col("e"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("location"))).alias("r")).collect()]
    assert got == [["indices_out_of_range"], [], ["invalid_type", "invalid_indices", "empty_text"], ["text_span_mismatch"]]


def test_freeform(spark):
    rows = spark.createDataFrame([("Berlin | 5 | 5\nbad\nx | a | 1",), (" none ",), (None,)], "r string")
    got = [[(x.text, x.start, x.stop, x.reason) for x in r.f] for r in rows.select(parsing.freeform(F.col("r")).alias("f")).collect()]
    assert got == [[("Berlin", 5, 5, None), (None, None, None, "wrong_field_count"), (None, None, None, "non_integer_indices")], [], []]
    typed = spark.createDataFrame([("- Berlin | LOC | 5 | 6",)], "r string").select(F.inline(parsing.freeform(F.col("r"), True))).first()
    assert (typed.text, typed.type, typed.start, typed.stop) == ("Berlin", "LOC", 5, 6)


def test_routing(spark):
    rows = spark.createDataFrame([("We need Technical help", "technical SUPPORT", "technical  help"), ("x", "other", "y")], "text string, department string, evidence string")
    got = parsing.routed(rows, ["Technical Support", "Billing"]).collect()
    assert (got[0].department, got[0].evidence_valid, got[0].error) == ("Technical Support", True, None)
    assert (got[1].department, got[1].evidence, got[1].error) == (None, "", "department is not allowed")
