import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanloom.functions import tags
from spanloom.operators import evaluation
from spanloom.operators.tokens import tokenize
from spanloom.plans import jobs
from spanloom.plans.io_queries import Echo
from spanloom.sources import writers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMALL = {"short": {"min_sentences": 1, "max_sentences": 1, "target": 1}, "medium": {"min_sentences": 2, "max_sentences": 2, "target": 1}, "long": {"min_sentences": 3, "max_sentences": 3, "target": 1}, "very_long": {"min_sentences": 4, "max_sentences": None, "target": 1}}


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    raw, to = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("prepared")
    for k, split in enumerate(("train", "dev", "test")):
        with (raw / f"{split}.jsonl").open("w") as out:
            for d in range(2):
                words = [w for i in range(6) for w in ("Method", str(i), ".")]
                out.write(json.dumps({"doc_id": f"{split}{d}{k}", "words": words, "sentences": [[3 * i, 3 * i + 3] for i in range(6)], "sections": [[0, 18]], "ner": [[3 * i, 3 * i + 1, "Method"] for i in range(6)]}) + "\n")
    assert jobs.prepare_corpus(spark, str(raw), f"file://{to}", SMALL) == {"documents": 6, "windows": 4}
    return f"file://{to}"


def test_corpus_jobs(spark, prepared, tmp_path):
    assert jobs.validate_corpus(spark, prepared, SMALL) == 0
    windows = spark.read.parquet(f"{prepared}/windows")
    stats = jobs.corpus_statistics(windows)
    assert {r.length_bucket: r.n for r in stats["sentences"].collect()} == dict.fromkeys(SMALL, 1) and stats["labels"].first().n == 10
    jobs.export_csv(spark, f"{prepared}/windows", f"{tmp_path}/csv")
    jobs.rebuild_from_csv(spark, f"{tmp_path}/csv", f"{tmp_path}/back")
    back = spark.read.json(f"{tmp_path}/back")
    assert {(r.example_id, r.text) for r in back.collect()} == {(r.example_id, r.text) for r in windows.collect()}
    assert jobs.inspect(spark, f"{prepared}/windows", 1, bucket="long").first().length_bucket == "long"
    jobs.study_readiness(spark, f"{prepared}/windows", 100, dict.fromkeys(SMALL, 1))
    with pytest.raises(ValueError, match="budget"):
        jobs.study_readiness(spark, f"{prepared}/windows", 1, dict.fromkeys(SMALL, 1))
    with pytest.raises(ValueError, match="too few"):
        jobs.select_pilot(spark, f"{prepared}/windows", f"{tmp_path}/pilot", 5, "all")


def test_batch_run_and_evaluation(spark, prepared, tmp_path):
    def predictions(windows, spoil):
        rows = []
        for i, w in enumerate(sorted(windows, key=lambda w: w.example_id)):
            own = [(e.text, "method", e.start_char, e.end_char) for e in w.entities]
            if spoil and i == 0:
                own = [("x", "Method", own[0][2], own[0][3] + 1)] + own[1:]
            rows.append({"example_id": w.example_id, "status": "ok" if i < 3 else "error", "processed_char_end": len(w.text), "predictions": [dict(zip(("text", "type", "start", "end"), p, strict=True)) for p in own], "llm_calls": 2, "input_tokens": 3, "seq": i})
        return rows

    windows = spark.read.parquet(f"{prepared}/windows").collect()
    rows = predictions(windows, False)
    rows = [{**rows[0], "status": "error", "seq": -1}, *predictions(windows, True), {"example_id": "no", "status": "ok", "seq": 9}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    own = jobs.evaluate_batch(spark, f"{prepared}/windows", str(tmp_path / "p.jsonl"), f"{tmp_path}/out", 50)
    s, gold = own.summary.first(), sum(len(w.entities) for w in sorted(windows, key=lambda w: w.example_id)[:3])
    assert (s.n_gold, s.n_failed, s.n_missing, s.n_unknown, s.coverage_rate) == (4, 1, 0, 1, 0.75)
    assert (s.micro_tp, s.micro_fp, s.micro_fn) == (gold - 1, 1, 1) and (s.overlap_tp, s.boundary_tolerant_tp) == (gold, gold)
    assert own.false_positives.count() == own.false_negatives.count() == 1 and own.failed.first().status == "error" and s.llm_calls == 8
    assert {r.group_type for r in own.groups.collect()} == {"bucket", "split", "label"} and own.intervals.count() == 3
    assert spark.read.json(writers.published(spark, f"{tmp_path}/out", "summary")).count() == 1 and len(own.per_example.collect()) == 3


def test_resumable_batch(spark, prepared, tmp_path):
    folder = f"file://{tmp_path}/run"
    first = jobs.run_batch(spark, f"{prepared}/windows", folder, Echo, ["LOC"], {"model": "echo"}, 4)
    assert first["attempted"] == 4 and first["answered"] == 4
    done = jobs.run_batch(spark, f"{prepared}/windows", folder, Echo, ["LOC"], {"model": "echo"}, 100)
    assert done["answered"] == done["planned"] == done["attempted"] == 10
    got = jobs.predictions_of(spark.read.parquet(f"{folder}/results"), ["LOC"]).collect()
    assert len(got) == 4 and {r.status for r in got} == {"ok"}


def test_export_scores(spark):
    span = "array<struct<source:string,status:string,start:int,end:int,type:string>>"
    kind = f"doc_name string, example_id string, model_predictions {span}, review_log {span}, processed_char_end int, n_sentences int"
    example = spark.createDataFrame([("e", "Ab cd. Ef", [(0, 6), (7, 9)], [("A", 0, 2), ("Material", 3, 5), ("A", 7, 9)])], "example_id string, text string, sentences array<struct<start_char:int,end_char:int>>, entities array<struct<label:string,start_char:int,end_char:int>>")
    m = lambda s, e, t, status="confirmed": ("model", status, s, e, t)
    rows = [("d1", "e", [m(0, 2, "a"), m(3, 5, "Dataset"), m(1, 2, "A")], [], 0, 1), ("d2", "e", None, [m(0, 2, "A")], None, None), ("d3", "e", None, [m(0, 2, "A", "edited")], None, None), ("d4", "no", [], [], 0, 0), ("d5", None, [], [], 0, 0)]
    got = {r.doc_name: r for r in evaluation.evaluate_exports(spark.createDataFrame(rows, kind), example).collect()}
    assert (got["d1"].tp, got["d1"].fp, got["d1"].fn, got["d1"].scope) == (2, 1, 0, "inferred")
    assert (got["d2"].tp, got["d2"].fn, got["d2"].legacy, got["d2"].scope) == (1, 2, True, "full")
    assert not any(got[d].available for d in ("d3", "d4", "d5")) and got["d3"].reason == "labels were edited"
    assert evaluation.micro(evaluation.evaluate_exports(spark.createDataFrame(rows, kind), example)).first().tp == 3


def test_location_eval(spark):
    rows = spark.createDataFrame([("1", "['She', 'saw', 'New', 'York']", "[0, 0, 4, 4]"), ("2", "['no']", "[0]"), ("3", "['Rome']", "[4]")], "id string, tokens string, ner_tags string")
    got = jobs.build_location_eval(rows, 1).first()
    assert (got.id, got.sentence, got.gold_entities) == ("1", "She saw New York", [(2, 3, "New York")])
    assert [r.id for r in jobs.few_shot_examples(rows, 5).collect()] == ["1", "3"]
    bad = spark.createDataFrame([("1", "['a']", "[0, 1]")], "id string, tokens string, ner_tags string")
    with pytest.raises(ValueError, match="length"):
        jobs.build_location_eval(bad)
    assert len(tags.COARSE) == 9 and len(tags.FINE) == 69
    names = spark.createDataFrame([(4,), (99,)], "t int").select(tags.name_of(F.col("t"), tags.COARSE).alias("n")).collect()
    assert [r.n for r in names] == ["location", "unknown-99"]


class Answers:
    def answer(self, request):
        if "classify" in request["prompt"]:
            return {"text": json.dumps({"type": {"label": "Incident", "evidence": "down"}, "queue": {"label": "IT", "evidence": "vpn"}, "tags": [{"label": "VPN", "evidence": ""}]}), "model_id": "m", "input_tokens": 1, "output_tokens": 1}
        return {"text": "- New York | LOC | 2 | 3" if "free" in request["prompt"] else json.dumps({"entities": [{"text": "New York", "type": "loc", "start": 2, "end": 3}]}), "model_id": "m", "input_tokens": 1, "output_tokens": 1}


def test_classification_and_extraction_jobs(spark, tmp_path):
    source = tmp_path / "t.csv"
    source.write_text('subject,body,type,queue,tag_1\n"vpn, again",is down,Incident,IT,VPN\n,x,y,z,w\nb,c,Request,HR,Pay\n')
    jobs.build_tickets(spark, str(source), f"{tmp_path}/out")
    tickets = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/out/tickets")
    assert tickets.count() == 2 and spark.read.json(f"{tmp_path}/out/labels").count() == 3
    tickets = tickets.withColumn("gold_tags", F.from_json("gold_tags", "array<string>"))
    jobs.classify_tickets(spark, tickets, {"types": ["Incident", "Request"], "queues": ["IT", "HR"], "tags": ["VPN", "Pay"]}, Answers, "classify {text} {tags}", f"{tmp_path}/c")
    scores = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/c/scores").first()
    assert (scores.n_examples, scores.type_accuracy, scores.tag_micro_recall) == (2, 0.5, 0.5)
    board = jobs.compare_scores(spark, [f"{tmp_path}/c/scores"], "type_accuracy")
    assert board.count() == 1
    rows = spark.createDataFrame([("r", "She saw New York", [("New York", 8, 16, "LOC")])], "id string, text string, gold array<struct<text:string,start:int,stop:int,type:string>>").withColumn("tokens", tokenize("text"))
    for freeform, template in ((False, "{tokens}"), (True, "free {text}")):
        jobs.extract(spark, rows, Answers, template, ["LOC"], f"{tmp_path}/x{freeform}", freeform)
        own = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/x{freeform}/scores").first()
        assert own.strict_f1 == 1.0 and own.lenient_f1 == 1.0
