import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanloom.operators import inference
from spanloom.plans.io_queries import Echo
from spanloom.streaming import runner

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no path to the tests


class Flaky:
    """Fails for prompts with 'bad'; others after one passing error."""

    seen: set = set()

    def answer(self, request):
        if "bad" in request["prompt"]:
            raise ValueError("malformed request")
        if request["prompt"] not in self.seen:
            self.seen.add(request["prompt"])
            raise TimeoutError("timeout")
        return {"text": "ok", "model_id": "m", "input_tokens": 1, "output_tokens": None}


def test_retries():
    out = inference.asked(Flaky(), {"prompt": "a"})
    assert (out["text"], out["attempts"], out["usage_reported"], out["error"]) == ("ok", 2, False, None)
    assert inference.asked(Flaky(), {"prompt": "bad"})["error"].startswith("ValueError")

    class Refuses:
        def answer(self, request):
            if request.get("logprobs"):
                raise RuntimeError("400: logprobs not supported")
            return {"text": "x", "input_tokens": 1, "output_tokens": 1}

    assert inference.asked(Refuses(), {"prompt": "a", "logprobs": True})["text"] == "x"


def test_prompts(spark):
    got = spark.range(1).select(inference.filled("{{a}} {x}!", {"x": F.lit("v")}).alias("p")).first().p
    assert got == "{a} v!"
    assert "{tokens}" in inference.schema_prompt(["A", "A"]) and inference.schema_prompt(["A", "A"]).count("- A") == 1


@pytest.mark.parametrize(("estimator", "models", "calls", "share"), [("self_consistency", ["m"], 3, None), ("model_agreement", ["m1", "m2"], 2, 1.0), ("none", ["m"], 1, None)])
def test_annotate(spark, estimator, models, calls, share):
    docs = spark.createDataFrame([(1, "Hello from Munich and Berlin.")], "id long, text string")
    got = inference.annotate(docs, "id", "text", ["LOC"], inference.passes(spark, estimator, models), Echo, inference.schema_prompt(["LOC"])).first()
    assert got.llm_calls == calls and got.processed_char_end == 29 and got.entities
    assert all("Hello from Munich and Berlin."[e.start : e.stop] == e.text for e in got.entities)
    if share is not None:
        assert {e.confidence for e in got.entities} == {share}
    if estimator == "none":
        assert {e.confidence for e in got.entities} == {None}
    with pytest.raises(ValueError):
        inference.passes(spark, "model_agreement", ["m", "m"])


class Labels:
    def answer(self, request):
        return {"text": json.dumps({"type": {"label": "Incident", "evidence": "down"}, "queue": {"label": "Nope", "evidence": ""}, "tags": [{"label": "VPN", "evidence": "vpn"}]}), "input_tokens": 1, "output_tokens": 1}


def test_classify(spark):
    rows = spark.createDataFrame([(1, "vpn down")], "id long, text string")
    got = inference.classify(rows, Labels, "{text} {types} {queues} {tags}", ["Incident"], ["IT"], ["VPN"], steps=2, second="{evidence}").first()
    assert (got.type.label, got.queue.label, [t.label for t in got.tags], got.invalid_queue, got.all_json_valid) == ("Incident", "", ["VPN"], "Nope", True)


def test_attempts_and_verification(spark):
    rows = spark.createDataFrame([(1, 1, False, "a"), (1, 2, True, "b"), (1, 3, True, "c"), (2, 1, False, "d"), (2, 2, False, "e")], "id int, attempt int, json_valid boolean, reply string")
    assert {r.id: r.reply for r in inference.first_valid(rows, ["id"]).collect()} == {1: "b", 2: "e"}
    kind = "id int, json_valid boolean, entities array<struct<text:string,start:int,stop:int>>"
    first = spark.createDataFrame([(1, True, [("a", 0, 1)]), (2, True, [("a", 0, 1)])], kind)
    second = spark.createDataFrame([(1, True, [("b", 2, 3)]), (2, False, [])], kind)
    got = {r.id: ([e.text for e in r.entities], len(r.added), len(r.removed)) for r in inference.verified(first, second, "id").collect()}
    assert got == {1: (["b"], 1, 1), 2: (["a"], 0, 0)}


class Second:
    """Fails on the second request of its first run."""

    failing = True

    def answer(self, request):
        if request["prompt"] == "p1" and request["fail"]:
            raise RuntimeError("boom")
        return {"text": request["prompt"].upper(), "input_tokens": 6, "output_tokens": 6}


def test_resume_after_a_failure(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    rows = spark.createDataFrame([("a", "p0"), ("b", "p1"), ("c", "p2")], "key string, prompt string")
    run = runner.Runner(spark, folder, ["key"], {"model": "m"}, 10)
    run.step(rows.withColumn("fail", F.lit(True)), 0, Second, ["prompt", "fail"])
    assert {r.key: r.status for r in run.latest().collect()} == {"a": "ok", "b": "error", "c": "ok"}
    run = runner.Runner(spark, folder, ["key"], {"model": "m"}, 10)
    run.step(rows.withColumn("fail", F.lit(False)), 1, Second, ["prompt", "fail"])
    assert {r.key: r.status for r in run.latest().collect()} == {"a": "ok", "b": "ok", "c": "ok"}
    assert run.progress(3) == {"planned": 3, "attempted": 4, "answered": 3, "share": 1.0, "seconds_left": None}
    with pytest.raises(ValueError, match="another configuration"):
        runner.Runner(spark, folder, ["key"], {"model": "other"}, 10)


def test_a_batch_that_runs_again(spark, tmp_path):
    """A stop after the attempts were written, and the batch run again: each row is asked once and has one result."""
    folder, rows = f"file://{tmp_path}/run", spark.createDataFrame([(f"k{i}", f"q{i}", False) for i in range(5)], "key string, prompt string, fail boolean")

    class Stopped(runner.Runner):
        def _tries(self, batch):
            self.stopped = super()._tries(batch)
            return self.stopped

    def broken():
        raise RuntimeError("stop")

    run = Stopped(spark, folder, ["key"], {}, 20)
    with pytest.raises(Exception, match="stop"):
        run.step(rows, 0, broken, ["prompt", "fail"])
    run = Stopped(spark, folder, ["key"], {}, 20)
    assert run.used == 5  # reserved before the calls
    run.step(rows, 0, Second, ["prompt", "fail"])
    assert run.stopped == 1 and run.results().count() == 5 and run.latest().count() == 5
    run.step(rows, 0, Second, ["prompt", "fail"])
    assert run.results().count() == 5 and run.progress(5, 10.0)["seconds_left"] == 0


def test_an_answer_that_is_not_accepted(spark):
    class Twice:
        def __init__(self):
            self.n = 0

        def answer(self, request):
            self.n += 1
            return {"text": "{" if self.n == 1 else "```json\n{}\n```"}

    out = inference.asked(Twice(), {"prompt": "p"}, 2, accept=inference.is_json)
    assert (out["text"], out["attempts"]) == ("```json\n{}\n```", 2)
    assert inference.asked(Twice(), {"prompt": "p"}, 1, accept=inference.is_json)["text"] == "{"


def test_models():
    choices = inference.model_choices({"a": {"endpoint": "x", "api_key": "k", "models": ["m", "n"]}, "b": {"endpoint": "y", "needs_key": False, "models": ["m"]}, "c": {"models": ["z"], "api_key": "k"}, "d": {"endpoint": "w", "models": ["o"]}})
    assert list(choices) == ["a:m", "a:n", "b:m"]
    assert inference.chosen_model(choices, None)[1] == "m" and inference.chosen_model(choices, "n")[0].key == "a" and inference.chosen_model(choices, "b:m")[0].key == "b"
    for wanted in ("m", "z"):
        with pytest.raises(ValueError, match="model"):
            inference.chosen_model(choices, wanted)
    with pytest.raises(ValueError, match="unknown"):
        inference.method("extraction", "none")


def test_encoder_checks(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "vec_id long, text string")
    good = inference.encoded(rows, "text", lambda: lambda texts: [[3.0, 4.0]] * len(texts), 2).collect()
    assert all(r.embedding == pytest.approx([0.6, 0.8]) for r in good)
    for bad in ([[0.0, 0.0]], [[float("nan"), 1.0]], [[1.0]]):
        with pytest.raises(Exception, match="encoder"):
            inference.encoded(rows, "text", lambda bad=bad: lambda texts: bad * len(texts), 2).collect()


def test_budget(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", f"q{i}", False) for i in range(3)], "key string, prompt string, fail boolean")
    run = runner.Runner(spark, f"file://{tmp_path}/run", ["key"], {}, 2)
    run.step(rows, 0, Second, ["prompt", "fail"])
    assert run.attempts().count() == 2 and run.results().count() == 2


def test_route_by_neighbours(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0], "it"), (2, [0.9, 0.1], "IT"), (3, [0.0, 1.0], "Billing"), (4, [0.5, 0.5], "gone")], "vec_id long, embedding array<double>, department string")
    queries = spark.createDataFrame([(10, [1.0, 0.05])], "vec_id long, embedding array<double>")
    got = inference.route_by_neighbours(queries, index, ["IT", "Billing"], 2).first()
    assert (got.department, got.n_hits, got.status) == ("IT", 2, "ok") and got.confidence == pytest.approx(1.0)


def test_replies_are_made_some_rows_at_a_time(spark, monkeypatch):
    import pandas as pd

    class Echo:
        def answer(self, request):
            return {"text": str(request["k"])}

    taken = []
    rows = type("Rows", (), {"schema": spark.range(1).withColumnRenamed("id", "k").schema, "mapInPandas": lambda self, part, schema: taken.append(part)})()
    inference.call(rows, Echo, ["k"])
    out = list(taken[0](iter([pd.DataFrame({"k": range(1300)})])))
    assert [len(x) for x in out] == [512, 512, 276] and [r["text"] for x in out for r in x["reply"]] == [str(i) for i in range(1300)]


def test_freeform_asks_once(spark, sf):
    """One call for each row, and no replies read as JSON: they are lines."""
    from spanloom.plans import study_queries

    plan = study_queries.extract_freeform(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan and "strict_json" not in plan and "from_json" not in plan


def test_exports_are_linked_once(spark, sf):
    """Every matching reads the linked exports that were written, not the tables again."""
    from spanloom.plans import study_queries

    files = study_queries.reviewed_exports(spark, sf).inputFiles()
    assert files and not any("lineitem" in f or "orders" in f for f in files)
