import datetime
import json
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanloom.operators.labels import dense_ids
from spanloom.runtime import written
from spanloom.sources import writers
from spanloom.streaming.desk import Desk
from spanloom.streaming.limits import Limits, Paced, paced, paced_table
from spanloom.streaming.runner import Runner, admitted

cloudpickle.register_pickle_by_value(sys.modules[__name__])
ROWS = "lane int, at long, id long, cost double"


def stated(rows, limits):
    out, lanes = {}, {}
    for lane, at, key, cost in sorted(rows, key=lambda r: (r[1], r[2])):
        free, calls, spent = lanes.get(lane, (0, 0, 0.0))
        if (limits.calls and calls >= limits.calls) or (limits.cost and spent >= limits.cost):
            out[key] = None
            continue
        start = max(at, free)
        lanes[lane] = (start + limits.interval, calls + 1, spent + cost)
        out[key] = start
    return out


@pytest.mark.parametrize("limits", [Limits(requests_per_minute=60), Limits(calls=20, requests_per_minute=600), Limits(cost=33.0, requests_per_minute=30), Limits()])
def test_pace_and_budgets(spark, tmp_path, limits):
    rng = random.Random(4)
    rows = [(i % 3, rng.randrange(60_000_000), i, float(rng.randrange(1, 4))) for i in range(150)]
    want = stated(rows, limits)
    table = spark.createDataFrame(rows, ROWS)
    assert {r.id: r.starts_at for r in paced_table(table, "lane", "at", "id", limits, "cost").collect()} == want
    for i in range(3):  # the stream holds the same rows in the order of arrival
        table.filter((F.col("at") / 20_000_000).cast("int") == i).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    own = paced(stream, "lane", "at", "id", limits, "cost")
    query = own.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/out")
    query.awaitTermination()
    assert sum(1 for p in query.recentProgress if p["numInputRows"]) == 3
    assert {r.id: r.starts_at for r in spark.read.schema(own.schema).parquet(f"file://{tmp_path}/out").collect()} == want


def test_a_limit_dealt_over_lanes():
    own = Limits(100, 10.0, 60).share(4)
    assert (own.calls, own.cost, own.requests_per_minute, own.interval) == (25, 2.5, 15, 4_000_000)


def test_a_paced_provider():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    own = Paced(Loud(), 500_000, lambda: now[0], sleep)
    for i in range(3):
        own.answer({"k": str(i), "bad": False})
    now[0] += 5
    own.answer({"k": "x", "bad": False})
    assert slept == [0.5, 0.5]


def test_a_run_with_limits(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", False, 2.0) for i in range(8)], "k string, bad boolean, price double")
    limits = Limits(calls=6, cost=9.0, requests_per_minute=600)
    run = Runner(spark, f"file://{tmp_path}/run", ["k"], {}, 100, limits, "price", lanes=1)
    began = time.monotonic()
    run.step(rows, 0, Loud, ["k", "bad"])
    assert (run.used, run.spent, run.results().count()) == (4, 8.0, 4) and time.monotonic() - began >= 0.3
    run = Runner(spark, f"file://{tmp_path}/run", ["k"], {}, 100, Limits(calls=6, cost=99.0), "price")
    assert (run.used, run.spent) == (4, 8.0)
    run.step(rows, 1, Loud, ["k", "bad"])
    assert run.results().count() == 6


class Loud:
    def answer(self, request):
        if request["bad"]:
            raise RuntimeError("no")
        return {"text": request["k"].upper()}


SCHEMA = "k string, bad boolean"


def _desk(spark, folder, most=0, config=None):
    from pyspark.sql.types import StringType, StructType

    schema = StructType().add("k", StringType()).add("bad", "boolean")
    return Desk(spark, f"{folder}/run", f"{folder}/in", schema, ["k"], config or {"m": 1}, most)


def _arrive(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{name}")


def test_requests_are_answered_once(spark, tmp_path):
    folder = f"file://{tmp_path}"
    _arrive(spark, folder, "0", [("a", False), ("b", True), ("a", False)])
    _desk(spark, folder).serve(Loud, ["k", "bad"])
    _arrive(spark, folder, "1", [("a", False), ("b", False), ("c", False)])
    desk = _desk(spark, folder)
    desk.serve(Loud, ["k", "bad"])
    desk.serve(Loud, ["k", "bad"])
    assert sorted((r.k, r.attempt, r.status, r.text) for r in desk.results().collect()) == [("a", 1, "ok", "A"), ("b", 1, "error", None), ("b", 2, "ok", "B"), ("c", 1, "ok", "C")]
    with pytest.raises(ValueError, match="another configuration"):
        _desk(spark, folder, config={"m": 2})


def test_attempts_are_written_before_the_calls(spark, tmp_path):
    folder = f"file://{tmp_path}"
    _arrive(spark, folder, "0", [(f"k{i}", False) for i in range(6)])

    def broken():
        raise RuntimeError("stop")

    desk = _desk(spark, folder)
    with pytest.raises(Exception, match="stop"):
        desk.serve(broken, ["k", "bad"])
    assert desk.attempts().count() == 6 and desk.results().count() == 0
    desk = _desk(spark, folder)
    assert desk.used == 6
    desk.serve(Loud, ["k", "bad"])
    assert desk.attempts().count() == 6 and desk.results().count() == 6


def test_budget_of_calls(spark, tmp_path):
    folder = f"file://{tmp_path}"
    _arrive(spark, folder, "0", [(f"k{i}", False) for i in range(6)])
    desk = _desk(spark, folder, 4)
    desk.serve(Loud, ["k", "bad"])
    assert desk.results().count() == 4
    _arrive(spark, folder, "1", [(f"k{i}", False) for i in range(6)])
    desk = _desk(spark, folder, 100)  # requested again under a larger budget, only the rest is asked
    desk.serve(Loud, ["k", "bad"])
    assert desk.results().count() == 6


def test_small_batches_read_no_more_as_a_run_grows(spark, tmp_path):
    """Rows that enter a batch are its requests and the results that are new: over many batches they grow in proportion."""
    folder, n, batches = f"file://{tmp_path}", 5, 40
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for i in range(batches):
            spark.createDataFrame([(f"k{j}", False) for j in range(i * n, i * n + n)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        desk = _desk(spark, folder)
        desk.admit(files_per_batch=1)
        assert sum(b["rows"] for b in desk.batches) == n * batches and max(b["rows"] for b in desk.batches) == n
        desk.ask(Loud, ["k", "bad"])
        _arrive(spark, folder, "again", [("k0", False)])
        desk.batches = []
        desk.admit(files_per_batch=1)
        assert sum(b["rows"] for b in desk.batches) == n * batches + 1  # the results once, as acknowledgements
        _arrive(spark, folder, "more", [("new", False), ("k1", False)])
        desk.batches = []
        desk.admit(files_per_batch=1)
        assert sum(b["rows"] for b in desk.batches) == 2 and desk.attempts().count() == n * batches + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keys_share_states_in_buckets(spark, tmp_path):
    """Python is called once for a bucket: keys of one bucket stay apart, times keep their microseconds, null is a key."""
    folder, schema = f"file://{tmp_path}", "t timestamp, k long, bad boolean"
    at = [datetime.datetime(2024, 1, 1, 0, 0, 0, i) for i in range(3)]
    rows = [(t, k, False) for t in at for k in (None, 1, 2)]
    shape = spark.createDataFrame([], schema).schema

    class Own:
        def answer(self, request):
            if request["bad"]:
                raise RuntimeError("no")
            return {"text": "x"}

    desk = Desk(spark, f"{folder}/run", f"{folder}/in", shape, ["t", "k"], {"m": 1}, buckets=2)
    for name, own in (("0", [*rows[:-1], (*rows[-1][:2], True)]), ("1", rows)):
        spark.createDataFrame(own, schema).write.parquet(f"{folder}/in/{name}")
        desk.serve(Own, ["t", "k", "bad"], files_per_batch=100)
    found = sorted(((r.t, r.k or 0, r.attempt, r.status) for r in desk.results().collect()))
    assert found == sorted([(t, k or 0, 1, "ok") for t, k, _ in rows[:-1]] + [(at[2], 2, 1, "error"), (at[2], 2, 2, "ok")])
    assert max(b["states"] for b in desk.batches) == 2
    with pytest.raises(ValueError, match="another configuration"):
        Desk(spark, f"{folder}/run", f"{folder}/in", shape, ["t", "k"], {"m": 1}, buckets=3)


def test_files_are_replaced_in_one_step(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/state/a.json"
    writers.put(spark, path, b"one")
    assert writers.get(spark, path) == b"one" and writers.get(spark, path + "x") is None

    def stop(*_):
        raise OSError("stop")

    monkeypatch.setattr(writers, "_replace", stop)
    with pytest.raises(OSError, match="stop"):
        writers.put(spark, path, b"two", tries=2, wait=0.0)
    monkeypatch.undo()
    assert writers.get(spark, path) == b"one"  # a stop before the rename loses nothing
    writers.put(spark, path, b"three")
    assert writers.get(spark, path) == b"three" and spark.read.text(path).first().value == "three"


def test_parts_of_a_bundle_appear_together(spark, tmp_path):
    """A stop between any two steps leaves the last whole bundle in sight."""
    folder = f"file://{tmp_path}/bundle"
    rows = lambda n: lambda to: spark.range(n).write.parquet(to)

    def stopping(*_):
        raise RuntimeError("stop")

    seen = lambda: [spark.read.parquet(writers.published(spark, folder, p)).count() for p in ("a", "b")]
    with pytest.raises(ValueError, match="no published"):
        seen()
    with pytest.raises(RuntimeError):
        writers.publish(spark, folder, {"a": rows(1), "b": stopping})
    with pytest.raises(ValueError, match="no published"):
        seen()
    for n in range(1, 5):
        writers.publish(spark, folder, {"a": rows(n), "b": rows(n)}, {"n": n})
        assert seen() == [n, n] and writers.manifest_of(spark, folder)["about"] == {"n": n}
        for parts in ({"a": stopping, "b": rows(9)}, {"a": rows(9), "b": stopping}):
            with pytest.raises(RuntimeError):
                writers.publish(spark, folder, parts)
            assert seen() == [n, n]
    assert len(writers.manifest_of(spark, folder)["runs"]) == 2


def test_states_survive(spark, tmp_path):
    folder = f"file://{tmp_path}/states"
    for n in range(3):
        writers.save_state(spark, folder, "example ä", {"next": n})
        time.sleep(0.01)
    assert [json.loads(r.value) for r in spark.read.option("pathGlobFilter", "*.json").text(folder).collect()] == [{"key": "example ä", "next": 2}]


def test_running_sums_and_numbers_do_not_depend_on_how_rows_are_dealt(spark):
    n = 20_000  # rows so wide that the two sides of the join were dealt to different numbers of partitions
    wide = F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 512) for i in range(4)))
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), wide.alias("text"), F.lit(1).alias("one"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        numbers = written(dense_ids(rows, "k", "number"), "numbers")
        sums = written(admitted(rows, ["k"], "one", n - 10), "sums")
        assert (numbers.count(), numbers.filter("number = k + 1").count()) == (n, n)
        assert (sums.count(), sums.filter("running = k + 1").count()) == (n - 10, n - 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
