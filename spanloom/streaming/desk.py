"""A resumable run as two streams: admission by keyed state, and calls.

Admission reads the requests and the results so far as streams. Its state holds for each key how often it was asked and
whether it has a good result, so a batch reads its own requests and the results that are new, never all results. Keys share
states in a fixed number of buckets: Python is called once for a bucket, not once for a key, which took 3 ms each. What it
admits is written as an attempt before anything is asked. The second stream reads the attempts, asks, and appends the
results, which admission then reads. A stop at any point runs a batch again from its checkpoint: attempts are replaced by
the same ones, and a call may be made twice but is never left uncounted. A key that failed is asked again when it is
requested again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.inference import Provider, call
from ..sources.writers import get, put
from .runner import fingerprint


#: Keys travel as JSON; times keep their microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _open():
    """The step of a bucket of keys: counts each key's attempts, drops requests of keys that are answered, and takes one request
    of a key at a time. Rows: key, request and status; the state is JSON with attempts and whether it is done for each key."""

    def one(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        waiting = {}
        for frame in frames:
            for key, request, status in zip(frame["key"], frame["request"], frame["status"], strict=True):
                own = known.setdefault(key, [0, False])
                if status == "ok":
                    own[1] = True
                if request is not None:
                    waiting[key] = request
        asked = [(key, request) for key, request in waiting.items() if not known[key][1]]
        for key, _ in asked:
            known[key][0] += 1
        state.update((json.dumps(known, ensure_ascii=False),))
        if asked:
            yield pd.DataFrame([(key, request, known[key][0]) for key, request in asked], columns=["key", "request", "attempt"])

    return one


class Desk:
    """A run in a folder: requests that arrive as Parquet files in ``source``, attempts, results and two checkpoints."""

    def __init__(self, spark: SparkSession, folder: str, source: str, schema: StructType, key: list[str], config: dict, most_calls: int = 0, buckets: int = 1 << 14):
        self.spark, self.folder, self.source, self.schema, self.key, self.most_calls, self.buckets = spark, folder.rstrip("/"), source, schema, key, most_calls, buckets
        mark = json.dumps({"fingerprint": fingerprint(config), "buckets": buckets}).encode()
        before = get(spark, f"{self.folder}/run.json")
        if before is not None and before != mark:
            raise ValueError("the folder holds a run of another configuration")
        if before is None:
            put(spark, f"{self.folder}/run.json", mark)
        keys = [schema[k] for k in key]
        self.attempt_schema = StructType([*keys]).add("request", "string").add("attempt", "long")
        self.result_schema = StructType([*keys]).add("attempt", "long").add("status", "string").add("text", "string").add("error", "string").add("batch", "long")
        for name in ("attempts", "results"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        self.used = self.attempts().count()
        self.batches: list[dict] = []

    def attempts(self) -> DataFrame:
        return self.spark.read.schema(self.attempt_schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/attempts")

    def results(self) -> DataFrame:
        return self.spark.read.schema(self.result_schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/results")

    def _files(self, path: str, schema: StructType, most: int) -> DataFrame:
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", most).option("recursiveFileLookup", True).parquet(path)

    def _write(self, rows: DataFrame, name: str, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch-{n:09d}")

    def _admit(self, rows: DataFrame, n: int) -> None:
        if self.most_calls:
            rows = rows.orderBy(*self.key).limit(max(0, self.most_calls - self.used))
        self._write(rows, "attempts", n)
        self.used += self.spark.read.schema(self.attempt_schema).parquet(f"{self.folder}/attempts/batch-{n:09d}").count()

    def _run(self, rows: DataFrame, name: str, step: Callable[[DataFrame, int], None]) -> None:
        query = rows.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint-{name}").trigger(availableNow=True).foreachBatch(step).start()
        query.awaitTermination()
        self.batches += [{"stream": name, "batch": p["batchId"], "rows": p["numInputRows"], "states": sum(o["numRowsTotal"] for o in p["stateOperators"])} for p in query.recentProgress if p["numInputRows"]]

    def admit(self, files_per_batch: int = 1) -> None:
        """Requests and results that are new through the state; attempts for what is to be asked."""
        request = F.to_json(F.struct(*self.schema.names), {"ignoreNullFields": "false"}).alias("request")
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).alias("bucket")
        key = F.to_json(F.struct(*self.key), _TIMES).alias("key")
        requests = self._files(self.source, self.schema, files_per_batch).select(bucket, key, request, F.lit(None).cast("string").alias("status"))
        answers = self._files(f"{self.folder}/results", self.result_schema, max(1000, files_per_batch)).select(bucket, key, F.lit(None).cast("string").alias("request"), "status")
        own = requests.unionByName(answers).groupBy("bucket").applyInPandasWithState(_open(), "key string, request string, attempt long", "known string", "append", GroupStateTimeout.NoTimeout)
        keys = F.from_json("key", StructType([self.schema[k] for k in self.key]), _TIMES)
        self._run(own.select(keys.alias("__k"), "request", "attempt").select(*(F.col("__k")[k].alias(k) for k in self.key), "request", "attempt"), "admission", self._admit)

    def ask(self, provider: Callable[[], Provider], columns: list[str], files_per_batch: int = 1000) -> None:
        """Every attempt that has no result yet."""

        def step(rows: DataFrame, n: int) -> None:
            own = rows.withColumn("__r", F.from_json("request", self.schema)).select(*self.key, "attempt", *(F.col(f"__r.{c}").alias(c) for c in columns if c not in self.key))
            out = call(own, provider, columns, tries=1)
            status = F.when(F.col("reply.error").isNull(), "ok").otherwise("error")
            self._write(out.select(*self.key, "attempt", status.alias("status"), F.col("reply.text").alias("text"), F.col("reply.error").alias("error"), F.lit(n).cast("long").alias("batch")), "results", n)

        self._run(self._files(f"{self.folder}/attempts", self.attempt_schema, files_per_batch), "calls", step)

    def serve(self, provider: Callable[[], Provider], columns: list[str], files_per_batch: int = 1) -> None:
        """Admits and asks all requests that have arrived."""
        self.admit(files_per_batch)
        self.ask(provider, columns)
