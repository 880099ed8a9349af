"""Resumable inference: a stream of requests, a budget, an attempts table written before each call, and append-only results.

Each batch drops what is done, admits rows while the budget lasts, writes the attempts, asks, and appends the replies.
A batch that fails is run again from the stream's checkpoint; calls are at least once, and attempts never count fewer.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.inference import Provider, call
from ..operators.scoring import latest
from ..runtime import written
from ..sources.writers import get, put
from .limits import Limits, Paced


def fingerprint(config: dict) -> str:
    """Of what makes runs comparable: method, model, labels, prompt, manifest and so on."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def admitted(rows: DataFrame, order: list[str], cost: str, most: float, group: str | None = None) -> DataFrame:
    """Rows in order while the running cost stays within the budget. Without a group, running sums go by range partitions:
    each partition sums its own and adds what the ones before hold, so no task sees all rows. The rows are written with the
    number of their partition first: evaluated twice, they could be dealt to other partitions each time."""
    if group:
        total = F.sum(cost).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        return rows.withColumn("running", total).filter(F.col("running") <= most)
    own = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "admission").withColumn("__p", F.shiftright("__m", 33))
    own = own.withColumn("__own", F.sum(cost).over(W.partitionBy("__p").orderBy("__m").rowsBetween(W.unboundedPreceding, 0)))
    parts = own.groupBy("__p").agg(F.sum(cost).alias("__n"))
    before = parts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return own.join(F.broadcast(before), "__p").withColumn("running", F.col("__own") + F.col("__before")).filter(F.col("running") <= most).drop("__m", "__p", "__own", "__before")


class Runner:
    """A run in a folder: results, attempts and the stream's checkpoint."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], config: dict, most_calls: int, limits: Limits | None = None, cost: str | None = None, lanes: int = 8):
        """most_calls: of the whole run. limits: more limits of the whole run, on calls, on the sum of the column ``cost`` and on
        requests a minute, of which each of at most ``lanes`` tasks gets its part."""
        self.spark, self.folder, self.key, self.mark = spark, folder.rstrip("/"), key, fingerprint(config)
        self.limits, self.cost, self.lanes = limits or Limits(), cost, lanes
        self.most_calls = min(most_calls, self.limits.calls) if self.limits.calls else most_calls
        before = get(spark, f"{self.folder}/run.json")
        if before is not None and json.loads(before)["fingerprint"] != self.mark:
            raise ValueError("the folder holds results of another configuration")
        if before is None:
            put(spark, f"{self.folder}/run.json", json.dumps({"fingerprint": self.mark}).encode())
        self.used = self.attempts().count()  # once; each step adds its own
        self.spent = (self.attempts().agg(F.sum(cost)).first()[0] or 0.0) if cost and self.used else 0.0

    def _table(self, name: str, schema: str | None = None) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema or ", ".join(f"{k} string" for k in self.key))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/try=*/_SUCCESS"))
        if not files:  # a first try that did not end
            return self.spark.createDataFrame([], schema or ", ".join(f"{k} string" for k in self.key))
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def attempts(self) -> DataFrame:
        return self._table("attempts", "batch long")

    def results(self) -> DataFrame:
        return self._table("results", "fingerprint string")

    def latest(self) -> DataFrame:
        """The last result of each key."""
        return latest(self.results(), self.key, ["batch", "try"])

    def step(self, rows: DataFrame, batch: int, provider: Callable[[], Provider], columns: list[str]) -> None:
        """One batch: what is not done and fits the budget is recorded as attempted, asked and appended, failures too.

        Each try of a batch has folders of its own, so a batch that runs again after a failure asks for what has no good
        result yet and for nothing twice. Attempts of all tries count towards the budget, as their calls may have been made.
        """
        done = self.results()
        if "status" in done.columns:
            rows = rows.join(done.filter("status = 'ok'").select(*self.key).distinct(), self.key, "left_anti")
        nth = self._tries(batch)
        own = admitted(rows.withColumn("__one", F.lit(1)), self.key, "__one", self.most_calls - self.used).drop("__one", "running")
        if self.cost and self.limits.cost:
            own = admitted(own, self.key, self.cost, self.limits.cost - self.spent).drop("running")
        # written and read again: a second evaluation must not admit other rows
        place = f"batch={batch}/try={nth}"
        own.write.mode("overwrite").parquet(f"{self.folder}/attempts/{place}")
        fixed = self.spark.read.schema(own.schema).parquet(f"{self.folder}/attempts/{place}")
        counted = fixed.agg(F.count("*"), F.sum(self.cost) if self.cost else F.lit(0.0)).first()
        self.used, self.spent = self.used + counted[0], self.spent + (counted[1] or 0.0)
        ask = provider
        if interval := self.limits.share(self.lanes).interval:
            fixed, ask = fixed.coalesce(self.lanes), lambda: Paced(provider(), interval)
        out = call(fixed, ask, columns, tries=1)
        status = F.when(F.col("reply.error").isNull(), "ok").otherwise("error")
        out.withColumns({"status": status, "fingerprint": F.lit(self.mark), "finished_at": F.current_timestamp()}).write.mode("overwrite").parquet(f"{self.folder}/results/{place}")

    def _tries(self, batch: int) -> int:
        """How often the batch has been begun."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/attempts/batch={batch}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return len(fs.listStatus(path)) if fs.exists(path) else 0

    def stream(self, source: str, schema, provider: Callable[[], Provider], columns: list[str], files_per_batch: int = 1):
        """All files of a folder that have not been read yet, some at a time; ends when none is left."""
        rows = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        query = rows.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, n: self.step(batch, n, provider, columns)).start()
        query.awaitTermination()
        return query

    def progress(self, planned: int, seconds: float | None = None) -> dict:
        """Calls planned, attempted and answered, the share that is done, and how long the rest will take at the pace so far."""
        own = self.results()
        answered = own.filter("status = 'ok'").select(*self.key).distinct().count() if "status" in own.columns else 0
        share = answered / planned if planned else 0.0
        out = {"planned": planned, "attempted": self.used, "answered": answered, "share": share, "seconds_left": None}
        if answered and seconds is not None:
            out["seconds_left"] = seconds / answered * (planned - answered)
        return out


def windowed_votes(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Votes for each event type in windows of time, for streams with late rows (beyond what batch runs need)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("votes"), F.avg("value").alias("mean"))
