"""Queries on streams of requests: pace and budgets as keyed state, and runs that are resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch, table
from ..streaming.desk import Desk
from ..streaming.limits import Limits, paced, paced_table

SLICES = 4
LIMITS = Limits(calls=1000, cost=3500.0, requests_per_minute=0.025)
MONTH = "timestamp'2024-01-01'"


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests: account, arrival in microseconds, cost, and the slice of the month in which they arrive."""
    own = table(spark, sf, "events").select("event_id", (F.col("user_id") % 8).cast("int").alias("account"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"), (F.col("event_id") % 7 + 1).cast("double").alias("cost"), "ts")
    return own.withColumn("slice", F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(SLICES - 1)).cast("int")).drop("ts")


def paced_requests(spark, sf):
    """STM-04: calls, cost and requests a minute of each account, over a stream whose files arrive one after the other."""
    source, to = scratch(spark, "requests"), scratch(spark, "paced")
    rows = _requests(spark, sf)
    for i in range(SLICES):
        rows.filter(F.col("slice") == i).drop("slice").coalesce(1).write.parquet(f"{source}/{i}")  # a file of each slice, later ones after earlier ones
    stream = spark.readStream.schema(rows.drop("slice").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    own = paced(stream, "account", "arrival", "event_id", LIMITS, "cost")
    query = own.writeStream.option("checkpointLocation", f"{to}-state").trigger(availableNow=True).format("parquet").start(to)
    query.awaitTermination()
    return spark.read.schema(own.schema).parquet(to).select("event_id", "account", "admitted", F.floor((F.col("starts_at") - F.unix_micros(F.expr(MONTH))) / 60_000_000).alias("minute"))


def paced_events(spark, sf):
    """STM-04: the same limits over a table, by running sums and maxima."""
    own = paced_table(_requests(spark, sf).drop("slice"), "account", "arrival", "event_id", LIMITS, "cost")
    return own.select("event_id", "account", "admitted", F.floor((F.col("starts_at") - F.unix_micros(F.expr(MONTH))) / 60_000_000).alias("minute"))


_PACED_SQL = f"""with e as (select event_id, (user_id % 8)::integer account, epoch_us(ts) arrival, event_id % 7 + 1 c, row_number() over (partition by user_id % 8 order by ts, event_id) - 1 i from events),
s as (select *, coalesce(sum(c) over (partition by account order by i rows between unbounded preceding and 1 preceding), 0) spent, max(arrival - i * {LIMITS.interval}) over (partition by account order by i) + i * {LIMITS.interval} start from e),
a as (select *, i < {LIMITS.calls} and spent < {LIMITS.cost} admitted from s)
select event_id, account, admitted, case when admitted then floor((start - epoch_us(timestamp '2024-01-01')) / 60000000)::bigint end "minute" from a"""


class Sometimes:
    """Answers with the customer's key; keys divisible by five fail the first time."""

    def __init__(self, first: bool = True):
        self.first = first

    def answer(self, request: dict) -> dict:
        if self.first and request["k"] % 5 == 0:
            raise RuntimeError("not now")
        return {"text": f"{request['k']} {request['status']}", "model_id": "m", "input_tokens": 1, "output_tokens": 1}


def resumed_desk(spark, sf):
    """STM-01 to STM-06: requests that arrive in three waves, of which the second asks for all keys again: those that failed
    are asked once more, those that were answered are not."""
    source, folder = scratch(spark, "requests"), scratch(spark, "desk")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("status"))
    desk = Desk(spark, folder, source, rows.schema, ["k"], {"model": "m"})
    for i, wave in enumerate((rows.filter("k % 3 <> 0"), rows, rows.filter("k % 2 = 0"))):
        wave.write.parquet(f"{source}/{i}")
        desk = Desk(spark, folder, source, rows.schema, ["k"], {"model": "m"})  # as after a stop
        desk.serve(lambda first=i == 0: Sometimes(first), ["k", "status"], files_per_batch=1000)
    asked = desk.attempts().groupBy("k").agg(F.count("*").alias("attempts"))
    found = desk.results().groupBy("k").agg(F.count_if(F.col("status") == "error").alias("failed"), F.max_by("text", "attempt").alias("text"))
    return asked.join(found, "k")


_DESK_SQL = """select c_custkey k, case when c_custkey % 3 <> 0 and c_custkey % 5 = 0 then 2 else 1 end::bigint attempts, case when c_custkey % 3 <> 0 and c_custkey % 5 = 0 then 1 else 0 end::bigint failed, c_custkey || ' ' || c_mktsegment as text from customer"""

QUERIES = {f.__name__: f for f in (paced_requests, paced_events, resumed_desk)}
ORACLE_SQL = {"paced_requests": _PACED_SQL, "paced_events": _PACED_SQL, "resumed_desk": _DESK_SQL}
