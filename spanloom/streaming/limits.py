"""Limits on calls, cost and pace for streams of requests, held as keyed state.

A lane is one account of a provider: its calls start at least ``interval`` apart, at their arrival or as soon as the one
before allows, and end with its budgets of calls and cost. A lane's requests are in one task, so a limit that many requests
share is best dealt over several lanes, each with its part.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..operators.inference import Provider

SECOND = 1_000_000


@dataclass(frozen=True)
class Limits:
    """Of one lane: calls (0: no limit), cost (0: none) and requests a minute (0: none)."""

    calls: int = 0
    cost: float = 0.0
    requests_per_minute: float = 0.0

    @property
    def interval(self) -> int:
        """Microseconds between two starts."""
        return round(60 * SECOND / self.requests_per_minute) if self.requests_per_minute > 0 else 0

    def share(self, lanes: int) -> Limits:
        """What each of some lanes gets of limits that hold for all of them."""
        return Limits(max(1, self.calls // lanes) if self.calls else 0, self.cost / lanes, self.requests_per_minute / lanes)


def lane(key: Column, lanes: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")


class Paced:
    """A provider whose calls in one task start at least an interval apart."""

    def __init__(self, provider: Provider, interval: int, clock=time.monotonic, sleep=time.sleep):
        self.provider, self.interval, self.clock, self.sleep, self.free = provider, interval / SECOND, clock, sleep, None

    def answer(self, request: dict) -> dict:
        now = self.clock()
        start = now if self.free is None else max(now, self.free)
        self.free = start + self.interval
        if start > now:
            self.sleep(start - now)
        return self.provider.answer(request)


def paced_table(rows: DataFrame, lane: str, at: str, key: str, limits: Limits, cost: str | None = None) -> DataFrame:
    """rows with starts_at (null if not admitted) and admitted, of a table: requests of a lane in the order of arrival and key.

    at: arrival in microseconds. The start of the i-th is the largest of arrival + (i - j) * interval over those before, so
    a running maximum gives what a loop would.
    """
    order = W.partitionBy(lane).orderBy(at, key)
    nth = (F.row_number().over(order) - 1).cast("long")
    own = rows.withColumn("__i", nth)
    spent = F.coalesce(F.sum(cost).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) if cost else F.lit(0.0)
    own = own.withColumn("admitted", F.lit(True) & (F.lit(not limits.calls) | (F.col("__i") < limits.calls)) & (F.lit(not limits.cost) | (spent < limits.cost)))
    slot = F.max(F.col(at) - F.col("__i") * limits.interval).over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("__i") * limits.interval
    return own.withColumn("starts_at", F.when(F.col("admitted"), slot)).drop("__i")


def paced(requests: DataFrame, lane: str, at: str, key: str, limits: Limits, cost: str | None = None) -> DataFrame:
    """The same for a stream of requests. The state of a lane is its next free start and what it has used, so a batch costs
    what it holds, however many came before. Within a batch requests are taken in order; a late one waits its turn. Of a
    lane, a task holds the requests of one batch (the source's limit on files bounds them)."""
    own = requests.select(*requests.columns)
    out = StructType([*own.schema.fields, StructField("starts_at", LongType()), StructField("admitted", BooleanType())])

    def one(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, calls, spent = state.get if state.exists else (None, 0, 0.0)
        batch = pd.concat(list(frames)).sort_values([at, key], kind="stable")
        starts: list[int | None] = []
        costs = batch[cost].to_list() if cost else [0.0] * len(batch)
        for arrival, price in zip(batch[at].to_list(), costs, strict=True):
            if (limits.calls and calls >= limits.calls) or (limits.cost and spent >= limits.cost):
                starts.append(None)
                continue
            start = int(arrival) if free is None else max(int(arrival), free)
            free, calls, spent = start + limits.interval, calls + 1, spent + float(price)
            starts.append(start)
        state.update((free, calls, spent))
        yield batch.assign(starts_at=pd.array(starts, "Int64"), admitted=[s is not None for s in starts])

    return own.groupBy(lane).applyInPandasWithState(one, out, "free long, calls long, spent double", "append", GroupStateTimeout.NoTimeout)
