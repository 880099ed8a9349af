"""Span algebra: overlaps, one-to-one matching, containment and listings. Spans have start and stop, half-open."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Of the shorter span."""
    return overlap(a0, a1, b0, b1) / F.least(a1 - a0, b1 - b0)


def _buckets(start: Column, stop: Column, width: int) -> Column:
    """The buckets that an interval touches; an empty one touches that of its start."""
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(stop - 1, start) / width)))


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], ends: tuple[str, str, str, str], width: int = 256) -> DataFrame:
    """Pairs of equal ``on`` whose intervals, ends being start and stop in a and in b, share a point, or of which an empty one
    lies within the other. Rows with a null end or that stop before they start have no pair.

    A range join by buckets: each interval goes to the buckets of ``width`` that it touches, and a pair is emitted in that
    of its later start alone. A large group is spread over its buckets, and rows that are compared share one, instead of
    all pairs of a group. The width should be about the length of the longer intervals.
    """
    a0, a1, b0, b1 = map(F.col, ends)
    left = a.filter(a1 >= a0).withColumn("__bucket", _buckets(a0, a1, width))
    right = b.filter(b1 >= b0).withColumn("__bucket", _buckets(b0, b1, width))
    own = left.join(right, [*on, "__bucket"])
    return own.filter((a0 < b1) & (b0 < a1) & (F.col("__bucket") == F.floor(F.greatest(a0, b0) / width))).drop("__bucket")


def overlapping_pairs(windows: DataFrame, group: list[str], key: str) -> DataFrame:
    """group, a, b and ratio of the windows of a group that overlap."""
    a = windows.select(*group, F.col(key).alias("a"), F.col("start").alias("a0"), F.col("stop").alias("a1"))
    b = windows.select(*group, F.col(key).alias("b"), F.col("start").alias("b0"), F.col("stop").alias("b1"))
    own = overlap_join(a, b, group, ("a0", "a1", "b0", "b1")).filter("a < b and greatest(a0, b0) < least(a1, b1)")
    return own.select(*group, "a", "b", overlap_ratio(*map(F.col, ("a0", "a1", "b0", "b1"))).alias("ratio"))


def candidates(gold: DataFrame, predicted: DataFrame, groups: list[str], mode: str, once: bool = False) -> DataFrame:
    """Pairs of one group and label that may match, with their score. once: neither side repeats a span.

    overlap: intersection over union. boundary_tolerant: spans also have first and last token; starts differ by one
    token at most and ends by two; the score is the sum of the differences, negative. Neither compares all pairs of a group:
    the first is a range join by buckets, the second an equality join on first tokens, of which one side states three.
    """
    extra = ["first", "last"] if mode == "boundary_tolerant" else []
    side = lambda d, x: d.select(*groups, "label", *(F.col(c).alias(f"{x}_{c}") for c in ("start", "stop", *extra)))
    p, g, on = side(predicted, "p"), side(gold, "g"), [*groups, "label"]
    if not once:
        p, g = p.distinct(), g.distinct()
    if mode == "overlap":
        own = overlap_join(p, g, on, ("p_start", "p_stop", "g_start", "g_stop"))
        shared = overlap(*map(F.col, ("p_start", "p_stop", "g_start", "g_stop")))
        return own.withColumn("score", shared / (F.greatest("p_stop", "g_stop") - F.least("p_start", "g_start"))).filter(F.col("score") > 0)
    near = p.withColumn("__first", F.explode(F.array(*(F.col("p_first") + d for d in (-1, 0, 1))))).join(g.withColumn("__first", F.col("g_first")), [*on, "__first"]).drop("__first")
    start, stop = F.abs(F.col("p_first") - F.col("g_first")), F.abs(F.col("p_last") - F.col("g_last"))
    return near.filter(stop <= 2).withColumn("score", (-(start + stop)).cast("double"))


_P, _G = ["p_start", "p_stop", "label"], ["g_start", "g_stop", "label"]


def _first_come(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """Greedy matches in one pass over each group's sorted pairs; a task remembers the spans that are used, no pairs."""
    own = pairs.select(*groups, "label", "p_start", "p_stop", "g_start", "g_stop", "score")
    order = [F.desc("score"), F.desc("p_start"), F.desc("p_stop"), F.desc("label"), F.desc("g_start"), F.desc("g_stop")]
    n = len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, p_used, g_used = None, set(), set()
        for batch in batches:
            kept = []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[: n + 5]), strict=True)):
                if row[:n] != group:
                    group, p_used, g_used = row[:n], set(), set()
                label, p, g = row[n], row[n + 1 : n + 3], row[n + 3 : n + 5]
                if (label, p) not in p_used and (label, g) not in g_used:
                    p_used.add((label, p))
                    g_used.add((label, g))
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int32()))

    return own.repartition(*groups).sortWithinPartitions(*groups, *order).mapInArrow(run, own.schema)


def one_to_one(pairs: DataFrame, groups: list[str], rounds: int = 0) -> DataFrame:
    """The pairs that greedy matching takes: by (score, prediction, gold), descending, each side used once.

    A pair that is the best of both its spans is taken whatever else happens, since the order is total. Each of the rounds
    takes all such pairs (two aggregations that combine before the shuffle, and joins on spans, so a large group is spread
    over its spans) and drops the pairs of used spans. What chains leave after the rounds goes through one sorted pass of
    each group. Rounds are for few groups with very many pairs; without them all goes through the pass.
    """
    own = pairs.select(*groups, "label", "p_start", "p_stop", "g_start", "g_stop", "score")
    taken = []
    for _ in range(rounds):
        own = written(own, "pairs")
        if own.isEmpty():
            break
        best = lambda side, other: own.groupBy(*groups, *side).agg(F.max(F.struct("score", *other)).alias("best"))  # noqa: B023, E731
        # by (score, prediction, gold) for either side: the prediction is the group's key in the first, the gold in the second
        p = best(_P, ["g_start", "g_stop"]).select(*groups, *_P, "best.g_start", "best.g_stop", "best.score")
        g = best(_G, ["p_start", "p_stop"]).select(*groups, *_G, "best.p_start", "best.p_stop")
        taken.append(written(p.join(g, [*groups, "label", "p_start", "p_stop", "g_start", "g_stop"]).select(*own.columns), "matches"))
        own = own.join(taken[-1].select(*groups, *_P), [*groups, *_P], "left_anti").join(taken[-1].select(*groups, *_G), [*groups, *_G], "left_anti")
    return functools.reduce(DataFrame.unionByName, taken, _first_come(own, groups))


def greedy_matches(pairs: DataFrame, groups: list[str], rounds: int = 0) -> DataFrame:
    """Number of one-to-one matches by group."""
    return one_to_one(pairs, groups, rounds).groupBy(*groups).agg(F.count("*").alias("tp"))


def flexible_counts(gold: DataFrame, predicted: DataFrame, groups: list[str], mode: str) -> DataFrame:
    """tp, fp and fn by group under one-to-one matching within labels."""
    sides = gold.select(*groups, "label", "start", "stop").distinct().groupBy(*groups).agg(F.count("*").alias("n_gold")).join(
        predicted.select(*groups, "label", "start", "stop").distinct().groupBy(*groups).agg(F.count("*").alias("n_predicted")), groups, "full"
    )
    own = sides.join(greedy_matches(candidates(gold, predicted, groups, mode), groups), groups, "left")
    tp, g, p = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "n_gold", "n_predicted"))
    return own.select(*groups, tp.alias("tp"), (p - tp).alias("fp"), (g - tp).alias("fn"))


def overlap_counts(matches: DataFrame, groups: list[str]) -> DataFrame:
    """Rows of groups, tp, fp and fn whose sums are ``flexible_counts`` by overlap. matches: groups, label, start, stop, and g and
    p, 1 where a side has the span; each span once.

    Spans that both sides have are the only pairs with a score of 1, so greedy matching takes them before all others; only the
    spans of one side are compared. Empty spans, and those without a label or group, match nothing, here as there.
    """
    known = F.expr("g = 1 and p = 1 and stop > start and label is not null") & functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in groups))
    own = matches.withColumn("same", F.coalesce(known, F.lit(False)).cast("int"))
    rest = own.filter("same = 0")
    pairs = one_to_one(candidates(rest.filter("g = 1"), rest.filter("p = 1"), groups, "overlap", once=True), groups)
    tp = F.col("same")
    whole = own.select(*groups, tp.alias("tp"), (F.col("p") - tp).alias("fp"), (F.col("g") - tp).alias("fn"))
    return whole.unionByName(pairs.select(*groups, F.lit(1).alias("tp"), F.lit(-1).alias("fp"), F.lit(-1).alias("fn")))


def listing(kept: DataFrame, against: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct spans of one side that the other has not."""
    return kept.select(*keys).distinct().join(against.select(*keys), keys, "left_anti")


def contained(entities: DataFrame, windows: DataFrame, on: str, width: int = 256) -> DataFrame:
    """Entities wholly inside a window, with offsets from its start: a range join by buckets, of which an entity needs only
    that of its start. Entities that stop before they start are in none."""
    w = windows.select(on, "window_id", F.col("start").alias("w0"), F.col("stop").alias("w1")).filter("w1 >= w0")
    w = w.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("w0") / width), F.floor(F.col("w1") / width))))
    own = entities.withColumn("__bucket", F.floor(F.col("start") / width)).join(w, [on, "__bucket"]).drop("__bucket")
    return own.filter("start >= w0 and stop <= w1 and start <= stop").withColumn("start", F.col("start") - F.col("w0")).withColumn("stop", F.col("stop") - F.col("w0")).drop("w0", "w1")


def clipped(sections: DataFrame, windows: DataFrame, on: str) -> DataFrame:
    """Sections that overlap a window, cut to it, and whether they were cut."""
    w = windows.select(on, "window_id", F.col("start").alias("w0"), F.col("stop").alias("w1"))
    own = overlap_join(sections, w, [on], ("start", "stop", "w0", "w1"))
    own = own.withColumn("clipped", (F.col("start") < F.col("w0")) | (F.col("stop") > F.col("w1")))
    return own.withColumn("start", F.greatest("start", "w0") - F.col("w0")).withColumn("stop", F.least("stop", "w1") - F.col("w0")).drop("w0", "w1")


def within_cutoff(spans: DataFrame, cutoffs: DataFrame, on: str) -> DataFrame:
    """Spans that end by their document's cutoff; documents without one keep all."""
    return spans.join(cutoffs.select(on, "cutoff"), on, "left").filter("cutoff is null or stop <= cutoff").drop("cutoff")


def cutoff(explicit: Column, sentences: Column, processed: Column, text: Column) -> Column:
    """Where scoring ends and why: an explicit end, the end of the last processed sentence, or the end of the text."""
    end = F.get(sentences, F.least(processed, F.size(sentences)) - 1)["stop"]
    return (
        F.when(explicit.isNotNull(), F.struct(explicit.cast("int").alias("cutoff"), F.lit("explicit").alias("scope")))
        .when(end.isNotNull(), F.struct(end.cast("int").alias("cutoff"), F.lit("sentences").alias("scope")))
        .otherwise(F.struct(F.length(text).alias("cutoff"), F.lit("full").alias("scope")))
    )


def step_changes(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """key, change and text of entities that a second step added, removed, or kept under another key: rephrased_or_shifted
    are pairs with one text whose start or stop differs. Rows: key, text, start, stop."""
    own = ["text", "start", "stop"]
    listed = lambda kept, against, name: listing(kept, against, [key, *own]).withColumn("change", F.lit(name))
    a = first.select(key, "text", F.col("start").alias("a0"), F.col("stop").alias("a1")).distinct()
    b = second.select(key, "text", F.col("start").alias("b0"), F.col("stop").alias("b1")).distinct()
    moved = a.join(b, [key, "text"]).filter("a0 <> b0 or a1 <> b1").select(key, "text", F.col("b0").alias("start"), F.col("b1").alias("stop"), F.lit("rephrased_or_shifted").alias("change")).distinct()
    return listed(second, first, "added").unionByName(listed(first, second, "removed")).unionByName(moved)
