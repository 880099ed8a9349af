"""Agreement of several runs on spans, and confidence from token probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ratio

KEY = ["start", "stop", "type"]


def aggregate_votes(spans: DataFrame, runs: DataFrame, document: list[str]) -> DataFrame:
    """Each span with votes, total, voters in the order of runs and confidence. spans: document, run, start, stop, type, text;
    runs: run and pos, the runs without spans too."""
    total = runs.agg(F.count("*").alias("total"))
    own = spans.join(F.broadcast(runs), "run").groupBy(*document, *KEY, "run").agg(F.min("pos").alias("pos"), F.min_by("text", "text").alias("text"))
    own = own.groupBy(*document, *KEY).agg(F.count("*").alias("votes"), F.min_by("text", "pos").alias("text"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "run"))), lambda v: v["run"]).alias("voters"))
    return own.join(F.broadcast(total)).withColumn("confidence", ratio(F.col("votes"), F.col("total")))


def agreement(spans: DataFrame, runs: DataFrame, document: list[str]) -> DataFrame:
    """A row for each pair of runs: sizes, shared and own spans, and Jaccard's coefficient (1 where both are empty)."""
    own = spans.select(*document, *KEY, "run").distinct().join(F.broadcast(runs), "run")
    sets = own.groupBy(*document, *KEY).agg(F.collect_set("pos").alias("in"))
    # the runs are few; each span counts for the pairs of them that it is in
    pairs = runs.select(F.col("run").alias("a"), F.col("pos").alias("pa")).join(runs.select(F.col("run").alias("b"), F.col("pos").alias("pb")), F.col("pa") < F.col("pb"))
    seen = sets.groupBy("in").agg(F.count("*").alias("n")).join(F.broadcast(pairs))
    has_a, has_b = F.array_contains("in", F.col("pa")), F.array_contains("in", F.col("pb"))
    counts = seen.groupBy("a", "b").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in (("n_a", has_a), ("n_b", has_b), ("shared", has_a & has_b))))
    out = pairs.select("a", "b").join(counts, ["a", "b"], "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_a", "n_b", "shared")})
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return out.select("a", "b", "n_a", "n_b", "shared", (F.col("n_a") - F.col("shared")).alias("only_a"), (F.col("n_b") - F.col("shared")).alias("only_b"), F.when(union > 0, F.col("shared") / union).otherwise(1.0).alias("jaccard"))


def unanimous(spans: DataFrame, runs: DataFrame, document: list[str]) -> DataFrame:
    """One row: all distinct spans, those that every run has, and their share."""
    n = runs.agg(F.count("*").alias("__n"))
    own = spans.groupBy(*document, *KEY).agg(F.countDistinct("run").alias("votes")).join(F.broadcast(n))
    own = own.agg(F.count("*").alias("n_union"), F.count_if(F.col("votes") == F.col("__n")).alias("n_unanimous"))
    return own.withColumn("share_unanimous", ratio(F.col("n_unanimous"), F.col("n_union")))


def agreement_matrix(spans: DataFrame, runs: list[str], document: list[str]) -> DataFrame:
    """A column for each run, true where it has the span, and the number of them."""
    own = spans.groupBy(*document, *KEY).agg(*(F.coalesce(F.max(F.col("run") == r), F.lit(False)).alias(r) for r in runs), F.countDistinct("run").alias("agreement"))
    return own.orderBy(F.desc("agreement"), *document, *KEY)


def logprob_confidence(tokens: Column, needle: Column) -> Column:
    """exp of the mean log probability of the tokens that the first occurrence of the text touches, between 0 and 1; null if it
    does not occur. tokens: structs with token and logprob."""
    kept = F.filter(tokens, lambda t: t["token"] != "")
    at = F.instr(F.array_join(kept["token"], ""), F.trim(needle)) - 1
    end = at + F.length(F.trim(needle))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(s, t):
        stop = s["at"] + F.length(t["token"])
        hit = (s["at"] < end) & (stop > at)
        return F.struct(stop.alias("at"), (s["sum"] + F.when(hit, t["logprob"]).otherwise(0.0)).alias("sum"), (s["n"] + hit.cast("int")).alias("n"))

    mean = F.aggregate(kept, zero, step, lambda s: F.when(s["n"] > 0, s["sum"] / s["n"]))
    return F.when((F.trim(needle) != "") & (at >= 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(mean))))
