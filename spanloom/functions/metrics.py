"""Ratios from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def with_prf(counts: DataFrame) -> DataFrame:
    """tp, fp, fn as long, with precision, recall and f1."""
    out = counts.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tp", "fp", "fn")})
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def multiset_counts(gold: DataFrame, predicted: DataFrame, groups: list[str], keys: list[str]) -> DataFrame:
    """tp, fp and fn by group; repeated keys match as often as both sides have them."""
    on = groups + keys
    both = gold.select(*on, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*on, F.lit(0).alias("g"), F.lit(1).alias("p")))
    own = both.groupBy(*on).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return own.groupBy(*groups).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))


def set_counts(gold: DataFrame, predicted: DataFrame, groups: list[str | Column], keys: list[str], parts: int | None = None) -> DataFrame:
    """As ``multiset_counts`` with each key once on either side. One shuffle on the keys; the sums combine before theirs.

    groups may be columns made from the keys, so that few groups need no sums for many smaller ones first. parts: into how many
    the keys are dealt before any are held (``runtime.parts_for``); a task then holds its part's keys, where otherwise each
    reader holds those of its piece of a file, which grows with the files, and few of them recur there."""
    on = list(dict.fromkeys([g for g in groups if isinstance(g, str)] + keys))
    both = gold.select(*on, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*on, F.lit(0).alias("g"), F.lit(1).alias("p")))
    if parts:
        both = both.repartition(parts, *on)
    own = both.groupBy(*on).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return own.groupBy(*groups).agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
