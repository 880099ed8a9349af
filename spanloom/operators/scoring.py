"""Scorecards: classification with evidence, extraction, batches of documents, and clustered bootstrap intervals."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import multiset_counts, ratio, with_prf
from ..functions.text import contains_evidence, exact_round, fold, squeeze


def accuracy_macro_f1(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: accuracy, and the mean F1 over all labels of either side, the empty one too."""
    pairs = rows.groupBy(fold(F.col(gold)).alias("g"), fold(F.col(predicted)).alias("p")).agg(F.count("*").alias("n"))
    # a row for either side's label; a hit carries both
    sides = pairs.select(F.explode(F.when(F.col("g") == F.col("p"), F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))))
        .otherwise(F.array(F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("fn")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn"))))).alias("s")).select("s.*")
    labels = with_prf(sides.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))
    return labels.agg(F.count("*").alias("n_labels"), F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"))


def tag_counts(gold: Column, predicted: Column) -> dict[str, Column]:
    """tp, fp and fn of two arrays of tags as sets of folded tags."""
    g, p = (F.array_distinct(F.transform(F.coalesce(x, F.array().cast("array<string>")), fold)) for x in (gold, predicted))
    return {"tp": F.size(F.array_intersect(g, p)), "fp": F.size(F.array_except(p, g)), "fn": F.size(F.array_except(g, p))}


def tag_rows(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Each row's counts and ratios; two empty sets score 0."""
    return with_prf(rows.withColumns(tag_counts(F.col(gold), F.col(predicted))))


def tag_metrics(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: micro ratios of the sums, and means of the rows' ratios, each rounded to four places first."""
    four = exact_round(4)
    own = tag_rows(rows, gold, predicted).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), *(F.avg(four(F.col(c))).alias(f"row_{c}") for c in ("precision", "recall", "f1")))
    return with_prf(own).select("tp", "fp", "fn", F.col("precision").alias("micro_precision"), F.col("recall").alias("micro_recall"), F.col("f1").alias("micro_f1"), "row_precision", "row_recall", "row_f1")


def evidence_rate(rows: DataFrame, evidence: str, text: str) -> DataFrame:
    """Of the non-empty entries of an array of evidence, the share that its text contains; 0 without any."""
    own = rows.select(F.explode(evidence).alias("e"), F.col(text).alias("t")).filter("e <> ''")
    own = own.agg(F.count("*").alias("n_evidence"), F.coalesce(F.sum(contains_evidence(F.col("e"), F.col("t")).cast("long")), F.lit(0)).alias("n_valid"))
    return own.withColumn("evidence_valid_rate", ratio(F.col("n_valid"), F.col("n_evidence")))


def json_rates(rows: DataFrame) -> DataFrame:
    """Shares over the rows to which they apply: all_json_valid (null as invalid), not_applicable, has_invalid_labels."""
    on = ~F.coalesce("not_applicable", F.lit(False))
    valid = F.coalesce("all_json_valid", F.lit(False))
    own = rows.agg(F.count("*").alias("n"), F.count_if(on).alias("n_applicable"), F.count_if(on & valid).alias("n_valid"), F.count_if(F.coalesce("has_invalid_labels", F.lit(False))).alias("n_labels"))
    return own.select("n", "n_applicable", ratio(F.col("n_valid"), F.col("n_applicable")).alias("json_valid_rate"), ratio(F.col("n_applicable") - F.col("n_valid"), F.col("n_applicable")).alias("invalid_json_rate"), ratio(F.col("n_labels"), F.col("n")).alias("invalid_label_rate"))


def classification_scorecard(records: DataFrame) -> DataFrame:
    """records: method, model, text, gold and prediction structs, all_json_valid, has_invalid_labels. One row of 16 columns."""
    one = lambda field: accuracy_macro_f1(records.select(F.col(f"gold.{field}").alias("g"), F.col(f"prediction.{field}.label").alias("p")), "g", "p").select(F.col("accuracy").alias(f"{field}_accuracy"), F.col("macro_f1").alias(f"{field}_macro_f1"))
    tags = tag_metrics(records.select(F.col("gold.tags").alias("g"), F.col("prediction.tags.label").alias("p")), "g", "p").select(*(F.col(c).alias(f"tag_{c}") for c in ("micro_precision", "micro_recall", "micro_f1", "row_precision", "row_recall", "row_f1")))
    evidence = F.filter(F.concat(F.array("prediction.type.evidence", "prediction.queue.evidence"), F.col("prediction.tags.evidence")), lambda e: e.isNotNull())
    rates = json_rates(records.withColumn("not_applicable", F.lit(False))).select("invalid_json_rate", "invalid_label_rate")
    out = records.agg(F.coalesce(F.min("method"), F.lit("unknown")).alias("method"), F.coalesce(F.min("model"), F.lit("")).alias("model"), F.count("*").alias("n_examples"))
    for part in (one("type"), one("queue"), tags, rates, evidence_rate(records.withColumn("__e", evidence), "__e", "text").select("evidence_valid_rate")):
        out = out.join(F.broadcast(part))  # one row each
    return out


def classification_errors(records: DataFrame) -> DataFrame:
    """Records with a wrong type or queue or tags that are not all right."""
    same = lambda field: fold(F.col(f"gold.{field}")) == fold(F.col(f"prediction.{field}.label"))
    own = tag_rows(records.withColumn("__g", F.col("gold.tags")).withColumn("__p", F.col("prediction.tags.label")), "__g", "__p").drop("__g", "__p")
    own = own.withColumn("type_correct", same("type")).withColumn("queue_correct", same("queue"))
    return own.filter("not type_correct or not queue_correct or f1 < 1")


STRICT, LENIENT = ["key_text", "start", "stop"], ["key_text"]


def extraction_counts(gold: DataFrame, predicted: DataFrame, groups: list[str], keys: list[str]) -> DataFrame:
    """Multiset counts by record (the type takes no part unless it is among the groups)."""
    with_key = lambda d: d.withColumn("key_text", squeeze(F.col("text")))
    return multiset_counts(with_key(gold), with_key(predicted), groups, keys)


def extraction_rows(gold: DataFrame, predicted: DataFrame, record: str) -> DataFrame:
    """Strict and lenient counts, precision and recall of each record that has a span on either side."""
    out = None
    for name, keys in (("strict", STRICT), ("lenient", LENIENT)):
        own = with_prf(extraction_counts(gold, predicted, [record], keys)).select(record, *(F.col(c).alias(f"{name}_{c}") for c in ("tp", "fp", "fn", "precision", "recall")))
        out = own if out is None else out.join(own, record)
    return out


def extraction_scorecard(records: DataFrame) -> DataFrame:
    """records: id, method, model, gold and prediction arrays of spans, json flags. One row of 12 columns."""
    flat = lambda side: records.select("id", F.inline(side))
    out = records.agg(F.coalesce(F.min("method"), F.lit("unknown")).alias("method"), F.coalesce(F.min("model"), F.lit("")).alias("model"), F.count("*").alias("n_examples"))
    for name, keys in (("strict", STRICT), ("lenient", LENIENT)):
        own = extraction_counts(flat("gold"), flat("prediction"), ["id"], keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
        out = out.join(F.broadcast(with_prf(own).select(*(F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")))))
    return out.join(F.broadcast(json_rates(records).select("json_valid_rate", "invalid_json_rate", "invalid_label_rate")))


def per_type(gold: DataFrame, predicted: DataFrame, example: str, label: str) -> DataFrame:
    """Strict counts inside each type with its support."""
    own = extraction_counts(gold, predicted, [example, label], STRICT).groupBy(label).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return with_prf(own).withColumn("support", F.col("tp") + F.col("fn"))


def macro_f1(counts: DataFrame, document: str) -> DataFrame:
    """Mean of the documents' F1."""
    own = with_prf(counts.groupBy(document).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))
    return own.agg(F.count("*").alias("n_documents"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def portable_draws(clusters: DataFrame, iterations: int) -> DataFrame:
    """it and number: as many draws as clusters in each iteration, by hashes that any SQL engine can repeat. clusters: number.
    Each task makes the draws of its slots, so they are made where they are summed."""
    n = clusters.count()
    slots = clusters.select(F.col("number").alias("slot"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))).alias("it"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("it").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % n
    return slots.select("it", drawn.alias("number"))


def exact_draws(spark, n: int, iterations: int, seed: int = 42) -> DataFrame:
    """it, number and times, drawn on the driver as Python's random module does; for corpora of some thousand clusters."""
    rng, rows = random.Random(seed), []
    positions = range(n)
    for it in range(iterations):
        rows += [(it, number, times) for number, times in Counter(rng.choice(positions) for _ in positions).items()]
    return spark.createDataFrame(rows, "it long, number long, times long")


def bootstrap(counts: DataFrame, draws: DataFrame, iterations: int) -> DataFrame:
    """Percentile intervals of precision, recall and F1 when clusters are drawn again. counts: number, tp, fp, fn; draws:
    it, number and times (1 if missing). The bounds are elements of the sorted values, not interpolated. Draws meet their
    counts and are summed in their task, so a row an iteration and task is shuffled."""
    times = F.col("times") if "times" in draws.columns else F.lit(1)
    sums = draws.withColumn("times", times).join(counts, "number")
    own = with_prf(sums.groupBy("it").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("tp", "fp", "fn"))))
    low, high = int(0.025 * iterations), min(iterations - 1, int(0.975 * iterations))
    names = ("precision", "recall", "f1")
    own = own.agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in names))  # one value for each iteration
    return own.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.get(c, F.lit(low)).alias("lower_95"), F.get(c, F.lit(high)).alias("upper_95")) for c in names))).alias("m")).select("m.*")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; combines before the shuffle, unlike a window."""
    rest = [c for c in rows.columns if c not in key]
    own = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return own.select(*key, "__last.*")


def coverage(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """One row: rows asked for, answered, missing and failed, unknown predictions, and the share answered."""
    both = gold.select(key, F.lit(True).alias("__gold")).join(predictions.select(key, "status", F.lit(True).alias("__predicted")), key, "full")
    return covered(both)


def covered(both: DataFrame) -> DataFrame:
    """As ``coverage`` of rows that are joined already: status, and __gold and __predicted, which are true or null."""
    own = both.agg(
        F.count_if("__gold").alias("n_gold"),
        F.count_if(F.expr("__gold and __predicted is null")).alias("n_missing"),
        F.count_if(F.expr("__gold and __predicted and coalesce(status, '') <> 'ok'")).alias("n_failed"),
        F.count_if(F.expr("__gold is null")).alias("n_unknown"),
    )
    return own.withColumn("coverage_rate", ratio(F.col("n_gold") - F.col("n_missing") - F.col("n_failed"), F.col("n_gold")))


def run_totals(predictions: DataFrame) -> DataFrame:
    """Sums over all latest rows, failed ones too."""
    return predictions.agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("llm_calls", "attempted_calls", "input_tokens", "output_tokens", "total_tokens", "elapsed_seconds", "estimated_cost_usd") if c in predictions.columns))


def leaderboard(scores: list[DataFrame], by: str) -> DataFrame:
    """All score rows with the columns of any, best first."""
    out = scores[0]
    for more in scores[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.orderBy(F.col(by).desc_nulls_last())
