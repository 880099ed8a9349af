"""Review queues, edits and what review logs say about a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPREAD = 0.01  # a smaller spread of confidence is no ranking
THRESHOLD, BUDGET = 0.80, 0.20


def flag_by_threshold(spans: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """flagged: below the threshold, or without a score."""
    return spans.withColumn("flagged", F.coalesce(F.col("confidence") < threshold, F.lit(True)))


def flag_by_budget(spans: DataFrame, document: list[str], budget: float = BUDGET) -> DataFrame:
    """flagged: the lowest share of a document's scores with ties, if they rank anything; and what has no score."""
    own = spans.groupBy(*document).agg(F.array_sort(F.collect_list("confidence")).alias("c"))
    n = F.size("c")
    k = F.when(F.lit(budget) > 0, F.greatest(F.lit(1), F.bround(n * F.lit(budget)).cast("int"))).otherwise(0)
    cut = F.get("c", F.least(k, n) - 1)
    usable = (n > 0) & (k > 0) & (cut < F.get("c", n - 1)) & (F.get("c", n - 1) - F.get("c", F.lit(0)) >= SPREAD)
    cuts = own.select(*document, F.when(usable, cut).alias("__cut"))
    return spans.join(cuts, document, "left").withColumn("flagged", F.col("confidence").isNull() | F.coalesce(F.col("confidence") <= F.col("__cut"), F.lit(False))).drop("__cut")


def has_signal(spans: DataFrame, document: list[str]) -> DataFrame:
    """spread of a document's scores and whether it ranks anything."""
    own = spans.groupBy(*document).agg(F.count("confidence").alias("n_scored"), (F.max("confidence") - F.min("confidence")).alias("s"))
    spread = F.when(F.col("n_scored") > 1, F.col("s")).otherwise(0.0)
    return own.select(*document, "n_scored", spread.alias("spread"), (spread >= SPREAD).alias("has_signal"))


def band(confidence: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(confidence.isNull(), "unknown").when(confidence >= max(threshold, 0.999), "high").when(confidence >= threshold, "medium").otherwise("low")


def needs_review(confidence: Column, threshold: float = THRESHOLD) -> Column:
    return F.coalesce(confidence < threshold, F.lit(True))


def summary(flagged: DataFrame, document: list[str]) -> DataFrame:
    """n, scored, flagged, mean confidence and share flagged of each document."""
    return flagged.groupBy(*document).agg(F.count("*").alias("n_entities"), F.count("confidence").alias("n_scored"), F.count_if("flagged").alias("n_flagged"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("flagged").cast("double")).alias("share_flagged"))


def queue(spans: DataFrame, document: list[str]) -> DataFrame:
    """place in a document's review queue: without score first, then by confidence, start and position in the input."""
    order = W.partitionBy(*document).orderBy(F.col("confidence").asc_nulls_first(), "start", "pos")
    return spans.withColumn("place", F.row_number().over(order))


def numbered(spans: DataFrame, document: list[str]) -> DataFrame:
    """num: 1 and on by start over the spans that are not deleted."""
    live = F.when(F.col("status") != "deleted", 0)
    order = W.partitionBy(*document, live.isNull()).orderBy("start", "pos")
    return spans.withColumn("num", F.when(live.isNotNull(), F.row_number().over(order)))


def apply_edits(spans: DataFrame, edits: DataFrame, key: str = "id") -> DataFrame:
    """Deleting comes before relabelling, that before confirming; unknown ids are ignored. edits: key, new_type, confirmed, delete."""
    own = spans.join(edits.select(key, "new_type", "confirmed", "delete", F.lit(True).alias("__edited")), key, "left")
    kept = F.col("delete")
    status = F.when(F.col("__edited").isNull(), F.col("status")).when(kept, "deleted").when(F.col("new_type") != F.col("type"), "edited").when(F.col("confirmed"), "confirmed").otherwise("pending")
    kind = F.when(F.col("__edited").isNotNull() & ~kept, F.col("new_type")).otherwise(F.col("type"))
    return own.withColumn("__status", status).withColumn("type", kind).withColumn("status", F.col("__status")).drop("new_type", "confirmed", "delete", "__edited", "__status")


def confirm_pending(spans: DataFrame, only: Column | None = None) -> DataFrame:
    """All pending spans confirmed, or those of a condition."""
    condition = F.col("status") == "pending"
    return spans.withColumn("status", F.when(condition if only is None else condition & only, "confirmed").otherwise(F.col("status")))


def manual_span(document: Column, text: Column) -> Column:
    """Start and stop of the text's first occurrence; null if it has none."""
    at = F.instr(document, text)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(text)).alias("stop")))


def routing_status(predicted: Column, approved: Column) -> Column:
    return F.when(predicted.isNull() | approved.isNull(), "failed").when(predicted == approved, "confirmed").otherwise("corrected")


def annotation_metrics(log: DataFrame, document: list[str]) -> DataFrame:
    """Counts and rates of what reviewers did with a model's spans; rates are null without such spans."""
    model = F.col("source") == "model"
    own = log.groupBy(*document).agg(
        F.count_if(model).alias("model_suggested"),
        *(F.count_if(model & (F.col("status") == s)).alias(name) for s, name in (("confirmed", "confirmed_as_is"), ("edited", "relabeled_by_human"), ("deleted", "deleted_by_human"))),
        F.count_if(F.col("source") == "human").alias("added_by_human"),
    )
    rate = lambda c: F.when(F.col("model_suggested") > 0, F.col(c) / F.col("model_suggested"))
    return own.withColumns({"acceptance_rate": rate("confirmed_as_is"), "edit_rate": rate("relabeled_by_human"), "deletion_rate": rate("deleted_by_human")})


def confidence_diagnostics(log: DataFrame, document: list[str], threshold: float = 0.75) -> DataFrame:
    """Whether low scores are where reviewers changed something: precision, recall and lift of the flag."""
    own = log.filter("source = 'model' and confidence is not null").withColumn("f", F.col("confidence") < threshold).withColumn("c", F.col("status").isin("edited", "deleted"))
    own = own.groupBy(*document).agg(F.count("*").alias("n_scored"), F.count_if("f").alias("n_flagged"), F.count_if("c").alias("n_changed"), F.count_if(F.expr("f and c")).alias("hits"), F.avg("confidence").alias("mean_confidence"))
    flagged = F.when(F.col("n_flagged") > 0, F.col("hits") / F.col("n_flagged"))
    others = F.col("n_scored") - F.col("n_flagged")
    unflagged = F.when(others > 0, (F.col("n_changed") - F.col("hits")) / others)
    lift = F.when(unflagged > 0, flagged / unflagged).when((unflagged == 0) & (flagged > 0), F.lit(float("inf")))
    return own.select(
        *document, "n_scored", "n_flagged", "n_changed", "mean_confidence", (F.col("n_flagged") / F.col("n_scored")).alias("share_flagged"), flagged.alias("flag_precision"),
        F.when(F.col("n_changed") > 0, F.col("hits") / F.col("n_changed")).alias("flag_recall"), unflagged.alias("change_rate_unflagged"), lift.alias("lift"),
    )


def routing_acceptance(rows: DataFrame) -> DataFrame:
    """By classifier: reviewed decisions, those accepted, and their share in percent."""
    own = rows.filter("review_status in ('confirmed', 'corrected')").groupBy("classifier").agg(F.count("*").alias("reviewed"), F.count_if(F.col("review_status") == "confirmed").alias("accepted"))
    return own.withColumn("acceptance_rate", 100 * F.col("accepted") / F.col("reviewed"))


def interventions(log: DataFrame) -> DataFrame:
    return log.filter("status <> 'pending'").groupBy("type", "status").agg(F.count("*").alias("n"))


def progress(log: DataFrame, document: list[str]) -> DataFrame:
    """Reviewed, pending and relabelled spans."""
    return log.groupBy(*document).agg(F.count_if(F.col("status") != "pending").alias("reviewed"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "edited").alias("relabelled"))


def unpivot_rates(metrics: DataFrame, document: list[str], rates: list[str]) -> DataFrame:
    return metrics.unpivot(document, rates, "rate", "value")


def export_documents(spans: DataFrame, document: list[str]) -> DataFrame:
    """A row for each document: what the model gave, the gold spans that are left, and the log."""
    entry = F.struct("start", "stop", "type", "text", "source", "status", "confidence")
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, entry)))
    return spans.groupBy(*document).agg(pick(F.col("source") == "model").alias("model_predictions"), pick(F.col("status").isin("confirmed", "edited")).alias("gold_entities"), pick(F.lit(True)).alias("review_log"))
