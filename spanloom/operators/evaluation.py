"""Whole evaluations of predicted against gold spans: a batch of windows, and one reviewed document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ratio, with_prf
from ..functions.text import canonical_label, slice_text
from ..runtime import shuffled, written
from . import scoring, spans
from .tokens import tokenize, touched

COUNTS = ("tp", "fp", "fn")
SPAN = ["start", "stop", "label"]


@dataclass
class Evaluation:
    """summary has one row; the others a row for each group, example or span."""

    summary: DataFrame
    groups: DataFrame
    flexible_groups: DataFrame
    per_example: DataFrame
    false_positives: DataFrame
    false_negatives: DataFrame
    failed: DataFrame
    intervals: DataFrame | None = None


def _keys(spans_column: str, start: str, stop: str, label: str, g: int, p: int) -> Column:
    """An array's spans with the side that they are of; none for null."""
    own = F.transform(spans_column, lambda s: F.struct(s[start].alias("start"), s[stop].alias("stop"), s[label].alias("label"), F.lit(g).alias("g"), F.lit(p).alias("p")))
    return F.coalesce(own, F.array())


def _with_tokens(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """first and last token that each span touches."""
    own = keys.join(texts.select("example_id", tokenize("text").alias("__t")), "example_id")
    hit = touched(F.col("__t"), F.col("start"), F.col("stop"))
    return own.withColumn("__h", hit).withColumn("first", F.col("__h.first")).withColumn("last", F.col("__h.last")).drop("__t", "__h")


def evaluate_batch(gold: DataFrame, predictions: DataFrame, iterations: int = 0, order: tuple[str, ...] = ("seq",), share: bool = False) -> Evaluation:
    """gold: example_id (once each), doc_id, source_split, length_bucket, text, entities (label, start_char, end_char). predictions:
    example_id, status, processed_char_end, predictions (type, start, end) and an order; the last row of an example counts.

    Missing and failed examples are left out of the scores and counted in the coverage. share: for callers that read several
    results; what these have in common is written first, as else the plan of each holds all that leads to it.
    """
    keep = (lambda rows, name: shuffled(written(rows, name))) if share else lambda rows, name: rows
    latest = scoring.latest(predictions, ["example_id"], list(order))
    both = gold.withColumnsRenamed({"source_split": "split", "length_bucket": "bucket"}).withColumn("__gold", F.lit(True)).join(latest.withColumn("__predicted", F.lit(True)), "example_id", "full")
    both = shuffled(written(both, "evaluated"))  # the last rows are looked for and joined once; read by a dozen results
    done = both.filter("__gold and status = 'ok'")
    by = ["example_id", "doc_id", "bucket", "split", "label"]
    sides = F.concat(_keys("entities", "start_char", "end_char", "label", 1, 0), _keys("predictions", "start", "end", "type", 0, 1))
    found = done.select("example_id", "doc_id", "bucket", "split", "processed_char_end", F.explode(sides).alias("s")).filter("s.stop <= processed_char_end")
    matches = found.withColumns({"label": canonical_label(F.col("s.label")), "start": F.col("s.start"), "stop": F.col("s.stop")}).groupBy(*by, "start", "stop").agg(F.max("s.g").alias("g"), F.max("s.p").alias("p"))
    matches = matches.withColumns({"tp": F.col("g") * F.col("p"), "fp": (1 - F.col("g")) * F.col("p"), "fn": F.col("g") * (1 - F.col("p"))})
    matches = shuffled(written(matches, "matches"))
    sums = [F.sum(c).alias(c) for c in COUNTS]
    strict = keep(done.select("example_id", "doc_id", "bucket", "split").join(matches.groupBy("example_id").agg(*sums), "example_id", "left").na.fill(0, list(COUNTS)), "strict")
    spans_of = lambda side: matches.filter(f"{side} = 1").select("example_id", "label", "start", "stop", F.lit(side).alias("side"))

    touching = keep(_with_tokens(spans_of("g").unionByName(spans_of("p")), done), "touched")
    tolerant = spans.flexible_counts(touching.filter("side = 'g'"), touching.filter("side = 'p'"), ["example_id"], "boundary_tolerant")
    overlapping = spans.overlap_counts(matches, ["example_id"])
    flexible = {"boundary_tolerant": keep(tolerant, "boundary_tolerant"), "overlap": keep(overlapping.groupBy("example_id").agg(*sums), "overlap")}
    per_example = with_prf(strict)
    for mode, counts in flexible.items():
        per_example = per_example.join(with_prf(counts).select("example_id", F.col("f1").alias(f"{mode}_f1")), "example_id", "left").na.fill(0.0, [f"{mode}_f1"])

    def grouped(rows: DataFrame, *columns: str) -> DataFrame:
        parts = [rows.groupBy(F.lit(c).alias("group_type"), F.col(c).alias("group")).agg(*sums) for c in columns]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return with_prf(out)

    groups = grouped(strict, "bucket", "split").unionByName(grouped(matches, "label"))
    where = done.select("example_id", "bucket", "split")
    flexible_groups = None
    for mode, counts in flexible.items():
        own = grouped(counts.join(where, "example_id"), "bucket", "split").withColumn("metric", F.lit(mode))
        flexible_groups = own if flexible_groups is None else flexible_groups.unionByName(own)

    texts = done.select("example_id", F.col("text").alias("__text"))
    listing = lambda c: matches.filter(F.col(c) == 1).join(texts, "example_id").select("example_id", "doc_id", "bucket", "label", F.col("start").alias("start_char"), F.col("stop").alias("end_char"), slice_text(F.col("__text"), F.col("start"), F.col("stop")).alias("text"))
    failed = both.filter("__gold and (status is null or status <> 'ok')").select("example_id", F.coalesce("status", F.when(F.col("__predicted").isNull(), "missing")).alias("status"))

    one = lambda rows, prefix: with_prf(rows.agg(*sums)).select(*(F.col(c).alias(f"{prefix}{c}") for c in (*COUNTS, "precision", "recall", "f1")))
    # sums over all need no row for each example: documents without spans count too
    documents = done.select("doc_id", *(F.lit(0).alias(c) for c in COUNTS)).unionByName(matches.select("doc_id", *COUNTS))
    summary = scoring.covered(both)
    for part in (one(matches, "micro_"), one(flexible["boundary_tolerant"], "boundary_tolerant_"), one(flexible["overlap"] if share else overlapping, "overlap_"), scoring.macro_f1(documents, "doc_id"), scoring.run_totals(both.filter("__predicted"))):
        if part.columns:
            summary = summary.join(F.broadcast(part))  # one row each
    intervals = None
    if iterations:
        clusters = strict.groupBy("doc_id").agg(*sums, F.min("example_id").alias("__first"))
        ranked = clusters.orderBy("__first").select("doc_id", *COUNTS).collect()  # one row for each document, as the draws need an order
        spark = gold.sparkSession
        counts = spark.createDataFrame([(i, r.tp, r.fp, r.fn) for i, r in enumerate(ranked)], "number long, tp long, fp long, fn long")
        intervals = scoring.bootstrap(counts, scoring.exact_draws(spark, len(ranked), iterations), iterations) if ranked else None
    return Evaluation(summary, groups, flexible_groups, per_example, listing("fp"), listing("fn"), failed, intervals)


def _linked(exports: DataFrame, examples: DataFrame) -> DataFrame:
    """exports with reason (null if it can be scored), legacy, w (cutoff and scope), and g and f: the gold and the predicted
    spans up to the cutoff.

    exports: doc_name, example_id, model_predictions (null in old exports), review_log (source, status and spans),
    processed_char_end and n_sentences. Old exports are scored by their log, unless labels were edited in it.
    """
    own = exports.join(examples.select("example_id", "text", "sentences", "entities"), "example_id", "left")
    log = F.filter("review_log", lambda x: x["source"] == "model")
    legacy = F.col("model_predictions").isNull()
    plain = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"))
    predicted = F.when(legacy, F.transform(log, plain)).otherwise(F.transform("model_predictions", plain))
    reason = F.when(F.col("example_id").isNull(), "not linked to an example").when(F.col("text").isNull(), "the example was not found").when(legacy & F.exists(log, lambda x: x["status"] == "edited"), "labels were edited")
    end = F.get("sentences", F.least(F.col("n_sentences"), F.size("sentences")) - 1)["end_char"]
    where = (
        F.when(F.col("processed_char_end") > 0, F.struct(F.col("processed_char_end").alias("cutoff"), F.lit("exact").alias("scope")))
        .when((F.col("n_sentences") > 0) & end.isNotNull(), F.struct(end.alias("cutoff"), F.lit("inferred").alias("scope")))
        .otherwise(F.struct(F.length("text").alias("cutoff"), F.lit("full").alias("scope")))
    )
    own = own.withColumn("reason", reason).withColumn("w", where).withColumn("p", predicted)
    gold = F.transform("entities", lambda e: F.struct(e["start_char"].alias("start"), e["end_char"].alias("stop"), canonical_label(e["label"]).alias("label")))
    found = F.transform("p", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("stop"), canonical_label(e["type"]).alias("label")))
    upto = lambda c: F.array_distinct(F.filter(c, lambda s: s["stop"] <= F.col("w.cutoff")))
    return own.withColumn("legacy", legacy).withColumn("g", upto(gold)).withColumn("f", upto(found))


def evaluate_exports(exports: DataFrame, examples: DataFrame) -> DataFrame:
    """A row for each reviewed document: whether it can be scored and why not, its cutoff and scope, strict counts and
    ratios, the F1 of boundary-tolerant and of overlap matching, and the spans found too much and missed."""
    own = _linked(exports, examples).select("doc_name", "text", "reason", "legacy", "w", "g", "f")
    own = shuffled(written(own, "linked"))  # read by either side of each matching; else each of them joins and collects again
    ok = F.col("reason").isNull()
    counts = {"tp": F.size(F.array_intersect("f", "g")), "fp": F.size(F.array_except("f", "g")), "fn": F.size(F.array_except("g", "f"))}
    out = with_prf(own.withColumns(counts)).select("doc_name", ok.alias("available"), "reason", "legacy", F.col("w.scope").alias("scope"), F.col("w.cutoff").alias("processed_char_end"), *(F.when(ok, F.col(c)).alias(c) for c in (*COUNTS, "precision", "recall", "f1")), F.when(ok, F.array_sort(F.array_except("f", "g"))).alias("false_positives"), F.when(ok, F.array_sort(F.array_except("g", "f"))).alias("false_negatives"))
    for mode in ("boundary_tolerant", "overlap"):
        part = with_prf(_flexible(own, mode, ["doc_name"])).select("doc_name", *(F.col(c).alias(f"{mode}_{c}") for c in (*COUNTS, "f1")))
        names = [f"{mode}_{c}" for c in (*COUNTS, "f1")]
        out = out.join(part, "doc_name", "left").withColumns({c: F.when(F.col("available"), F.coalesce(F.col(c), F.lit(0))) for c in names})  # no spans at all: 0
    return out


def _flexible(linked: DataFrame, mode: str, groups: list[str]) -> DataFrame:
    own = linked.filter("reason is null")
    side = lambda c: own.select(F.col("doc_name").alias("example_id"), *groups, F.explode(c).alias("s")).select("example_id", *groups, "s.start", "s.stop", "s.label")
    gold, found = side("g"), side("f")
    if mode == "boundary_tolerant":
        texts = own.select(F.col("doc_name").alias("example_id"), "text")
        gold, found = _with_tokens(gold, texts), _with_tokens(found, texts)
    return spans.flexible_counts(gold, found, groups, mode)


def exports_by_label(exports: DataFrame, examples: DataFrame) -> DataFrame:
    """Strict counts and ratios of the exports that can be scored, by document and label."""
    own = _linked(exports, examples).filter("reason is null")
    side = lambda c, g, p: own.select("doc_name", F.explode(c).alias("s")).select("doc_name", "s.*", F.lit(g).alias("g"), F.lit(p).alias("p"))
    met = side("g", 1, 0).unionByName(side("f", 0, 1)).groupBy("doc_name", "label", "start", "stop").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return with_prf(met.groupBy("doc_name", "label").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn")))


def micro(exports: DataFrame) -> DataFrame:
    """One row over the exports that could be scored."""
    own = exports.filter("available").agg(F.count("*").alias("documents"), *(F.sum(c).alias(c) for c in COUNTS))
    return with_prf(own).withColumn("share", ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))
