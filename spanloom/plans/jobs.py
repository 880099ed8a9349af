"""The batch jobs: each reads, calls the operators and writes, and can be run by itself.

python -m spanloom.plans.jobs JOB key=value ... runs one; the keys are the arguments of the functions below.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import LOCATION
from ..operators import corpus, evaluation, inference, labels, retrieval, scoring, validate
from ..operators.tokens import parse_int_array, parse_string_array, sentence_texts, tag_runs
from ..sources import readers, writers
from ..streaming.runner import Runner

BUCKETS = {"short": {"min_sentences": 1, "max_sentences": 20, "target": 250}, "medium": {"min_sentences": 21, "max_sentences": 80, "target": 250}, "long": {"min_sentences": 81, "max_sentences": 200, "target": 250}, "very_long": {"min_sentences": 201, "max_sentences": None, "target": 250}}
PREDICTIONS = "example_id string, status string, processed_char_end int, predictions array<struct<text:string,type:string,start:int,end:int>>, llm_calls long, input_tokens long, output_tokens long, total_tokens long, elapsed_seconds double, estimated_cost_usd double, seq long"


def bounds(buckets: dict) -> dict[str, tuple[int, int | None]]:
    return {n: (b["min_sentences"], b.get("max_sentences")) for n, b in buckets.items()}


def prepare_corpus(spark: SparkSession, raw: str, to: str, buckets: dict = BUCKETS, seed: int = 42) -> dict:
    """Raw records to documents, a seeded sample of windows, a review sample, statistics and a manifest."""
    rows, bad = readers.raw_records(spark, [r.path for r in readers.split_files(spark, raw).collect()])
    validate.require(bad)
    corpus.documents(rows).write.mode("overwrite").parquet(f"{to}/documents")
    docs = spark.read.parquet(f"{to}/documents")
    validate.require(validate.document_violations(docs))
    lengths = [(r.doc_id, r.sentence_count) for r in docs.select("doc_id", "sentence_count", "source_split").orderBy("source_split", "doc_id").collect()]
    plan = corpus.sample_plan(lengths, buckets, seed)
    windows = corpus.windows(docs, spark.createDataFrame(plan, "doc_id string, bucket string, sentence_start int, sentence_stop int"))
    windows.write.mode("overwrite").partitionBy("source_split").parquet(f"{to}/windows")
    windows = spark.read.parquet(f"{to}/windows")
    validate.require(validate.example_violations(windows, docs, bounds(buckets), {n: b["target"] for n, b in buckets.items()}))
    corpus.smoke_sample(windows).write.mode("overwrite").json(f"{to}/smoke")
    corpus.review_sample(windows).write.mode("overwrite").json(f"{to}/review")
    counts = {"documents": len(lengths), "windows": len(plan)}
    about = writers.manifest(spark, f"{to}/windows", {"seed": seed, "buckets": buckets}, counts)
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{to}/manifest")
    return counts


def corpus_statistics(windows: DataFrame) -> dict[str, DataFrame]:
    """Sentences and characters by bucket, windows by split, labels, and windows for each document."""
    return {
        "sentences": corpus.summary(windows, ["length_bucket"], "sentence_count"),
        "characters": corpus.summary(windows.withColumn("characters", F.length("text")), ["length_bucket"], "characters"),
        "entities": windows.groupBy("length_bucket").agg(F.sum(F.size("entities")).alias("entities"), F.count_if(F.size("entities") == 0).alias("without")),
        "splits": windows.groupBy("source_split").agg(F.count("*").alias("windows")),
        "labels": windows.select(F.explode("entities.label").alias("label")).groupBy("label").agg(F.count("*").alias("n")),
        "per_document": corpus.counts_of_counts(windows, "doc_id"),
    }


def validate_corpus(spark: SparkSession, folder: str, buckets: dict = BUCKETS) -> int:
    docs, windows = (spark.read.parquet(f"{folder}/{n}") for n in ("documents", "windows"))
    found = validate.document_violations(docs).unionByName(validate.example_violations(windows, docs, bounds(buckets)))
    validate.require(found)
    return 0


def export_csv(spark: SparkSession, windows: str, to: str) -> None:
    writers.write_flat(spark.read.parquet(windows), to)


def rebuild_from_csv(spark: SparkSession, folder: str, to: str) -> None:
    back, bad = writers.reassembled(*(readers.csv(spark, writers.published(spark, folder, n), s) for n, s in (("examples", readers.EXAMPLES), ("sentences", readers.SENTENCES), ("entities", readers.ENTITIES))))
    validate.require(bad)
    writers.write_lines(back, to)


def inspect(spark: SparkSession, windows: str, n: int = 1, example_id: str | None = None, doc_id: str | None = None, bucket: str | None = None) -> DataFrame:
    """The n-th window, by id, of those that the conditions allow."""
    rows = spark.read.parquet(windows)
    for column, value in (("example_id", example_id), ("doc_id", doc_id), ("length_bucket", bucket)):
        rows = rows.filter(F.col(column) == value) if value is not None else rows
    return rows.orderBy("example_id").offset(int(n) - 1).limit(1)


def select_pilot(spark: SparkSession, windows: str, to: str, per_bucket: int = 5, split: str = "dev", exclude: str | None = None) -> None:
    rows = spark.read.parquet(windows)
    rows = rows if split == "all" else rows.filter(F.col("source_split") == split)
    if exclude:
        rows = rows.join(spark.read.json(exclude).select("doc_id").distinct(), "doc_id", "left_anti")
    own = corpus.pilot(rows, int(per_bucket), list(corpus.BUCKETS))
    if own.count() != int(per_bucket) * len(corpus.BUCKETS):
        raise ValueError("a bucket has too few documents")
    writers.write_lines(own, to)


def study_readiness(spark: SparkSession, windows: str, most_calls: int, target: dict[str, int]) -> None:
    rows = spark.read.parquet(windows)
    planned = rows.agg(F.sum(F.size(sentence_texts(F.col("text"))))).first()[0] or 0
    validate.require(validate.readiness(rows, planned, int(most_calls), target))


def run_batch(spark: SparkSession, windows: str, to: str, provider: Callable, label_names: list[str], config: dict, most_calls: int) -> dict:
    """Sentences of windows through a provider, resumable: what is answered is not asked again."""
    rows = inference.sentences(spark.read.parquet(windows), "example_id", "text")
    template = inference.schema_prompt(label_names)
    words = F.transform("tokens", lambda t: t["text"])
    rows = rows.withColumn("prompt", inference.filled(template, {"tokens": inference.indexed(words), "text": F.col("text")}))
    run = Runner(spark, to, ["example_id", "sentence"], config | {"labels": label_names}, most_calls)
    used = run.attempts().agg(F.max("batch")).first()[0] if run.attempts().columns else None
    run.step(rows, 0 if used is None else used + 1, provider, ["prompt"])
    return run.progress(rows.count())


def predictions_of(run: DataFrame, label_names: list[str]) -> DataFrame:
    """A run's latest replies as predictions by example; an example with a failed sentence is an error."""
    own = inference.structured_entities(run, label_names)
    flat = F.flatten(F.collect_list(F.transform("entities", lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type"), e["start"].alias("start"), e["stop"].alias("end")))))
    return own.groupBy("example_id").agg(F.when(F.count_if(F.col("status") != "ok") > 0, "error").otherwise("ok").alias("status"), F.max("stop").cast("int").alias("processed_char_end"), flat.alias("predictions"), F.count("*").alias("llm_calls"), F.max("batch").alias("seq"))


def evaluate_batch(spark: SparkSession, windows: str, predictions: str, to: str, iterations: int = 2000) -> evaluation.Evaluation:
    """Summary, scores, false positives and negatives, and failures of a batch, each in a folder."""
    own = evaluation.evaluate_batch(spark.read.parquet(windows), readers.jsonl_lenient(spark, predictions, PREDICTIONS), int(iterations))
    parts = {"summary": own.summary, "groups": own.groups, "flexible_groups": own.flexible_groups, "per_example": own.per_example, "false_positives": own.false_positives, "false_negatives": own.false_negatives, "failed_examples": own.failed}
    writers.write_bundle(parts | ({"intervals": own.intervals} if own.intervals is not None else {}), to)
    return own


def build_tickets(spark: SparkSession, source: str, to: str, limit: int = 0) -> None:
    """Tickets with dense ids and their label schema, which is that of all rows, before the limit."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(source).withColumn("__seq", F.monotonically_increasing_id())
    own = labels.clean_tickets(raw, "__seq")
    labels.label_schema(own, ["type", "queue"], "tags").write.mode("overwrite").json(f"{to}/labels")
    kept = readers.first_rows(own, "ticket_id", int(limit))
    writers.write_scores(kept.select("ticket_id", "text", F.col("type").alias("gold_type"), F.col("queue").alias("gold_queue"), F.col("tags").alias("gold_tags")), f"{to}/tickets")


def build_index(spark: SparkSession, vectors: str, to: str) -> dict:
    return writers.write_index(spark.read.parquet(vectors), to)


def query_index(spark: SparkSession, folder: str, vector: list[float], k: int = 5) -> DataFrame:
    """The k tickets most similar to a vector."""
    index = writers.open_index(spark, folder).withColumnRenamed("ticket_id", "vec_id")
    query = spark.createDataFrame([(-1, [float(x) for x in vector])], "vec_id long, embedding array<double>")
    extra = tuple(c for c in ("text", "type", "queue") if c in index.columns)
    return retrieval.top_k(retrieval.normalised(query, "embedding"), index, int(k), extra=extra).orderBy("rank")


def classify_tickets(spark: SparkSession, tickets: DataFrame, schema: dict[str, list[str]], provider: Callable, template: str, to: str, **options) -> None:
    """Candidate tags, a provider's predictions, records, scores and errors."""
    known = labels.tag_frequency(tickets, "gold_tags")
    tags = spark.createDataFrame([(t, i) for i, t in enumerate(schema["tags"])], "tag string, pos int").join(known, "tag", "left")
    short = labels.candidate_tags(tickets, "ticket_id", "text", tags).groupBy("ticket_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]).alias("candidate_tags"))
    own = inference.classify(tickets.join(short, "ticket_id"), provider, template, schema["types"], schema["queues"], schema["tags"], **options)
    records = own.select("ticket_id", F.lit("classify").alias("method"), F.col("reply.model_id").alias("model"), "text", F.struct(F.col("gold_type").alias("type"), F.col("gold_queue").alias("queue"), F.col("gold_tags").alias("tags")).alias("gold"), F.struct("type", "queue", "tags").alias("prediction"), "all_json_valid", "has_invalid_labels", F.col("reply.error").alias("error"))
    records.write.mode("overwrite").json(f"{to}/records")
    back = spark.read.schema(records.schema).json(f"{to}/records")
    writers.write_scores(scoring.classification_scorecard(back), f"{to}/scores")
    writers.write_scores(scoring.classification_errors(back), f"{to}/errors")


def compare_scores(spark: SparkSession, paths: list[str], by: str) -> DataFrame:
    return scoring.leaderboard([spark.read.option("header", True).option("inferSchema", True).csv(p) for p in paths], by)


def build_location_eval(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """Sentences with a location in them, from printed token and tag arrays; the first of them by id, as many as the limit."""
    own = rows.select("id", parse_string_array(F.col("tokens")).alias("tokens"), parse_int_array(F.col("ner_tags")).alias("tags"))
    validate.require(validate.violations(own, "id", {"length": F.size("tokens") != F.size("tags")}))
    flat = own.select("id", F.posexplode(F.arrays_zip("tokens", "tags")).alias("i", "t")).select("id", "i", F.col("t.tokens").alias("token"), F.col("t.tags").alias("tag"))
    spans = tag_runs(flat, ["id"], ["i"], "token", "tag", only=LOCATION).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "text"))).alias("gold_entities"))
    out = own.join(spans, "id").select("id", F.array_join("tokens", " ").alias("sentence"), "tokens", "gold_entities")
    return readers.first_rows(out, "id", limit)


def few_shot_examples(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first rows by id, of a thousand, whose tags fit their tokens and have a location."""
    head = readers.first_rows(rows, "id").filter(F.size(parse_string_array(F.col("tokens"))) == F.size(parse_int_array(F.col("ner_tags"))))
    return build_location_eval(head, n)


def extract(spark: SparkSession, rows: DataFrame, provider: Callable, template: str, types: list[str], to: str, freeform: bool = False) -> None:
    """Extraction from sentences: records, and their scores. rows: id, text, tokens (structs with offsets) and gold spans."""
    asked = inference.call(rows.withColumn("prompt", inference.filled(template, {"tokens": inference.indexed(F.transform("tokens", lambda t: t["text"])), "text": F.col("text")})), provider, ["prompt"])
    own = (inference.freeform_entities if freeform else inference.structured_entities)(asked, types)
    spans = F.transform("entities", lambda e: F.struct(e["text"].alias("text"), e["start"].alias("start"), e["stop"].alias("stop"), e["type"].alias("type")))
    records = own.select("id", F.lit("freeform" if freeform else "structured").alias("method"), F.col("reply.model_id").alias("model"), "gold", spans.alias("prediction"), F.col("json_valid").alias("all_json_valid"), F.lit(freeform).alias("not_applicable"), (F.size("rejected") > 0).alias("has_invalid_labels"), F.col("reply.error").alias("error"))
    records.write.mode("overwrite").json(f"{to}/records")
    writers.write_scores(scoring.extraction_scorecard(spark.read.schema(records.schema).json(f"{to}/records")), f"{to}/scores")


JOBS = {f.__name__: f for f in (prepare_corpus, validate_corpus, export_csv, rebuild_from_csv, inspect, select_pilot, study_readiness, evaluate_batch, build_tickets, build_index, writers.parquet_to_csv)}


def main(args: list[str]) -> None:
    from ..runtime import ensure_workers

    spark = SparkSession.builder.getOrCreate()
    ensure_workers(spark)
    out = JOBS[args[0]](spark, **dict(a.split("=", 1) for a in args[1:]))
    print(out.toJSON().collect() if isinstance(out, DataFrame) else json.dumps(out, default=str))


if __name__ == "__main__":
    main(sys.argv[1:])
