"""Queries on documents as records, windows, files, model calls and resumable runs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..operators import corpus, inference, scoring, tokens, validate
from ..runtime import parts_for, scratch, table, written
from ..sources import readers, writers
from ..streaming import runner
from .scoring_queries import _strict_counts
from .text_queries import BOUNDS, SENTENCES, TOKENS, _Q


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw records: one sentence and section each, and their first two words as an entity."""
    own = table(spark, sf, "documents").select("doc_id", "text")
    # what a task hands to Python at once is many times its texts, so parts have so many documents at any size of the files
    own = own.repartition(parts_for(own.count(), spark, 2_000), "doc_id")
    own = own.select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 3).cast("string").alias("source_split"), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("words"))
    n = F.size("words")
    whole = F.when(n > 0, F.array(F.array(F.lit(0), n))).otherwise(F.array().cast("array<array<int>>"))
    return own.select("doc_id", "source_split", "words", whole.alias("sentences"), whole.alias("sections"), F.when(n > 1, F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("stop"), F.lit("Task").alias("label")))).otherwise(F.array().cast("array<struct<start:int,stop:int,label:string>>")).alias("ner"))


def document_records(spark, sf):
    """TOK-06, TOK-07, TOK-08: documents normalised with offsets."""
    own = corpus.documents(_raw(spark, sf))
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), "token_count", F.md5("text").alias("digest"), F.get("entities", F.lit(0))["text"].alias("entity"), F.get("sentences", F.lit(0))["end_char"].alias("length"))


DOCUMENTS_SQL = f"""with g as (select doc_id, {TOKENS} t from documents), u as (select doc_id, i, t[i] tok, t[i - 1] prev from (select doc_id, t, unnest(range(1, len(t) + 1)) i from g)),
s as (select *, case when i = 1 or tok in ({_Q(tokens.NO_BLANK_BEFORE + tokens.JOINS + tokens.SUFFIXES)}) or prev in ({_Q(tokens.NO_BLANK_AFTER + tokens.JOINS)}) or starts_with(tok, '''') then '' else ' ' end sep from u),
d as (select doc_id, count(*)::integer token_count, string_agg(sep || tok, '' order by i) x, case when count(*) > 1 then string_agg(sep || tok, '' order by i) filter (i <= 2) end entity from s group by doc_id)
select doc_id, token_count, md5(x) digest, entity, length(x)::integer as length from d"""


def document_violations(spark, sf):
    """VAL-06, VAL-08: normalised documents break only the rules that faults planted in them break."""
    own = corpus.documents(_raw(spark, sf))
    n = F.col("doc_id").cast("long")
    moved = F.transform("sentences", lambda x: x.withField("end_char", x["end_char"] + F.lit(1)))
    own = own.withColumn("token_count", F.when(n % 10 == 3, F.col("token_count") + 1).otherwise(F.col("token_count"))).withColumn("sentences", F.when(n % 7 == 2, moved).otherwise(F.col("sentences")))
    return validate.document_violations(own).groupBy("rule").agg(F.count("*").alias("violations"), F.sum(F.col("key").cast("long")).alias("keys"))


def _sentences(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """Documents, all or only some, with their sentences as spans, for windows over them."""
    own = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", (F.col("doc_id") % 3).cast("string").alias("source_split"))
    own = own if only is None else own.join(F.broadcast(only), "doc_id", "left_semi")
    own = own.withColumn("s", tokens.split_sentences("text"))
    ends = F.transform("s", lambda x, i: F.struct(i.alias("sentence_index"), i.alias("token_start"), (i + 1).alias("token_end_exclusive"), x["start"].alias("start_char"), x["stop"].alias("end_char"), x["text"].alias("text")))
    section = F.array(F.struct(F.lit(0).alias("section_index"), F.lit(1).alias("token_start"), F.size("s").alias("token_end_exclusive"), F.lit(0).alias("start_char"), F.length("text").alias("end_char")))
    entities = F.filter(F.transform("s", lambda x, i: F.struct(F.format_string("%s__entity_%06d", F.col("doc_id"), i).alias("entity_id"), F.lit("Task").alias("label"), x["text"].alias("text"), i.alias("token_start"), (i + 1).alias("token_end_exclusive"), x["start"].alias("start_char"), x["stop"].alias("end_char"))), lambda e: e["token_start"] % 2 == 0)
    return own.select("doc_id", "source_split", "text", F.size("s").alias("token_count"), F.size("s").alias("sentence_count"), ends.alias("sentences"), section.alias("sections"), entities.alias("entities"))


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    """A window over sentences two to four of each document that has them."""
    docs = _sentences(spark, sf)
    plan = docs.filter("sentence_count >= 4").select("doc_id", F.lit("short").alias("bucket"), F.lit(1).alias("sentence_start"), F.lit(4).alias("sentence_stop"))
    return corpus.windows(docs, plan)


def window_records(spark, sf):
    """RNK-11, JON-04, JON-05: windows with their sentences, entities and sections."""
    own = _windows(spark, sf)
    return own.select("example_id", F.md5("text").alias("digest"), F.size("sentences").alias("n_sentences"), F.size("entities").alias("n_entities"), F.get("sections", F.lit(0))["clipped_by_window"].alias("clipped"), F.get("sentences", F.lit(2))["end_char"].alias("length"))


def window_violations(spark, sf):
    """VAL-07: windows agree with their documents but for the faults planted in them."""
    bounds = {name: (low, high) for name, low, high in BOUNDS}
    n = F.col("doc_id").cast("long")
    own = _windows(spark, sf).withColumn("source_split", F.when(n % 10 == 3, "x").otherwise(F.col("source_split"))).withColumn("text", F.when(n % 7 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("length_bucket", F.when(n % 6 == 1, "long").otherwise(F.col("length_bucket")))
    own, docs = written(own, "windows"), written(_sentences(spark, sf), "documents")  # checks read their input several times
    return validate.example_violations(own, docs, bounds).groupBy("rule").agg(F.count("*").alias("violations"))


def flatten_roundtrip(spark, sf):
    """SNK-03, SNK-04, SRC-08: windows written as three tables, read and put together again."""
    to = scratch(spark, "flat")
    windows = _windows(spark, sf)
    for name, rows in writers.flattened(windows).items():
        rows.write.parquet(f"{to}/{name}")
    back, bad = writers.reassembled(*(spark.read.parquet(f"{to}/{n}") for n in ("examples", "sentences", "entities")))
    found = back.agg(F.count("*").alias("windows"), F.sum(F.size("sentences")).alias("sentences"), F.sum(F.coalesce(F.size("entities"), F.lit(0))).alias("entities"), F.sum(F.length("text")).alias("characters"))
    return found.join(F.broadcast(bad.agg(F.count("*").alias("violations"))))


def window_sample(spark, sf):
    """RNK-10: a seeded sample of windows; only ids and sentence counts reach the driver."""
    docs = table(spark, sf, "documents")
    counts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), tokens.sentence_count(F.col("text")).alias("n"))
    found = counts.toArrow().sort_by("doc_id")  # sorted here, as Spark would count twice to find its ranges
    lengths = list(zip(*(found[c].to_pylist() for c in ("doc_id", "n")), strict=True))
    buckets = {name: {"min_sentences": low, "max_sentences": high, "target": 5} for name, low, high in BOUNDS}
    plan = corpus.sample_plan(lengths, buckets)
    plan = F.broadcast(spark.createDataFrame(plan, "doc_id string, bucket string, sentence_start int, sentence_stop int"))  # a few windows; only their documents are split
    return corpus.windows(_sentences(spark, sf, plan.select("doc_id").distinct()), plan).select("example_id", "length_bucket", "sentence_count", F.md5("text").alias("digest"))


def bootstrap_exact(spark, sf):
    """AGG-15 with the draws of Python's generator."""
    counts = _strict_counts(spark, sf, (F.col("example") % 50).alias("number"))
    return scoring.bootstrap(counts, scoring.exact_draws(spark, 50, 200), 200)


def jsonl_roundtrip(spark, sf):
    """SNK-01, SNK-02, SRC-03: canonical lines by split, read strictly."""
    to = scratch(spark, "lines")
    writers.write_lines(table(spark, sf, "customer").withColumn("split", F.col("c_custkey") % 3), to, "split")
    back = readers.jsonl(spark, to, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.max("c_name").alias("last"))


def csv_roundtrip(spark, sf):
    """SNK-06, SNK-13, SRC-06: texts with line ends and quotes through CSV."""
    to = scratch(spark, "csv")
    writers.write_scores(table(spark, sf, "conversations").withColumn("parts", F.split("text", " ")).select("conv_id", "turn", "role", "text", F.size("parts").alias("n")), to)
    back = readers.csv(spark, to, "conv_id long, turn long, role string, text string, n int")
    return back.select("conv_id", "turn", F.md5("text").alias("digest"), "n")


def vector_index_roundtrip(spark, sf):
    """SNK-08, SNK-09, SRC-15: a written index passes its checks."""
    to = scratch(spark, "index")
    writers.write_index(table(spark, sf, "embeddings"), to, "vec_id")
    return writers.open_index(spark, to, "vec_id").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"), F.round(F.sum(F.element_at("embedding", 1) * F.col("vec_id")), 6).alias("first"), F.round(F.sum(F.element_at("embedding", -1) * F.col("vec_id")), 6).alias("last"))


def budget_admission(spark, sf):
    """STM-04: rows in order while their running cost lasts."""
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 7 + 1).alias("cost"))
    return runner.admitted(rows, ["event_id"], "cost", 20_000).select("event_id", "running")


class Echo:
    """A provider without a network: entities are the capitalised tokens of the prompt, some of them by seed."""

    def answer(self, request: dict) -> dict:
        found = [(int(i), t) for i, t in re.findall(r"^(\d+): (\S+)$", request["prompt"], re.M)]
        keep = int(request.get("seed") or 0) % 3 + 1
        own = [{"text": t, "type": "LOC", "start": i, "end": i} for i, t in found if t[:1].isupper() and (i + len(t)) % (keep + 1)]
        return {"text": "```json\n" + json.dumps({"entities": own}) + "\n```", "model_id": "echo", "input_tokens": len(found), "output_tokens": 2 * len(own)}


def stub_llm_pipeline(spark, sf):
    """LLM-02, LLM-12 to LLM-15, LLM-20: sentences times passes through a provider, parsed, checked and voted on."""
    own = inference.annotate(table(spark, sf, "benchmark"), "item_id", "text", ["LOC"], inference.passes(spark, "self_consistency", ["echo"]), Echo, inference.schema_prompt(["LOC"]))
    return own.select("item_id", "llm_calls", "input_tokens", "output_tokens", "processed_sentences", F.size("entities").alias("n_entities"), F.aggregate("entities", F.lit(0.0), lambda s, e: s + e["confidence"]).alias("confidence"))


class Props:
    """Answers with the number that a JSON prompt holds."""

    def answer(self, request: dict) -> dict:
        return {"text": str(json.loads(request["props"])["k"]), "model_id": "props", "input_tokens": 1, "output_tokens": 1}


def resume_stream(spark, sf):
    """STM-02 to STM-04, STM-06: a run over a stream of files, with attempts written before the calls; the latest results."""
    own = table(spark, sf, "events").select("event_id", "props")
    source = scratch(spark, "requests")
    own.write.parquet(source)
    run = runner.Runner(spark, scratch(spark, "run"), ["event_id"], {"method": "props", "model": "none"}, own.count())
    run.stream(source, own.schema, Props, ["props"], files_per_batch=1000)
    return run.latest().select("event_id", "status", F.col("reply.text").try_cast("int").alias("k"))


def vote_windows(spark, sf):
    """Votes for each type in windows of a day (beyond the batch operators)."""
    own = runner.windowed_votes(table(spark, sf, "events"), width="1 day")
    return own.select(F.col("window.start").alias("day"), "event_type", "votes", "mean")


QUERIES = {f.__name__: f for f in (document_records, document_violations, window_records, window_violations, flatten_roundtrip, window_sample, bootstrap_exact, jsonl_roundtrip, csv_roundtrip, vector_index_roundtrip, budget_admission, stub_llm_pipeline, resume_stream, vote_windows)}

ORACLE_SQL = {
    "document_records": DOCUMENTS_SQL,
    "document_violations": f"""with d as (select doc_id from documents where len({TOKENS}) > 0), v as (select 'token_count' r, doc_id from d where doc_id % 10 = 3 union all select 'sentences_boundary', doc_id from d where doc_id % 7 = 2) select r as "rule", count(*) violations, sum(doc_id)::bigint "keys" from v group by 1""",
    "window_violations": f"""with d as (select doc_id n from documents where len({SENTENCES}) >= 4) select 'split' as "rule", count(*) violations from d where n % 10 = 3 union all select 'window_text', count(*) from d where n % 7 = 2 union all select 'bucket', count(*) from d where n % 6 = 1""",
    "jsonl_roundtrip": "select c_mktsegment, count(*) n, sum(c_custkey)::bigint \"keys\", max(c_name) \"last\" from customer group by 1",
    "csv_roundtrip": "select conv_id, turn, md5(text) digest, len(string_split(text, ' '))::integer n from conversations",
    "vector_index_roundtrip": """with e as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings), u as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) s from e) select count(*) n, sum(vec_id)::bigint ids, round(sum(v[1] / s * vec_id), 6) "first", round(sum(v[-1] / s * vec_id), 6) "last" from u""",
    "budget_admission": "with e as (select event_id, sum(event_id % 7 + 1) over (order by event_id) running from events) select event_id, running::bigint running from e where running <= 20000",
    "resume_stream": "select event_id, 'ok' status, (props->>'$.k')::integer k from events",
    "vote_windows": "select date_trunc('day', ts) as day, event_type, count(*) votes, avg(value) mean from events group by 1, 2",
}
