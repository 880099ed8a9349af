"""Model calls as DataFrame stages. A provider answers requests; everything before and after is relational.

A provider is any object with ``answer(request: dict) -> dict``; it gives text, model_id, token counts and, if it can,
token probabilities. ``TableProvider`` answers from a table of replies by the prompt's hash, so that runs need no network.
Calls are at least once: a task that runs again asks again, which the attempts table of ``streaming.runner`` records.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import fold, object_slice, strict_json, strip_fences
from . import parsing, retrieval, votes
from .tokens import indexed, split_sentences, span_of, tokenize

REPLY = "text string, model_id string, input_tokens long, output_tokens long, usage_reported boolean, logprobs array<struct<token:string,logprob:double>>, attempts int, error string"
RETRY = ("timeout", "rate", "temporar", "unavailable", "connection")
OPTIONAL = ("logprobs", "seed")


class Provider(Protocol):
    def answer(self, request: dict) -> dict: ...


def is_json(text: str | None) -> bool:
    """Whether a reply without its fences is JSON to the last character."""
    try:
        json.loads(re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", (text or "").strip(), flags=re.IGNORECASE)))
    except ValueError:
        return False
    return True


def asked(provider: Provider, request: dict, tries: int = 3, wait: float = 0.0, accept: Callable[[str | None], bool] | None = None) -> dict:
    """One answer: errors that may pass are tried again after a growing wait; parameters that a model refuses are dropped;
    an answer that is not accepted is asked for again, and the last one stands."""
    request = dict(request)
    for attempt in range(1, tries + 1):
        try:
            out = provider.answer(request)
            if accept and attempt < tries and not accept(out.get("text")):
                continue
            usage = out.get("input_tokens") is not None and out.get("output_tokens") is not None
            return {"text": out.get("text"), "model_id": out.get("model_id"), "input_tokens": out.get("input_tokens"), "output_tokens": out.get("output_tokens"), "usage_reported": usage, "logprobs": out.get("logprobs") or [], "attempts": attempt, "error": None}
        except Exception as error:  # noqa: BLE001  a failed row is a row with an error
            said = str(error)
            refused = [k for k in OPTIONAL if request.get(k) is not None and k in said]
            for k in refused:
                request.pop(k)
            if attempt == tries or not (refused or any(word in said.lower() for word in RETRY)):
                return {"text": None, "model_id": None, "input_tokens": None, "output_tokens": None, "usage_reported": False, "logprobs": [], "attempts": attempt, "error": f"{type(error).__name__}: {said}"}
            if not refused:
                time.sleep(wait * attempt)
    raise AssertionError


def call(rows: DataFrame, provider: Callable[[], Provider], columns: list[str], tries: int = 3, wait: float = 0.0, accept: Callable[[str | None], bool] | None = None) -> DataFrame:
    """rows with a struct column reply. columns go to the provider; provider() makes one for each task."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = provider()
        for whole in batches:
            for at in range(0, len(whole), 512):  # replies are many times the bytes of their requests as Python's objects
                batch = whole.iloc[at : at + 512].reset_index(drop=True)
                requests = [{k: None if v is None or v != v else v for k, v in r.items()} for r in batch[columns].to_dict("records")]  # pandas has nulls as NaN
                batch["reply"] = [asked(own, request, tries, wait, accept) for request in requests]
                yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(part, f"{fields}, reply struct<{_ddl(REPLY)}>")


def _ddl(fields: str) -> str:
    return re.sub(r"(\w+) ((?:array<.*?>>)|\w+)(?:, )?", r"\1:\2,", fields).rstrip(",")


def from_table(rows: DataFrame, prompt: str, replies: DataFrame) -> DataFrame:
    """The offline provider as a join: replies has prompt_sha256 and the reply's columns."""
    own = replies.select("prompt_sha256", F.struct(*(c for c in replies.columns if c != "prompt_sha256")).alias("reply"))
    return rows.withColumn("prompt_sha256", F.sha2(prompt, 256)).join(own, "prompt_sha256", "left")


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} places; {{ and }} stand for braces."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.lit(m[0][0]) if m[1] is None else values[m[1]])
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


RULES = "Copy each span from the text as it stands and give no span that the text does not hold. If there is none, reply with an empty list."


def schema_prompt(labels: list[str], descriptions: dict[str, str] | None = None, domain: str = "", dataset: str = "") -> str:
    """A prompt for extraction built from a label schema: what the texts are, each label with what it means, the rules and
    the reply's form."""
    seen = list(dict.fromkeys(label.strip() for label in labels if label.strip()))
    lines = [f"- {label}" + (f": {descriptions[label]}" if descriptions and label in descriptions else "") for label in seen]
    about = " ".join(x for x in (f"The texts are from {dataset}." if dataset else "", domain.strip()) if x)
    body = (about + "\n" if about else "") + "Mark every span of these types:\n" + "\n".join(lines) + f"\n{RULES}"
    return body.replace("{", "{{").replace("}", "}}") + '\nReply with JSON: {{"entities": [{{"text": "", "type": "", "start": 0, "end": 0}}]}}, inclusive token numbers.\n\n{tokens}'


def routing_prompt(departments: list[str], guidance: str = "") -> str:
    """A prompt that asks for one of the departments and for evidence in the text's own words."""
    body = "Choose one department:\n" + "\n".join(f"- {d}" for d in dict.fromkeys(departments)) + (f"\n{guidance.strip()}" if guidance.strip() else "")
    body += "\nUse a name from the list and none of your own. The evidence is a passage of the text, word for word."
    return body.replace("{", "{{").replace("}", "}}") + '\nReply with JSON: {{"department": "", "evidence": ""}}.\n\n{text}'


def few_shot(examples: Column, structured: bool = True) -> Column:
    """Worked examples for a prompt. examples: array of structs with text and entities (text, type, start, stop)."""
    entity = lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type"), e["start"].alias("start"), e["stop"].alias("end"))
    as_json = lambda x: F.to_json(F.struct(F.transform(x["entities"], entity).alias("entities")))
    line = lambda e: F.concat_ws(" | ", e["text"], e["type"], e["start"].cast("string"), e["stop"].cast("string"))
    as_lines = lambda x: F.when(F.size(x["entities"]) > 0, F.array_join(F.transform(x["entities"], line), "\n")).otherwise("NONE")
    return F.array_join(F.transform(examples, lambda x: F.concat(F.lit("Text: "), x["text"], F.lit("\nAnswer:\n"), (as_json if structured else as_lines)(x))), "\n\n")


ENTITIES = "entities array<struct<text:string,type:string,start:int,end:int>>"


def parsed(reply: Column, schema: str) -> tuple[Column, Column]:
    """The reply read by a schema, and whether it is JSON to the last character."""
    body = strip_fences(reply)
    return F.from_json(body, schema), F.coalesce(strict_json(body)["valid"], F.lit(False))


def structured_entities(rows: DataFrame, labels: list[str]) -> DataFrame:
    """json_valid, entities and rejects of sentences with a reply. rows: tokens (structs with text, start, stop in the
    document) and reply. Offsets become characters of the document; blank texts are read from the tokens."""
    read, valid = parsed(F.col("reply.text"), ENTITIES)
    given = F.coalesce(F.when(F.col("json_valid"), F.col("__read.entities")), F.from_json(F.lit("[]"), "array<struct<text:string,type:string,start:int,end:int>>"))
    return _checked(rows.withColumn("__read", read).withColumn("json_valid", F.when(F.col("reply.error").isNull(), valid)).withColumn("__e", given).drop("__read"), labels)


def _checked(own: DataFrame, labels: list[str]) -> DataFrame:
    """entities and rejected of the entities that a reply gives (__e: text, type, start, end)."""
    words = F.transform("tokens", lambda t: t["text"])

    def one(e):
        kind = parsing.matched_label(e["type"], labels)
        entity = F.struct(e["text"].alias("text"), F.coalesce(kind, F.lit("")).alias("type"), e["start"].alias("start"), e["end"].alias("stop"))
        reasons = parsing.entity_reasons(entity, words, F.array(*map(F.lit, labels)), check_text=False)
        span = span_of(F.col("tokens"), e["start"], e["end"])
        text = F.when(F.trim(F.coalesce(e["text"], F.lit(""))) != "", F.trim(e["text"])).otherwise(F.array_join(F.slice(words, F.greatest(F.coalesce(e["start"], F.lit(0)), F.lit(0)) + 1, F.greatest(F.coalesce(e["end"] - e["start"], F.lit(0)) + 1, F.lit(0))), " "))
        return F.struct(text.alias("text"), kind.alias("type"), span["start"].alias("start"), span["stop"].alias("stop"), reasons.alias("reasons"))

    own = own.withColumn("__all", F.transform("__e", one))
    return own.withColumn("entities", F.filter("__all", lambda e: F.size(e["reasons"]) == 0)).withColumn("rejected", F.filter("__all", lambda e: F.size(e["reasons"]) > 0)).drop("__e", "__all")


def freeform_entities(rows: DataFrame, labels: list[str]) -> DataFrame:
    """As ``structured_entities`` for replies of lines; json_valid does not apply."""
    own = rows.withColumn("__lines", parsing.freeform(F.col("reply.text"), with_type=True))
    good = F.transform(F.filter("__lines", lambda x: x["reason"].isNull()), lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"), x["start"].alias("start"), x["stop"].alias("end")))
    own = own.withColumn("__e", F.when(F.col("reply.error").isNull(), good).otherwise(F.array().cast("array<struct<text:string,type:string,start:int,end:int>>")))
    return _checked(own, labels).withColumn("json_valid", F.lit(None).cast("boolean")).withColumn("malformed", F.filter("__lines", lambda x: x["reason"].isNotNull())).drop("__lines")


def first_valid(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of several attempts the first whose JSON is valid, else the last. rows: key, attempt, json_valid and others."""
    rest = [c for c in rows.columns if c not in key]
    order = F.struct(F.coalesce(F.col("json_valid"), F.lit(True)).cast("int"), F.when(F.coalesce(F.col("json_valid"), F.lit(True)), -F.col("attempt")).otherwise(F.col("attempt")))
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def verified(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The second step's entities where its JSON is valid, else the first's, and what was added and removed."""
    own = first.select(key, F.col("entities").alias("__a")).join(second.select(key, F.col("entities").alias("__b"), F.col("json_valid").alias("__ok")), key, "left")
    chosen = F.when(F.coalesce("__ok", F.lit(False)), F.col("__b")).otherwise(F.col("__a"))
    keys = lambda c: F.transform(F.coalesce(c, F.array()), lambda e: F.struct(e["text"], e["start"], e["stop"]))
    own = own.withColumn("entities", chosen)
    return own.select(key, "entities", F.array_except(keys(F.col("entities")), keys(F.col("__a"))).alias("added"), F.array_except(keys(F.col("__a")), keys(F.col("entities"))).alias("removed"))


def passes(spark, estimator: str, models: list[str], k: int = 3) -> DataFrame:
    """run, pos, model, seed and logprobs of the calls that an estimator needs for each sentence."""
    if estimator == "self_consistency":
        rows = [(f"run {i + 1}", i, models[0], 1000 + i, False) for i in range(max(2, k))]
    elif estimator == "model_agreement":
        if len(set(models)) < 2:
            raise ValueError("agreement needs two models")
        rows = [(m, i, m, None, False) for i, m in enumerate(dict.fromkeys(models))]
    elif estimator in ("none", "logprob"):
        rows = [("run 1", 0, models[0], None, estimator == "logprob")]
    else:
        raise ValueError(f"unknown estimator {estimator}")
    return spark.createDataFrame(rows, "run string, pos int, model string, seed int, logprobs boolean")


def sentences(docs: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """A row for each sentence with its tokens (offsets in the document)."""
    own = docs.select(key, split_sentences(text).alias("__s"))
    own = own.select(key, F.size("__s").alias("total_sentences"), F.posexplode("__s" if most is None else F.slice("__s", 1, most)).alias("sentence", "s"))
    own = own.withColumn("tokens", tokenize("s.text"))
    shifted = F.transform("tokens", lambda t: F.struct(t["text"].alias("text"), (t["start"] + F.col("s.start")).alias("start"), (t["stop"] + F.col("s.start")).alias("stop")))
    return own.select(key, "sentence", "total_sentences", F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), shifted.alias("tokens"))


def annotate(docs: DataFrame, key: str, text: str, labels: list[str], plan: DataFrame, provider: Callable[[], Provider], template: str, most: int | None = None) -> DataFrame:
    """Sentences times passes through a provider: entities with confidence by document, and the run's totals.

    One pass is scored by token probabilities (null without them); several by votes.
    """
    own = sentences(docs, key, text, most).join(F.broadcast(plan))  # a few passes
    own = own.withColumn("prompt", filled(template, {"tokens": indexed(F.transform("tokens", lambda t: t["text"])), "text": F.col("text")}))
    done = structured_entities(call(own, provider, ["prompt", "model", "seed", "logprobs"]), labels)
    spans = done.select(key, "run", "sentence", F.col("reply.logprobs").alias("lp"), F.explode("entities").alias("e")).select(key, "run", "lp", "e.text", "e.type", "e.start", "e.stop")
    if plan.count() == 1:
        scored = spans.dropDuplicates([key, "start", "stop", "type"]).withColumn("confidence", votes.logprob_confidence(F.col("lp"), F.col("text"))).withColumn("voters", F.array(F.col("run"))).drop("lp", "run")
    else:
        scored = votes.aggregate_votes(spans.drop("lp"), plan.select("run", "pos"), [key]).select(key, "text", "type", "start", "stop", "confidence", "voters")
    entities = scored.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "type", "text", "confidence", "voters"))).alias("entities"))
    totals = done.groupBy(key).agg(
        F.count("*").alias("llm_calls"), F.sum(F.coalesce("reply.input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("reply.output_tokens", F.lit(0))).alias("output_tokens"), F.bool_and("reply.usage_reported").alias("usage_reported"),
        F.count_if(~F.coalesce("json_valid", F.lit(True))).alias("invalid_responses"), F.count_if(F.col("reply.error").isNotNull()).alias("failed_calls"), F.max("stop").alias("processed_char_end"), F.countDistinct("sentence").alias("processed_sentences"), F.max("total_sentences").alias("total_sentences"),
    )
    return totals.join(entities, key, "left")


def classify(tickets: DataFrame, provider: Callable[[], Provider], template: str, types: list[str], queues: list[str], tags: list[str], top_k: int | None = None, steps: int = 1, second: str | None = None) -> DataFrame:
    """Zero- or few-shot classification (the template tells), or two steps in which the second only sees the first's JSON."""
    lit = lambda xs: F.array(*map(F.lit, xs))
    own = tickets.withColumn("prompt", filled(template, {"text": F.col("text"), "types": bullets(lit(types)), "queues": bullets(lit(queues)), "tags": bullets(F.col("candidate_tags") if "candidate_tags" in tickets.columns else lit(tags)), "examples": F.col("examples") if "examples" in tickets.columns else F.lit("")}))
    own = call(own, provider, ["prompt"])
    if steps == 2:
        body = strip_fences(F.col("reply.text"))
        own = own.withColumn("step_1", F.col("reply.text")).withColumn("__ok", F.coalesce(strict_json(body)["valid"], F.lit(False)))
        own = own.withColumn("prompt", filled(second, {"evidence": F.when(F.col("__ok"), strict_json(body)["value"]).otherwise(F.lit("{}"))})).drop("reply")
        own = call(own, provider, ["prompt"])
    read, valid = parsed(F.col("reply.text"), "type struct<label:string,evidence:string>, queue struct<label:string,evidence:string>, tags array<struct<label:string,evidence:string>>")
    own = own.withColumn("__p", read).withColumn("all_json_valid", valid & (F.col("__ok") if steps == 2 else F.lit(True)))
    own = own.withColumns({f: F.when(F.col("all_json_valid"), F.col(f"__p.{f}")) for f in ("type", "queue", "tags")}).drop("__p", "__ok")
    return parsing.clean_prediction(own, lit(types), lit(queues), lit(tags), F.col("candidate_tags") if "candidate_tags" in tickets.columns else None, top_k)


def examples_from_neighbours(hits: DataFrame, k: int) -> DataFrame:
    """query_id and the text of its nearest labelled tickets, for a prompt. hits: query_id, rank, text, type, queue, tags."""
    line = F.concat(F.lit("Ticket: "), F.left("text", F.lit(180)), F.lit("\nType: "), "type", F.lit("\nQueue: "), "queue", F.lit("\nTags: "), F.array_join("tags", ", "))
    own = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return own.select("query_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("examples"))


def route(tickets: DataFrame, provider: Callable[[], Provider], departments: list[str]) -> DataFrame:
    """Departments by a model: a reply's object, its department in the configured spelling, and evidence that the text has."""
    own = call(tickets.withColumn("prompt", filled(routing_prompt(departments), {"text": F.col("text")})), provider, ["prompt"])
    read = F.from_json(object_slice(strip_fences(F.col("reply.text"))), "department string, evidence string")
    own = own.withColumn("department", read["department"]).withColumn("evidence", F.coalesce(read["evidence"], F.lit("")))
    return parsing.routed(own, departments)


def route_by_neighbours(queries: DataFrame, index: DataFrame, departments: list[str], k: int = 5) -> DataFrame:
    """Departments by a weighted vote of the nearest labelled tickets; query_id, department, confidence, n_hits and status."""
    hits = retrieval.top_k(queries, index, k * retrieval.OVERFETCH, extra=("department",))
    names = parsing.matched_label(F.col("department"), departments)
    hits = retrieval.filtered(hits.withColumn("department", names), F.col("department").isNotNull(), k)
    won = retrieval.weighted_vote(hits, "department").join(hits.groupBy("query_id").agg(F.count("*").alias("n_hits")), "query_id")
    asked_for = queries.select(F.col("vec_id").alias("query_id"))
    return asked_for.join(won, "query_id", "left").withColumn("status", F.when(F.col("department").isNull(), "no_match").otherwise("ok"))


def encoded(rows: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], Any]], dimension: int, to: str = "embedding", batch: int = 32) -> DataFrame:
    """rows with unit vectors of their texts. encoder() loads a function from texts to vectors once for each task; it sees
    ``batch`` texts at a time. Vectors of another shape, not finite or zero fail the query; null counts as empty text."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for rows in batches:
            own = own or encoder()
            texts, found = [x or "" for x in rows.column(text).to_pylist()], []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                vectors = np.asarray(own(some), np.float64)
                if vectors.shape != (len(some), dimension):
                    raise ValueError(f"the encoder gave {vectors.shape} for {(len(some), dimension)}")
                sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
                if not np.isfinite(vectors).all() or not (sizes > 0).all():
                    raise ValueError("the encoder gave vectors that are zero or not finite")
                found.append(vectors / sizes)
            flat = np.concatenate(found).ravel() if found else np.empty(0)
            array = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimension), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*rows.columns, array], [*rows.schema.names, to])

    return rows.mapInArrow(part, StructType([*rows.schema.fields, StructField(to, ArrayType(DoubleType()))]))


def nearest_texts(queries: DataFrame, index: DataFrame, encoder: Callable[[], Callable[[list[str]], Any]], dimension: int, k: int = 5, extra: tuple[str, ...] = ("type", "queue")) -> DataFrame:
    """The k indexed tickets most similar to each text, without those of the same text, ranked. queries: vec_id and text;
    index: vec_id, text, unit vectors in embedding and the extra columns."""
    asked_for = encoded(queries, "text", encoder, dimension)
    hits = retrieval.top_k(asked_for, index, k * retrieval.OVERFETCH, extra=("text", *extra))
    hits = hits.join(queries.select(F.col("vec_id").alias("query_id"), F.col("text").alias("query_text")), "query_id")
    return retrieval.filtered(hits, fold(F.col("query_text")) != fold(F.col("text")), k).drop("query_text")


def classify_by_neighbours(tickets: DataFrame, index: DataFrame, provider: Callable[[], Provider], template: str, types: list[str], queues: list[str], tags: list[str], k: int = 3) -> DataFrame:
    """Classification with retrieved examples: each ticket's nearest labelled tickets whose labels the schema has, written
    into the prompt. tickets: vec_id, text, embedding; index: vec_id, text, embedding, type, queue, tags."""
    hits = retrieval.top_k(tickets, index, k * retrieval.OVERFETCH, extra=("text", "type", "queue", "tags"))
    hits = hits.join(tickets.select(F.col("vec_id").alias("query_id"), F.col("text").alias("query_text")), "query_id")
    allowed = F.col("type").isin(types) & F.col("queue").isin(queues) & (fold(F.col("query_text")) != fold(F.col("text")))
    shown = examples_from_neighbours(retrieval.filtered(hits, allowed, k), k).withColumnRenamed("query_id", "vec_id")
    own = tickets.drop("embedding").join(shown, "vec_id", "left").na.fill("", ["examples"])
    return classify(own, provider, template, types, queues, tags)


@dataclass(frozen=True)
class ModelSource:
    """An endpoint and the models that it offers."""

    key: str
    label: str
    endpoint: str | None
    models: tuple[str, ...]
    has_key: bool = False
    needs_key: bool = True
    logprobs: bool = False

    @property
    def ready(self) -> bool:
        return bool(self.endpoint) and (self.has_key or not self.needs_key)


def model_choices(settings: dict[str, dict]) -> dict[str, tuple[ModelSource, str]]:
    """source:model of each model that can be asked, in the order of the settings."""
    out = {}
    for key, own in settings.items():
        source = ModelSource(key, own.get("label") or key, own.get("endpoint"), tuple(own.get("models") or ()), bool(own.get("api_key")), own.get("needs_key", True), bool(own.get("supports_logprobs")))
        out |= {f"{key}:{model}": (source, model) for model in source.models if source.ready}
    return out


def chosen_model(choices: dict[str, tuple[ModelSource, str]], wanted: str | None) -> tuple[ModelSource, str]:
    """The model of an id, or of a bare name that only one source has; the first one where none is asked for."""
    if not choices:
        raise ValueError("no model can be asked")
    if not wanted:
        return next(iter(choices.values()))
    if wanted in choices:
        return choices[wanted]
    named = [c for c in choices.values() if c[1] == wanted]
    if len(named) != 1:
        raise ValueError(f"{'several sources have' if named else 'no source has'} the model {wanted}")
    return named[0]


def extract(rows: DataFrame, provider: Callable[[], Provider], template: str, labels: list[str], freeform: bool = False, tries: int = 2) -> DataFrame:
    """Entities of rows (id, text, tokens, and examples if the template has them): the first reply of up to ``tries`` whose
    JSON is valid, else the last; free-form replies are asked for once."""
    words = F.transform("tokens", lambda t: t["text"])
    values = {"tokens": indexed(words), "text": F.col("text"), "examples": F.col("examples") if "examples" in rows.columns else F.lit("")}
    values |= {c: F.col(c) for c in rows.columns if c not in values}
    own = rows.withColumn("prompt", filled(template, values))
    if freeform:
        return freeform_entities(call(own, provider, ["prompt"]), labels)
    return structured_entities(call(own, provider, ["prompt"], tries, accept=is_json), labels)


def extract_verified(rows: DataFrame, provider: Callable[[], Provider], template: str, second: str, labels: list[str]) -> DataFrame:
    """Two steps: a second prompt sees the first's entities as JSON and replaces them where its own JSON is valid."""
    first = extract(rows, provider, template, labels)
    again = first.select("id", "text", "tokens", F.to_json(F.struct("entities")).alias("entities_json"))
    return verified(first, extract(again, provider, second, labels), "id")


#: Methods by name: what each needs is a template, labels (or a ticket schema) and a provider.
CLASSIFIERS: dict[str, Callable[..., DataFrame]] = {"zero_shot": classify, "few_shot": classify, "agent": partial(classify, steps=2), "neighbours": classify_by_neighbours}
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {"zero_shot_structured": extract, "few_shot_structured": extract, "zero_shot_freeform": partial(extract, freeform=True), "few_shot_freeform": partial(extract, freeform=True), "verified": extract_verified}


def method(kind: str, name: str) -> Callable[..., DataFrame]:
    """The classifier or extractor of a name."""
    known = {"classification": CLASSIFIERS, "extraction": EXTRACTORS}[kind]
    if name not in known:
        raise ValueError(f"unknown method {name}; there are {', '.join(known)}")
    return known[name]
