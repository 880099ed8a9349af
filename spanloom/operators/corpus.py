"""Corpus preparation: raw records to documents, sentence windows by length, samplers and statistics."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import slice_text
from .tokens import laid_out

BUCKETS = ("short", "medium", "long", "very_long")


def length_bucket(n: Column, bounds: list[tuple[str, int, int | None]]) -> Column:
    """The first bucket whose bounds hold the count, both included; the last may be open."""
    out = None
    for name, low, high in bounds:
        own = (n >= low) & ((n <= high) if high is not None else F.lit(True))
        out = F.when(own, name) if out is None else out.when(own, name)
    return out


def documents(raw: DataFrame) -> DataFrame:
    """doc_id, source_split, text, counts, tokens, sentences, sections and entities of raw records (words, sentences, sections
    and ner as token spans, half-open). Records without words give none. A row is laid out by itself, so nothing is shuffled."""
    own = raw.select("*", F.explode(laid_out("words")).alias("__d")).withColumns({c: F.col(f"__d.{c}") for c in ("text", "tokens")})

    def spans(column: Column, index: str, more=lambda s, i: []):
        def one(s, i):
            start, stop = F.get("tokens", s[0])["start_char"], F.get("tokens", s[1] - 1)["end_char"]
            return F.struct(i.alias(index), s[0].alias("token_start"), s[1].alias("token_end_exclusive"), start.alias("start_char"), stop.alias("end_char"), *more((start, stop), i))

        return F.transform(column, one)

    text = lambda s, i: [slice_text(F.col("text"), s[0], s[1]).alias("text")]
    pair = F.transform("ner", lambda e: F.array(e["start"], e["stop"]))
    named = F.zip_with(spans(pair, "i", text), F.col("ner"), lambda s, e: F.struct(F.format_string("%s__entity_%06d", F.col("doc_id"), s["i"]).alias("entity_id"), e["label"].alias("label"), s["text"].alias("text"), s["token_start"].alias("token_start"), s["token_end_exclusive"].alias("token_end_exclusive"), s["start_char"].alias("start_char"), s["end_char"].alias("end_char")))
    return own.select(
        "doc_id", "source_split", "text", F.size("words").alias("token_count"), F.size("sentences").alias("sentence_count"), F.size("sections").alias("section_count"), F.size("ner").alias("entity_count"),
        "tokens", spans(F.col("sentences"), "sentence_index", text).alias("sentences"), spans(F.col("sections"), "section_index").alias("sections"), named.alias("entities"),
    )


def windows(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The windows of a plan (doc_id, bucket, sentence_start, sentence_stop) with offsets from their start, whole entities
    and cut sections."""
    own = docs.join(plan, "doc_id")
    first, last = F.get("sentences", F.col("sentence_start")), F.get("sentences", F.col("sentence_stop") - 1)
    own = own.withColumns({"__c0": first["start_char"], "__c1": last["end_char"], "__t0": first["token_start"], "__t1": last["token_end_exclusive"]})
    c0, c1, t0, t1 = (F.col(c) for c in ("__c0", "__c1", "__t0", "__t1"))
    chosen = F.slice("sentences", F.col("sentence_start") + 1, F.col("sentence_stop") - F.col("sentence_start"))
    sentences = F.transform(chosen, lambda s, i: F.struct(i.alias("relative_sentence_index"), s["sentence_index"].alias("source_sentence_index"), (s["start_char"] - c0).alias("start_char"), (s["end_char"] - c0).alias("end_char"), s["text"].alias("text")))
    inside = F.filter("entities", lambda e: (e["token_start"] >= t0) & (e["token_end_exclusive"] <= t1))
    entities = F.transform(inside, lambda e: F.struct(e["entity_id"].alias("entity_id"), e["label"].alias("label"), e["text"].alias("text"), (e["start_char"] - c0).alias("start_char"), (e["end_char"] - c0).alias("end_char"), e["token_start"].alias("source_token_start"), e["token_end_exclusive"].alias("source_token_end_exclusive")))
    met = F.filter("sections", lambda s: ~((s["token_end_exclusive"] <= t0) | (s["token_start"] >= t1)))
    sections = F.transform(met, lambda s: F.struct(s["section_index"].alias("source_section_index"), (F.greatest(s["start_char"], c0) - c0).alias("start_char"), (F.least(s["end_char"], c1) - c0).alias("end_char"), s["token_start"].alias("source_token_start"), s["token_end_exclusive"].alias("source_token_end_exclusive"), ((s["start_char"] < c0) | (s["end_char"] > c1)).alias("clipped_by_window")))
    return own.select(
        F.format_string("%s__sent_%06d_%06d", F.col("doc_id").cast("string"), "sentence_start", "sentence_stop").alias("example_id"), "doc_id", "source_split", F.col("bucket").alias("length_bucket"),
        (F.col("sentence_stop") - F.col("sentence_start")).alias("sentence_count"), F.col("sentence_count").alias("source_document_sentence_count"), F.col("sentence_start").alias("source_sentence_start"),
        F.col("sentence_stop").alias("source_sentence_end_exclusive"), t0.alias("source_token_start"), t1.alias("source_token_end_exclusive"), slice_text(F.col("text"), c0, c1).alias("text"),
        sentences.alias("sentences"), sections.alias("sections"), entities.alias("entities"),
    )


def sample_plan(lengths: list[tuple[str, int]], buckets: dict[str, dict], seed: int = 42, most_overlap: float = 0.5) -> list[tuple[str, str, int, int]]:
    """doc_id, bucket, first sentence and end of a seeded sample of windows. Only ids and sentence counts come to the driver,
    since each choice depends on those before; the windows themselves are made from the plan in parallel.

    Longer buckets come first. In each, documents with fewer windows are asked first, in shuffled order; then random ones
    until the target is met. A window may overlap an earlier one of its document by a share of the shorter at most.
    """
    rng, taken, plan = random.Random(seed), defaultdict(list), []

    def fits(doc: str, start: int, stop: int) -> bool:
        return all(max(0, min(stop, b) - max(start, a)) / min(stop - start, b - a) <= most_overlap for a, b in taken[doc])

    def draw(doc: tuple[str, int], low: int, high: int | None, tries: int) -> tuple[int, int] | None:
        longest = low if high is None else min(high, doc[1])
        for _ in range(tries):
            size = rng.randint(low, longest) if longest > low else low
            start = rng.randint(0, doc[1] - size)
            if fits(doc[0], start, start + size):
                return start, start + size
        return None

    for number, bucket in enumerate(reversed(BUCKETS)):
        spec = buckets[bucket]
        low, high, target = spec["min_sentences"], spec.get("max_sentences"), spec["target"]
        eligible = [d for d in lengths if d[1] >= low]
        shuffled = eligible[:]
        random.Random(seed + number).shuffle(shuffled)
        shuffled.sort(key=lambda d: len(taken[d[0]]))
        chosen: set[tuple[str, int, int]] = set()
        queue, tries = iter(shuffled), 0
        while len(chosen) < target:
            doc = next(queue, None)
            if doc is not None:
                found = draw(doc, low, high, 200)
            elif eligible and tries < max(10_000, 100 * target):
                tries += 1
                doc = rng.choice(eligible)
                found = draw(doc, low, high, 20)
            else:
                raise ValueError(f"bucket {bucket}: {len(chosen)} of {target} windows")
            if found and (doc[0], *found) not in chosen:
                chosen.add((doc[0], *found))
                taken[doc[0]].append(found)
                plan.append((doc[0], bucket, *found))
    return plan


def pilot(rows: DataFrame, per_bucket: int, buckets: list[str], bucket: str = "length_bucket", doc: str = "doc_id", key: str = "example_id") -> DataFrame:
    """per_bucket rows of each bucket in turn, by key, no document twice over all buckets."""
    out = None
    for name in buckets:  # a fixed number of steps, each over a bounded choice of documents
        own = rows.filter(F.col(bucket) == name)
        if out is not None:
            own = own.join(F.broadcast(out.select(doc)), doc, "left_anti")  # at most per_bucket rows for each bucket
        firsts = own.groupBy(doc).agg(F.min_by(F.struct(*rows.columns), F.col(key)).alias("r")).select("r.*").orderBy(key).limit(per_bucket)
        out = firsts if out is None else out.unionByName(firsts)
    return out


def smoke_sample(rows: DataFrame, per_bucket: int = 2) -> DataFrame:
    """The first windows of each bucket, no document twice within it."""
    once = W.partitionBy("length_bucket", "doc_id").orderBy("example_id")
    own = rows.withColumn("__i", F.row_number().over(once)).filter("__i = 1")
    return own.withColumn("__i", F.row_number().over(W.partitionBy("length_bucket").orderBy("example_id"))).filter(F.col("__i") <= per_bucket).drop("__i")


def review_sample(rows: DataFrame, per_bucket: int = 8) -> DataFrame:
    """The first windows of each bucket with a preview of 500 characters and of five entities."""
    own = rows.withColumn("__i", F.row_number().over(W.partitionBy("length_bucket").orderBy("example_id"))).filter(F.col("__i") <= per_bucket).drop("__i")
    return own.withColumn("preview", F.left("text", F.lit(500))).withColumn("entities", F.slice("entities", 1, 5))


def summary(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """n, least, largest, mean and exact median."""
    return rows.groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def counts_of_counts(rows: DataFrame, key: str) -> DataFrame:
    """How many keys have so many rows."""
    return rows.groupBy(key).agg(F.count("*").alias("windows")).groupBy("windows").agg(F.count("*").alias("documents"))


#: All that an export may tell of where its example comes from; gold spans are not among it.
TRACE = ("example_id", "doc_id", "source_split", "length_bucket", "sentence_count")


def traceability(windows: DataFrame, dataset: str) -> DataFrame:
    """The columns of TRACE and the dataset's name, by an explicit list, so that what is added to windows never follows."""
    return windows.select(F.lit(dataset).alias("source_dataset"), *TRACE)
