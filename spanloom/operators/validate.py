"""Checks as tables of violations (rule, key, detail); ``require`` raises if there are any."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One pass over the rows: a row for each rule that one breaks."""
    return rows.select(F.explode(_broken(rules)).alias("rule"), F.col(key).cast("string").alias("key"))


def _broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())))


def duplicates(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    own = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return own.select(F.lit(rule).alias("rule"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(found: DataFrame) -> None:
    if first := found.limit(5).collect():
        raise ValueError("; ".join(f"{r.rule}: {r.key}" for r in first))


def bad_span(text: Column, item: Column, check_text: bool = True) -> Column:
    start, stop = item["start_char"], item["end_char"]
    bad = ~((start >= 0) & (start < stop) & (stop <= F.length(text)))
    return F.coalesce(bad | (F.substring(text, start + F.lit(1), stop - start) != item["text"]) if check_text else bad, F.lit(True))


@F.arrow_udf(BooleanType())
def _slices_differ(text: pa.Array, starts: pa.Array, stops: pa.Array, texts: pa.Array) -> pa.Array:
    """Whether some span is out of range or its text is not the slice. Spark's substring walks a text from its start each
    time, which is quadratic over a document's tokens; slices here are not."""
    return _each_slice_differs(text, starts, stops, texts)


def _each_slice_differs(text: pa.Array, starts: pa.Array, stops: pa.Array, texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([_some_slices_differ(*(c.slice(at, 16) for c in (text, starts, stops, texts))) for at in range(0, max(1, len(text)), 16)])  # some rows at a time, as a document has very many spans


def _some_slices_differ(text: pa.Array, starts: pa.Array, stops: pa.Array, texts: pa.Array) -> pa.Array:
    own = text.to_pylist()
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    size = np.array([len(t or "") for t in own], np.int64)
    base, n = np.cumsum(size) - size, pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False)
    row, (a, b) = np.repeat(np.arange(len(own)), n), (c.flatten() for c in (starts, stops))
    bad = pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    i, j = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b))
    bad = bad | ~((i >= 0) & (i < j) & (j <= size[row]))
    if texts.null_count < len(texts):  # rows without an array of texts are not compared
        asked = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)[row])
        words = pc.fill_null(texts.flatten(), "")
        long = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        bad[asked] |= (j - i)[asked] != long
        same = ~bad[asked]
        at, k = asked[same], long[same]
        said = code("".join(words.take(pa.array(np.flatnonzero(same))).to_pylist()))
        place = np.repeat((base[row] + i)[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        bad[np.repeat(at, k)[code("".join(t or "" for t in own))[place] != said]] = True
    return pa.array(np.bincount(row[bad], minlength=len(own)) > 0)


def bad_spans(text: Column, items: Column, check_text: bool = True) -> Column:
    """``bad_span`` for any of an array of spans."""
    return _slices_differ(text, items["start_char"], items["end_char"], items["text"] if check_text else F.lit(None).cast("array<string>"))


def _with_slices(rows: DataFrame, key: str, rules: dict[str, Column], spans: dict[str, tuple[str, bool]]) -> DataFrame:
    """``violations`` of rules, and of rules that a row also breaks if one of an array's spans is no slice of its text, by rule
    the array and whether texts are compared. Rows go to Python once, by column, and leave with a flag for each rule: a function
    of columns would hold the rows that it is asked for, which are many times the bytes of their texts, until it answers."""
    own = [F.col(key).cast("string").alias("key"), _broken(rules).alias("broken"), F.col("text")]
    for i, (column, check_text) in enumerate(spans.values()):
        items = F.col(column)
        own += [items["start_char"].alias(f"a{i}"), items["end_char"].alias(f"b{i}"), (items["text"] if check_text else F.lit(None).cast("array<string>")).alias(f"t{i}")]
    flags = [f"f{i}" for i in range(len(spans))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_each_slice_differs(batch["text"], batch[f"a{i}"], batch[f"b{i}"], batch[f"t{i}"]) for i in range(len(flags))]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["broken"], *found], names=["key", "broken", *flags])

    told = rows.select(*own).mapInArrow(run, "key string, broken array<string>, " + ", ".join(f"{f} boolean" for f in flags))
    return told.select(F.explode(F.array_union("broken", _broken({name: F.col(f) for name, f in zip(spans, flags, strict=True)}))).alias("rule"), "key")


def document_violations(docs: DataFrame) -> DataFrame:
    """Ids, token order, spans in range and sorted, texts equal to their slices, and token and character ends that agree."""
    n = F.col("token_count")

    def edges(column: str, sort: bool):
        items = F.col(column)
        out = F.exists(items, lambda s: ~((s["token_start"] >= 0) & (s["token_start"] < s["token_end_exclusive"]) & (s["token_end_exclusive"] <= n)))
        off = F.exists(items, lambda s: (s["start_char"] != F.get("tokens", s["token_start"])["start_char"]) | (s["end_char"] != F.get("tokens", s["token_end_exclusive"] - 1)["end_char"]))
        unsorted = F.exists(F.transform(items, lambda s, i: (i > 0) & (s["token_start"] < F.get(items, i - 1)["token_start"])), lambda x: F.coalesce(x, F.lit(False)))
        return {f"{column}_range": out, f"{column}_boundary": off} | ({f"{column}_order": unsorted} if sort else {})

    rules = {
        "missing_id": F.col("doc_id").isNull(),
        "token_count": F.size("tokens") != n,
        "token_order": F.when(F.size("tokens") > 0, F.col("tokens")["token_index"] != F.sequence(F.lit(0), F.size("tokens") - 1)),
    }
    rules |= edges("sentences", True) | edges("sections", True) | edges("entities", False)
    slices = {"token_text": ("tokens", True), "sentences_boundary": ("sentences", True), "sections_boundary": ("sections", False), "entities_boundary": ("entities", True)}
    # each id is listed beside the rules that its document breaks, so that ids seen twice are found without reading documents twice
    found = _with_slices(docs, "doc_id", {"duplicate_id": F.lit(True)} | rules, slices).groupBy("rule", "key").agg(F.count("*").alias("n"))
    times = F.when(F.col("rule") == "duplicate_id", F.when(F.col("n") > 1, 1).otherwise(0)).otherwise(F.col("n").cast("int"))
    return found.select("rule", F.when(F.col("rule") == "duplicate_id", F.coalesce("key", F.lit(""))).otherwise(F.col("key")).alias("key"), times.alias("n")).select("rule", F.explode(F.array_repeat("key", F.col("n"))).alias("key"))


def example_violations(examples: DataFrame, docs: DataFrame, bounds: dict[str, tuple[int, int | None]], target: dict[str, int] | None = None, most_overlap: float = 0.5) -> DataFrame:
    """Windows against their documents: known, same split, unique, contiguous, in their bucket, no entity cut, little overlap."""
    from .spans import overlapping_pairs

    source = docs.select("doc_id", F.col("source_split").alias("__split"), F.col("text").alias("__text"), F.col("sentences").alias("__sentences"))
    own = examples.join(source, "doc_id", "left")
    inside = F.lit(False)
    for name, (low, high) in bounds.items():
        inside = inside | ((F.col("length_bucket") == name) & (F.col("sentence_count") >= low) & (F.col("sentence_count") <= (high if high is not None else 2**31 - 1)))
    first, last = F.get("__sentences", F.col("source_sentence_start")), F.get("__sentences", F.col("source_sentence_end_exclusive") - 1)
    rules = {
        "unknown_document": F.col("__text").isNull(),
        "split": F.col("source_split") != F.col("__split"),
        "sentence_count": F.col("sentence_count") != F.size("sentences"),
        "contiguous": F.exists(F.transform("sentences", lambda s, i: s["source_sentence_index"] != F.col("source_sentence_start") + i), lambda x: x),
        "window_text": F.col("text") != F.substring(F.col("__text"), first["start_char"] + F.lit(1), last["end_char"] - first["start_char"]),
        "bucket": ~inside,
        "sentence_span": bad_spans(F.col("text"), F.col("sentences")),
        "entity_span": bad_spans(F.col("text"), F.col("entities")),
        "entity_cut": F.exists("entities", lambda e: ~((e["source_token_start"] >= F.col("source_token_start")) & (e["source_token_start"] < e["source_token_end_exclusive"]) & (e["source_token_end_exclusive"] <= F.col("source_token_end_exclusive")))),
        "section_span": F.exists("sections", lambda s: bad_span(F.col("text"), s, False)),
    }
    spans = examples.select("doc_id", "example_id", F.col("source_sentence_start").alias("start"), F.col("source_sentence_end_exclusive").alias("stop"))
    far = overlapping_pairs(spans, ["doc_id"], "example_id").filter(F.col("ratio") > most_overlap).select(F.lit("overlap").alias("rule"), F.concat_ws("|", "a", "b").alias("key"))
    parts = [duplicates(examples, ["example_id"], "duplicate_example"), duplicates(examples, ["doc_id", "source_sentence_start", "source_sentence_end_exclusive"], "duplicate_window"), violations(own, "example_id", rules), far]
    if target:
        wanted = examples.sparkSession.createDataFrame(list(target.items()), "length_bucket string, wanted long")
        got = wanted.join(examples.groupBy("length_bucket").agg(F.count("*").alias("n")), "length_bucket", "left").filter("coalesce(n, 0) <> wanted")
        parts.append(got.select(F.lit("bucket_count").alias("rule"), F.col("length_bucket").alias("key")))
    return union(*parts)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def split_leaks(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in several splits."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def readiness(examples: DataFrame, planned_calls: int, most_calls: int, target: dict[str, int]) -> DataFrame:
    """A study's manifest against its plan: budget, document isolation over splits, and balance of buckets."""
    spark = examples.sparkSession
    parts = [split_leaks(examples, "doc_id", "source_split").select(F.lit("split_leak").alias("rule"), F.col("doc_id").cast("string").alias("key"))]
    wanted = spark.createDataFrame(list(target.items()), "length_bucket string, wanted long")
    counts = wanted.join(examples.groupBy("length_bucket").agg(F.count("*").alias("n")), "length_bucket", "left").filter("coalesce(n, 0) <> wanted")
    parts.append(counts.select(F.lit("balance").alias("rule"), F.col("length_bucket").alias("key")))
    if planned_calls > most_calls:
        parts.append(spark.createDataFrame([("budget", str(planned_calls))], "rule string, key string"))
    return union(*parts)
