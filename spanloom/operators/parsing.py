"""Model replies: fences, free-form lines, predictions and entities, each with what was wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, contains_evidence

INTEGER = r"^\s*[+-]?[0-9]+\s*$"


def freeform(reply: Column, with_type: bool = False) -> Column:
    """Lines ``text | start | end`` (or with the type in second place) as structs; ``reason`` is null for good ones.
    Nothing, and NONE, give no lines. With types, bullets before a line are dropped."""
    n = 4 if with_type else 3
    own = F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s+|\s+$", "")
    lines = F.when((own == "") | (F.upper(own) == "NONE"), F.array().cast("array<string>")).otherwise(F.split(own, r"\r\n|\n|\r"))
    clean = lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[-*]+", "")) if with_type else F.trim(s)
    lines = F.filter(F.transform(lines, clean), lambda s: s != "")

    def one(line):
        parts = F.transform(F.split(line, r"\|"), lambda p: F.trim(p))
        start, end = F.get(parts, F.lit(n - 2)), F.get(parts, F.lit(n - 1))
        reason = F.when(F.size(parts) != n, "wrong_field_count").when(~(start.rlike(INTEGER) & end.rlike(INTEGER)), "non_integer_indices")
        good = reason.isNull()
        return F.struct(
            line.alias("line"), F.when(good, F.get(parts, F.lit(0))).alias("text"), F.when(good, F.get(parts, F.lit(1)) if with_type else F.lit(None).cast("string")).alias("type"),
            F.when(good, start.try_cast("int")).alias("start"), F.when(good, end.try_cast("int")).alias("stop"), reason.alias("reason"),
        )

    return F.transform(lines, one)


def clean_prediction(rows: DataFrame, types: Column, queues: Column, tags: Column, candidates: Column | None = None, top_k: int | None = None) -> DataFrame:
    """type, queue (label and evidence) and tags (array of them) as a schema allows, with what was not: invalid_type,
    invalid_queue, invalid_tags, and the tags outside the candidates, which stay."""
    empty = F.struct(F.lit("").alias("label"), F.lit("").alias("evidence"))
    trimmed = lambda s: F.struct(F.trim(F.coalesce(s["label"], F.lit(""))).alias("label"), F.trim(F.coalesce(s["evidence"], F.lit(""))).alias("evidence"))
    own = rows.withColumns({f: trimmed(F.coalesce(F.col(f), empty)) for f in ("type", "queue")})
    given = F.filter(F.transform(F.coalesce("tags", F.array(empty)), trimmed), lambda t: t["label"] != "")
    own = own.withColumn("__tags", F.filter(given, lambda t, i: F.array_position(F.transform(given, lambda x: x["label"]), t["label"]) == i + 1))
    for field, allowed in (("type", types), ("queue", queues)):
        bad = (F.col(f"{field}.label") != "") & ~F.array_contains(allowed, F.col(f"{field}.label"))
        own = own.withColumn(f"invalid_{field}", F.when(bad, F.col(f"{field}.label"))).withColumn(field, F.when(bad, empty).otherwise(F.col(field)))
    own = own.withColumn("invalid_tags", F.filter(F.transform("__tags", lambda t: t["label"]), lambda x: ~F.array_contains(tags, x)))
    kept = F.filter("__tags", lambda t: F.array_contains(tags, t["label"]))
    outside = F.filter(F.transform(kept, lambda t: t["label"]), lambda x: ~F.array_contains(candidates, x)) if candidates is not None else F.array().cast("array<string>")
    if candidates is not None:
        outside = F.when(F.size(candidates) > 0, outside).otherwise(F.array().cast("array<string>"))
    own = own.withColumn("tags_outside_candidates", outside).withColumn("tags", F.slice(kept, 1, top_k) if top_k else kept).drop("__tags")
    wrong = F.col("invalid_type").isNotNull() | F.col("invalid_queue").isNotNull() | (F.size("invalid_tags") > 0)
    return own.withColumn("has_invalid_labels", wrong)


def entity_reasons(entity: Column, tokens: Column, allowed: Column, check_text: bool = True) -> Column:
    """What is wrong with an entity whose start and stop are inclusive token indices; an empty array if nothing is."""
    start, stop, n = entity["start"], entity["stop"], F.size(tokens)
    text, kind = F.trim(F.coalesce(entity["text"], F.lit(""))), F.trim(F.coalesce(entity["type"], F.lit("")))
    inside = F.coalesce((start >= 0) & (stop >= start) & (stop < n), F.lit(False))
    expected = F.when(inside, F.array_join(F.slice(tokens, F.when(inside, start + 1).otherwise(1), F.when(inside, stop - start + 1).otherwise(0)), " ")).otherwise("")
    reasons = [
        F.when(~F.array_contains(allowed, kind), "invalid_type"),
        F.when(start.isNull() | stop.isNull(), "invalid_indices").when(~inside, "indices_out_of_range"),
    ]
    if check_text:
        reasons += [F.when(text == "", "empty_text"), F.when((text != "") & (expected != "") & (text != F.trim(expected)), "text_span_mismatch")]
    return F.array_compact(F.array(*reasons))


def as_location(entities: Column) -> Column:
    """The type of every entity overwritten, as the place extractors do before they validate."""
    return F.transform(F.filter(entities, lambda e: e.isNotNull()), lambda e: F.struct(e["text"].alias("text"), F.lit("location").alias("type"), e["start"].alias("start"), e["stop"].alias("stop")))


def matched_label(label: Column, allowed: list[str]) -> Column:
    """The first configured spelling that agrees but for case; null if none does."""
    names = {}
    for name in allowed:
        names.setdefault(name.strip().lower(), name)
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.lower(F.trim(label))) if names else F.lit(None).cast("string")


#: The shapes of answers that hold nothing, by task.
EMPTY = {
    "classification": "struct<type:struct<label:string,evidence:string>,queue:struct<label:string,evidence:string>,tags:array<struct<label:string,evidence:string>>>",
    "extraction": "struct<entities:array<struct<text:string,type:string,start:int,end:int>>>",
}


def empty_answer(task: str) -> Column:
    """An answer without labels or entities, for rows that have none."""
    blank = F.struct(F.lit("").alias("label"), F.lit("").alias("evidence"))
    own = F.struct(blank.alias("type"), blank.alias("queue"), F.array().cast("array<struct<label:string,evidence:string>>").alias("tags")) if task == "classification" else F.struct(F.array().cast("array<struct<text:string,type:string,start:int,end:int>>").alias("entities"))
    return own.cast(EMPTY[task])


def routed(rows: DataFrame, departments: list[str]) -> DataFrame:
    """department (configured spelling, of two that differ but for case the later), evidence (blank unless the text has it), evidence_valid, and error."""
    names = {d.casefold(): d for d in departments}
    found = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), casefold(F.trim("department")))
    valid = contains_evidence(F.col("evidence"), F.col("text"))
    return rows.withColumn("error", F.when(found.isNull(), "department is not allowed")).withColumn("department", found).withColumn("evidence_valid", valid).withColumn("evidence", F.when(valid, F.col("evidence")).otherwise(""))
