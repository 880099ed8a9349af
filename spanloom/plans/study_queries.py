"""Queries on model calls with stub providers, scorecards, reviewed exports, corpus files and resumed runs."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tags import COARSE, allowed
from ..operators import corpus, evaluation, inference, parsing, retrieval, scoring, spans, tokens, validate
from ..runtime import scratch, shuffled, spread, table
from ..sources import readers, writers
from ..streaming import runner
from . import jobs
from .scoring_queries import GP, PRF, SPAN, _gold, _predicted
from .text_queries import NORM, SENTENCES, TOKENS

def _k() -> Column:
    return F.col("k")


class Parrot:
    """Answers with the prompt."""

    def answer(self, request: dict) -> dict:
        return {"text": request["prompt"], "model_id": "parrot", "input_tokens": 1, "output_tokens": 1}


class LastPart:
    """Answers with what follows the prompt's last empty line."""

    def answer(self, request: dict) -> dict:
        return {"text": request["prompt"].rpartition("\n\n")[2], "model_id": "last", "input_tokens": 1, "output_tokens": 1}


class Fails:
    """Fails for multiples of seven, until told not to."""

    def __init__(self, fails: bool = True):
        self.fails = fails

    def answer(self, request: dict) -> dict:
        k = int(request["k"])
        if self.fails and k % 7 == 0:
            raise ValueError("no answer")
        return {"text": str(2 * k), "model_id": "m", "input_tokens": 1, "output_tokens": 1}


# --- classification

TYPES, QUEUES, TAGS = ["Low", "High", "Medium"], ["F", "O"], ["t0", "t1", "t2", "t3"]


def _tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets whose text is the reply that a model gives: good ones, labels outside the schema, and broken JSON."""
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    kind = F.when(_k() % 4 == 0, "Low").when(_k() % 4 == 1, "High").when(_k() % 4 == 2, "odd").otherwise(" Medium ")
    said = F.format_string('{"type": {"label": "%s", "evidence": "e"}, "queue": {"label": "%s", "evidence": ""}, "tags": [{"label": "t%d", "evidence": "x"}, {"label": "t%d", "evidence": "y"}, {"label": "", "evidence": ""}]}', kind, F.col("o_orderstatus"), _k() % 5, _k() % 3)
    return own.select("k", F.when(_k() % 9 == 0, F.substring(said, 1, 30)).when(_k() % 5 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said).alias("text"))


def _classified(own: DataFrame) -> DataFrame:
    return own.select("k", F.col("type.label").alias("type"), F.col("queue.label").alias("queue"), F.array_join("tags.label", ",").alias("tags"), F.array_join("invalid_tags", ",").alias("invalid_tags"), "has_invalid_labels", "all_json_valid")


def classify_zero_shot(spark, sf):
    """LLM-04, LLM-05, LLM-08, STR-18, VAL-02: one step; replies are parsed, checked against the schema and flagged."""
    return _classified(inference.method("classification", "zero_shot")(_tickets(spark, sf), Parrot, "{text}", TYPES, QUEUES, TAGS))


def classify_two_steps(spark, sf):
    """LLM-06: the second step sees the first's JSON, or an empty object where there is none."""
    return _classified(inference.method("classification", "agent")(_tickets(spark, sf), Parrot, "{text}", TYPES, QUEUES, TAGS, second="{evidence}"))


_CLASSIFIED_SQL = """with o as (select o_orderkey k, o_orderstatus s, o_orderkey % 9 <> 0 ok from orders),
p as (select k, ok, case when ok then case k % 4 when 0 then 'Low' when 1 then 'High' when 2 then 'odd' else 'Medium' end else '' end t, case when ok then s else '' end q, case when ok then list_distinct(['t' || (k % 5), 't' || (k % 3)]) else [] end g from o),
u as (select k, string_agg(x, ',' order by i) filter (x <> 't4') tags, string_agg(x, ',' order by i) filter (x = 't4') invalid_tags from (select k, i, case when i = 1 then 't' || (k % 5) else 't' || (k % 3) end x from p, (values (1), (2)) n(i) where ok and (i = 1 or k % 5 <> k % 3)) group by k)
select k, case when t in ('Low', 'High', 'Medium') then t else '' end as "type", case when q in ('F', 'O') then q else '' end queue, coalesce(tags, '') tags, coalesce(invalid_tags, '') invalid_tags,
  t = 'odd' or (q <> '' and q not in ('F', 'O')) or invalid_tags is not null has_invalid_labels, ok all_json_valid from p left join u using (k)"""


def classify_with_neighbours(spark, sf):
    """LLM-07, STR-21: the examples in the prompt are the nearest tickets whose labels the schema has; the reply is them."""
    own = table(spark, sf, "embeddings").select("vec_id", "embedding", F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), F.concat(F.lit("type "), (F.col("label") % 3).cast("string")).alias("type"), F.lit("q").alias("queue"), F.array(F.lit("t")).alias("tags"))
    own = retrieval.normalised(own, "embedding")
    asked = own.filter("vec_id % 50 = 0").select("vec_id", "embedding", "text")
    found = inference.method("classification", "neighbours")(asked, own, Parrot, "{examples}", ["type 0", "type 1"], ["q"], ["t"], k=2)
    return found.select("vec_id", F.col("reply.text").alias("shown"))


_NEIGHBOURS_SQL = """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings), n as (select vec_id, label % 3 l, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) s from e),
h as (select q.vec_id, i.vec_id hit, i.l, row_number() over (partition by q.vec_id order by list_dot_product(q.v, i.v) / q.s / i.s desc, i.vec_id desc) r from n q, n i where q.vec_id % 50 = 0 and q.vec_id <> i.vec_id),
k as (select *, row_number() over (partition by vec_id order by r) r2 from h where r <= 10 and l < 2)
select q.vec_id, coalesce(string_agg('Ticket: text ' || hit || chr(10) || 'Type: type ' || l || chr(10) || 'Queue: q' || chr(10) || 'Tags: t', chr(10) || chr(10) order by r2) filter (r2 <= 2), '') shown from (select vec_id from embeddings where vec_id % 50 = 0) q left join k using (vec_id) group by 1"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    part = lambda label, evidence: F.struct(label.alias("label"), evidence.alias("evidence"))
    tag = lambda n: F.concat(F.lit("T "), (_k() % n).cast("string"))
    gold = F.struct(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("queue"), F.array(tag(4), tag(3)).alias("tags"))
    said = F.struct(
        part(F.when(_k() % 7 == 0, "other").otherwise(F.lower("o_orderpriority")), F.lit("key  of")).alias("type"),
        part(F.when(_k() % 5 == 0, "P").otherwise(F.col("o_orderstatus")), F.when(_k() % 2 == 0, "absent").otherwise("")).alias("queue"),
        F.array(part(F.lower(tag(4)), F.lit("ROW")), part(tag(5), F.when(_k() % 3 == 0, F.lit(None).cast("string")).otherwise("nowhere"))).alias("tags"),
    )
    return own.select("k", F.lit("m").alias("method"), F.lit("n").alias("model"), F.concat(F.lit("the Key of\trow "), _k().cast("string")).alias("text"), gold.alias("gold"), said.alias("prediction"), (_k() % 10 != 0).alias("all_json_valid"), (_k() % 9 == 0).alias("has_invalid_labels"))


def classification_scores(spark, sf):
    """AGG-07, AGG-04, STR-27: the scorecard of 16 columns."""
    return scoring.classification_scorecard(_records(spark, sf))


def classification_error_rows(spark, sf):
    """MUT-05, SNK-05: rows with a wrong type, queue or tags, through prediction lines and back."""
    to = scratch(spark, "records")
    records = _records(spark, sf).withColumn("reply", F.lit("raw"))
    writers.prediction_lines(records, to)
    back = spark.read.schema(records.drop("reply").schema).json(f"{to}/predictions")
    return scoring.classification_errors(back).select("k", "type_correct", "queue_correct", "tp", "fp", "fn")


_RECORDS = """o as (select o_orderkey k, o_orderpriority gt, case when o_orderkey % 7 = 0 then 'other' else lower(o_orderpriority) end pt, o_orderstatus gq, case when o_orderkey % 5 = 0 then 'P' else o_orderstatus end pq,
  list_distinct(['t ' || (o_orderkey % 4), 't ' || (o_orderkey % 3)]) g, list_distinct(['t ' || (o_orderkey % 4), 't ' || (o_orderkey % 5)]) p from orders),
f as (select k, lower(gt) gt, pt, lower(gq) gq, lower(pq) pq, len(list_intersect(g, p)) tp, len(p) - len(list_intersect(g, p)) fp, len(g) - len(list_intersect(g, p)) fn from o)"""


def _macro(name: str, g: str, p: str) -> str:
    return f"""{name}l as (select {g} l from f union select {p} from f), {name}c as (select l, count(*) filter ({g} = l and {p} = l) tp, count(*) filter ({p} = l and {g} <> l) fp, count(*) filter ({g} = l and {p} <> l) fn from {name}l, f group by l),
{name} as (select avg(f1) macro from (select {PRF} from {name}c)), {name}a as (select count(*) filter ({g} = {p})::double / count(*) accuracy from f)"""


_SCORECARD_SQL = f"""with {_RECORDS}, {_macro("ty", "gt", "pt")}, {_macro("qu", "gq", "pq")},
r as (select {PRF} from f), rows_ as (select avg(round("precision", 4)) rp, avg(round(recall, 4)) rr, avg(round(f1, 4)) rf from r), s as (select sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from f), m as (select {PRF} from s),
e as (select count(*) + count(*) filter (k % 2 = 0) + count(*) + count(*) filter (k % 3 <> 0) n, 2 * count(*) valid from f)
select 'm' as "method", 'n' model, (select count(*) from f) n_examples, tya.accuracy type_accuracy, ty.macro type_macro_f1, qua.accuracy queue_accuracy, qu.macro queue_macro_f1,
  m.precision tag_micro_precision, m.recall tag_micro_recall, m.f1 tag_micro_f1, rp tag_row_precision, rr tag_row_recall, rf tag_row_f1,
  (select count(*) filter (k % 10 = 0)::double / count(*) from f) invalid_json_rate, (select count(*) filter (k % 9 = 0)::double / count(*) from f) invalid_label_rate, e.valid::double / e.n evidence_valid_rate from tya, ty, qua, qu, m, rows_, e"""


# --- extraction


def _span_records(spark: SparkSession, sf: str) -> DataFrame:
    one = F.struct("text", "start", "stop", F.col("label").alias("type"))
    pack = lambda d, name: d.groupBy(F.col("example").alias("id")).agg(F.collect_list(one).alias(name))
    own = pack(_gold(spark, sf), "gold").join(pack(_predicted(spark, sf), "prediction"), "id", "full")
    k = F.col("id")
    return own.select("id", F.lit("m").alias("method"), F.lit("n").alias("model"), "gold", "prediction", (k % 6 != 0).alias("all_json_valid"), (k % 8 == 0).alias("not_applicable"), (k % 9 == 0).alias("has_invalid_labels"))


def extraction_scores(spark, sf):
    """AGG-12, AGG-08, MUT-06: the scorecard of 12 columns."""
    return scoring.extraction_scorecard(_span_records(spark, sf))


def _extraction_sql() -> str:
    squeezed = NORM("text").replace("lower(", "(")
    one = lambda name, keys: f"""{name}s as (select example, {keys}, count(*) filter (side = 'g') g, count(*) filter (side = 'p') p from s group by example, {keys}), {name}c as (select sum(least(g, p)) tp, sum(p - least(g, p)) fp, sum(g - least(g, p)) fn from {name}s), {name} as (select {PRF} from {name}c)"""
    return f"""with {GP}, s as (select example, {squeezed} t, start, stop, 'g' side from gold union all select example, {squeezed} t, start, stop, 'p' from pred), {one("strict", "t, start, stop")}, {one("lenient", "t")},
i as (select distinct example k from s), r as (select count(*) n, count(*) filter (k % 8 <> 0) a, count(*) filter (k % 8 <> 0 and k % 6 <> 0) v, count(*) filter (k % 9 = 0) l from i)
select 'm' as "method", 'n' model, n n_examples, strict.precision strict_precision, strict.recall strict_recall, strict.f1 strict_f1, lenient.precision lenient_precision, lenient.recall lenient_recall, lenient.f1 lenient_f1,
  v::double / a json_valid_rate, (a - v)::double / a invalid_json_rate, l::double / n invalid_label_rate from strict, lenient, r"""


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of three tokens, and the reply that a model gives for each."""
    own = spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")
    word = F.concat(F.lit("w"), _k().cast("string"))
    word = F.concat_ws(" ", word, F.lit("in"), F.lit("Oslo"))
    own = own.select("k", _k().alias("id"), word.alias("text"), tokens.tokenize(word).alias("tokens"))
    entity = lambda text, kind, a, b: F.format_string('{"text": "%s", "type": "%s", "start": %d, "end": %d}', text, kind, a, b)
    first = entity(F.when(_k() % 2 == 0, "").otherwise(" Oslo "), F.when(_k() % 3 == 0, "loc").otherwise("LOC"), F.lit(2), F.lit(2))
    other = entity(F.lit("far"), F.when(_k() % 5 == 0, "XYZ").otherwise("LOC"), _k() % 4, _k() % 4 + 1)
    reply = F.concat(F.lit('{"entities": ['), first, F.lit(", "), other, F.lit("]}"))
    return own.withColumn("said", F.when(_k() % 11 == 0, F.concat(F.lit("nonsense"), _k().cast("string"))).otherwise(reply)).withColumn("lines", F.concat(F.lit("- "), F.when(_k() % 2 == 0, "NONE\nbad").otherwise("Oslo | LOC | 2 | 2\nbad | 1"), F.lit("\n"), F.format_string("w | LOC | %d | 0", _k() % 2)))


def _entities(own: DataFrame, *more: Column) -> DataFrame:
    listed = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["text"], e["type"], e["start"].cast("string"), e["stop"].cast("string"))), ";")
    reasons = F.array_join(F.transform("rejected", lambda e: F.array_join(e["reasons"], "+")), ";")
    return own.select(F.col("id").alias("k"), "json_valid", listed.alias("entities"), reasons.alias("rejected"), "reply.attempts", *more)


def extract_structured(spark, sf):
    """LLM-09, LLM-10, VAL-04, TOK-04: replies as JSON; blank texts are read from the tokens, offsets become characters."""
    return _entities(inference.method("extraction", "zero_shot_structured")(_sentences(spark, sf), Parrot, "{said}", ["LOC"]))


_STRUCTURED_SQL = """with c as (select c_custkey k, length('w' || c_custkey) n from customer),
e as (select k, case when k % 2 = 0 then 'Oslo' else 'Oslo' end || ':LOC:' || (n + 4) || ':' || (n + 8) a,
  case when k % 5 = 0 then null when k % 4 = 0 then 'far:LOC:0:' || (n + 3) when k % 4 = 1 then 'far:LOC:' || (n + 1) || ':' || (n + 8) end b,
  case when k % 5 = 0 and k % 4 >= 2 then 'invalid_type+indices_out_of_range' when k % 5 = 0 then 'invalid_type' when k % 4 >= 2 then 'indices_out_of_range' end r from c)
select k, k % 11 <> 0 json_valid, case when k % 11 = 0 then '' else concat_ws(';', a, b) end entities, case when k % 11 = 0 then '' else coalesce(r, '') end rejected, case when k % 11 = 0 then 2 else 1 end attempts from e"""


def extract_freeform(spark, sf):
    """LLM-09, LLM-10, STR-09: replies as lines; broken lines are kept apart."""
    own = inference.method("extraction", "zero_shot_freeform")(_sentences(spark, sf), Parrot, "{lines}", ["LOC"])
    return _entities(own, F.array_join("malformed.reason", ";").alias("malformed")).withColumn("json_valid", F.coalesce("json_valid", F.lit(True)))


_FREEFORM_SQL = """with c as (select c_custkey k, length('w' || c_custkey) n from customer)
select k, true json_valid, concat_ws(';', case when k % 2 = 1 then 'Oslo:LOC:' || (n + 4) || ':' || (n + 8) end, case when k % 2 = 0 then 'w:LOC:0:' || n end) entities, case when k % 2 = 1 then 'indices_out_of_range' else '' end rejected, 1 attempts,
case when k % 2 = 1 then 'wrong_field_count' else 'wrong_field_count;wrong_field_count' end malformed from c"""


def extract_in_two_steps(spark, sf):
    """LLM-11, SET-03: the second step's entities where its JSON is valid, and what it added and removed."""
    second = F.when(_k() % 4 == 0, F.lit("none")).when(_k() % 4 == 1, F.lit('{"entities": []}')).otherwise(F.lit('{"entities": [{"text": "Oslo", "type": "LOC", "start": 2, "end": 2}, {"text": "in", "type": "LOC", "start": 1, "end": 1}]}'))
    first = inference.extract(_sentences(spark, sf), Parrot, "{said}", ["LOC"])
    again = inference.extract(_sentences(spark, sf).withColumn("said", second), Parrot, "{said}", ["LOC"])
    return inference.verified(first, again, "id").select(F.col("id").alias("k"), *(F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["text"], e["start"].cast("string"))), ";").alias(c) for c in ("entities", "added", "removed")))


_TWO_STEPS_SQL = """with c as (select c_custkey k, length('w' || c_custkey) n from customer),
a as (select k, n, case when k % 11 = 0 then [] when k % 5 <> 0 and k % 4 = 0 then ['Oslo:' || (n + 4), 'far:0'] when k % 5 <> 0 and k % 4 = 1 then ['Oslo:' || (n + 4), 'far:' || (n + 1)] else ['Oslo:' || (n + 4)] end f from c),
b as (select k, f, case k % 4 when 0 then f when 1 then [] else ['Oslo:' || (n + 4), 'in:' || (n + 1)] end e from a)
select k, array_to_string(e, ';') entities, array_to_string(list_filter(e, lambda x: not list_contains(f, x)), ';') added, array_to_string(list_filter(f, lambda x: not list_contains(e, x)), ';') removed from b"""


def entity_changes(spark, sf):
    """JON-13, SET-03: spans that a second step added, removed, or moved under the same text."""
    with_id = lambda d: d.select(F.col("example").alias("id"), T.squeeze(F.col("text")).alias("text"), "start", "stop")
    return spans.step_changes(with_id(_gold(spark, sf)), with_id(_predicted(spark, sf)), "id").groupBy("id", "change").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


_CHANGES_SQL = f"""with {GP}, a as (select distinct example id, {NORM("text").replace("lower(", "(")} t, start, stop from gold), b as (select distinct example id, {NORM("text").replace("lower(", "(")} t, start, stop from pred),
c as (select *, 'added' change from (select * from b except select * from a) union all select *, 'removed' from (select * from a except select * from b)
union all select distinct b.id, b.t, b.start, b.stop, 'rephrased_or_shifted' from a join b using (id, t) where a.start <> b.start or a.stop <> b.stop)
select id, change, count(*) n, sum(start)::bigint starts from c group by 1, 2"""


def location_eval(spark, sf):
    """PRJ-14, PRJ-15, TOK-12, TOK-16, VAL-12: printed arrays to sentences with location spans."""
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    rows = own.select(_k().alias("id"), F.format_string("['a%d' 'b' \"it's\" 'c']", _k()).alias("tokens"), F.format_string("[%d %d 0 %d]", _k() % 5, _k() % 5, _k() % 3 * 2).alias("ner_tags"))
    flat = jobs.build_location_eval(rows, 0)
    names = F.element_at(F.array(*map(F.lit, allowed(COARSE))), F.size("gold_entities"))
    located = parsing.as_location(F.transform("gold_entities", lambda e: F.struct(e["text"], e["start"], e["stop"])))
    return flat.select("id", "sentence", F.array_join(F.transform(located, lambda e: F.concat_ws(":", e["type"], e["text"], e["start"].cast("string"), e["stop"].cast("string"))), ";").alias("spans"), names.alias("name"))


_LOCATION_SQL = """with c as (select c_custkey k, c_custkey % 5 = 4 x, c_custkey % 3 = 2 y from customer)
select k id, 'a' || k || ' b it''s c' sentence, concat_ws(';', case when x then 'location:a' || k || ' b:0:1' end, case when y then 'location:c:3:3' end) spans, case when x and y then 'building' else 'art' end as "name" from c where x or y"""


# --- routing and retrieval


def route_by_model(spark, sf):
    """LLM-16, STR-20, VAL-05: a reply's department in the configured spelling, and evidence that the text has."""
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    reply = F.format_string('Sure: {"department": "%s", "evidence": "%s"}', F.when(_k() % 4 == 0, "Nowhere").otherwise(F.lower("c_mktsegment")), F.when(_k() % 3 == 0, "Department").otherwise("not\\u0020there"))
    departments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]
    return inference.route(own.withColumn("text", reply), LastPart, departments).select("k", "department", "evidence", "evidence_valid", "error")


def route_by_index(spark, sf):
    """LLM-17, RNK-02: a weighted vote of the nearest labelled tickets, with status."""
    own = retrieval.normalised(table(spark, sf, "embeddings"), "embedding").withColumn("department", F.concat(F.lit("D"), F.col("label").cast("string")))
    asked = own.filter("vec_id % 25 = 0").select("vec_id", "embedding")
    return inference.route_by_neighbours(asked, own, ["d0", "d1", "d2"], 3).select("query_id", "department", F.round("confidence", 6).alias("confidence"), "n_hits", "status")


_ROUTE_INDEX_SQL = """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings), n as (select vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) s from e),
h as (select q.vec_id query_id, i.label, list_dot_product(q.v, i.v) / q.s / i.s sim, row_number() over (partition by q.vec_id order by list_dot_product(q.v, i.v) / q.s / i.s desc, i.vec_id desc) r from n q, n i where q.vec_id % 25 = 0 and q.vec_id <> i.vec_id),
k as (select query_id, label, sim, row_number() over (partition by query_id order by r) r2 from h where r <= 15 and label < 3),
w as (select query_id, label, sum(case when sim > 0 then sim else 1e-9 / r2 end) w, max(sim) best, count(*) n from k where r2 <= 3 group by 1, 2),
t as (select query_id, arg_max('d' || label, (w, best, 'd' || label)) department, max(w) / sum(w) c, sum(n)::bigint n_hits from w group by 1)
select q.vec_id query_id, department, round(c, 6) confidence, n_hits, case when department is null then 'no_match' else 'ok' end status from (select vec_id from embeddings where vec_id % 25 = 0) q left join t on t.query_id = q.vec_id"""


class Letters:
    """A text encoder: how often each of eight letters occurs, and one."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([[1.0, *(t.lower().count(c) for c in "aeinorst")] for t in texts])


def nearest_to_texts(spark, sf):
    """LLM-18, LLM-19: texts encoded in batches, the nearest of other texts by cosine."""
    own = table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"), "text")
    index = inference.encoded(own, "text", Letters, 9)
    return inference.nearest_texts(own, index, Letters, 9, 3, extra=()).select("query_id", "rank", F.round("similarity", 9).alias("similarity"))


_LETTERS = "list_value(1.0::double, " + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))::double" for c in "aeinorst") + ")"
_NEAREST_SQL = f"""with n as (select item_id, {NORM("text")} t, {_LETTERS} v from benchmark), h as (select q.item_id query_id, q.t <> i.t other, list_cosine_similarity(q.v, i.v) s, row_number() over (partition by q.item_id order by list_cosine_similarity(q.v, i.v) desc, i.item_id desc) r from n q, n i where q.item_id <> i.item_id),
k as (select *, row_number() over (partition by query_id order by r) "rank" from h where r <= 15 and other) select query_id, "rank"::integer "rank", round(s, 9) similarity from k where "rank" <= 3"""


# --- evaluation


def _batch(spark: SparkSession, sf: str, share: bool = False) -> evaluation.Evaluation:
    own = F.struct(F.col("label"), F.col("start").alias("start_char"), F.col("stop").alias("end_char"))
    ids = shuffled(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")))
    gold = ids.join(_gold(spark, sf).groupBy(F.col("example").alias("k")).agg(F.collect_list(own).alias("entities")), "k", "left")
    gold = gold.select(_k().cast("string").alias("example_id"), (_k() % 500).cast("string").alias("doc_id"), F.concat(F.lit("s"), (_k() % 3).cast("string")).alias("source_split"), F.concat(F.lit("b"), (_k() % 2).cast("string")).alias("length_bucket"), F.repeat(F.lit("word "), 40).alias("text"), "entities")
    said = F.struct(F.col("label").alias("type"), "start", F.col("stop").alias("end"))
    found = ids.filter("k % 6 <> 0").join(_predicted(spark, sf).groupBy(F.col("example").alias("k")).agg(F.collect_list(said).alias("predictions")), "k", "left")
    found = found.select(_k().cast("string").alias("example_id"), F.when(_k() % 10 == 1, "error").otherwise("ok").alias("status"), (F.lit(60) + _k() % 50).cast("int").alias("processed_char_end"), "predictions", F.lit(2).cast("long").alias("llm_calls"))
    tries = found.withColumn("seq", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))  # a first try fails
    return evaluation.evaluate_batch(gold, tries.withColumn("status", F.when(F.col("seq") == 0, "error").otherwise(F.col("status"))), share=share)


def batch_groups(spark, sf):
    """EVL-02, SNK-07, AGG-13, PRJ-06: a batch's bundle published and read; its strict counts by bucket, split and label."""
    to = scratch(spark, "bundle")
    own = _batch(spark, sf, share=True)
    writers.write_bundle({"summary": own.summary, "groups": own.groups, "per_example": own.per_example, "false_positives": own.false_positives, "false_negatives": own.false_negatives, "failed_examples": own.failed}, to)
    return readers.csv(spark, writers.published(spark, to, "groups"), "group_type string, group string, tp long, fp long, fn long, precision double, recall double, f1 double")


def batch_summary(spark, sf):
    """EVL-02, EVL-03, JON-08, AGG-14, AGG-16: coverage, micro counts strict, tolerant and by overlap, and totals."""
    own = _batch(spark, sf).summary
    return own.select("n_gold", "n_missing", "n_failed", "micro_tp", "micro_fp", "micro_fn", "overlap_tp", "overlap_fp", "overlap_fn", "n_documents", F.round("macro_f1", 9).alias("macro_f1"), "llm_calls")


_BATCH = f"""{GP}, o as (select o_orderkey k from orders), d as (select k from o where k % 6 <> 0 and k % 10 <> 1),
g as (select distinct example k, start, stop, case when lower(label) in ('material', 'dataset') then 'dataset' else lower(label) end label from gold join d on d.k = example where stop <= 60 + example % 50),
p as (select distinct example k, start, stop, case when lower(label) in ('material', 'dataset') then 'dataset' else lower(label) end label from pred join d on d.k = example where stop <= 60 + example % 50),
m as (select coalesce(g.k, p.k) k, coalesce(g.label, p.label) label, (g.k is not null and p.k is not null)::int tp, (g.k is null)::int fp, (p.k is null)::int fn from g full join p on g.k = p.k and g.start = p.start and g.stop = p.stop and g.label = p.label),
e as (select d.k, coalesce(sum(tp), 0) tp, coalesce(sum(fp), 0) fp, coalesce(sum(fn), 0) fn from d left join m using (k) group by 1)"""
_GROUPS_SQL = f"""with {_BATCH}, c as (select 'bucket' group_type, 'b' || (k % 2) as "group", sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from e group by 2 union all select 'split', 's' || (k % 3), sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint from e group by 2 union all select 'label', label, sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint from m group by 2) select *, {PRF} from c"""


def greedy_sql(pairs: str, group: str) -> str:
    """A recursive statement for one-to-one matching: pairs has the group, label, both spans and score."""
    return f"""c as (select *, row_number() over (partition by {group} order by score desc, p_start desc, p_stop desc, label desc, g_start desc, g_stop desc) r from ({pairs})),
walk as (select distinct {group}, 0::bigint r, []::varchar[] up, []::varchar[] ug from c union all
  select c.{group}, c.r, case when list_contains(up, c.p_key) or list_contains(ug, c.g_key) then up else list_append(up, c.p_key) end, case when list_contains(up, c.p_key) or list_contains(ug, c.g_key) then ug else list_append(ug, c.g_key) end
  from walk join c on c.{group} = walk.{group} and c.r = walk.r + 1),
matched as (select {group}, max(len(up)) tp from walk group by 1)"""


_KEYS = "p.start || ':' || p.stop || ':' || label p_key, g.start || ':' || g.stop || ':' || label g_key, p.start p_start, p.stop p_stop, g.start g_start, g.stop g_stop"
_OVERLAP = "(least(p.stop, g.stop) - greatest(p.start, g.start))::double / (greatest(p.stop, g.stop) - least(p.start, g.start)) score"
_SUMMARY_SQL = f"""with recursive {_BATCH}, {greedy_sql(f"select p.k, label, {_KEYS}, {_OVERLAP} from p join g using (k, label) where greatest(p.start, g.start) < least(p.stop, g.stop)", "k")},
docs as (select k % 500 doc, sum(tp) tp, sum(fp) fp, sum(fn) fn from e group by 1), fs as (select {PRF} from docs)
select (select count(*) from o) n_gold, (select count(*) from o where k % 6 = 0) n_missing, (select count(*) from o where k % 6 <> 0 and k % 10 = 1) n_failed, sum(tp)::bigint micro_tp, sum(fp)::bigint micro_fp, sum(fn)::bigint micro_fn,
  (select sum(tp) from matched)::bigint overlap_tp, ((select count(*) from p) - (select sum(tp) from matched))::bigint overlap_fp, ((select count(*) from g) - (select sum(tp) from matched))::bigint overlap_fn, (select count(*) from docs) n_documents, (select round(avg(f1), 9) from fs) macro_f1, (select 2 * count(*) from o where k % 6 <> 0)::bigint llm_calls from e"""
_SIDES = f"{GP}, g as (select distinct example, label, start, stop from gold), p as (select distinct example, label, start, stop from pred)"
_FLEX = "s as (select (select coalesce(sum(tp), 0) from matched)::bigint tp, (select count(*) from p) np, (select count(*) from g) ng), t as (select tp, np - tp fp, ng - tp fn from s) select *, {prf} from t".format(prf=PRF)
FLEX_OVERLAP_SQL = f"""with recursive {_SIDES}, {greedy_sql(f"select p.example, label, {_KEYS}, {_OVERLAP} from p join g using (example, label) where greatest(p.start, g.start) < least(p.stop, g.stop)", "example")}, {_FLEX}"""
_MOVED = "example % 50 example, label, (start + (example // 50) % 40 * 7)::integer start, (stop + (example // 50) % 40 * 7)::integer stop"
DOMINANT_SQL = f"""with recursive {GP}, g as (select distinct {_MOVED} from gold), p as (select distinct {_MOVED} from pred), {greedy_sql(f"select p.example, label, {_KEYS}, {_OVERLAP} from p join g using (example, label) where greatest(p.start, g.start) < least(p.stop, g.stop)", "example")},
ends as (select example, unnest(up) u, unnest(ug) v from (select example, up, ug from walk qualify row_number() over (partition by example order by r desc) = 1))
select example, split_part(u, ':', 3) as label, split_part(u, ':', 1)::integer p_start, split_part(u, ':', 2)::integer p_stop, split_part(v, ':', 1)::integer g_start, split_part(v, ':', 2)::integer g_stop from ends"""
_ENDS = "abs(p.start // 3 - g.start // 3) + abs((p.stop - 1) // 3 - (g.stop - 1) // 3)"
FLEX_TOLERANT_SQL = f"""with recursive {_SIDES}, {greedy_sql(f"select p.example, label, {_KEYS}, -({_ENDS})::double score from p join g using (example, label) where abs(p.start // 3 - g.start // 3) <= 1 and abs((p.stop - 1) // 3 - (g.stop - 1) // 3) <= 2", "example")}, {_FLEX}"""


def _exports(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    named = F.struct(F.col("label"), F.col("start").alias("start_char"), F.col("stop").alias("end_char"))
    ends = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct((i * 30).alias("end_char")))
    none = F.array().cast("array<struct<label:string,start_char:int,end_char:int>>")
    examples = ids.filter("k % 13 <> 0").join(_gold(spark, sf).groupBy(F.col("example").alias("k")).agg(F.collect_list(named).alias("e")), "k", "left").select(_k().cast("string").alias("example_id"), F.repeat(F.lit("word "), 28).alias("text"), ends.alias("sentences"), F.coalesce("e", none).alias("entities"))
    said = F.struct(F.col("label").alias("type"), "start", F.col("stop").alias("end"), F.when(F.col("example") % 4 == 0, "edited").otherwise("confirmed").alias("status"), F.lit("model").alias("source"))
    log = ids.join(_predicted(spark, sf).groupBy(F.col("example").alias("k")).agg(F.collect_list(said).alias("l")), "k", "left")
    empty = F.array().cast("array<struct<type:string,start:int,end:int,status:string,source:string>>")
    log = log.withColumn("l", F.coalesce("l", empty))
    exports = log.select(F.concat(F.lit("d"), _k().cast("string")).alias("doc_name"), F.when(_k() % 11 != 0, _k().cast("string")).alias("example_id"), F.when(_k() % 5 != 0, F.col("l")).alias("model_predictions"), F.col("l").alias("review_log"), F.when(_k() % 3 == 0, F.lit(40) + _k() % 60).otherwise(0).cast("int").alias("processed_char_end"), (_k() % 6).cast("int").alias("n_sentences"))
    return exports, examples


def reviewed_exports(spark, sf):
    """EVL-01, VAL-11, PRJ-07: reviewed documents against hidden gold, with cutoffs, old exports and overlap matching."""
    own = evaluation.evaluate_exports(*_exports(spark, sf))
    return own.select("doc_name", "available", "reason", "legacy", "scope", "processed_char_end", "tp", "fp", "fn", F.size("false_positives").alias("n_listed"), "overlap_tp")


def export_micro(spark, sf):
    """AGG-28: one row over the exports that could be scored."""
    return evaluation.micro(evaluation.evaluate_exports(*_exports(spark, sf))).select("documents", "tp", "fp", "fn", "precision", "recall", "f1")


def export_labels(spark, sf):
    """EVL-01: counts by document and label."""
    return evaluation.exports_by_label(*_exports(spark, sf)).select("doc_name", "label", "tp", "fp", "fn")


_EXPORTS = f"""{GP}, o as (select o_orderkey k, o_orderkey % 11 = 0 unlinked, o_orderkey % 13 = 0 lost, o_orderkey % 5 = 0 legacy, o_orderkey in (select example from pred) logged from orders),
w as (select *, case when unlinked then 'not linked to an example' when lost then 'the example was not found' when legacy and logged and k % 4 = 0 then 'labels were edited' end reason,
  case when k % 3 = 0 then 'exact' when not (unlinked or lost) and k % 6 > 0 then 'inferred' else 'full' end scope, case when k % 3 = 0 then 40 + k % 60 when unlinked or lost then null when k % 6 > 0 then 30 * least(k % 6, 4) else 140 end cut from o),
g as (select distinct example k, lower(label) label, start, stop from gold join w on w.k = example where stop <= cut and reason is null),
p as (select distinct example k, lower(label) label, start, stop from pred join w on w.k = example where stop <= cut and reason is null),
m as (select coalesce(g.k, p.k) k, coalesce(g.label, p.label) label, (g.k is not null and p.k is not null)::int tp, (g.k is null)::int fp, (p.k is null)::int fn from g full join p on g.k = p.k and g.start = p.start and g.stop = p.stop and g.label = p.label),
e as (select w.*, coalesce(sum(tp), 0)::bigint tp, coalesce(sum(fp), 0)::bigint fp, coalesce(sum(fn), 0)::bigint fn from w left join m using (k) group by all)"""
_REVIEWED_SQL = f"""with recursive {_EXPORTS}, {greedy_sql(f"select p.k, label, {_KEYS}, {_OVERLAP} from p join g using (k, label) where greatest(p.start, g.start) < least(p.stop, g.stop)", "k")}
select 'd' || k doc_name, reason is null available, reason, legacy, scope, cut::int processed_char_end, case when reason is null then e.tp end tp, case when reason is null then fp end fp, case when reason is null then fn end fn, case when reason is null then fp::int end n_listed, case when reason is null then coalesce(matched.tp, 0) end::bigint overlap_tp from e left join matched using (k)"""


# --- corpus, files and runs


def corpus_files(spark, sf):
    """SRC-01, SRC-02: one file for each split, found below a folder; good records, and the lines that are none by rule."""
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    good = F.format_string('{"doc_id": "d%d", "words": ["a", "b"], "sentences": [[0, 2]], "sections": [[0, 2]], "ner": [[0, 1, "Task"]]}', _k())
    line = F.when(_k() % 10 == 0, "not json {").when(_k() % 7 == 0, F.format_string('{"doc_id": "d%d", "sentences": [[0, 2]], "sections": [], "ner": []}', _k())).otherwise(good)
    to = scratch(spark, "corpus")
    for i, name in enumerate(readers.SPLITS):
        writers.write_one_file(own.filter(_k() % 3 == i).select(line.alias("value")), f"{to}/{name}.jsonl")
    rows, bad = readers.raw_records(spark, [r.path for r in readers.split_files(spark, to).collect()])  # three paths
    return rows.groupBy("source_split").agg(F.count("*").alias("n")).withColumn("rule", F.lit("good")).unionByName(bad.groupBy("source_split", F.col("key").alias("rule")).agg(F.count("*").alias("n")))


def lenient_lines(spark, sf):
    """SRC-04, SRC-05, SRC-09: lines with blanks among them, a missing file, and a tree of Parquet folders."""
    to = scratch(spark, "lines")
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    own.select(F.when(_k() % 4 == 0, "  ").otherwise(F.to_json(F.struct("k", "c_name"))).alias("value")).write.text(f"{to}/lines")
    back, none = (readers.jsonl_lenient(spark, f"{to}/{name}", "k long, c_name string") for name in ("lines", "missing"))
    for i, where in enumerate(("a", "b/c")):
        own.filter(_k() % 2 == i).write.parquet(f"{to}/tree/{where}")
    tree = readers.parquet_tree(spark, f"{to}/tree")
    out = back.agg(F.count("*").alias("n"), F.sum("k").alias("keys"), F.max("c_name").alias("last"))
    return out.join(F.broadcast(none.agg(F.count("*").alias("n_missing")))).join(F.broadcast(tree.agg(F.count("*").alias("n_tree"), F.sum("k").alias("tree_keys"))))


def mapped_columns(spark, sf):
    """SRC-07, PRJ-04, PRJ-11: a table under the engine's names, its first thousand rows, and all of them for a limit of 0."""
    to = scratch(spark, "csv")
    writers.write_scores(table(spark, sf, "customer"), to)
    own = readers.mapped(readers.csv(spark, to, table(spark, sf, "customer").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), {"ticket_id": "c_custkey", "text": "c_name", "gold": "absent"}, ["ticket_id"])
    every = readers.first_rows(own, "ticket_id", 0).agg(F.count("*").alias("n_all"))
    return readers.first_rows(own, "ticket_id", 1000).join(F.broadcast(every))


def text_files(spark, sf):
    """SRC-12, SRC-10, SNK-11, SNK-12: small files written in one step: texts, one with a bad byte, a binary one read by a
    function, exports of which one is broken, and the saved states of examples."""
    to = scratch(spark, "files")
    for row in table(spark, sf, "region").collect():  # five rows
        writers.put(spark, f"{to}/texts/{row.r_regionkey}.txt", row.r_name.encode() + (b"\xff" if row.r_regionkey == 1 else b""))
        writers.put(spark, f"{to}/exports/{row.r_regionkey}.json", json.dumps({"doc": row.r_name, "n": row.r_regionkey}, indent=1).encode() if row.r_regionkey != 2 else b"{ broken")
        writers.save_state(spark, f"{to}/states", row.r_name, {"next": row.r_regionkey})
        writers.save_state(spark, f"{to}/states", row.r_name, {"next": row.r_regionkey + 1})
    writers.put(spark, f"{to}/texts/scan.pdf", b"two wo-\nrds  here\n\n\n\nend ")
    texts = readers.texts(spark, f"{to}/texts", lambda content: content.decode()).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "text")
    exports = readers.exports(spark, f"{to}/exports", "doc string, n long").filter("doc is not null").select(F.concat(F.lit("export "), F.col("n").cast("string")).alias("name"), F.col("doc").alias("text"))
    states = writers.load_states(spark, f"{to}/states", "next long").select(F.concat(F.lit("state "), F.col("key")).alias("name"), F.col("next").cast("string").alias("text"))
    sums = readers.file_digests(spark, f"{to}/texts").select(F.concat(F.lit("sum "), F.regexp_extract("path", r"([^/]+)$", 1)).alias("name"), F.col("sha256").alias("text")).filter("name not in ('sum 1.txt', 'sum scan.pdf')")
    return texts.unionByName(exports).unionByName(states).unionByName(sums)


_FILES_SQL = """select r_regionkey || '.txt' as "name", r_name || case when r_regionkey = 1 then chr(65533) else '' end as text from region union all select 'scan.pdf', 'two words here' || chr(10) || chr(10) || 'end'
union all select 'export ' || r_regionkey, r_name from region where r_regionkey <> 2 union all select 'state ' || r_name, (r_regionkey + 1)::varchar from region union all select 'sum ' || r_regionkey || '.txt', sha256(r_name) from region where r_regionkey <> 1"""


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus")
    split = F.when(F.col("o_custkey") % 97 == 0, (_k() % 2).cast("string")).otherwise((F.col("o_custkey") % 2).cast("string"))
    return own.select(_k().cast("string").alias("example_id"), F.col("o_custkey").cast("string").alias("doc_id"), F.concat(F.lit("s"), split).alias("source_split"), F.col("o_orderstatus").alias("length_bucket"), (_k() % 30).cast("int").alias("sentence_count"), F.lit("x").alias("text"), F.array(F.lit("gold")).alias("entities"))


def study_readiness(spark, sf):
    """VAL-09, SET-05: a study whose budget, balance and document isolation fail in known places."""
    return validate.readiness(_examples(spark, sf), 10, 9, {"F": 1, "O": 2}).select("rule", "key")


_READINESS_SQL = """with e as (select o_custkey d, case when o_custkey % 97 = 0 then o_orderkey % 2 else o_custkey % 2 end s from orders) select 'split_leak' as "rule", d::varchar as "key" from e group by d having count(distinct s) > 1
union all select 'balance', o_orderstatus from orders where o_orderstatus in ('F', 'O') group by o_orderstatus having count(*) <> case o_orderstatus when 'F' then 1 else 2 end union all select 'budget', '10'"""


def traced_examples(spark, sf):
    """PRJ-12, PRJ-10, PRJ-05: what an export may tell of its example, without documents that another list has; gold is not in it."""
    own = _examples(spark, sf)
    used = own.filter("doc_id like '%7'").select("doc_id").distinct()
    return corpus.traceability(own.join(used, "doc_id", "left_anti"), "corpus")


def split_union(spark, sf):
    """SET-04: the parts of a split table hold the same rows as the whole, and with one row more they do not."""
    own = table(spark, sf, "customer").select("c_custkey", "c_name")
    parts = own.filter("c_custkey % 3 = 0").unionByName(own.filter("c_custkey % 3 <> 0"))
    return spark.createDataFrame([("same", validate.same_rows(parts, own)), ("one more", validate.same_rows(parts.unionByName(own.orderBy("c_custkey").limit(1)), own))], "case string, same boolean")


def span_rules(spark, sf):
    """VAL-03, VAL-06, TOK-05: planted faults in spans, by rule."""
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.lit("some text here").alias("text"))
    span = F.struct(F.when(_k() % 4 == 0, -1).otherwise(5).alias("start_char"), F.when(_k() % 6 == 0, 5).when(_k() % 7 == 0, 99).otherwise(9).alias("end_char"), F.when(_k() % 5 == 0, "next").otherwise("text").alias("text"))
    rules = {"range_or_text": validate.bad_span(F.col("text"), span), "range": validate.bad_span(F.col("text"), span, False), "any": validate.bad_spans(F.col("text"), F.array(span))}
    return validate.violations(own, "k", rules).groupBy("rule").agg(F.count("*").alias("n"))


_RULES_SQL = """with o as (select o_orderkey % 4 = 0 a, o_orderkey % 6 = 0 b, o_orderkey % 7 = 0 c, o_orderkey % 5 = 0 d from orders) select 'range_or_text' as "rule", count(*) filter (a or b or c or d) n from o union all select 'range', count(*) filter (a or (b) or c) from o union all select 'any', count(*) filter (a or b or c or d) from o"""


def prompts(spark, sf):
    """STR-18 to STR-21, SRC-14, SRC-17: a template read from a file and filled, with examples, for each built-in text."""
    path = f"{scratch(spark, 'prompts')}.txt"
    writers.put(spark, path, inference.schema_prompt(["LOC", "PER", "LOC "], {"LOC": "a {place}"}, "Short notes.", "notes").encode())
    shown = F.array(F.struct(F.lit("In Rome").alias("text"), F.array(F.struct(F.lit("Rome").alias("text"), F.lit("LOC").alias("type"), F.lit(1).alias("start"), F.lit(1).alias("stop"))).alias("entities")))
    own = readers.sample_texts(spark).withColumn("tokens", inference.indexed(F.transform(tokens.tokenize("text"), lambda t: t["text"])))
    filled = inference.filled(readers.prompt_template(spark, path), {"tokens": F.col("tokens")})
    routing = inference.filled(inference.routing_prompt(["A", "B", "A"], "Ask {twice}."), {"text": F.col("text")})
    return own.select("name", filled.alias("prompt"), inference.few_shot(shown).alias("examples"), inference.few_shot(shown, False).alias("lines"), routing.alias("routing"))


_PROMPTS_SQL = f"""with s as (select * from (values ('release note', 'Ann Berg joined the Oslo office in May. She tests the new parser with two colleagues.'), ('ticket', 'The invoice of March is missing, and the portal shows an error.'), ('empty', '')) v("name", text)),
t as (select "name", text, {TOKENS} l from s)
select "name", E'The texts are from notes. Short notes.\\nMark every span of these types:\\n- LOC: a {{place}}\\n- PER\\nCopy each span from the text as it stands and give no span that the text does not hold. If there is none, reply with an empty list.\\nReply with JSON: {{"entities": [{{"text": "", "type": "", "start": 0, "end": 0}}]}}, inclusive token numbers.\\n\\n' || array_to_string(list_transform(range(0, len(l)), lambda i: i || ': ' || l[i + 1]), chr(10)) prompt,
E'Text: In Rome\\nAnswer:\\n{{"entities":[{{"text":"Rome","type":"LOC","start":1,"end":1}}]}}' examples, E'Text: In Rome\\nAnswer:\\nRome | LOC | 1 | 1' "lines",
E'Choose one department:\\n- A\\n- B\\nAsk {{twice}}.\\nUse a name from the list and none of your own. The evidence is a passage of the text, word for word.\\nReply with JSON: {{"department": "", "evidence": ""}}.\\n\\n' || text routing from t"""


def label_colours(spark, sf):
    """STR-24: a colour for each label by its place, the same in every run, and a darker one."""
    own = table(spark, sf, "nation").select("n_name", T.label_colour(F.col("n_name"), [f"{x}" for x in ("FRANCE", "CHINA")]).alias("colour"))
    return own.select("n_name", "colour", T.darker(F.col("colour")).alias("dark"))


_COLOURS_SQL = f"""with p as (select {T.PALETTE!r} p), n as (select n_name, case n_name when 'FRANCE' then 0 when 'CHINA' then 1 else ('0x' || substr(md5(n_name), 1, 6))::int % {len(T.PALETTE)} end i from nation), c as (select n_name, p[i + 1] colour from n, p)
select n_name, colour, '#' || lower(lpad(to_hex(('0x' || substr(colour, 2, 2))::int // 2), 2, '0')) || lower(lpad(to_hex(('0x' || substr(colour, 4, 2))::int // 2), 2, '0')) || lower(lpad(to_hex(('0x' || substr(colour, 6, 2))::int // 2), 2, '0')) dark from c"""


def unicode_blanks(spark, sf):
    """STR-01 to STR-04: all white space that Unicode knows is collapsed, and that of control characters."""
    signs = "  　\x1c\x1f\x85 \x0b\t\n"
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    sign = F.substring(F.lit(signs), (_k() % len(signs) + 1).cast("int"), F.lit(1))
    text = F.concat(sign, F.lit("A"), sign, sign, F.lit("ß​c"), F.lit(" "), sign)
    return own.select("k", T.fold(text).alias("folded"), T.squeeze(text).alias("squeezed"), T.strip_fences(F.concat(sign, F.lit("```json"), sign, F.lit("{}"), sign, F.lit("```"), sign)).alias("bare"))


def resumed_run(spark, sf):
    """STM-01 to STM-05, STM-07: a run whose budget ends it and whose failed rows are asked again; no answered row is asked twice."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    n = rows.count()
    folder, most = scratch(spark, "run"), 2 * n
    first = runner.Runner(spark, folder, ["k"], {"model": "m"}, n // 2)
    first.step(rows, 0, Fails, ["k"])
    second = runner.Runner(spark, folder, ["k"], {"model": "m"}, most)
    second.step(rows, 1, lambda: Fails(False), ["k"])
    second.step(rows, 1, lambda: Fails(False), ["k"])  # the same batch once more asks nothing
    done = second.results().groupBy("k").agg(F.count("*").alias("asked"), F.count_if(F.col("status") == "error").alias("failed"))
    return second.latest().select("k", "status", F.col("reply.text").alias("reply"), "batch").join(done, "k")


_RESUMED_SQL = """with c as (select c_custkey k, row_number() over (order by c_custkey) <= (select count(*) // 2 from customer) early from customer)
select k, 'ok' status, (2 * k)::varchar reply, case when early and k % 7 <> 0 then 0 else 1 end batch, case when early and k % 7 = 0 then 2 else 1 end::bigint asked, case when early and k % 7 = 0 then 1 else 0 end::bigint failed from c"""


# --- statements for queries of other modules

_PLACES = f"""d as (select doc_id, text, {SENTENCES} s from documents), f as (select * from d where len(s) >= 4),
a as (select *, strpos(text, s[1]) - 1 + length(s[1]) e0 from f), b as (select *, e0 + strpos(substr(text, e0 + 1), s[2]) - 1 b1 from a), b2 as (select *, b1 + length(s[2]) e1 from b),
b3 as (select *, e1 + strpos(substr(text, e1 + 1), s[3]) - 1 + length(s[3]) e2 from b2), w as (select *, e2 + strpos(substr(text, e2 + 1), s[4]) - 1 + length(s[4]) e3 from b3)"""
WINDOWS_SQL = f"""with {_PLACES} select doc_id || '__sent_000001_000004' example_id, md5(substr(text, b1 + 1, e3 - b1)) digest, 3 n_sentences, 1 n_entities, b1 > 0 or e3 < length(text) clipped, (e3 - b1)::integer as length from w"""
FLATTEN_SQL = f"""with {_PLACES} select count(*) windows, sum(3)::bigint sentences, count(*) entities, sum(e3 - b1)::bigint characters, 0::bigint violations from w"""
ROUNDED_SQL = f"""with t as (select l_orderkey k, list(distinct 'tag ' || (l_partkey % 6)) filter (l_linenumber % 2 = 1) g, list(distinct 'tag ' || (l_partkey % 6 + case when l_suppkey % 5 = 0 then 1 else 0 end)) filter (l_linenumber % 3 <> 0) p from lineitem group by 1),
c as (select coalesce(len(list_intersect(g, p)), 0) tp, coalesce(len(p), 0) np, coalesce(len(g), 0) ng from t), d as (select tp, np - tp fp, ng - tp fn from c), r as (select *, {PRF} from d),
s as (select sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from d), m as (select *, {PRF} from s), a as (select avg(round("precision", 4)) row_precision, avg(round(recall, 4)) row_recall, avg(round(f1, 4)) row_f1 from r)
select tp, fp, fn, m.precision micro_precision, m.recall micro_recall, m.f1 micro_f1, row_precision, row_recall, row_f1 from m, a"""
STUB_SQL = f"""with d as (select item_id, {SENTENCES} s from benchmark), x as (select item_id, i, regexp_extract_all(s[i], '{T.TOKEN.replace(chr(39), chr(39) * 2)}') t from (select item_id, s, unnest(range(1, len(s) + 1)) i from d)), v as (select * from x where len(t) > 0),
u as (select item_id, i, j - 1 j, t[j] tok from (select *, unnest(range(1, len(t) + 1)) j from v)), c as (select *, upper(tok[1]) = tok[1] and lower(tok[1]) <> tok[1] cap, (((j + length(tok)) % 4 <> 0)::int * 0 + ((j + length(tok)) % 3 <> 0)::int + ((j + length(tok)) % 4 <> 0)::int + ((j + length(tok)) % 2 <> 0)::int) votes from u),
k as (select item_id, sum(case when cap then votes else 0 end) total, count(*) filter (cap and votes > 0) n_entities, count(*) n_tokens from c group by 1), n as (select item_id, count(*) n from v group by 1)
select item_id, 3 * n llm_calls, (3 * n_tokens)::bigint input_tokens, (2 * total)::bigint output_tokens, n processed_sentences, n_entities::integer n_entities, total / 3.0::double confidence from k join n using (item_id)"""

QUERIES = {f.__name__: f for f in (classify_zero_shot, classify_two_steps, classify_with_neighbours, classification_scores, classification_error_rows, extraction_scores, extract_structured, extract_freeform, extract_in_two_steps, entity_changes, location_eval, route_by_model, route_by_index, nearest_to_texts, batch_groups, batch_summary, reviewed_exports, export_micro, export_labels, corpus_files, lenient_lines, mapped_columns, text_files, study_readiness, traced_examples, split_union, span_rules, prompts, label_colours, unicode_blanks, resumed_run)}

ORACLE_SQL = {
    "classify_zero_shot": _CLASSIFIED_SQL,
    "classify_two_steps": _CLASSIFIED_SQL,
    "classify_with_neighbours": _NEIGHBOURS_SQL,
    "classification_scores": _SCORECARD_SQL,
    "classification_error_rows": f"with {_RECORDS} select k, gt = pt type_correct, gq = pq queue_correct, tp, fp, fn from f where gt <> pt or gq <> pq or fp > 0 or fn > 0",
    "extraction_scores": _extraction_sql(),
    "extract_structured": _STRUCTURED_SQL,
    "extract_freeform": _FREEFORM_SQL,
    "extract_in_two_steps": _TWO_STEPS_SQL,
    "entity_changes": _CHANGES_SQL,
    "location_eval": _LOCATION_SQL,
    "route_by_model": """select c_custkey k, case when c_custkey % 4 <> 0 then c_mktsegment end department, case when c_custkey % 3 = 0 then 'Department' else '' end evidence, c_custkey % 3 = 0 evidence_valid, case when c_custkey % 4 = 0 then 'department is not allowed' end error from customer""",
    "route_by_index": _ROUTE_INDEX_SQL,
    "nearest_to_texts": _NEAREST_SQL,
    "batch_groups": _GROUPS_SQL,
    "batch_summary": _SUMMARY_SQL,
    "reviewed_exports": _REVIEWED_SQL,
    "export_micro": f"with {_EXPORTS}, s as (select count(*) documents, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from e where reason is null) select *, {PRF} from s",
    "export_labels": f"with {_EXPORTS} select 'd' || k doc_name, label, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from m group by 1, 2",
    "corpus_files": """select case c_custkey % 3 when 0 then 'train' when 1 then 'dev' else 'test' end source_split, case when c_custkey % 10 = 0 then 'json' when c_custkey % 7 = 0 then 'words' else 'good' end as "rule", count(*) n from customer group by 1, 2""",
    "lenient_lines": """select count(*) filter (c_custkey % 4 <> 0) n, (sum(c_custkey) filter (c_custkey % 4 <> 0))::bigint "keys", max(c_name) filter (c_custkey % 4 <> 0) "last", 0::bigint n_missing, count(*) n_tree, sum(c_custkey)::bigint tree_keys from customer""",
    "mapped_columns": "select c_custkey ticket_id, c_name as text, (select count(*) from customer) n_all from customer order by 1 limit 1000",
    "text_files": _FILES_SQL,
    "study_readiness": _READINESS_SQL,
    "traced_examples": """select 'corpus' source_dataset, o_orderkey::varchar example_id, o_custkey::varchar doc_id, 's' || case when o_custkey % 97 = 0 then o_orderkey % 2 else o_custkey % 2 end source_split, o_orderstatus length_bucket, (o_orderkey % 30)::integer sentence_count from orders where o_custkey % 10 <> 7""",
    "split_union": "select 'same' as \"case\", true same union all select 'one more', false",
    "span_rules": _RULES_SQL,
    "prompts": _PROMPTS_SQL,
    "label_colours": _COLOURS_SQL,
    "unicode_blanks": "select c_custkey k, 'a ß' || chr(8203) || 'c' folded, 'A ß' || chr(8203) || 'c' squeezed, '{}' bare from customer",
    "resumed_run": _RESUMED_SQL,
    "flex_overlap_prf": FLEX_OVERLAP_SQL,
    "dominant_matches": DOMINANT_SQL,
    "flex_tolerant_prf": FLEX_TOLERANT_SQL,
    "window_records": WINDOWS_SQL,
    "flatten_roundtrip": FLATTEN_SQL,
    "tag_metrics_rounded": ROUNDED_SQL,
    "stub_llm_pipeline": STUB_SQL,
}
