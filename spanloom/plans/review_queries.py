"""Queries on votes, review logs and retrieval, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, parsing, retrieval, review, votes
from ..runtime import table
from .derived import REVIEW_SQL, SCORES_SQL, VOTES_SQL, view

RUNS = ["click", "error", "purchase", "signup", "view"]


def _runs(spark):
    return spark.createDataFrame([(r, i) for i, r in enumerate(RUNS)], "run string, pos int")


def vote_aggregation(spark, sf):
    """AGG-20."""
    own = votes.aggregate_votes(view(spark, sf, VOTES_SQL), _runs(spark), ["doc"])
    return own.select("doc", "start", "stop", "type", "votes", "total", F.array_join("voters", ",").alias("voters"), "confidence")


def agreement_report(spark, sf):
    """AGG-21, JON-12."""
    return votes.agreement(view(spark, sf, VOTES_SQL), _runs(spark), ["doc"])


def unanimous_spans(spark, sf):
    """AGG-21."""
    return votes.unanimous(view(spark, sf, VOTES_SQL), _runs(spark), ["doc"])


def agreement_matrix(spark, sf):
    """RNK-14."""
    return votes.agreement_matrix(view(spark, sf, VOTES_SQL), RUNS, ["doc"])


def logprob_confidence(spark, sf):
    """AGG-22: words with probabilities by arithmetic; the confidence of the third word and of one that does not occur."""
    own = table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    toks = F.transform("w", lambda w, i: F.struct(F.concat(w, F.lit(" ")).alias("token"), (-(i % 7) / 10.0).cast("double").alias("logprob")))
    own = own.withColumn("t", toks)
    return own.select("item_id", votes.logprob_confidence(F.col("t"), F.concat(F.get("w", F.lit(2)), F.lit(" "), F.get("w", F.lit(3)))).alias("confidence"), votes.logprob_confidence(F.col("t"), F.lit("#none#")).alias("missing"))


def flag_threshold(spark, sf):
    """RNK-04, RNK-06."""
    own = review.flag_by_threshold(view(spark, sf, SCORES_SQL))
    return own.select("id", "flagged", review.band(F.col("confidence")).alias("band"), review.needs_review(F.col("confidence")).alias("needs_review"))


def flag_budget(spark, sf):
    """RNK-04."""
    return review.flag_by_budget(view(spark, sf, SCORES_SQL), ["doc"]).select("id", "flagged")


def review_signal(spark, sf):
    """RNK-05."""
    return review.has_signal(view(spark, sf, SCORES_SQL), ["doc"])


def review_summary(spark, sf):
    """AGG-30."""
    return review.summary(review.flag_by_budget(view(spark, sf, SCORES_SQL), ["doc"]), ["doc"])


def review_queue_order(spark, sf):
    """RNK-07."""
    return review.queue(view(spark, sf, SCORES_SQL), ["doc"]).select("doc", "id", "place")


def span_numbers(spark, sf):
    """RNK-08."""
    return review.numbered(view(spark, sf, SCORES_SQL), ["doc"]).select("doc", "id", "num")


def annotation_metrics(spark, sf):
    """AGG-24."""
    return review.annotation_metrics(view(spark, sf, REVIEW_SQL), ["doc"])


def confidence_diagnostics(spark, sf):
    """AGG-25."""
    return review.confidence_diagnostics(view(spark, sf, REVIEW_SQL), ["doc"])


def interventions_by_label(spark, sf):
    """AGG-27."""
    return review.interventions(view(spark, sf, REVIEW_SQL))


def review_progress(spark, sf):
    """AGG-31."""
    return review.progress(view(spark, sf, REVIEW_SQL), ["doc"])


def unpivot_rates(spark, sf):
    """RNK-15, AGG-29."""
    rates = ["acceptance_rate", "edit_rate", "deletion_rate"]
    return review.unpivot_rates(review.annotation_metrics(view(spark, sf, REVIEW_SQL), ["doc"]), ["doc"], rates).groupBy("rate").agg(F.avg("value").alias("mean"))


def routing_acceptance(spark, sf):
    """AGG-26, MUT-04."""
    own = table(spark, sf, "orders").selectExpr("concat('c', o_orderkey % 3) classifier", "case when o_orderkey % 11 = 0 then null else concat('D', o_custkey % 4) end predicted", "concat('D', o_orderkey % 4) approved")
    return review.routing_acceptance(own.withColumn("review_status", review.routing_status(F.col("predicted"), F.col("approved"))))


def apply_review_edits(spark, sf):
    """MUT-01, MUT-02, JON-14."""
    own = view(spark, sf, SCORES_SQL)
    edits = table(spark, sf, "orders").selectExpr("o_orderkey id", "case o_orderstatus when 'F' then 'click' else 'view' end new_type", "o_orderkey % 2 = 0 confirmed", "o_orderkey % 17 = 0 delete")
    out = review.apply_edits(own, edits)
    return review.confirm_pending(out, F.col("confidence") >= 0.5).select("id", "type", "status")


def manual_spans(spark, sf):
    """MUT-03."""
    own = table(spark, sf, "documents").select("doc_id", review.manual_span(F.col("text"), F.lit(" the ")).alias("s"))
    return own.select("doc_id", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"))


def export_documents(spark, sf):
    """SNK-10."""
    own = view(spark, sf, REVIEW_SQL).withColumns({"start": F.col("id"), "stop": F.col("id") + 1, "text": F.lit("t")})
    return review.export_documents(own, ["doc"]).select("doc", F.size("model_predictions").cast("long").alias("n_model"), F.size("gold_entities").cast("long").alias("n_gold"), F.size("review_log").cast("long").alias("n_log"))


def ticket_routing(spark, sf):
    """VAL-05, JON-15, STR-15."""
    own = table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn id", "text", "case turn % 3 when 0 then ' BILLING ' when 1 then 'it' else 'other' end department", "case when turn % 2 = 0 then substr(text, 3, 9) else 'not in it #' end evidence")
    return parsing.routed(own, ["Billing", "IT"]).select("id", "department", "evidence", "evidence_valid", "error")


def knn_topk(spark, sf):
    """RNK-01, JON-10: the five most similar vectors of each query vector (ids divisible by 50)."""
    own = table(spark, sf, "embeddings")
    return retrieval.top_k(own.filter("vec_id % 50 = 0"), own, 5).select("query_id", "rank", "vec_id", F.round("similarity", 9).alias("similarity"))


def knn_overfetch_filter(spark, sf):
    """RNK-02, JON-16: three of the fifteen nearest that have an even label."""
    own = table(spark, sf, "embeddings")
    hits = retrieval.top_k(own.filter("vec_id % 50 = 0"), own, 3 * retrieval.OVERFETCH, extra=("label",))
    return retrieval.filtered(hits, F.col("label") % 2 == 0, 3).select("query_id", "rank", "vec_id", "label")


def knn_weighted_vote(spark, sf):
    """AGG-23."""
    own = table(spark, sf, "embeddings")
    hits = retrieval.top_k(own.filter("vec_id % 50 = 0"), own, 5, extra=("label",))
    return retrieval.weighted_vote(hits, "label").withColumn("confidence", F.round("confidence", 9))


def index_quality(spark, sf):
    """SRC-15, SNK-08, VAL-10."""
    return retrieval.index_quality(table(spark, sf, "embeddings"), "vec_id", "embedding")


def value_summary(spark, sf):
    """AGG-17."""
    return corpus.summary(table(spark, sf, "events"), ["event_type"], "value").withColumnRenamed("n", "events")


def windows_per_document(spark, sf):
    """AGG-18: how many orders have so many lines."""
    return corpus.counts_of_counts(table(spark, sf, "lineitem"), "l_orderkey")


QUERIES = {f.__name__: f for f in (vote_aggregation, agreement_report, unanimous_spans, agreement_matrix, logprob_confidence, flag_threshold, flag_budget, review_signal, review_summary, review_queue_order, span_numbers, annotation_metrics, confidence_diagnostics, interventions_by_label, review_progress, unpivot_rates, routing_acceptance, apply_review_edits, manual_spans, export_documents, ticket_routing, knn_topk, knn_overfetch_filter, knn_weighted_vote, index_quality, value_summary, windows_per_document)}

_POS = "list_position(['click', 'error', 'purchase', 'signup', 'view'], run)"
_V = f"with v as ({VOTES_SQL}), s as (select distinct doc, start, stop, type, run from v)"
_S = f"with s as ({SCORES_SQL})"
_R = f"with r as ({REVIEW_SQL})"
_CUT = """, a as (select doc, list_sort(list(confidence) filter (confidence is not null)) c, count(confidence) n from s group by doc),
k as (select *, greatest(1, round_even(n * 0.2, 0)::integer) k from a), cuts as (select doc, case when n > 0 and c[least(k, n)] < c[n] and c[n] - c[1] >= 0.01 then c[least(k, n)] end cut from k),
f as (select s.*, confidence is null or coalesce(confidence <= cut, false) flagged from s join cuts using (doc))"""
_METRICS = """, m as (select doc, count(*) filter (source = 'model') model_suggested, count(*) filter (source = 'model' and status = 'confirmed') confirmed_as_is, count(*) filter (source = 'model' and status = 'edited') relabeled_by_human,
count(*) filter (source = 'model' and status = 'deleted') deleted_by_human, count(*) filter (source = 'human') added_by_human from r group by doc),
t as (select *, confirmed_as_is::double / nullif(model_suggested, 0) acceptance_rate, relabeled_by_human::double / nullif(model_suggested, 0) edit_rate, deleted_by_human::double / nullif(model_suggested, 0) deletion_rate from m)"""
_KNN = """with u as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings), s as (select q.vec_id query_id, i.vec_id, i.label, list_dot_product(q.e, i.e) sim from u q join u i on q.vec_id <> i.vec_id where q.vec_id % 50 = 0),
h as (select *, row_number() over (partition by query_id order by sim desc, vec_id desc) r from s qualify r <= {0})"""
ORACLE_SQL = {
    "vote_aggregation": f"{_V} select doc, start, stop, type, count(*) votes, 5::bigint total, string_agg(run, ',' order by {_POS}) voters, count(*)::double / 5 confidence from s group by doc, start, stop, type",
    "agreement_report": f"""with v as ({VOTES_SQL}), s as (select distinct doc, start, stop, type, run from v), n as (select run, count(*) n from s group by run),
p as (select a.run a, b.run b, a.n n_a, b.n n_b from n a join n b on list_position(['click', 'error', 'purchase', 'signup', 'view'], a.run) < list_position(['click', 'error', 'purchase', 'signup', 'view'], b.run)),
x as (select a.run a, b.run b, count(*) shared from s a join s b on (a.doc, a.start, a.stop, a.type) = (b.doc, b.start, b.stop, b.type) group by 1, 2)
select p.a, p.b, n_a, n_b, coalesce(shared, 0) shared, n_a - coalesce(shared, 0) only_a, n_b - coalesce(shared, 0) only_b, coalesce(shared, 0)::double / (n_a + n_b - coalesce(shared, 0)) jaccard from p left join x using (a, b)""",
    "unanimous_spans": f"{_V}, g as (select count(*) n from s group by doc, start, stop, type) select count(*) n_union, count(*) filter (n = 5) n_unanimous, count(*) filter (n = 5)::double / count(*) share_unanimous from g",
    "agreement_matrix": f"with v as ({VOTES_SQL}) select doc, start, stop, type, " + ", ".join(f'bool_or(run = \'{r}\') "{r}"' for r in RUNS) + ", count(distinct run) agreement from v group by doc, start, stop, type",
    "logprob_confidence": """with w as (select item_id, string_split(text, ' ') w from benchmark), u as (select item_id, w, i, w[i] || ' ' tok, -((i - 1) % 7) / 10.0::double lp from (select *, unnest(range(1, len(w) + 1)) i from w)),
o as (select *, sum(length(tok)) over (partition by item_id order by i) stop from u), r as (select item_id, string_agg(tok, '' order by i) t from u group by 1),
n as (select item_id, strpos(t, w[3] || ' ' || w[4]) - 1 a, length(w[3] || ' ' || w[4]) l from r join w using (item_id))
select item_id, exp(avg(lp) filter (stop - length(tok) < a + l and stop > a)) confidence, null::double missing from o join n using (item_id) group by item_id""",
    "flag_threshold": f"{_S} select id, confidence is null or confidence < 0.8 flagged, case when confidence is null then 'unknown' when confidence >= 0.999 then 'high' when confidence >= 0.8 then 'medium' else 'low' end band, confidence is null or confidence < 0.8 needs_review from s",
    "flag_budget": f"{_S}{_CUT} select id, flagged from f",
    "review_signal": f"{_S}, a as (select doc, count(confidence) n_scored, case when count(confidence) > 1 then max(confidence) - min(confidence) else 0 end::double spread from s group by doc) select *, spread >= 0.01 has_signal from a",
    "review_summary": f"{_S}{_CUT} select doc, count(*) n_entities, count(confidence) n_scored, count(*) filter (flagged) n_flagged, avg(confidence) mean_confidence, count(*) filter (flagged)::double / count(*) share_flagged from f group by doc",
    "review_queue_order": f"{_S} select doc, id, row_number() over (partition by doc order by confidence nulls first, start, pos)::integer place from s",
    "span_numbers": f"{_S} select doc, id, case when status <> 'deleted' then row_number() over (partition by doc, status = 'deleted' order by start, pos) end::integer num from s",
    "annotation_metrics": f"{_R}{_METRICS} select * from t",
    "confidence_diagnostics": f"""{_R}, s as (select *, confidence < 0.75 f, status in ('edited', 'deleted') c from r where source = 'model' and confidence is not null),
a as (select doc, count(*) n_scored, count(*) filter (f) n_flagged, count(*) filter (c) n_changed, count(*) filter (f and c) h, avg(confidence) mean_confidence from s group by doc),
b as (select *, h::double / nullif(n_flagged, 0) fp, (n_changed - h)::double / nullif(n_scored - n_flagged, 0) u from a)
select doc, n_scored, n_flagged, n_changed, mean_confidence, n_flagged::double / n_scored share_flagged, fp flag_precision, h::double / nullif(n_changed, 0) flag_recall, u change_rate_unflagged, case when u > 0 then fp / u when u = 0 and fp > 0 then 'infinity'::double end lift from b""",
    "interventions_by_label": f"{_R} select type, status, count(*) n from r group by 1, 2",
    "review_progress": f"{_R} select doc, count(*) reviewed, 0::bigint pending, count(*) filter (status = 'edited') relabelled from r group by doc",
    "unpivot_rates": f"{_R}{_METRICS} select 'acceptance_rate' rate, avg(acceptance_rate) mean from t union all select 'edit_rate', avg(edit_rate) from t union all select 'deletion_rate', avg(deletion_rate) from t",
    "routing_acceptance": """with o as (select 'c' || (o_orderkey % 3) classifier, o_custkey % 4 = o_orderkey % 4 same from orders where o_orderkey % 11 <> 0)
select classifier, count(*) reviewed, count(*) filter (same) accepted, 100.0::double * count(*) filter (same) / count(*) acceptance_rate from o group by 1""",
    "apply_review_edits": f"""{_S}, e as (select o_orderkey id, case o_orderstatus when 'F' then 'click' else 'view' end nt, o_orderkey % 2 = 0 c, o_orderkey % 17 = 0 d from orders),
j as (select s.id, confidence, case when e.id is not null and not d then nt else type end as type, case when e.id is null then status when d then 'deleted' when nt <> type then 'edited' when c then 'confirmed' else 'pending' end st from s left join e using (id))
select id, type, case when st = 'pending' and confidence >= 0.5 then 'confirmed' else st end status from j""",
    "manual_spans": "select doc_id, case when strpos(text, ' the ') > 0 then strpos(text, ' the ') - 1 end::integer as start, case when strpos(text, ' the ') > 0 then strpos(text, ' the ') + 4 end::integer as stop from documents",
    "export_documents": f"{_R} select doc, count(*) filter (source = 'model') n_model, count(*) filter (status in ('confirmed', 'edited')) n_gold, count(*) n_log from r group by doc",
    "ticket_routing": r"""with c as (select conv_id * 1000 + turn id, text, case turn % 3 when 0 then 'Billing' when 1 then 'IT' end department, case when turn % 2 = 0 then substr(text, 3, 9) else 'not in it #' end e from conversations),
v as (select *, trim(regexp_replace(lower(e), '\s+', ' ', 'g')) ne, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) nt from c), w as (select *, ne <> '' and contains(nt, ne) ok from v)
select id, department, case when ok then e else '' end evidence, ok evidence_valid, case when department is null then 'department is not allowed' end error from w""",
    "knn_topk": _KNN.format(5) + " select query_id, r::integer rank, vec_id, round(sim, 9) similarity from h",
    "knn_overfetch_filter": _KNN.format(15) + ", k as (select *, row_number() over (partition by query_id order by r) k from h where label % 2 = 0) select query_id, k::integer rank, vec_id, label from k where k <= 3",
    "knn_weighted_vote": _KNN.format(5) + ", w as (select query_id, label, sum(case when sim > 0 then sim else 1e-9 / r end) w, max(sim) best from h group by 1, 2) select query_id, label, round(w / sum(w) over (partition by query_id), 9) confidence from w qualify row_number() over (partition by query_id order by w desc, best desc, label desc) = 1",
    "index_quality": "with v as (select vec_id, embedding e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) n from embeddings) select count(*) n_rows, count(distinct vec_id) n_keys, min(len(e))::integer min_dimension, max(len(e))::integer max_dimension, count(*) filter (len(list_filter(e, lambda x: not isfinite(x))) > 0) n_not_finite, count(*) filter (n = 0) n_zero, count(*) filter (abs(n - 1) > 1e-5) n_not_unit from v",
    "value_summary": "select event_type, count(*) events, min(value) as min, max(value) as max, avg(value) mean, median(value) median from events group by 1",
    "windows_per_document": "select windows, count(*) documents from (select count(*) windows from lineitem group by l_orderkey) group by 1",
}
