"""Queries on spans and labels, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import set_counts, with_prf
from ..operators import scoring, spans
from ..runtime import parts_for, table, written
from .derived import GOLD_SQL, PREDICTED_SQL, view
from .text_queries import BLANKS, NORM

GP = f"gold as ({GOLD_SQL}), pred as ({PREDICTED_SQL})"
PRF = """case when tp + fp > 0 then tp::double / (tp + fp) else 0 end as "precision", case when tp + fn > 0 then tp::double / (tp + fn) else 0 end as recall,
  case when tp > 0 then 2 * (tp::double / (tp + fp)) * (tp::double / (tp + fn)) / (tp::double / (tp + fp) + tp::double / (tp + fn)) else 0 end as f1"""
SPAN = ["example", "start", "stop", "label"]
SETS = f"""{GP}, g as (select distinct example, start, stop, label from gold), p as (select distinct example, start, stop, label from pred),
m as (select coalesce(g.example, p.example) example, coalesce(g.label, p.label) label, coalesce(g.start, p.start) start, coalesce(g.stop, p.stop) stop, g.example is not null has_g, p.example is not null has_p
  from g full join p on g.example = p.example and g.start = p.start and g.stop = p.stop and g.label = p.label)"""
COUNTS = "count(*) filter (has_g and has_p) tp, count(*) filter (has_p and not has_g) fp, count(*) filter (has_g and not has_p) fn"


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, GOLD_SQL)


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, PREDICTED_SQL)


def _strict_counts(spark: SparkSession, sf: str, *groups: str | Column) -> DataFrame:
    """Strict counts by groups that the keys give; Parquet tells the number of its rows without reading them."""
    return set_counts(_gold(spark, sf), _predicted(spark, sf), list(groups), SPAN, parts_for(table(spark, sf, "lineitem").count(), spark))


def strict_prf_by_label(spark, sf):
    """SET-01, AGG-01, AGG-13."""
    return with_prf(_strict_counts(spark, sf, "label"))


def prf_by_grouping(spark, sf):
    """AGG-13: totals, by bucket and by split, from one set of matches."""
    own = _strict_counts(spark, sf, (F.col("example") % 4).alias("bucket"), (F.col("example") % 3).alias("split"))
    groups = F.grouping_id()
    out = own.groupingSets([[], ["bucket"], ["split"]], "bucket", "split").agg(groups.cast("long").alias("grouping_id"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return with_prf(out)


def _multiset(keys):
    def query(spark, sf):
        own = scoring.extraction_counts(_gold(spark, sf), _predicted(spark, sf), ["example"], keys)
        return with_prf(own.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))

    return query


def _multiset_sql(keys: str, group: str = "") -> str:
    k = f"example, {keys}{', ' + group if group else ''}"
    norm = f"trim(regexp_replace(text, '{BLANKS}', ' ', 'g')) key_text"
    return f"""with {GP}, g as (select {k}, count(*) n from (select *, {norm} from gold) group by all), p as (select {k}, count(*) n from (select *, {norm} from pred) group by all),
c as (select {group + "," if group else ""} sum(least(coalesce(g.n, 0), coalesce(p.n, 0)))::bigint tp, sum(greatest(coalesce(p.n, 0) - coalesce(g.n, 0), 0))::bigint fp, sum(greatest(coalesce(g.n, 0) - coalesce(p.n, 0), 0))::bigint fn from g full join p using ({k}) group by all)
select *, {PRF}{", tp + fn as support" if group else ""} from c"""


def per_type_support(spark, sf):
    """AGG-11."""
    return scoring.per_type(_gold(spark, sf), _predicted(spark, sf), "example", "label")


def macro_doc_f1(spark, sf):
    """AGG-14: documents are customers' orders here."""
    return scoring.macro_f1(_strict_counts(spark, sf, (F.col("example") % 200).alias("doc")), "doc")


def bootstrap_ci(spark, sf):
    """AGG-15 with draws that SQL can repeat."""
    counts = written(_strict_counts(spark, sf, (F.col("example") % 50).alias("number")), "clusters")  # counted, drawn from and summed
    return scoring.bootstrap(counts, scoring.portable_draws(counts.select("number"), 200), 200)


BOOTSTRAP_SQL = f"""with {SETS}, c as (select example % 50 number, {COUNTS} from m group by 1), k as (select count(*) n from c),
d as (select it, cast('0x' || substr(md5(it::varchar || ':' || number::varchar), 1, 8) as bigint) % (select n from k) number from c, range(200) r(it)),
s as (select it, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from d join c using (number) group by it), v as (select it, {PRF} from s),
u as (select 'precision' metric, "precision" v from v union all select 'recall', recall from v union all select 'f1', f1 from v)
select metric, list_sort(list(v))[6] lower_95, list_sort(list(v))[196] upper_95 from u group by metric"""


def overlap_candidates(spark, sf):
    """JON-07."""
    return spans.candidates(_gold(spark, sf), _predicted(spark, sf), ["example"], "overlap")


def flex_overlap_prf(spark, sf):
    """JON-07, JON-08: greedy one-to-one matching by overlap."""
    own = spans.flexible_counts(_gold(spark, sf), _predicted(spark, sf), ["example"], "overlap")
    return with_prf(own.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def flex_tolerant_prf(spark, sf):
    """JON-07, JON-08: ends may differ by some tokens; a token is three characters here."""
    tokens = {"first": F.floor(F.col("start") / 3).cast("int"), "last": F.floor((F.col("stop") - 1) / 3).cast("int")}
    own = spans.flexible_counts(_gold(spark, sf).withColumns(tokens), _predicted(spark, sf).withColumns(tokens), ["example"], "boundary_tolerant")
    return with_prf(own.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def dominant_matches(spark, sf):
    """JON-08: the pairs that greedy matching takes over labels of many examples, by rounds of pairs that are best at both ends."""
    side = lambda rows, x: rows.select((F.col("example") % 50).alias("example"), (F.col("start") + F.floor(F.col("example") / 50) % 40 * 7).cast("int").alias("start"), (F.col("stop") + F.floor(F.col("example") / 50) % 40 * 7).cast("int").alias("stop"), "label")
    pairs = spans.candidates(side(_gold(spark, sf), "g"), side(_predicted(spark, sf), "p"), ["example"], "overlap")
    return spans.one_to_one(pairs, ["example"], rounds=3).select("example", "label", "p_start", "p_stop", "g_start", "g_stop")


def fp_listing(spark, sf):
    """SET-02."""
    return spans.listing(_predicted(spark, sf), _gold(spark, sf), SPAN)


def fn_listing(spark, sf):
    """SET-02."""
    return spans.listing(_gold(spark, sf), _predicted(spark, sf), SPAN)


def window_overlap_stats(spark, sf):
    """JON-06, AGG-18: pairs of windows of a document that overlap."""
    own = _gold(spark, sf).withColumn("key", F.col("example") * 10 + F.col("line"))
    pairs = spans.overlapping_pairs(own, ["example"], "key")
    return pairs.agg(F.count("*").alias("pairs"), F.max("ratio").alias("max_ratio"), F.round(F.avg("ratio"), 9).alias("mean_ratio"))


def prefix_cutoff(spark, sf):
    """PRJ-06: spans up to a document's cutoff."""
    cut = _gold(spark, sf).groupBy("example").agg(F.lit(60).alias("cutoff")).filter("example % 2 = 0")
    return spans.within_cutoff(_gold(spark, sf), cut, "example").groupBy("example").agg(F.count("*").alias("kept"))


def containment(spark, sf):
    """JON-04, JON-05: spans inside windows and spans cut by them."""
    windows = table(spark, sf, "orders").selectExpr("o_orderkey example", "o_orderkey % 7 window_id", "cast(o_custkey % 30 as int) start", "cast(o_custkey % 30 + 45 as int) stop")
    inside = spans.contained(_gold(spark, sf), windows, "example").groupBy("window_id").agg(F.count("*").alias("inside"), F.sum("start").alias("starts"))
    cut = spans.clipped(_gold(spark, sf), windows, "example").groupBy("window_id").agg(F.count("*").alias("met"), F.count_if("clipped").alias("clipped"), F.sum(F.col("stop") - F.col("start")).alias("length"))
    return inside.join(cut, "window_id")


def coverage_missing_unknown(spark, sf):
    """JON-01, JON-02, AGG-16."""
    gold = table(spark, sf, "orders").selectExpr("o_orderkey id")
    key = F.when(F.col("l_orderkey") % 10 == 3, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    predicted = table(spark, sf, "lineitem").groupBy(key.alias("id")).agg(F.when(F.max("l_linenumber") == 7, "error").otherwise("ok").alias("status"))
    return scoring.coverage(gold, predicted, "id")


def latest_prediction(spark, sf):
    """PRJ-08: the last row of each key."""
    return scoring.latest(table(spark, sf, "events").select("user_id", "event_type", "value", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value", "event_id")


def run_totals(spark, sf):
    """AGG-16, STR-26."""
    rows = table(spark, sf, "events").selectExpr("event_id", "case when event_id % 4 = 0 then null else event_id % 50 end input_tokens", "event_id % 20 output_tokens")
    own = scoring.run_totals(rows)
    return own.withColumn("cost_usd", F.col("input_tokens") * 0.5 / 1e6 + F.col("output_tokens") * 1.5 / 1e6)


def accuracy_macro_f1(spark, sf):
    """AGG-02."""
    rows = table(spark, sf, "labels").selectExpr("case quality when 1 then ' Good  One' when 0 then 'bad' else '' end g", "case when toxic = 1 then 'BAD' when doc_id % 5 = 0 then '' else 'good one' end p")
    return scoring.accuracy_macro_f1(rows, "g", "p")


def _tag_sets(spark, sf):
    own = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("Tag "), (F.col("l_partkey") % 6).cast("string")))).alias("gold"),
        F.collect_set(F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("tag  "), (F.col("l_partkey") % 6 + F.when(F.col("l_suppkey") % 5 == 0, 1).otherwise(0)).cast("string")))).alias("predicted"),
    )
    return own


def tag_set_metrics(spark, sf):
    """AGG-03: counts and ratios over all rows (AGG-04 rounds the rows' ratios with Python's rule, which is tested apart)."""
    own = scoring.tag_rows(_tag_sets(spark, sf), "gold", "predicted")
    sums = own.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.avg("precision").alias("row_precision"), F.avg("recall").alias("row_recall"), F.avg("f1").alias("row_f1"))
    return sums


TAGS_SQL = f"""with t as (select l_orderkey k, list(distinct 'tag ' || (l_partkey % 6)) filter (l_linenumber % 2 = 1) g, list(distinct 'tag ' || (l_partkey % 6 + case when l_suppkey % 5 = 0 then 1 else 0 end)) filter (l_linenumber % 3 <> 0) p from lineitem group by 1),
c as (select coalesce(len(list_intersect(g, p)), 0) tp, coalesce(len(p), 0) np, coalesce(len(g), 0) ng from t), d as (select tp, np - tp fp, ng - tp fn from c), r as (select *, {PRF} from d)
select sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn, avg("precision") row_precision, avg(recall) row_recall, avg(f1) row_f1 from r"""


def tag_metrics_rounded(spark, sf):
    """AGG-04 with rows' ratios rounded to four places as Python does."""
    return scoring.tag_metrics(_tag_sets(spark, sf), "gold", "predicted")


def evidence_valid_rate(spark, sf):
    """STR-14, AGG-05: the first words of a conversation's turn as evidence for its text, some of them spoilt."""
    own = table(spark, sf, "conversations").withColumn("n", F.lit(12) + F.col("turn").cast("int"))
    ev = F.array(F.concat(F.lit("  "), F.substring("text", F.lit(1), F.col("n"))), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.substring("text", 5, 6), F.lit("#"))))
    return scoring.evidence_rate(own.withColumn("e", ev), "e", "text")


def json_validity_rates(spark, sf):
    """AGG-06, AGG-09, AGG-10."""
    rows = table(spark, sf, "events").selectExpr("case event_id % 3 when 0 then true when 1 then false end all_json_valid", "case when event_id % 5 = 0 then true when event_id % 5 = 1 then false end not_applicable", "case when event_id % 7 = 0 then true when event_id % 7 < 3 then false end has_invalid_labels")
    return scoring.json_rates(rows)


def leaderboard_union(spark, sf):
    """RNK-13."""
    a = table(spark, sf, "nation").selectExpr("n_name name", "cast(n_nationkey * 7 % 25 as double) score", "n_regionkey region")
    b = table(spark, sf, "region").selectExpr("r_name name", "cast(r_regionkey as double) + 0.5 score")
    return scoring.leaderboard([a, b], "score")


def split_disjointness(spark, sf):
    """SET-05: texts that occur in several splits."""
    from ..functions.text import fold
    from ..operators.validate import split_leaks

    rows = table(spark, sf, "documents").select(fold(F.col("text")).alias("t"), (F.col("doc_id") % 3).alias("split"))
    return split_leaks(rows.withColumn("key", F.md5("t")), "key", "split")


QUERIES = {f.__name__: f for f in (strict_prf_by_label, prf_by_grouping, per_type_support, macro_doc_f1, bootstrap_ci, overlap_candidates, flex_overlap_prf, flex_tolerant_prf, dominant_matches, fp_listing, fn_listing, window_overlap_stats, prefix_cutoff, containment, coverage_missing_unknown, latest_prediction, run_totals, accuracy_macro_f1, tag_set_metrics, tag_metrics_rounded, evidence_valid_rate, json_validity_rates, leaderboard_union, split_disjointness)}
QUERIES |= {"multiset_prf_strict": _multiset(scoring.STRICT), "multiset_prf_lenient": _multiset(scoring.LENIENT)}

ORACLE_SQL = {
    "strict_prf_by_label": f"with {SETS}, c as (select label, {COUNTS} from m group by label) select *, {PRF} from c",
    "prf_by_grouping": f"with {SETS}, e as (select example, example % 4 bucket, example % 3 split, {COUNTS} from m group by 1), c as (select bucket, split, grouping(bucket, split)::bigint grouping_id, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from e group by grouping sets ((), (bucket), (split))) select *, {PRF} from c",
    "multiset_prf_strict": _multiset_sql("key_text, start, stop"),
    "multiset_prf_lenient": _multiset_sql("key_text"),
    "per_type_support": _multiset_sql("key_text, start, stop", "label"),
    "macro_doc_f1": f"with {SETS}, d as (select example % 200 doc, {COUNTS} from m group by 1), r as (select {PRF} from d) select count(*) n_documents, avg(f1) macro_f1 from r",
    "bootstrap_ci": BOOTSTRAP_SQL,
    "overlap_candidates": f"""with {GP}, g as (select distinct example, start, stop, label from gold), p as (select distinct example, start, stop, label from pred)
select example, label, p.start p_start, p.stop p_stop, g.start g_start, g.stop g_stop, (least(p.stop, g.stop) - greatest(p.start, g.start))::double / (greatest(p.stop, g.stop) - least(p.start, g.start)) score
from p join g using (example, label) where greatest(p.start, g.start) < least(p.stop, g.stop)""",
    "fp_listing": f"with {GP} select distinct example, start, stop, label from pred where (example, start, stop, label) not in (select (example, start, stop, label) from gold)",
    "fn_listing": f"with {GP} select distinct example, start, stop, label from gold where (example, start, stop, label) not in (select (example, start, stop, label) from pred)",
    "window_overlap_stats": f"""with {GP}, w as (select example, example * 10 + line k, start, stop from gold), r as (select (least(a.stop, b.stop) - greatest(a.start, b.start))::double / least(a.stop - a.start, b.stop - b.start) ratio
from w a join w b on a.example = b.example and a.k < b.k and greatest(a.start, b.start) < least(a.stop, b.stop)) select count(*) pairs, max(ratio) max_ratio, round(avg(ratio), 9) mean_ratio from r""",
    "prefix_cutoff": f"with {GP} select example, count(*) kept from gold where example % 2 <> 0 or stop <= 60 group by 1",
    "containment": f"""with {GP}, w as (select o_orderkey example, o_orderkey % 7 window_id, o_custkey % 30 w0, o_custkey % 30 + 45 w1 from orders),
i as (select window_id, count(*) inside, sum(start - w0)::bigint starts from gold join w using (example) where start >= w0 and stop <= w1 group by 1),
c as (select window_id, count(*) met, count(*) filter (start < w0 or stop > w1) clipped, sum(least(stop, w1) - greatest(start, w0))::bigint length from gold join w using (example) where not (stop <= w0 or start >= w1) group by 1)
select * from i join c using (window_id)""",
    "coverage_missing_unknown": """with g as (select o_orderkey id from orders), p as (select case when l_orderkey % 10 = 3 then -l_orderkey else l_orderkey end id, case when max(l_linenumber) = 7 then 'error' else 'ok' end status from lineitem group by 1),
b as (select g.id gid, p.id pid, status from g full join p on g.id = p.id),
c as (select count(gid) n_gold, count(*) filter (gid is not null and pid is null) n_missing, count(*) filter (gid is not null and status = 'error') n_failed, count(*) filter (gid is null) n_unknown from b)
select *, (n_gold - n_missing - n_failed)::double / n_gold coverage_rate from c""",
    "latest_prediction": "select user_id, event_type, value, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "run_totals": "with r as (select case when event_id % 4 = 0 then null else event_id % 50 end i, event_id % 20 o from events) select sum(coalesce(i, 0))::bigint input_tokens, sum(o)::bigint output_tokens, sum(coalesce(i, 0)) * 0.5::double / 1e6 + sum(o) * 1.5::double / 1e6 cost_usd from r",
    "accuracy_macro_f1": f"""with r as (select case quality when 1 then 'good one' when 0 then 'bad' else '' end g, case when toxic = 1 then 'bad' when doc_id % 5 = 0 then '' else 'good one' end p from labels),
l as (select g l from r union select p from r), c as (select l, count(*) filter (g = l and p = l) tp, count(*) filter (p = l and g <> l) fp, count(*) filter (g = l and p <> l) fn from l, r group by l), f as (select *, {PRF} from c)
select count(*) n_labels, avg(f1) macro_f1, (select count(*) filter (g = p)::double / count(*) from r) accuracy from f""",
    "tag_set_metrics": TAGS_SQL,
    "evidence_valid_rate": f"""with e as (select text, unnest(['  ' || substr(text, 1, 12 + turn::int), case when turn % 3 = 0 then '' else substr(text, 5, 6) || '#' end]) ev from conversations), c as (select count(*) n_evidence, count(*) filter ({NORM("ev")} <> '' and contains({NORM("text")}, {NORM("ev")})) n_valid from e where ev <> '')
select *, n_valid::double / n_evidence evidence_valid_rate from c""",
    "json_validity_rates": """with r as (select event_id % 3 = 0 v, event_id % 5 <> 0 a, event_id % 7 = 0 l from events) select count(*) n, count(*) filter (a) n_applicable, count(*) filter (a and v)::double / count(*) filter (a) json_valid_rate,
count(*) filter (a and not v)::double / count(*) filter (a) invalid_json_rate, count(*) filter (l)::double / count(*) invalid_label_rate from r""",
    "leaderboard_union": "select n_name name, (n_nationkey * 7 % 25)::double score, n_regionkey region from nation union all select r_name, r_regionkey + 0.5::double, null from region",
    "split_disjointness": f"select md5({NORM('text')}) \"key\", count(distinct doc_id % 3) n_splits from documents group by 1 having count(distinct doc_id % 3) > 1",
}
