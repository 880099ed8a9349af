"""Queries on texts shown with their spans, broken lines by number, rows of scorecards, manifests, and model calls in steps."""

from __future__ import annotations

import contextlib
import json
import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import inference, labels, scoring, tokens
from ..runtime import scratch, table, written
from ..sources import readers, writers
from ..streaming.runner import Runner
from .derived import GOLD_SQL, PREDICTED_SQL, view
from .text_queries import TOKENS

KINDS = ["LOC", "PER", "ORG"]


def highlighted_documents(spark, sf):
    """STR-23, STR-24: documents as HTML with marks; the second span overlaps the first and is passed over."""
    span = lambda start, stop, label: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(label).alias("label"))
    at = F.col("doc_id") % 7
    spans = F.when(F.length("text") >= 60, F.array(span(at + 8 + F.col("doc_id") % 3, at + 24, "ORG"), span(at, at + 8, "LOC"), span(at + 4, at + 12, "PER"), span(at + 30, at + 30, "PER")))
    own = table(spark, sf, "documents").withColumn("spans", spans)
    return own.select("doc_id", F.sha2(T.highlighted(F.col("text"), F.col("spans"), KINDS), 256).alias("html"))


def _escaped(x: str) -> str:
    for mark, form in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{mark}', '{form}')"
    return x


def _mark_sql(start: str, size: str, label: str) -> str:
    return f"""'<mark style="background:{T.PALETTE[KINDS.index(label)]}" title="{label}">' || {_escaped(f"substr(text, ({start} + 1)::bigint, ({size})::bigint)")} || '</mark>'"""


_HTML_SQL = f"""with d as (select *, doc_id % 7 a, doc_id % 3 b from documents)
select doc_id, sha256(case when length(text) >= 60 then {_escaped("substr(text, 1, a)")} || {_mark_sql("a", "8", "LOC")} || {_escaped("substr(text, a + 9, b)")} || {_mark_sql("a + 8 + b", "16 - b", "ORG")} || {_escaped("substr(text, a + 25)")} else {_escaped("text")} end) html from d"""


@contextlib.contextmanager
def _ranges_of(spark, size: int):
    """Files are read in ranges of size bytes while this lasts."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def line_errors(spark, sf):
    """SRC-02: broken lines of corpus files by number; the files are read in many ranges."""
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_comment").alias("c") if "c_comment" in table(spark, sf, "customer").columns else F.col("c_name").alias("c"))
    good = F.to_json(F.struct(F.concat(F.lit("d"), F.col("k").cast("string")).alias("doc_id"), F.array("c").alias("words"), F.expr("array(array(0, 1)) as sentences"), F.expr("array(array(0, 1)) as sections"), F.expr("array(array('0')) as ner")))
    line = F.when(F.col("k") % 10 == 0, "not json {").when(F.col("k") % 7 == 0, '{"doc_id": "x", "words": []}').when(F.col("k") % 13 == 0, "").otherwise(good)
    to = scratch(spark, "lines")
    for i, name in enumerate(readers.SPLITS):
        writers.write_one_file(own.filter(F.col("k") % 3 == i).repartitionByRange(1, "k").sortWithinPartitions("k").select(line.alias("value")), f"{to}/{name}.jsonl")
    with _ranges_of(spark, 4096):
        _, bad = readers.raw_records(spark, [r.path for r in readers.split_files(spark, to).collect()])  # three paths
        return written(bad.select("source_split", "line", "key"), "line-errors")


_LINES_SQL = """with c as (select c_custkey k, row_number() over (partition by c_custkey % 3 order by c_custkey) line from customer)
select case k % 3 when 0 then 'train' when 1 then 'dev' else 'test' end source_split, line, case when k % 10 = 0 then 'json' else 'sentences,sections,ner' end "key" from c where k % 10 = 0 or k % 7 = 0"""


def extraction_rows(spark, sf):
    """MUT-06, AGG-08: every record's strict and lenient counts and ratios."""
    gold, predicted = view(spark, sf, GOLD_SQL), view(spark, sf, PREDICTED_SQL)
    return scoring.extraction_rows(gold, predicted, "example")


def _rows_sql(name: str, keys: str) -> str:
    norm = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
    side = lambda x: f"select example, {norm} t, start, stop, count(*) n from {x} group by all"
    return f"""{name}_p as (select coalesce(g.example, p.example) example, coalesce(g.n, 0) g, coalesce(p.n, 0) p from (select example, {keys}, sum(n) n from ({side("gold")}) group by all) g full join (select example, {keys}, sum(n) n from ({side("pred")}) group by all) p using (example, {keys})),
{name} as (select example, sum(least(g, p))::bigint {name}_tp, sum(p - least(g, p))::bigint {name}_fp, sum(g - least(g, p))::bigint {name}_fn from {name}_p group by 1)"""


_EXTRACTION_ROWS_SQL = f"""with gold as ({GOLD_SQL}), pred as ({PREDICTED_SQL}), {_rows_sql("strict", "t, start, stop")}, {_rows_sql("lenient", "t")}
select *, {", ".join(f"case when {n}_tp + {n}_fp > 0 then {n}_tp / ({n}_tp + {n}_fp)::double else 0 end {n}_precision, case when {n}_tp + {n}_fn > 0 then {n}_tp / ({n}_tp + {n}_fn)::double else 0 end {n}_recall" for n in ("strict", "lenient"))} from strict join lenient using (example)"""


class Steps:
    """First the first token of a listing as a place; then, of the answer that the second prompt holds, people, or no JSON for
    words of odd length. With worked examples, the token whose number is that of the examples."""

    def answer(self, request: dict) -> dict:
        prompt = request["prompt"]
        listed = re.findall(r"^(\d+): (\S+)$", prompt, re.M)
        if prompt.startswith("AGAIN"):
            own = json.loads(prompt.split("\n")[1])["entities"]
            text = "{" if any(len(e["text"]) % 2 for e in own) else json.dumps({"entities": [{"text": e["text"], "type": "PER", "start": 0, "end": 0} for e in own]})
        else:
            at = max(0, prompt.count("Answer:\n") - 1)
            word = dict(listed).get(str(at), "")
            text = json.dumps({"entities": [{"text": word, "type": "LOC", "start": at, "end": at}]})
        return {"text": text, "model_id": "steps", "input_tokens": 1, "output_tokens": 1}


def _items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", tokens.tokenize("text").alias("tokens"))


def _named(rows):
    listed = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["text"], e["type"], e["start"].cast("string"), e["stop"].cast("string"))), ";")
    return rows.select("id", listed.alias("entities"))


def verified_extraction(spark, sf):
    """LLM-11: the second prompt holds the first answer, whose types it changes; where its answer is no JSON the first stands."""
    return _named(inference.extract_verified(_items(spark, sf), Steps, "FIRST\n{tokens}", "AGAIN\n{entities_json}", ["LOC", "PER"]))


_VERIFIED_SQL = f"""with t as (select item_id id, text, {TOKENS}[1] w from benchmark)
select id, w || ':' || case when length(w) % 2 = 1 then 'LOC' else 'PER' end || ':' || (strpos(text, w) - 1) || ':' || (strpos(text, w) - 1 + length(w)) entities from t"""


def few_shot_extraction(spark, sf):
    """LLM-10, STR-21: prompts with one to three worked examples, from texts of the documents."""
    own = table(spark, sf, "documents").filter("length(text) > 20").select(F.col("doc_id"), F.left("text", F.lit(20)).alias("text")).orderBy("doc_id").limit(3)
    entity = F.struct(F.lit("x").alias("text"), F.lit("LOC").alias("type"), F.lit(0).alias("start"), F.lit(0).alias("stop"))
    shots = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda r: F.struct(F.regexp_replace(r["text"], r"\s+", " ").alias("text"), F.array(entity).alias("entities"))).alias("shots"))  # three rows
    rows = _items(spark, sf).join(F.broadcast(shots)).withColumn("examples", inference.few_shot(F.slice("shots", F.lit(1), (F.col("id") % 3 + 1).cast("int")))).drop("shots")
    return _named(inference.method("extraction", "few_shot_structured")(rows, Steps, "{examples}\n\n{tokens}", ["LOC"]))


_FEW_SQL = f"""with t as (select item_id id, {TOKENS} t, regexp_split_to_array(text, '{T.TOKEN.replace(chr(39), chr(39) * 2)}') gaps, (item_id % 3)::integer n from benchmark),
p as (select id, t[n + 1] w, list_sum(list_transform(gaps[1:n + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(t[1:n], lambda x: length(x))), 0) a from t)
select id, w || ':LOC:' || a::bigint || ':' || (a + length(w))::bigint entities from p"""


class Flaky:
    """Times out on the first try of every third key."""

    def __init__(self):
        self.seen = set()

    def answer(self, request: dict) -> dict:
        if request["k"] % 3 == 0 and request["k"] not in self.seen:
            self.seen.add(request["k"])
            raise TimeoutError("timeout")
        if request["k"] % 7 == 0:
            raise ValueError("no such model")
        return {"text": str(request["k"] * 2)}


def retried_calls(spark, sf):
    """LLM-01: errors that may pass are tried again, others are not."""
    out = inference.call(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), Flaky, ["k"], 3)
    return out.select("k", F.col("reply.text").alias("text"), "reply.attempts", F.col("reply.error").alias("error"))


_RETRIED_SQL = """select c_custkey k, case when c_custkey % 7 <> 0 then (c_custkey * 2)::varchar end as text, case when c_custkey % 3 = 0 then 2 else 1 end::integer attempts, case when c_custkey % 7 = 0 then 'ValueError: no such model' end error from customer"""


def run_progress(spark, sf):
    """STM-07, STM-03: calls planned, attempted and answered after a budget ended a run; another configuration is refused."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    folder, n = scratch(spark, "run"), rows.count()
    run = Runner(spark, folder, ["k"], {"model": "m"}, n // 3)
    run.step(rows, 0, Flaky, ["k"])
    refused = False
    try:
        Runner(spark, folder, ["k"], {"model": "other"}, n)
    except ValueError:
        refused = True
    done = run.progress(n)
    return spark.createDataFrame([(done["planned"], done["attempted"], done["answered"], done["share"], refused)], "planned long, attempted long, answered long, share double, refused boolean")


_PROGRESS_SQL = """with c as (select c_custkey k, row_number() over (order by c_custkey) i, count(*) over () n from customer), t as (select max(n) n, max(n) // 3 a, count(*) filter (i <= n // 3 and k % 3 <> 0 and k % 7 <> 0) o from c)
select n planned, a attempted, o answered, o / n::double share, true refused from t"""


def file_manifest(spark, sf):
    """SNK-11: the manifest of a folder: bytes and digests of its files, counts and a configuration."""
    to = scratch(spark, "out")
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    for i, name in enumerate(readers.SPLITS):
        writers.write_one_file(own.filter(F.col("k") % 3 == i).repartitionByRange(1, "k").sortWithinPartitions("k").select(F.col("c_name").alias("value")), f"{to}/{name}.txt")
    text = writers.manifest(spark, to, {"seed": 1}, {"rows": own.count()})
    about = spark.createDataFrame([(text,)], "m string").select(F.from_json("m", "config struct<seed: int>, counts struct<rows: long>, files map<string, struct<bytes: long, sha256: string>>").alias("m"))
    return about.select(F.col("m.config.seed").alias("seed"), F.col("m.counts.rows").alias("n_rows"), F.explode("m.files").alias("file", "f")).select("seed", "n_rows", "file", "f.bytes", "f.sha256")


_MANIFEST_SQL = """with f as (select case c_custkey % 3 when 0 then 'train' when 1 then 'dev' else 'test' end || '.txt' file, string_agg(c_name || chr(10), '' order by c_custkey) t from customer group by 1)
select 1 seed, (select count(*) from customer) n_rows, file, strlen(t)::bigint bytes, sha256(t) sha256 from f"""


def tag_lists(spark, sf):
    """STR-10: tags from JSON lists with blank ones, broken JSON, and lists."""
    own = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    text = F.when(F.col("p_partkey") % 5 == 0, "[broken").when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(F.to_json(F.concat(F.col("words"), F.array(F.lit(" "), F.lit(" end ")))))
    return own.select("p_partkey", F.array_join(labels.tag_list(text), "|").alias("of_text"), F.array_join(labels.tag_list(F.col("words"), "array"), "|").alias("of_list"))


_TAG_LISTS_SQL = """select p_partkey, case when p_partkey % 5 = 0 or p_partkey % 7 = 0 then '' else array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '|') || '|end' end of_text, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '|') of_list from part"""

def token_bounds(spark, sf):
    """TOK-05: character spans of token spans whose end is not included; those that are none are null."""
    own = _items(spark, sf).withColumn("a", (F.col("id") % 9 - 1).cast("int")).withColumn("b", (F.col("id") % 9 + F.col("id") % 4 - 1).cast("int"))
    return own.select("id", tokens.span_between(F.col("tokens"), F.col("a"), F.col("b")).alias("s")).select("id", "s.start", "s.stop")


_BOUNDS_SQL = f"""with t as (select item_id id, text, {TOKENS} t, regexp_split_to_array(text, '{T.TOKEN.replace(chr(39), chr(39) * 2)}') gaps, (item_id % 9 - 1)::integer a, (item_id % 9 + item_id % 4 - 1)::integer b from benchmark),
e as (select *, a >= 0 and a < b and b <= len(t) ok, list_sum(list_transform(gaps[1:a + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(t[1:a], lambda x: length(x))), 0) p, list_sum(list_transform(gaps[1:b], lambda x: length(x))) + coalesce(list_sum(list_transform(t[1:b], lambda x: length(x))), 0) q from t)
select id, case when ok then p::integer end as start, case when ok then q::integer end as stop from e"""


def benchmark_lookup(spark, sf):
    """SRC-11, SRC-13, VAL-13: the benchmark as lines, the fixture where it is missing, one item by id, and settings from a file."""
    to, schema = scratch(spark, "benchmark"), "item_id long, text string"
    own = table(spark, sf, "benchmark").select("item_id", "text")
    writers.write_lines(own, f"{to}/whole")
    writers.write_lines(own.filter("item_id % 2 = 0"), f"{to}/smoke")
    writers.put(spark, f"{to}/use.yaml", json.dumps({"runner": {"name": "n", "labels": ["LOC", " LOC ", "", "PER"]}}).encode())
    settings = readers.template_config(readers.config(spark, f"{to}/use.yaml"))
    whole, smoke, none = f"{to}/whole/*.txt", f"{to}/smoke/*.txt", f"{to}/none"
    read = lambda path: readers.benchmark(spark, path, smoke, schema, ["item_id", "text"])
    first = own.agg(F.max("item_id")).first()[0]
    parts = [("whole", read(whole)), ("fixture", read(none)), ("one", readers.lookup(spark, "item_id", first, [none, smoke, whole], schema, ["item_id"])), ("nothing", readers.lookup(spark, "item_id", -1, [smoke, whole], schema, ["item_id"]))]
    counted = [rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.coalesce(F.sum("item_id"), F.lit(0)).alias("ids"), F.lit("|".join(settings["labels"])).alias("labels")) for name, rows in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


_LOOKUP_SQL = """select part, n, ids, 'LOC|PER' as labels from (select 'whole' part, count(*) n, sum(item_id)::bigint ids from benchmark union all select 'fixture', count(*), sum(item_id)::bigint from benchmark where item_id % 2 = 0
union all select 'one', 1, max(item_id) from benchmark union all select 'nothing', 0, 0)"""

QUERIES = {f.__name__: f for f in (highlighted_documents, line_errors, extraction_rows, verified_extraction, few_shot_extraction, retried_calls, run_progress, file_manifest, tag_lists, token_bounds, benchmark_lookup)}
ORACLE_SQL = {
    "highlighted_documents": _HTML_SQL,
    "line_errors": _LINES_SQL,
    "extraction_rows": _EXTRACTION_ROWS_SQL,
    "verified_extraction": _VERIFIED_SQL,
    "few_shot_extraction": _FEW_SQL,
    "retried_calls": _RETRIED_SQL,
    "run_progress": _PROGRESS_SQL,
    "file_manifest": _MANIFEST_SQL,
    "tag_lists": _TAG_LISTS_SQL,
    "token_bounds": _BOUNDS_SQL,
    "benchmark_lookup": _LOOKUP_SQL,
}
