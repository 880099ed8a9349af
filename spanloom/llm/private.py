"""Personal data by patterns, and by what the corpus says about the words around it; in DataFrame functions alone.

Patterns find e-mail addresses, IP addresses, card and telephone numbers: the protected entities. Words near an entity can
give it away once it is taken out, if they hardly occur elsewhere. How much a term t tells of an entity e is their pointwise
mutual information in documents, as a share of the information of e itself:

    log2(n(t, e) * N / (n(t) * n(e))) / log2(N / n(e))

with N documents, n(t) of them with the term, n(e) with the entity, and n(t, e) with the term near the entity (``reach``
characters either side). A term whose share reaches ``threshold``, in at least ``support`` different contexts of the
entity, is disclosing; it is then marked wherever it occurs in the documents in which it stands near that entity.
``sanitised`` takes entities out and generalises disclosing terms to their first letters where these tell less than the
threshold, or else removes them.

Counts are taken over all documents and combine before they are shuffled; pairs are those of an entity with the words near
it, never those of whole documents. The texts of documents with an entity are kept in a written table; no text is shuffled
but those in which a term is marked.

Results on odd input: a null text counts as empty; rows that repeat id and text get the same spans and are one document
for n(e) and n(t, e); a null doc_id is an id like others; an entity in every document has nothing to tell; spans of
different kinds may overlap (all are listed); texts are scanned whole in time that grows with their length, whatever runs
they hold; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions.text import find_all, rewritten

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns with what keeps long runs from being tried from each of their characters: a match of e-mail or ip begins
# where a run begins or the last match ended, and runs that cannot match in another way are not tried again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}{3,}"
FOUND = "array<struct<kind:int,start:int,stop:int,entity:string,words:array<string>,context:bigint>>"


def lowered(text: Column) -> Column:
    """In lower case with as many characters as before."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _near(gap: Column, reach: int, before: bool) -> Column:
    """The end or the start of a gap, without a word that is cut."""
    own = F.right(gap, F.lit(reach)) if before else F.left(gap, F.lit(reach))
    return F.when(F.length(gap) > reach, F.regexp_replace(own, r"^\S+" if before else r"\S+$", "")).otherwise(own)


def entities(text: Column, reach: int = 60) -> Column:
    """The base spans by kind and start, with the entity's plain form and the different words near it."""

    def spans(kind: str, trigger: Column, pattern: str, holds, plain) -> Column:
        def one(m: Column) -> Column:
            context = F.concat(_near(m["before"], reach, True), F.lit(" "), _near(m["after"], reach, False))
            words = F.array_distinct(F.regexp_extract_all(lowered(F.regexp_replace(context, EMAIL, " ")), F.lit(TERM), F.lit(0)))
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), F.concat(F.lit(f"{kind}:"), plain(m["match"])).alias("entity"), words.alias("words"), F.xxhash64(F.array_join(words, " ")).alias("context"))

        own = F.transform(F.filter(find_all(text, pattern), lambda m: holds(m["match"])), one)
        return F.when(trigger, own).otherwise(F.array().cast(FOUND))

    sized = lambda m, least, most: F.length(_digits(m)).between(least, most)
    return F.concat(
        spans("email", F.contains(text, F.lit("@")), EMAIL, lambda m: F.lit(True), F.lower),
        spans("ip", text.rlike(r"[0-9]\.[0-9]"), IP, lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), lambda m: m),
        spans("card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD, lambda m: sized(m, 13, 19) & F.call_function("luhn_check", _digits(m)), _digits),
        spans("phone", F.contains(text, F.lit("+")), PHONE, lambda m: sized(m, 9, 15), _digits),
    )


def scanned(docs: DataFrame, reach: int = 60) -> DataFrame:
    """doc_id, base, and where base is not empty, key (128 bits of id and text) and text; written, as all else reads it."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("base", entities(F.col("text"), reach))
    some = F.size("base") > 0
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("text")))
    return runtime.written(own.select("doc_id", "base", F.when(some, key).alias("key"), F.when(some, F.col("text")).alias("text")), "private-base")


def vocabulary(docs: DataFrame) -> DataFrame:
    """term and n_t, the documents with it, of all texts; written."""
    terms = F.array_distinct(F.regexp_extract_all(lowered(F.col("text")), F.lit(TERM), F.lit(0)))
    return runtime.written(docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "private-terms")


def _near_words(base: DataFrame) -> DataFrame:
    """key, entity, context and words: the words near an entity in a document, and a hash of one of their contexts."""
    own = base.filter("key is not null").select("key", F.explode("base").alias("b")).select("key", "b.entity", "b.words", "b.context")
    return own.groupBy("key", "entity").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"), F.min("context").alias("context"))


def told(n_te: Column, n_t: Column, n_e: Column, n: int) -> Column:
    """The share of an entity's information that a term tells; null for an entity in every document."""
    whole = F.log2(F.lit(float(n)) / n_e)
    return F.when(whole > 0, F.log2(n_te * F.lit(float(n)) / (n_t * n_e)) / whole)


def disclosing(base: DataFrame, terms: DataFrame, threshold: float = 0.8, support: int = 3, letters: int = 4) -> DataFrame:
    """entity, term, share and general: the terms that tell of an entity, and the form that tells less (null: none)."""
    n = base.count()
    near = _near_words(base)
    n_e = near.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support)
    pairs = near.select("entity", "context", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.count_distinct("context").alias("contexts"))
    stem = F.left(F.col("term"), F.lit(letters)).alias("stem")
    strong = pairs.filter(F.col("contexts") >= support).join(terms, "term").join(n_e, "entity").withColumn("share", told(F.col("n_te"), F.col("n_t"), F.col("n_e"), n)).filter(F.col("share") >= threshold)
    strong = runtime.written(strong.select("entity", "term", "share", "n_e", stem), "private-strong")
    stems = terms.select(stem, "n_t").join(strong.select("stem").distinct(), "stem").groupBy("stem").agg(F.sum("n_t").alias("n_t"))
    beside = pairs.select("entity", stem, "n_te").join(strong.select("entity", "stem").distinct(), ["entity", "stem"]).groupBy("entity", "stem").agg(F.sum("n_te").alias("n_te"))
    least = F.coalesce(told(F.col("n_te"), F.col("n_t"), F.col("n_e"), n), F.lit(1.0))
    general = F.when((F.length("term") > letters) & (least < threshold), F.concat("stem", F.lit("*")))
    return strong.join(beside, ["entity", "stem"]).join(stems, "stem").select("entity", "term", "share", general.alias("general"))


def marked(docs: DataFrame, reach: int = 60, threshold: float = 0.8, support: int = 3) -> DataFrame:
    """doc_id, key, base and terms: the spans of patterns and those of disclosing terms (start, stop, share and general)."""
    base = scanned(docs, reach)
    strong = disclosing(base, vocabulary(docs), threshold, support)
    own = _near_words(base).select("key", "entity", F.explode("words").alias("term")).join(strong, ["entity", "term"])
    # a form must hold for all entities that the term tells of
    hits = own.groupBy("key", "term").agg(F.max("share").alias("share"), F.when(F.count("general") == F.count("*"), F.max("general")).alias("general"))
    hits = runtime.written(hits, "private-hits")
    texts = base.filter("key is not null").join(hits.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    inside = lambda m: F.exists("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))
    words = texts.select("key", "base", F.explode(find_all(lowered(F.col("text")), TERM)).alias("m")).select("key", "base", F.struct("m.start", "m.stop").alias("m"), F.col("m.match").alias("term"))
    found = words.join(hits, ["key", "term"]).filter(~inside(F.col("m"))).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("m.start", "m.stop", "share", "general"))).alias("terms"))
    plain = base.filter("key is null").select("doc_id", "key", "text", "base", F.lit(None).cast(found.schema["terms"].dataType).alias("terms"))
    return plain.unionByName(base.filter("key is not null").join(found, "key", "left").select(*plain.columns))


def _listed(spans: Column, kind=None) -> Column:
    name = lambda s: F.lit(kind) if kind else F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string")))


def report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256 and spans, a row for each row of docs."""
    own = marked(docs, **settings).withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int,share:double,general:string>>")))
    of = lambda i: F.size(F.filter("base", lambda b: b["kind"] == i)).cast("long")
    counts = [of(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])]
    base = _listed(F.col("base"))
    return own.select("doc_id", *counts, F.size("terms").cast("long").alias("n_term"), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, _listed(F.col("terms"), "term")), ",").alias("spans"))


def sanitised(docs: DataFrame, **settings) -> DataFrame:
    """doc_id and text of the documents with an entity: entities as their kind in brackets, disclosing terms in their
    general form or removed. Of spans that overlap the first is written, of those with one start the longest."""
    own = marked(docs, **settings).filter("key is not null")
    kind = lambda s: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))
    forms = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), kind(s).alias("form"))),
        F.coalesce(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.coalesce(s["general"], F.lit("")).alias("form"))), F.array().cast("array<struct<start:int,stop:int,form:string>>")),
    )
    return own.withColumn("__forms", forms).select("doc_id", rewritten(F.col("text"), F.col("__forms"), lambda s, _: s["form"]).alias("text"))


def _found_sql(kind: str, pattern: str, holds: str) -> str:
    number = KINDS.index(kind)
    return f"""select {number} kind, '{kind}' name, id, doc_id, stop - length(m) start, stop, m, gaps[i] before, gaps[i + 1] after from (
  select *, found[i] m, sum(length(gaps[i]) + length(found[i])) over (partition by id order by i)::bigint stop from (
    select *, unnest(range(1, len(found) + 1)) i from (select id, doc_id, string_split_regex(text, '{pattern}') gaps, regexp_extract_all(text, '{pattern}') found from d where regexp_matches(text, '{pattern}'))))
  where {holds}"""


def sql(reach: int = 60, threshold: float = 0.8, support: int = 3) -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda x, i: case when i % 2 = 0 then (x::int * 2) // 10 + (x::int * 2) % 10 else x::int end))"
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    parts = " union all ".join((
        _found_sql("email", email, "true"),
        _found_sql("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: x::hugeint > 255)) = 0"),
        _found_sql("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) between 13 and 19 and {doubled} % 10 = 0"),
        _found_sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) between 9 and 15"),
    ))
    words = lambda x: f"regexp_extract_all(lower(replace({x}, 'İ', 'i')), '{TERM}')"
    before = rf"case when length(before) > {reach} then regexp_replace(right(before, {reach}), '^\S+', '') else before end"
    after = rf"case when length(after) > {reach} then regexp_replace(left(after, {reach}), '\S+$', '') else after end"
    told = "case when n_e < n then log2(n_te * n::double / (n_t * n_e)) / log2(n::double / n_e) end"
    return rf"""
with d as materialized (select row_number() over () id, doc_id, coalesce(text, '') as text, count(*) over () n from documents),
base as materialized (select *, name || ':' || case name when 'email' then lower(m) when 'ip' then m else {digits} end entity, list_distinct({words(f"regexp_replace({before} || ' ' || {after}, '{email}', ' ', 'g')")}) words from ({parts})),
rows as (select d.id, md5(coalesce(d.doc_id::varchar, '') || ' ' || text) k from d where id in (select id from base)),
near as materialized (select k, entity, list_distinct(flatten(list(words))) words, min(list_sort(words)) context from base join rows using (id) group by all),
n_e as (select entity, count(*) n_e from near group by all having count(*) >= {support}),
pairs as (select entity, term, count(*) n_te, count(distinct context) contexts from (select entity, context, unnest(words) term from near) group by all having count(distinct context) >= {support}),
v as (select term, count(*) n_t from (select unnest(list_distinct({words("text")})) term from d) group by all),
strong as (select distinct entity, term from pairs join v using (term) join n_e using (entity), (select max(n) n from d) where {told} >= {threshold}),
hits as (select distinct k, term from (select k, entity, unnest(words) term from near) join strong using (entity, term)),
tokens as (select id, found[i] term, stop, stop - length(found[i]) start from (select *, sum(length(gaps[i]) + length(found[i])) over (partition by id order by i)::bigint stop from (select *, unnest(range(1, len(found) + 1)) i from (
  select id, string_split_regex(lower(replace(text, 'İ', 'i')), '{TERM}') gaps, {words("text")} found from d where id in (select id from rows join hits using (k)))))),
marks as (select t.id, t.start, t.stop from tokens t join rows r on r.id = t.id join hits h on h.k = r.k and h.term = t.term where not exists (select 1 from base b where b.id = t.id and b.start < t.stop and t.start < b.stop)),
listed as (select id, kind, start, name || ':' || start || ':' || stop s from base union all select id, 4, start, 'term:' || start || ':' || stop from marks),
own as (select id, string_agg(s, ',' order by kind, start) spans, coalesce(string_agg(s, ',' order by kind, start) filter (kind < 4), '') base, {", ".join(f"count(*) filter (kind = {i}) n_{kind}" for i, kind in enumerate(KINDS))} from listed group by id)
select d.doc_id::bigint doc_id, {", ".join(f"coalesce(n_{kind}, 0)::bigint n_{kind}" for kind in KINDS)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join own using (id)"""
