"""Source divergence audit: how far the sources of a language use its words differently, in plain relational steps.

Terms are exploded and counted by language, source and term; each language keeps the terms of enough of its documents.
Groups (a language and a source) are crossed with the kept terms of their language, so that zeros count too; a self-join
on language and term gives the distance of each two sources, and a join with the language's own shares gives the terms
that a source uses more than its language. Shares are smoothed and stated in whole billionths, all in exact integers.

The cross meets on the language and a salt of the term, so a language with most rows is spread over tasks; distances and
counts are summed before they are shuffled. The rows grow with terms times sources of a language, and those of the
self-join with terms times pairs of sources: that is the method's own size, since all pairs are asked for.

Results on odd input: null text, language and source count as empty; a group without terms, or of a language that keeps
none, still has its row for each other source, with value 0 if nothing is kept; repeated rows are documents of their own;
equal values rank by the item's bytes; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import runtime

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, PRIOR = 1_000_000_000, 5
SALTS = 64


def _lowered(text: Column) -> Column:
    """A to Z in lower case and nothing else; texts in ASCII take the shorter way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _filled(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source"), F.coalesce("text", empty).alias("text"))


def counts(docs: DataFrame, least_documents: int = 30) -> DataFrame:
    """lang, source, term and n: occurrences of the terms that at least least_documents documents of the language have."""
    terms = F.regexp_extract_all(_lowered(F.col("text")), F.lit(TERM), F.lit(0))
    # twice in one pass: every occurrence, and every term of the document once
    both = _filled(docs).select("lang", "source", terms.alias("terms")).select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    own = both.select("lang", "source", "once", F.explode("terms").alias("term")).groupBy("lang", "term", "source").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("n_documents"))
    documents = F.sum("n_documents").over(W.partitionBy("lang", "term"))  # a row for each source
    return own.withColumn("__documents", documents).filter(F.col("__documents") >= least_documents).select("lang", "source", "term", "n")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)) in decimals that cannot run over."""
    wide = lambda c: c.cast("decimal(18,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(n + PRIOR)
    return (F.lit(1) + F.call_function("div", top, wide(total + PRIOR * terms))).cast("long")


def _dense(kept: DataFrame, groups: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, term, source, p: every kept term for every group of its language, and one row with term '' and p 0 for each
    group, so that groups of languages without kept terms have pairs, too."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    own = groups.join(sums, ["lang", "source"], "left").join(totals, "lang", "left")
    sized = own.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    salted = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    terms = kept.select("lang", "term").distinct().withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    full = terms.join(salted, ["lang", "salt"]).join(kept, ["lang", "term", "source"], "left")
    p = share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("terms"))
    return full.select("lang", "term", "source", p.alias("p")).unionByName(groups.select("lang", F.lit("").alias("term"), "source", F.lit(0).cast("long").alias("p")))


def _ranked(rows: DataFrame, most: int | None) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    own = rows.withColumn("rank", rank)
    return own if most is None else own.filter(F.col("rank") <= most)


def audit(docs: DataFrame, least_documents: int = 30, most_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank. Part pair: the distance to each other source of the language, the sum over
    all kept terms. Part term: the most_terms terms that a source uses most beyond the language as a whole."""
    kept = runtime.written(counts(docs, least_documents), "term-counts")
    groups = runtime.written(_filled(docs).select("lang", "source").distinct(), "term-groups")
    whole = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    totals = whole.groupBy("lang").agg(F.sum("n").alias("all"), F.count("*").alias("terms"))  # a row a language

    dense = _dense(kept, groups, totals.select("lang", "terms"))
    a, b = (dense.select("lang", "term", F.col("source").alias(f"source_{x}"), F.col("p").alias(f"p_{x}")) for x in "ab")
    half = a.join(b, ["lang", "term"]).filter("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(F.abs(F.col("p_a") - F.col("p_b"))).alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = half.select("lang", ways.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    q = whole.join(totals, "lang").select("lang", "term", share(F.col("n"), F.col("all"), F.col("terms")).alias("q"), "terms")
    used = kept.filter("n > 0").join(sums, ["lang", "source"]).join(q, ["lang", "term"])
    used = used.withColumn("value", share(F.col("n"), F.col("total"), F.col("terms")) - F.col("q")).filter("value > 0")
    terms = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return _ranked(pairs, None).unionByName(_ranked(terms, most_terms))


SQL = rf"""
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') terms from documents),
w as (select id, lang, source, unnest(terms) term from d),
kept as (select lang, term from w group by all having count(distinct id) >= 30),
v as (select lang, count(*)::hugeint v from kept group by lang),
groups as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint n from w join kept using (lang, term) group by all),
dense as (select lang, source, term, coalesce(n, 0)::hugeint n from groups join kept using (lang) left join c using (lang, source, term)),
p as (select lang, source, term, n, 1 + ({SCALE}::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v)::hugeint p from dense join v using (lang)),
whole as (select lang, term, sum(n)::hugeint n from c group by all),
q as (select lang, term, 1 + ({SCALE}::hugeint * (n + 5)) // (sum(n) over (partition by lang) + 5 * v)::hugeint q from whole join v using (lang)),
sums as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select g.lang, g.source, 'pair' part, h.source item, coalesce(f, 0)::bigint as value from groups g join groups h on g.lang = h.lang and g.source <> h.source left join sums s on s.lang = g.lang and s.source = g.source and s.item = h.source
  union all select lang, source, 'term', term, (p - q)::bigint from p join q using (lang, term) where n > 0 and p > q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank from parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50"""
