import re
from collections import Counter
from fractions import Fraction
from math import floor

import duckdb

from spanloom.llm import divergence

from .odd import documents

ROWS = [(1, "one two three TWO", "en", "a"), (2, "two three Ünder", "en", "b"), (3, "two, two; three3four", "en", "a"), (4, "", "en", "c"), (5, None, None, "d"), (5, "solo", None, None), (6, "eins zwei", "de", "a"), (7, "1 2 3", "de", "b"), (7, "1 2 3", "de", "b"), (8, "two three two", "en", "b")]


def brute(rows, least):
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(divergence.TERM, t or "")]
    own = [(lang or "", source or "", terms(text)) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in own}:
        seen = Counter(t for g, _, ts in own if g == lang for t in set(ts))
        kept = sorted(t for t, n in seen.items() if n >= least)
        groups = {s: Counter(t for g, o, ts in own if (g, o) == (lang, s) for t in ts if t in set(kept)) for s in {o for g, o, _ in own if g == lang}}
        share = lambda c: {t: 1 + floor(Fraction(10**9 * (c[t] + 5), sum(c.values()) + 5 * len(kept))) for t in kept}
        q, p = share(sum(groups.values(), Counter())), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", more, 50)):
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as term", "2 as n", "'x' as item", "'y' as salt")
    for least in (1, 2, 3, 9):
        assert found(divergence.audit(docs, least)) == brute(ROWS, least)


def test_shares_of_large_counts(spark):
    n, total, terms = 9 * 10**14, 10**15, 10**6
    got = spark.range(1).select(divergence.share(*(divergence.F.lit(x) for x in (n, total, terms))).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_odd_rows(spark):
    docs = documents(spark).selectExpr("*", "if(doc_id % 2 = 0, null, 's') as source")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert found(divergence.audit(docs, 1)) == brute(rows, 1)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_sql_on_given_rows(spark, sf):
    own = duckdb.connect()
    own.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    names = "lang, source, part, item, value, rank"
    assert found(divergence.audit(spark.read.parquet(f"{sf}/documents.parquet"))) == sorted(own.sql(f"select {names} from ({divergence.SQL})").fetchall())
