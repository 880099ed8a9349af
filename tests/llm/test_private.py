import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb

from spanloom.llm import private

from .odd import documents

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain(kind, m):
    return kind + ":" + (m.lower() if kind == "email" else m if kind == "ip" else re.sub("[^0-9]", "", m))


def low(text):
    return text.replace("İ", "i").lower()


def base(text, reach=60):
    out = []
    for kind, pattern in PLAIN.items():
        found = list(re.finditer(pattern, text))
        ends, starts = [0] + [m.end() for m in found], [m.start() for m in found] + [len(text)]
        for i, m in enumerate(found):
            before, after = text[ends[i] : m.start()], text[m.end() : starts[i + 1]]
            if len(before) > reach:
                before = re.sub(r"^\S+", "", before[-reach:])
            if len(after) > reach:
                after = re.sub(r"\S+\Z", "", after[:reach])
            if holds(kind, m[0]):
                context = low(re.sub(PLAIN["email"], " ", before + " " + after))
                out.append((kind, m.start(), m.end(), plain(kind, m[0]), tuple(dict.fromkeys(TERM.findall(context)))))
    return out


def brute(rows, reach=60, threshold=0.8, support=3):
    texts = [(i, t or "", base(t or "", reach)) for i, t in rows]
    n, n_t = len(texts), Counter(w for _, t, _ in texts for w in set(TERM.findall(low(t))))
    near = defaultdict(lambda: (set(), set()))
    for i, t, spans in texts:
        for *_, entity, words in spans:
            near[i, t, entity][0].update(words)
            near[i, t, entity][1].add(words)
    n_e, n_te, contexts = Counter(e for _, _, e in near), Counter(), defaultdict(set)
    for (_, _, e), (words, own) in near.items():
        for w in words:
            n_te[e, w] += 1
            contexts[e, w].add(min(own))
    strong = {(e, w) for (e, w), k in n_te.items() if len(contexts[e, w]) >= support and n_e[e] < n and math.log2(k * n / (n_t[w] * n_e[e])) / math.log2(n / n_e[e]) >= threshold}
    out = []
    for i, t, spans in texts:
        marked = {w for e, (words, _) in ((e, x) for (j, u, e), x in near.items() if (j, u) == (i, t)) for w in words if (e, w) in strong}
        terms = [(m.start(), m.end()) for m in TERM.finditer(low(t)) if m[0] in marked and not any(a < m.end() and m.start() < b for _, a, b, *_ in spans)]
        listed = [f"{k}:{a}:{b}" for k, a, b, *_ in spans]
        out.append((i, *(sum(s[0] == k for s in spans) for k in PLAIN), len(terms), hashlib.sha256(",".join(listed).encode()).hexdigest(), ",".join(listed + [f"term:{a}:{b}" for a, b in terms])))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'b' as base", "1 as key", "2 as kind", "'t' as term", "'e' as entity")


def corpus(seed=3, n=160):
    """Random words, and entities of which some words stand nowhere else."""
    rng = random.Random(seed)
    words = ["the", "of", "Über", "house", "river", "table", "green", "İstanbul", "paper"] + [f"w{c}{d}x" for c in "abcdef" for d in "abc"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([0, 3, 20, 60]))]
        if i % 8 == 0:
            text += ["Zorbium", rng.choice(words), "contact Max.Berg@mail.example.com", rng.choice(words), "quixotter", *rng.choices(words, k=12), "zorbium"]
        if i % 9 == 0:
            text += ["router", "at", "10.0.0.1", rng.choice(words), "gateway", "300.1.1.1", "1.2.3.4.5"]
        if i % 20 == 0:
            text += ["zorbing", "+49 (30) 1234-5678,", "card 4111 1111-1111 1111 x"]
        if i % 11 == 0:
            text += ["zorba", "zorbas"]
        rows.append((i // 2 if i % 30 == 0 else i, " ".join(text)))
    return [*rows, *rows[:9], (None, rows[8][1]), (500, None), (501, "")]


def test_against_brute_force(spark):
    rows = corpus()
    for settings in ({}, {"reach": 20, "support": 2}, {"threshold": 0.5, "support": 1}):
        got = found(private.report(frame(spark, rows), **settings))
        assert got == brute(rows, **settings)
    assert sum(r[5] for r in got) > 50


def test_copies_of_one_passage_are_no_evidence(spark):
    rows = [(i, "Ann Berg lives here, mail a.b@example.com today") for i in range(30)] + [(100 + i, f"plain text number {i}") for i in range(100)]
    assert all(r[5] == 0 for r in found(private.report(frame(spark, rows))))


def test_sanitised_texts(spark):
    rows = [(i, f"w{chr(97 + i)}a zorbium mail x@y.org quixotter w{chr(97 + i)}b") for i in range(5)] + [(10 + i, "zorbing zorba and other plain words") for i in range(60)]
    got = {r.doc_id: r.text for r in private.sanitised(frame(spark, rows)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert all("zorb* " in t and "[EMAIL]" in t and "quixotter" not in t and "mail" not in t.replace("[EMAIL]", "") for t in got.values())


def test_odd_rows_and_long_runs(spark):
    long = "a" * 300_000 + " " + "1" * 300_000 + ".1" * 100_000 + " +" + "(" * 100_000 + " x@" + "b" * 100_000
    rows = [(1, long), (2, "a@b.c_d@e.f.g@h.i"), (3, "1.2.3.4 001.002.003.255 1.2.3.256 1.2.3"), (4, "4111-1111-1111-1111 4111111111111112 +1 (222) 333-4444"), (5, "🙂🙂 ü@b.de x+y@z.co.uk. é 10.0.0.1")]
    got = {r.doc_id: r for r in private.report(frame(spark, rows)).collect()}
    for i, text in rows[1:]:
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in base(text)), text
    assert got[1].spans == ",".join(f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"(?<![0-9])[0-9]+(\.[0-9]+){3}", long) if holds("ip", m[0]))
    docs = documents(spark)
    assert found(private.report(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert private.report(docs.limit(0)).count() == 0
    assert private.sanitised(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = private.report(frame(spark, corpus()[:20]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sql_on_given_rows(spark, sf):
    own = duckdb.connect()
    own.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = private.report(spark.read.parquet(f"{sf}/documents.parquet"))
    assert found(got) == sorted(own.sql(f"select {', '.join(got.columns)} from ({private.sql()})").fetchall(), key=repr)


def test_sql_finds_the_same_terms(spark):
    rows = corpus()
    own = duckdb.connect()
    own.sql("create table documents (doc_id bigint, text varchar)")
    own.executemany("insert into documents values (?, ?)", rows)
    got = private.report(frame(spark, rows))
    assert found(got) == sorted(own.sql(f"select {', '.join(got.columns)} from ({private.sql()})").fetchall(), key=repr)
