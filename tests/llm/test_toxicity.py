import random
import re
import zlib

from spanloom.llm import toxicity

from .odd import DOCS, documents

RNG = random.Random(2)
PLAIN = ["calm", "river", "stone", "paper", "green", "cloud", "table", "walk", "idle", "lamp"]


def labelled(spark, n=900):
    docs, labels = [], []
    for i in range(n):
        words = [RNG.choice(PLAIN) for _ in range(RNG.randrange(3, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(RNG.randrange(1, 4)):
                words.insert(RNG.randrange(len(words)), RNG.choice(["idiot", "moron", "scum"]))
        elif i % 7 == 0:
            words[1:1] = ["pond", "scum"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_disguises(spark):
    docs, labels = labelled(spark)
    lexicon = toxicity.fit(docs, labels, least_log_odds=1.5)
    assert "pond scum" in lexicon.exceptions
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.scored(docs, lexicon).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held)
    assert len(held) > 200 and right / len(held) > 0.95
    more = spark.createDataFrame([(1, "you ID10T!! " + "calm river " * 5), (2, "an 1d1оt (Cyrillic o) stone"), (3, "idiotic stone"), (4, "the pond scum is green"), (5, "mor0n, m0r0n***")], "doc_id long, text string")
    got = {r.doc_id: r.n_hits for r in toxicity.scored(more, lexicon).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 2}


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = labelled(spark, 300)
    spoilt = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end toxic")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, spoilt)


def test_odd_rows(spark):
    lexicon = toxicity.Lexicon({"dog": 3.0}, (), (-3.0, 1.0, 1.0, 1.0))
    rows = toxicity.scored(documents(spark), lexicon).collect()
    assert len(rows) == len(DOCS)
    got = {r.doc_id: r for r in rows}
    assert got[1].n_hits == 1 and got[8].n_hits == 1 and got[3].score == got[4].score == got[7].score < got[1].score
    kept = toxicity.scored(documents(spark), lexicon, True, ("__score", "__n_hits"))
    assert kept.columns[-2:] == ["__score", "__n_hits"] and kept.count() == len(DOCS)
    empty = toxicity.fit(documents(spark).limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty == toxicity.Lexicon() and {r.score for r in toxicity.scored(documents(spark), empty).collect()} == {0.0}


def test_fold():
    assert toxicity.fold("ÉCOLE L0ser $tar p@th") == "ecoie ioser $tar path"


def naive(lexicon, text):
    """n_hits and score of a text by a search for each term and phrase at each place."""
    folded, hits = toxicity.fold(text or ""), []
    places = lambda term, stem: [(m.start(), m.start() + len(term)) for m in re.finditer(rf"(?<![a-z])(?={re.escape(term)}{'' if stem else '(?![a-z])'})", folded)]
    spared = [place for phrase in lexicon.exceptions for place in places(phrase, False)]
    for term, weight in lexicon.weights.items():
        hits += [weight for a, b in places(term.rstrip("*"), term[-1] == "*") if not any(c <= a and b <= d for c, d in spared)]
    return len(hits), lexicon.score(lexicon.features([(0, 0, w) for w in hits], len(folded.split())))


def test_scores_are_those_of_a_naive_search(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abe") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    texts = ["".join(rng.choice(["A", "a", "b", "e", "b", "@", "4", "3", " ", " ", ".", "\n", "é", "ß"]) for _ in range(rng.randrange(0, 400))) for _ in range(300)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 3000))) for _ in range(40)] + [None, ""]
    terms = {rng.choice(words): float(rng.randrange(1, 9)) for _ in range(12)} | {f"{w}*": 2.5 for w in rng.sample(words, 5)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for exceptions in ((), tuple({f"{rng.choice(words)} {rng.choice(words)}" for _ in range(60)})):
        lexicon = toxicity.Lexicon(terms, exceptions, (-3.0, 1.0, 1.0, 1.0))
        got = {r.doc_id: (r.n_hits, round(r.score, 9)) for r in toxicity.scored(docs, lexicon).collect()}
        want = {i: naive(lexicon, text) for i, text in enumerate(texts)}
        assert got == {i: (n, round(score, 9)) for i, (n, score) in want.items()}
        assert sum(n > 0 for n, _ in want.values()) > 100
