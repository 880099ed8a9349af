import random
import re

import numpy as np

from spanloom.llm import near_duplicates as nd
from spanloom.llm.shingles import sets

from .odd import DOCS, documents


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(docs):
    own = {d: shingles(t) for d, t in docs}
    root = {d: d for d in own}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(own[a] & own[b])
            if own[a] and own[b] and 100 * shared >= 75 * (len(own[a]) + len(own[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(own[d]), find(d), find(d) == d) for d in ids}


def edited(words, rng, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(5000)]


def corpus(seed=5, group=140):
    """A large group of near copies of one text, small groups, copies and unrelated texts."""
    rng = random.Random(seed)
    out, n = [], 0
    for size in (group, 6, 3, 2, 2):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randrange(60, 200))]
        for _ in range(size):
            out.append((n, " ".join(edited(base, rng, rng.choice((0, 0.01, 0.03, 0.06))))))
            n += 1
    for _ in range(40):
        out.append((n, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 60)))))
        n += 1
    rng.shuffle(out)
    return out


def result(rows):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_components_are_those_of_all_pairs(spark):
    docs = corpus()
    assert result(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs)


def test_blocks_of_large_bands(spark, monkeypatch):
    """Bands over the limit for pairs go through blocks and give the same components."""
    docs = corpus(seed=9)
    monkeypatch.setattr(nd, "SMALL", 4)
    monkeypatch.setattr(nd, "R_BLOCK", 8)
    monkeypatch.setattr(nd, "M_BLOCK", 16)
    assert result(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_odd_rows(spark):
    rows = nd.near_duplicates(documents(spark)).collect()
    assert len(rows) == len(DOCS)
    got = {r.doc_id: r for r in rows}
    assert (got[2].component_id, got[2].kept) == (1, False) and got[1].kept
    assert all((got[i].n_shingles, got[i].component_id, got[i].kept) == (0, i, True) for i in (3, 4, 5))
    assert got[7].n_shingles == 1 and got[8].component_id == 1
    assert nd.near_duplicates(documents(spark).limit(0)).count() == 0


def test_near_copies_without_an_id(spark, monkeypatch):
    """A near copy whose only row has a null doc_id is linked, in pairs and in blocks; what is linked with no id stays null."""
    rng = random.Random(11)
    base = [rng.choice(VOCABULARY) for _ in range(200)]
    copies = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in (20, 60, 100, 140)]
    alone = [" ".join(rng.choice(VOCABULARY) for _ in range(50)) for _ in range(2)]
    rows = [(3, " ".join(base)), (9, copies[0]), *((None, text) for text in [*copies[1:], copies[1], *alone, None, ""])]
    for small in (nd.SMALL, 1):
        monkeypatch.setattr(nd, "SMALL", small)
        got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == sorted(
            [(3, 196, 3, True), (9, 196, 3, False), *[(0, 196, 3, False)] * 4, *[(0, 46, 0, False)] * 2, *[(0, 0, 0, False)] * 2]
        )


def test_sets_of_words():
    texts = ["a b c d e f", "A  B\tC\nd\re\x0bf", "a b", "", None, "x" * 100 + " y", "é à b c d", " a b c d e a b c d e a b c d e "]
    own = sets([t.encode() if t is not None else None for t in texts])
    assert [len(s) for s in own] == [len(shingles(t)) for t in texts]
    assert np.array_equal(own[0], own[1])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.75, 0.95):
        shared = rng.integers(0, 2**64, int(4000 * share), dtype=np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 2**64, int(2000 * (1 - share)), dtype=np.uint64)]) for _ in range(2))
        true = len(shared) / (len(a) + len(b) - len(shared))
        x, y = nd.sketch(a), nd.sketch(b)
        assert np.array_equal(nd.merged(x, y), nd.sketch(np.union1d(a, b)))
        (found,) = nd.likely_similarity(x[None], y[None], np.array([float(len(a))]), np.array([float(len(b))]))
        assert abs(found - true) < 0.12
    assert not nd.sketch(np.empty(0, np.uint64)).any()


def test_components(spark):
    from spanloom.llm.components import components

    links = [(5, 4), (4, 3), (9, 3), (10, 11), (11, 12), (12, 13), (13, 14), (7, 7)]
    got = {r.v: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_that_share_half_a_digest(spark):
    rows = [(1, 3, 7, 70, b"a", 1), (2, 3, 7, 71, b"b", 2), (3, 3, 7, 70, b"a", 3), (4, 3, 8, 80, b"c", 4), (5, 0, None, None, None, 5)]
    found = spark.createDataFrame(rows, "doc_id long, n_shingles long, class long, check long, registers binary, row_key long")
    classes = nd._classes(found)
    assert {r["class"]: r.least != r.most for r in classes.collect()} == {7: True, 8: False}
    told = nd.told_apart(found, classes)
    assert told.columns == found.columns and {r.doc_id: r["class"] for r in told.collect()} == {1: 70, 2: 71, 3: 70, 4: 8, 5: None}
    assert {r["class"]: r.first_doc for r in nd._classes(told).collect()} == {70: 1, 71: 2, 8: 4}
