import hashlib
import random

import numpy as np

from spanloom.llm import repeats
from spanloom.llm.bwt import window_classes

from .odd import DOCS, documents


def brute(docs, width=100):
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - width + 1):
            window = raw[i : i + width]
            if window in seen:
                cover[i] += 1
                cover[i + width] -= 1
            seen.add(window)
        hit = np.cumsum(cover)[:-1] > 0
        kept = bytes(b for b, h in zip(raw, hit, strict=True) if not h)
        runs = np.count_nonzero(np.diff(np.concatenate([[0], hit.astype(int)])) == 1)
        out[doc_id] = (len(raw), int(hit.sum()), int(runs), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfgé')}{i}" for i in range(900)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(40) for _ in range(5)]
    docs = []
    for d in range(n):
        parts = [prose(rng.randrange(1, 60)) for _ in range(3)]
        if d % 3 == 0:
            parts.insert(1, shared[0])  # in a third of all texts
        if d % 4 == 0:
            own = rng.choice(shared)
            cut = rng.randrange(len(own) // 2)
            parts.append(own[cut : cut + rng.randrange(90, 200)])
        docs.append((d, " ".join(parts)))
    docs += [(n, docs[3][1]), (n + 1, docs[3][1]), (n + 2, "a" * 700), (n + 3, "ab" * 300), (n + 4, docs[9][1] * 2), (n + 5, "x" * 99), (n + 6, "x" * 100 + "y")]
    return docs


def result(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows.collect()}


def test_report_is_exact(spark):
    docs = corpus()
    assert result(repeats.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == brute(docs)


def test_several_transforms_and_parts(spark, monkeypatch):
    docs = corpus(seed=8, n=30)
    heads, strings = [], []
    for d, text in docs:
        raw = text.encode()
        if len(raw) >= 100:
            heads.append((0, d, 0, len(raw) - 99))
            strings.append(raw)
    whole = repeats.repeated_windows(np.array(heads), strings, 100)
    monkeypatch.setattr(repeats, "ONE_TRANSFORM", 3000)
    parts = repeats.repeated_windows(np.array(heads), strings, 100)
    assert sorted(zip(*map(list, whole), strict=True)) == sorted(zip(*map(list, parts), strict=True)) and len(whole[0])
    texts = [t.encode() for _, t in docs]
    one = {(key, at) for data, valid, begins, of in repeats._parts(texts, list(range(len(texts))), 100, 1 << 20) for at in np.nonzero(valid)[0] for key in [int(of[np.searchsorted(begins, at, "right") - 1][0])]}
    assert len(one)


def test_long_text_in_parts(spark, monkeypatch):
    docs = [(1, " ".join(f"w{i}" for i in range(3000))), (2, " ".join(f"w{i}" for i in range(1500, 2500)))]
    want = brute(docs)
    monkeypatch.setattr(repeats._parts, "__defaults__", (4000,))
    assert result(repeats.report(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_window_classes():
    rng = random.Random(3)
    for _ in range(150):
        width = rng.choice([1, 2, 3, 5, 8])
        strings = [bytes(rng.choice(b"abc\x00") for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 7))]
        to, back = {}, {}
        for s, own in zip(strings, window_classes(strings, width), strict=True):
            assert len(own) == max(0, len(s) - width + 1)
            for i, c in enumerate(own.tolist()):
                w = s[i : i + width]
                assert to.setdefault(w, c) == c and back.setdefault(c, w) == w


def test_odd_rows(spark):
    text = "".join(random.Random(1).choices("abcdefghij", k=151))
    rows = [*DOCS, (20, text, "en", 1), (21, text, "en", 1), (21, text, "en", 1), (21, "other " + text, "en", 1)]
    got = repeats.report(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.n_bytes == r.n_removed == r.n_spans == 0 for r in got if r.doc_id in (3, 4))
    removed = sorted((r.n_bytes, r.n_removed) for r in got if r.doc_id in (20, 21))
    assert removed == [(151, 0), (151, 151), (151, 151), (157, 151)]
    kept = repeats.without_repeats(documents(spark, rows))
    assert kept.columns == documents(spark).columns and kept.count() == len(rows)
    assert repeats.report(documents(spark).limit(0)).count() == 0


def test_cut_characters(spark):
    base = "é" * 120
    docs = [(1, base), (2, "a" + base)]
    got = {r.doc_id: r.text for r in repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[2] == "a" and got[1].startswith("é")


def every_anchor(docs, width=100):
    texts = [(t or "").encode() for _, t in docs]
    found = [repeats.records(data, valid, width)[2] for data, valid, _, _ in repeats._parts(texts, list(range(len(texts))), width)]
    own = np.unique(np.concatenate(found))
    return own, np.full(len(own), 3, np.uint64)


def test_frequent_anchors_over_several_buckets(spark, monkeypatch):
    """With every anchor dealt over three buckets the report stays the same."""
    docs = corpus(seed=4)
    hot = every_anchor(docs)
    monkeypatch.setattr(repeats, "_hot", lambda *_: hot)
    assert result(repeats.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == brute(docs)


def test_sample_finds_frequent_anchors(spark, monkeypatch):
    docs = corpus(n=150)
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    rows = spark.createDataFrame(docs, "doc_key long, text string").repartition(30)
    own, parts = repeats._hot(rows, 100, 200, least=15)
    assert 0 < len(own) < 200 and (np.diff(own.astype(object)) > 0).all() and parts.min() >= 2
