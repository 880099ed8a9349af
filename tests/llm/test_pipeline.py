import hashlib
import struct

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from spanloom.llm import byte_bpe, decontamination, toxicity
from spanloom.runtime import table

from .test_near_duplicates import brute as near
from .test_repeats import brute as removed


def test_stages_in_order(spark, sf):
    """Each stage against a plain statement of what it does, on the rows its predecessor kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_repeats", "decontamination", "byte_bpe"]
    docs = table(spark, sf, "documents")
    columns = docs.columns
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        steps.append(docs)
    assert all(s.columns == columns for s in steps[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    first = {r.doc_id: r for r in table(spark, sf, "documents").collect()}

    lexicon = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.scored(table(spark, sf, "documents"), lexicon).collect()}
    assert rows[0].keys() == {d for d in first if scores[d] < 0.7} and len(rows[0]) < len(first)

    want = near([(d, r.text) for d, r in rows[0].items()])
    assert rows[1].keys() == {d for d, (_, _, kept) in want.items() if kept}

    cut = removed([(d, r.text) for d, r in rows[1].items()])
    assert rows[2].keys() == rows[1].keys()
    for d, r in rows[2].items():
        assert (r.text == rows[1][d].text) == (cut[d][1] == 0) and r.n_chars == len(r.text)
        assert len(r.text.encode()) <= cut[d][0] - cut[d][1]

    items = [decontamination.normal(r.text) for r in table(spark, sf, "benchmark").collect()]
    leaks = {d for d, r in rows[2].items() if any(i in decontamination.normal(r.text) for i in items)}
    assert rows[3].keys() == rows[2].keys() - leaks - edited(spark, sf, rows[2])

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert rows[4].keys() == rows[3].keys()
    for d, r in rows[4].items():
        ids = encoding.encode_ordinary(rows[3][d].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


def edited(spark, sf, rows):
    """Documents that hold an item with up to 8 % edits, by the plain dynamic programme over all pairs that share a piece."""
    items = {decontamination.normal(r.text) for r in table(spark, sf, "benchmark").collect() if r.text and r.text.strip()}
    return {d for d, r in rows.items() if any(distance(i, t, decontamination.budget(len(i), 0.08)) for t in [decontamination.normal(r.text or "")] for i in items if any(p in t for _, p in decontamination.pieces(i, 0.08)))}


def distance(item, text, most):
    """Whether the item is within ``most`` edits of a substring of the text."""
    above = np.arange(len(item) + 1)
    for c in text:
        diagonal = above[:-1] + np.array([c != x for x in item])
        row = np.concatenate(([0], np.minimum(diagonal, above[1:] + 1)))
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
        if row[-1] <= most:
            return True
        above = row
    return False


def test_near_copies_without_an_id(spark, sf):
    """A near copy with a null doc_id goes, though others without an id stay."""
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (None, " ".join([*words[:50], "x", *words[51:]])), (None, "words of its own and no copy of any"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], *rows[2:]], key=repr)


def test_leaks_without_an_id(spark, sf):
    """A leak with a null doc_id goes, and no clean document for having the same id or none."""
    item = max((r.text for r in table(spark, sf, "benchmark").collect() if r.text), key=len)
    clean = [(1, "no item here"), (None, "none here either"), (2, "of one id, but clean"), (None, None)]
    leaks = [(None, f"before {item} after"), (2, item), (3, f"see: {item}")]
    docs = spark.createDataFrame([*clean, *leaks], "doc_id long, text string")
    got = corpus_pipeline.drop_leaks(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(clean, key=repr)


CLASHES = ["__text", "__score", "__n_hits", "__row", "__own", "__key", "__places", "__doc_key", "__ROW_", "score", "place", "bucket", "class", "row_key"]


def test_columns_with_the_names_that_stages_use(spark, sf):
    """All but the last stage return the columns of documents, whatever they are called, and take an empty table."""
    passage = "a passage of more than a hundred bytes that two of the documents have in common, word for word, from end to end; "
    rows = [(1, f"first words {passage}"), (2, f"second and other words here {passage}"), (2, f"second and other words here {passage}"), (None, None), (None, "no id"), (None, "no id"), (3, ""), (2, "another text of id two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'{i}' as `{c}`" for i, c in enumerate(CLASHES)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert all(tuple(r)[2:] == tuple(map(str, range(len(CLASHES)))) for r in kept)
        if name == "suffix_repeats":
            assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted((r[0] or 0, r[1].removesuffix(f" {passage}") if r[0] == 2 else r[1] or "") for r in rows)
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.encode(spark, docs, sf).count() == len(rows)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
