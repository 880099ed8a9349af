import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import neighbours


def _rows(spark, n, seed=0, dimension=16):
    rng = np.random.default_rng(seed)
    own = rng.standard_normal((n, dimension))
    own[n // 2 : n // 2 + 20] = own[0]  # ties
    return own, spark.createDataFrame([(i, own[i].astype("f4").tolist(), "x") for i in range(n)], "vec_id long, embedding array<float>, salt string").repartition(3)


def _brute(own, divisor, k):
    own, out = own.astype("f4").astype("f8"), {}
    for q in range(0, len(own), divisor):
        d = np.sqrt(((own - own[q]) ** 2).sum(1))
        out[q] = [(round(float(d[i]), 9), i) for i in sorted((i for i in range(len(own)) if i != q), key=lambda i: (d[i], i))[:k]]
    return out


def test_recall_and_order(spark):
    own, rows = _rows(spark, 3000)
    got = {}
    for r in neighbours.nearest(rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = _brute(own, 100, 10)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(f[1], f[2]) for f in found] == sorted((f[1], f[2]) for f in found)
        hits += len({f[2] for f in found} & {i for _, i in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_all_candidates_is_exact(spark):
    own, rows = _rows(spark, 300)
    got = {}
    for r in neighbours.nearest(rows, share=1.0).collect():
        got.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in _brute(own, 100, 10).items()}


def test_odd_vectors(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 0.0]), (100, [1.0, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [3.0, 0.0]), (None, [1.0, 1.0]), (200, [1.0]), (7, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>"
    )
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(rows).collect())
    assert got == [(0, 1, 100, 0.5), (0, 2, 6, 2.0), (100, 1, 0, 0.5), (100, 2, 6, float(np.sqrt(4.25)))]
    assert neighbours.nearest(rows.filter("vec_id > 1000")).count() == 0
    assert neighbours.nearest(rows.filter("vec_id = 6")).count() == 0


def test_longest_prefix_first():
    rng = np.random.default_rng(1)
    own = rng.standard_normal((500, 8))
    forest = neighbours.Forest(own, 6, 16)
    (found,) = forest.candidates(own[:1], 20)
    assert 0 in found and len(found) >= 20
    (every,) = forest.candidates(own[:1], 500)
    assert len(every) == 500


def _with_copies(n, part, noise=0.0):
    """Unit vectors in 64 dimensions of which the first part are copies of one."""
    rng = np.random.default_rng(3)
    own = rng.standard_normal((n, 64))
    copies = int(n * part)
    own[:copies] = own[0] + noise * rng.standard_normal((copies, 64))
    return own / np.linalg.norm(own, axis=1, keepdims=True), copies


def test_copies_count_once():
    own, copies = _with_copies(2400, 1 / 3)
    forest = neighbours.Forest(own, 48, 24)
    for found in forest.candidates(own[copies::40], 40, 0.4):
        assert len(np.unique(own[found], axis=0)) >= int(0.4 * (len(own) - copies + 1))
        assert np.count_nonzero(found < copies) in (0, copies)
    signed = neighbours.Forest(np.array([[0.0, 1.0], [-0.0, 1.0], [1.0, 1.0]]), 2, 8)
    assert len(signed.sorted[0]) == 2


def test_recall_beside_copies(spark):
    """Queries outside a group of copies keep their recall, whether the copies are exact or near."""
    for part, noise in ((1 / 3, 0.0), (0.8, 0.0), (0.8, 0.01)):
        own, copies = _with_copies(5000, part, noise)
        order = np.random.default_rng(5).permutation(len(own))
        own = own[order]
        rows = spark.createDataFrame([(i, own[i].astype("f4").tolist()) for i in range(len(own))], "vec_id long, embedding array<float>").coalesce(1)
        want = _brute(own, 50, 10)
        hits = asked = 0
        got = {}
        for r in neighbours.nearest(rows, divisor=50).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        for q, found in got.items():
            if order[q] >= copies:
                asked, hits = asked + 10, hits + len(found & {i for _, i in want[q]})
            elif not noise:
                assert found == {i for _, i in want[q]}
        assert asked >= 100 and hits / asked >= 0.9


def test_query_of_entry(spark, sf):
    from spanloom.llm.queries import QUERIES
    from spanloom.runtime import table

    got = QUERIES["op1_hash_prefix_forest"](spark, sf)
    assert got.groupBy("query_id").agg(F.count("*").alias("n")).filter("n <> 10").count() == 0
    assert got.select("query_id").distinct().count() == table(spark, sf, "embeddings").filter("vec_id % 100 = 0").count()
