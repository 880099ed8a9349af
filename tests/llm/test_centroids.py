import hashlib
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import centroids


def brute(rows, k=8, rounds=10, seed="3", dimension=64):
    own = [(i, [math.floor(centroids.SCALE * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    middle = [list(v) for _, v in sorted(own, key=lambda r: (digest(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, c), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in own]
        for j in set(at):
            mine = [v for (_, v), a in zip(own, at, strict=True) if a == j]
            middle[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = [nearest(v) for _, v in own]
    inertia = {j: sum(d for d, a in at if a == j) for j in range(len(middle))}
    fits = lambda n: n if n < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), sha[j]) for (i, _), (d, j) in zip(own, at, strict=True)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as cluster", "'u' as upper", "2.0 as lower", "'n' as n", "'v' as v")


def test_ties_repeats_and_empty_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 50), [float(x) for x in rng.integers(-2, 3, 4) / 1024]) for i in range(120)]  # a grid: many ties
    rows += [(7, [0.0] * 4)] * 30 + [(None, [1.0, 2.0, 3.0, 4.0]), (60, None), (61, [1.0]), (62, [1.0, None, 1.0, 1.0]), (63, [float("nan")] * 4), (64, [float("inf")] * 4), (65, [])]
    for k, rounds in ((8, 10), (3, 1), (1, 2), (500, 2)):
        assert found(centroids.clustered(frame(spark, rows).repartition(3), k, rounds, dimension=4)[0]) == brute(rows, k, rounds, dimension=4)


def test_bounds_save_distances_and_change_nothing(spark):
    rng = np.random.default_rng(1)
    around = rng.normal(size=(6, 16))
    rows = [(i, [float(np.float32(x)) for x in around[i % 6] + rng.normal(scale=0.05, size=16)]) for i in range(600)]
    got, _, evaluated = centroids.clustered(frame(spark, rows), dimension=16)
    assert found(got) == brute(rows, dimension=16)
    assert len(evaluated) == 11 and sum(evaluated[3:]) < 0.3 * 8 * 600 * 8


def test_large_components(spark):
    rows = [(i, [float(x) * 10.0**p for x in (1, -2, i)]) for i in range(9) for p in (0, 3, 6, 9, 20)]
    got = found(centroids.clustered(frame(spark, rows, "double"), 4, 3, dimension=3)[0])
    assert got == brute(rows, 4, 3, dimension=3) and any(r[2] is None for r in got)
    assert found(centroids.clustered(frame(spark, [*rows, (99, [1e300, 0.0, 0.0])], "double"), 4, 3, dimension=3)[0]) == got


def test_empty(spark):
    assert centroids.clustered(frame(spark, []))[0].count() == 0
    assert centroids.clustered(frame(spark, [(1, None)]))[0].count() == 0


def test_sql_on_given_rows(spark, sf):
    own = duckdb.connect()
    own.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got, _, evaluated = centroids.clustered(spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", F.lit("l")))
    assert found(got) == sorted(own.sql(f"select {', '.join(got.columns)} from ({centroids.sql()})").fetchall(), key=repr)
    assert evaluated[-1] < 8 * got.count()
