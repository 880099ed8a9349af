"""Centroid clustering of whole-number vectors with Elkan's bounds.

Each vector keeps its cluster, an upper bound on the distance to its own centroid and a lower bound on that to every
other. After a round the bounds move with the centroids; a distance is computed only where neither the bounds nor half
the distance between two centroids rule the other centroid out. Bounds are rounded outwards and must rule out strictly, so
ties still fall to the smaller number; distances that are computed are exact integers, and so are sums and centroids.

A round is one pass: each task reads its vectors and bounds, and writes them with the new bounds and one row of sums for
each cluster. The sums are added by Spark; only centroids (clusters times components) pass through the driver. The state
of a round lies in the shared folder and that of the round before is deleted, so two are kept at most.

Results on odd input: vectors that are null, of another length, or hold a null or non-finite component take no part, nor
do those with a component of LIMIT and more, for which no distance has a number in 64 bits; a null vec_id takes part but
is the last to be a start; rows that repeat an id are vectors of their own, of which the smaller vector starts first; with
fewer vectors than clusters there are as many clusters as vectors; distances and sums beyond 64 bits are null; an empty
table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

SCALE = 1024
#: Integers below it have squared distances in 64 bits; others are computed with Python's integers.
SMALL = 2**27
LIMIT = 1e30
#: The state of a round: vectors and lower bounds as bytes, rows of sums behind those of vectors.
STATE = "vec_id long, v binary, cluster int, upper double, lower binary, distance long, n long, sums array<decimal(38,0)>, inertia decimal(38,0), evaluated long"


def kept(vectors: DataFrame, dimension: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v of the vectors that take part."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    if own.schema["v"].dataType.elementType.typeName() != "float":
        own = own.withColumn("v", F.col("v").cast("array<double>"))
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < LIMIT)
    return own.filter(F.size("v") == dimension).filter(F.forall("v", usable))


def whole(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * v): whole numbers, which doubles hold exactly."""
    return np.floor(v.astype(np.float64) * SCALE)


def starts(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors whose ids have the smallest digests."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), F.col("v").cast("array<double>")).select("v").limit(k).collect()
    return [[int(x) for x in whole(np.array(r.v))] for r in rows]


def _squares(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def _up(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf), np.inf)


def _down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), 0), 0), 0)


def _between(a: list[int], b: list[int]) -> tuple[float, float]:
    """The distance, rounded down and up."""
    square = sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    root = math.sqrt(square)  # of an integer below LIMIT's square
    return max(math.nextafter(math.nextafter(root, 0), 0), 0.0), math.nextafter(math.nextafter(root, math.inf), math.inf)


class Round:
    """Centroids, how far each has moved since the last round, and half the distances between them."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        k = len(centroids)
        self.centroids = centroids
        self.moved = np.array([_between(a, b)[1] if a != b else 0.0 for a, b in zip(before, centroids, strict=True)] if before else [0.0] * k)
        self.half = np.array([[_between(a, b)[0] / 2 if i != j else 0.0 for j, b in enumerate(centroids)] for i, a in enumerate(centroids)])
        others = self.half + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.nearest = others.min(axis=1)
        self.small = max(abs(x) for c in centroids for x in c) < SMALL

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Changes cluster and bounds in place; gives the number of distances computed."""
        if not self.small or np.abs(x).max(initial=0) >= SMALL:
            return self._assign_large(x, cluster, upper, lower)
        upper += self.moved[cluster]
        np.nextafter(upper, np.inf, out=upper)
        lower -= self.moved
        np.maximum(np.nextafter(lower, -np.inf), 0, out=lower)
        rows = np.flatnonzero(upper >= self.nearest[cluster])
        centroids, own = np.array(self.centroids, np.int64), x[rows].astype(np.int64)
        a, bounds = cluster[rows], lower[rows]
        best = _squares(own, centroids[a])
        u, n = _up(best), len(rows)
        bounds[np.arange(len(rows)), a] = _down(best)
        for j in range(len(centroids)):
            at = np.flatnonzero((a != j) & (bounds[:, j] <= u) & (self.half[a, j] <= u))
            if not at.size:
                continue
            d = _squares(own[at], centroids[j])
            n += at.size
            bounds[at, j] = _down(d)
            nearer = (d < best[at]) | ((d == best[at]) & (j < a[at]))
            to = at[nearer]
            a[to], best[to] = j, d[nearer]
            u[to] = _up(best[to])
        cluster[rows], upper[rows], lower[rows] = a, u, bounds
        return n

    def _assign_large(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        for i, row in enumerate(x):
            own = [int(v) for v in row]
            cluster[i] = min(range(len(self.centroids)), key=lambda j: (sum((v - c) ** 2 for v, c in zip(own, self.centroids[j], strict=True)), j))
        upper[:], lower[:] = np.inf, 0
        return len(x) * len(self.centroids)

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> list[int]:
        if self.small and np.abs(x).max(initial=0) < SMALL:
            return _squares(x.astype(np.int64), np.array(self.centroids, np.int64)[cluster]).tolist()
        return [sum((int(v) - c) ** 2 for v, c in zip(row, self.centroids[j], strict=True)) for row, j in zip(x, cluster, strict=True)]


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row as bytes."""
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32) if len(rows) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A column of bytes or of lists as a matrix that can be changed."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(-1, width)
    column = column.cast(pa.binary())
    first, last = (int.from_bytes(column.buffers()[1][4 * i : 4 * i + 4].to_pybytes(), "little") for i in (column.offset, column.offset + len(column)))
    return np.frombuffer(column.buffers()[2].slice(first, last - first), kind).reshape(-1, width).copy()


def _pass(now: Round, dimension: int, kind: type, last: bool):
    """What a task does in a round: its vectors with new clusters and bounds, then a row of sums for each cluster. In the
    first round vectors come as lists, without bounds."""
    k = len(now.centroids)
    decimal = pa.decimal128(38, 0)
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.binary()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(decimal)), ("inertia", decimal), ("evaluated", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        n, sums, inertia, evaluated = [0] * k, [[0] * dimension for _ in range(k)], [0] * k, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _rows(batch.column("v"), kind, dimension)
            x = whole(v)
            if "lower" in batch.schema.names:
                cluster, upper = (batch.column(c).to_numpy().copy() for c in ("cluster", "upper"))
                lower = _rows(batch.column("lower"), np.float64, k)
            else:
                cluster, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros((len(x), k))
            evaluated += now.assign(x, cluster, upper, lower)
            far = now.distances(x, cluster) if last else [None] * len(x)
            exact = np.abs(x).max() < SMALL
            for j in range(k):
                at = np.flatnonzero(cluster == j)
                n[j] += at.size
                more = x[at].astype(np.int64).sum(axis=0).tolist() if exact else [sum(map(int, c)) for c in x[at].T]
                sums[j] = [a + b for a, b in zip(sums[j], more, strict=True)]
                inertia[j] += sum(far[i] for i in at) if last else 0
            fits = [d if d is not None and d < 2**63 else None for d in far]
            none = pa.nulls(len(x))
            columns = [batch.column("vec_id"), _bytes(v), cluster, upper, _bytes(lower), pa.array(fits, pa.int64()), *(none.cast(f.type) for f in list(schema)[6:])]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)
        if any(n):
            found = [j for j in range(k) if n[j]]
            rows = {"cluster": found, "n": [n[j] for j in found], "sums": [[Decimal(x) for x in sums[j]] for j in found], "inertia": [Decimal(min(inertia[j], 2**63)) for j in found], "evaluated": [evaluated] + [0] * (len(found) - 1)}
            yield pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * len(found)), f.type) for f in schema], schema=schema)

    return run


def _sums(state: DataFrame) -> dict[int, tuple[int, list[int], int, int]]:
    """For each cluster the number of vectors, the sums of their components, their inertia and the distances computed."""
    own = state.filter("n is not null").select("cluster", "n", "inertia", "evaluated", F.posexplode("sums").alias("i", "s"))
    found = own.groupBy("cluster", "i").agg(*(F.sum(c).alias(c) for c in ("n", "s", "inertia", "evaluated"))).orderBy("cluster", "i").collect()  # clusters times components
    by = {j: [r for r in found if r.cluster == j] for j in {r.cluster for r in found}}
    return {j: (rows[0].n, [int(r.s) for r in rows], int(rows[0].inertia), rows[0].evaluated) for j, rows in by.items()}


def _drop(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dimension: int = 64) -> tuple[DataFrame, list[list[int]], list[int]]:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256; the centroids; and how many distances each
    pass computed (without bounds: vectors times clusters)."""
    spark = vectors.sparkSession
    own = kept(vectors, dimension)
    centroids = starts(own, k, seed)
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], columns), [], []
    kind = np.float32 if own.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    state = own
    before, path, evaluated = None, None, []
    for nth in range(rounds + 1):
        older, path = path, runtime.scratch(spark, f"centroids-{nth}")
        state.mapInArrow(_pass(Round(centroids, before), dimension, kind, nth == rounds), STATE).write.parquet(path)
        whole_state = spark.read.schema(STATE).parquet(path)
        sums = _sums(whole_state)
        evaluated.append(sum(s[3] for s in sums.values()))
        state = whole_state.filter("n is null").select("vec_id", "v", "cluster", *(["distance"] if nth == rounds else ["upper", "lower"]))
        if nth < rounds:
            before, centroids = centroids, [[x // sums[j][0] for x in sums[j][1]] if j in sums else c for j, c in enumerate(centroids)]
        if older:
            _drop(spark, older)
    fits = lambda n: n if n < 2**63 else None
    total = fits(sum(s[2] for s in sums.values()))
    about = [(j, fits(s[2]), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, s in sums.items()]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(named), "cluster").select(*(c.split()[0] for c in columns.split(", "))), centroids, evaluated  # k rows


def sql(k: int = 8, rounds: int = 10, seed: str = "3", dimension: int = 64) -> str:
    steps = [
        f"e as materialized (select row_number() over () id, vec_id, embedding from embeddings where len(embedding) = {dimension} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dimension})",
        f"x as materialized (select id, i, floor({SCALE} * embedding[i]::double)::hugeint x from e, range(1, {dimension + 1}) t(i))",
        f"s as (select id, row_number() over (order by sha256('{seed}:' || vec_id), embedding) - 1 k from e qualify k < {k})",
        "c0 as materialized (select k, i, x c from s join x using (id))",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} as (select id, k, sum((x - c) * (x - c))::hugeint d from x join c{n} using (i) group by all)")
        steps.append(f"a{n} as materialized (select id, k, d from d{n} qualify row_number() over (partition by id order by d, k) = 1)")
        if n < rounds:
            steps.append(f"m{n} as (select k, i, sum(x)::hugeint t, count(*)::hugeint n from a{n} join x using (id) group by all)")
            steps.append(f"c{n + 1} as materialized (select k, i, case when n is null then c else (t - ((t % n) + n) % n) // n end c from c{n} left join m{n} using (k, i))")
    end = f"a{rounds} a join e using (id) join (select k, sha256(string_agg(c::varchar, ',' order by i)) centroid_sha256 from c{rounds} group by k) using (k)"
    return f"with {', '.join(steps)} select vec_id, a.k::integer as cluster, a.d::bigint distance, (sum(a.d) over (partition by a.k))::bigint cluster_inertia, (sum(a.d) over ())::bigint inertia, centroid_sha256 from {end}"
