"""Approximate nearest neighbours by a hash-prefix forest.

Every block of vectors has a forest of its own: for each tree the vectors' hash strings (signs of random projections,
packed into 64-bit words) in sorted order. A query descends in all trees at once to the longest prefixes that match and
then ascends level by level, in step, taking in the rows whose prefixes match in any tree, until it has its share of
candidates. Equal vectors stand in the forest once and count once towards the share, and all of them are candidates when
one is. Distances are computed exactly, in double precision, and the best of each block are merged.

Queries form blocks too. Each block of vectors meets each block of queries once, in a join on a block number that is
salted over the partitions; no task needs more than one block of either at a time.

Results on odd input: vectors that are null, zero, of another length than most or hold null or non-finite
components take no part; with fewer candidates than k a query gets them all; ties go to the smaller id; rows that repeat
an id are all candidates, except for a query with that id; a repeated query is answered once; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import runtime

BLOCK = "block int, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.filter("vec_id is not null and size(v) > 0").filter(finite).filter(F.exists("v", lambda x: x != 0))


def _blocks(rows: DataFrame, dimension: int, most_rows: int) -> DataFrame:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, vectors, n, block = [], [], 0, TaskContext.get().partitionId()

        def out():
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "ids": [np.concatenate(ids).tobytes()], "vectors": [np.concatenate(vectors).tobytes()]})

        for batch in batches:
            for at in range(0, batch.num_rows, most_rows):
                cut = batch.slice(at, most_rows)
                if n + cut.num_rows > most_rows:
                    yield out()
                    ids, vectors, n = [], [], 0
                ids.append(cut.column("vec_id").to_numpy())
                vectors.append(cut.column("v").flatten().to_numpy().reshape(-1, dimension))
                n += cut.num_rows
        if n:
            yield out()

    return rows.filter(F.size("v") == dimension).mapInArrow(part, BLOCK)


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int = 20_240_601):
        rng = np.random.default_rng(seed)
        packed = np.ascontiguousarray(vectors + 0.0).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel()  # + 0.0: one zero
        _, first, self.of = np.unique(packed, return_index=True, return_inverse=True)
        vectors = vectors[first]
        self.planes = [rng.standard_normal((vectors.shape[1], bits)) for _ in range(trees)]
        self.bits, self.order, self.sorted = bits, [], []
        for strings in self._strings(vectors):
            if not self.order:
                names, self.string = np.unique(strings, return_inverse=True)
                self.n_strings = len(names)
            order = np.argsort(strings, kind="stable")
            self.order.append(order)
            self.sorted.append(strings[order])

    def _strings(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        for planes in self.planes:
            yield ((vectors @ planes > 0) * weights).sum(1, dtype=np.uint64)

    def _enough(self, seen: np.ndarray, least: int, share: float) -> bool:
        if np.count_nonzero(seen) < min(least, len(seen)):
            return False
        strings = np.zeros(self.n_strings, bool)
        strings[self.string[seen]] = True
        return np.count_nonzero(strings) >= int(share * self.n_strings)

    def candidates(self, queries: np.ndarray, least: int, share: float = 0.0) -> Iterator[np.ndarray]:
        """For each query the rows that match it in some tree at the deepest level that gives, in distinct vectors, ``least``
        and ``share`` of all or more, and ``share`` of the first tree's full hash strings, of which near copies have few."""
        n, depths = len(self.sorted[0]), range(self.bits, -1, -1)
        least = max(least, int(share * n))
        strings = list(self._strings(queries))
        low = np.empty((len(strings), self.bits + 1, len(queries)), np.int64)
        high = np.empty_like(low)
        for t, own in enumerate(strings):
            for depth in depths:
                shift = np.uint64(self.bits - depth)
                first = (own >> shift) << shift if depth else np.zeros_like(own)
                last = first | ((np.uint64(1) << shift) - np.uint64(1))
                low[t, depth] = np.searchsorted(self.sorted[t], first, "left")
                high[t, depth] = np.searchsorted(self.sorted[t], last, "right")
        totals = (high - low).sum(0)
        for q in range(len(queries)):
            # rows in several trees count once, so the ascent starts where the sum suffices and goes on from there
            enough = np.nonzero(totals[:, q] >= min(least, n))[0]
            depth = int(enough.max()) if len(enough) else 0
            seen = np.zeros(n, bool)
            while True:  # what matches at a level matches at those above it too
                for t in range(len(strings)):
                    seen[self.order[t][low[t, depth, q] : high[t, depth, q]]] = True
                if depth == 0 or self._enough(seen, least, share):
                    break
                depth -= 1
            yield np.nonzero(seen[self.of])[0]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = 48, bits: int = 24, share: float = 0.4, most_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance). vectors and queries have vec_id and v (see ``valid``).

    share: of a block's distinct vectors, the part to take as candidates at least. It sets the recall; it is high by default because
    vectors without structure in many dimensions have neighbours that are hardly nearer than the rest.
    """
    spark = vectors.sparkSession
    lengths = vectors.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = lengths.n
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _blocks(vectors, dimension, most_rows).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    asked = _blocks(queries.dropDuplicates(["vec_id"]).coalesce(max(1, salts // 4)), dimension, 1024).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = forest = None
        for batch in batches:
            for ids, packed, q_ids, q_packed in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "q_ids", "q_vectors")), strict=True):
                if held != ids:
                    held, own_ids, own = ids, np.frombuffer(ids, "i8"), np.frombuffer(packed, "f8").reshape(-1, dimension)
                    forest = Forest(own, trees, bits)
                asked_ids, asked_own = np.frombuffer(q_ids, "i8"), np.frombuffer(q_packed, "f8").reshape(-1, dimension)
                out: list[list] = [[], [], []]
                # all products at once tell which candidates can be among the nearest; their distances are then computed exactly
                sums, q_sums = (own**2).sum(1), (asked_own**2).sum(1)
                slack = 1e-12 * (dimension + 1)
                for q, rows_found in enumerate(forest.candidates(asked_own, 4 * k, share)):
                    if q % 128 == 0:
                        rough = sums - 2 * (asked_own[q : q + 128] @ own.T)
                    rows_found = rows_found[own_ids[rows_found] != asked_ids[q]]
                    if len(rows_found) > k:
                        about = rough[q % 128][rows_found]
                        edge = np.partition(about, k - 1)[k - 1] + slack * (sums[rows_found].max() + q_sums[q])
                        rows_found = rows_found[~(about > edge)]
                    score = np.sqrt(((own[rows_found] - asked_own[q]) ** 2).sum(1))
                    best = np.lexsort((own_ids[rows_found], score))[:k]
                    out[0] += [int(asked_ids[q])] * len(best)
                    out[1] += own_ids[rows_found[best]].tolist()
                    out[2] += score[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    # a block is work for a task though it is few bytes, so partitions keep their number
    found = rows.repartition(salts, "salt").join(asked.repartition(salts, "salt"), "salt").select("ids", "vectors", "q_ids", "q_vectors").mapInArrow(part, FOUND)
    order = W.partitionBy("query_id").orderBy("score", "vec_id")  # at most k rows from each block
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, divisor: int = 100, k: int = 10, **options) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by divisor."""
    rows = valid(vectors)
    rows = runtime.written(rows, "neighbour-vectors")
    return search(rows, rows.filter(F.col("vec_id") % divisor == 0), k, **options)
