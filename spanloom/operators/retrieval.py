"""Exact nearest neighbours by cosine similarity, filters after over-fetching, and similarity-weighted votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OVERFETCH = 5


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(rows: DataFrame, vector: str) -> DataFrame:
    """Unit vectors; zero and non-finite ones are left out (``index_quality`` counts them)."""
    own = rows.withColumn("__n", norm(F.col(vector))).filter((F.col("__n") > 0) & (F.col("__n") < float("inf")))
    return own.withColumn(vector, F.transform(vector, lambda x: x / F.col("__n"))).drop("__n")


def top_k(queries: DataFrame, index: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", extra: tuple[str, ...] = (), block: int = 2048) -> DataFrame:
    """query_id, key, extra columns, similarity and rank of the k most similar rows but the query's own, ties to the larger key.

    Blocks of queries meet blocks of the index in one join on a salt; a task multiplies two blocks and keeps each
    query's best k, so what is shuffled is blocks and k rows for each query and block, never pairs.
    """
    spark = index.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = {f.name: f.dataType for f in index.schema.fields}

    def packed(names: list[str]):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    cut = batch.slice(at, block)
                    keys = cut.column(key).to_numpy()
                    vectors = cut.column(vector).flatten().cast(pa.float64()).to_numpy()
                    rest = pa.RecordBatch.from_arrays([cut.column(c) for c in names], names) if names else None
                    sink = pa.BufferOutputStream()
                    if rest is not None:
                        with pa.ipc.new_stream(sink, rest.schema) as out:
                            out.write_batch(rest)
                    yield pa.RecordBatch.from_pydict({"keys": [keys.tobytes()], "vectors": [vectors.tobytes()], "rest": [sink.getvalue().to_pybytes()]})

        return part

    schema = "keys binary, vectors binary, rest binary"
    rows = index.select(key, vector, *extra).mapInArrow(packed(list(extra)), schema).withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(salts)).cast("int"))
    asked = queries.select(key, vector).coalesce(max(1, salts // 4)).mapInArrow(packed([]), schema).selectExpr("keys q_keys", "vectors q_vectors").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    fields = ", ".join(["query_id long", f"{key} long", *(f"{c} {kinds[c].simpleString()}" for c in extra), "similarity double"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a pair of blocks at a time, as views of the batch: copies of all would take as much again
                keys, vectors, rest, q_keys, q_vectors = (batch.column(c)[i].as_buffer() for c in ("keys", "vectors", "rest", "q_keys", "q_vectors"))
                keys, q_keys = np.frombuffer(keys, "i8"), np.frombuffer(q_keys, "i8")
                own, asked_own = np.frombuffer(vectors).reshape(len(keys), -1), np.frombuffer(q_vectors).reshape(len(q_keys), -1)
                similarity = asked_own @ own.T
                similarity[q_keys[:, None] == keys[None, :]] = -np.inf
                n = min(k, len(keys))
                edge = -np.partition(-similarity, n - 1, axis=1)[:, n - 1]
                q, at = np.nonzero((similarity >= edge[:, None]) & (similarity > -np.inf))
                more = pa.ipc.open_stream(rest).read_next_batch().take(pa.array(at)).columns if extra else []
                yield pa.RecordBatch.from_arrays([pa.array(q_keys[q]), pa.array(keys[at]), *more, pa.array(similarity[q, at])], ["query_id", key, *extra, "similarity"])

    found = rows.join(asked, "salt").mapInArrow(part, fields)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc(key))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def excluding_text(hits: DataFrame, query_text: str, text: str, fold) -> DataFrame:
    """Hits whose folded text is not the query's."""
    return hits.filter(fold(F.col(query_text)) != fold(F.col(text)))


def filtered(hits: DataFrame, allowed: Column, k: int) -> DataFrame:
    """Of over-fetched hits those that a condition allows, ranked again; there may be fewer than k."""
    order = W.partitionBy("query_id").orderBy("rank")
    own = hits.filter(allowed).withColumn("rank", F.row_number().over(order))
    return own.filter(F.col("rank") <= k)


def weighted_vote(hits: DataFrame, label: str) -> DataFrame:
    """The label with the largest weight for each query and its share. A similarity of 0 or less weighs 1e-9 over its rank."""
    weight = F.when(F.col("similarity") > 0, F.col("similarity")).otherwise(F.lit(1e-9) / F.col("rank"))
    own = hits.filter(F.col(label).isNotNull()).groupBy("query_id", label).agg(F.sum(weight).alias("w"), F.max("similarity").alias("best"))
    own = own.groupBy("query_id").agg(F.max(F.struct("w", "best", label)).alias("m"), F.sum("w").alias("total"))
    return own.select("query_id", F.col(f"m.{label}").alias(label), (F.col("m.w") / F.col("total")).alias("confidence"))


def index_quality(rows: DataFrame, key: str, vector: str, tolerance: float = 1e-5) -> DataFrame:
    """One row: rows, distinct keys, least and largest dimension, non-finite and zero vectors, and vectors off unit length."""
    own = rows.withColumn("__n", norm(F.col(vector)))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.agg(
        F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.min(F.size(vector)).alias("min_dimension"), F.max(F.size(vector)).alias("max_dimension"),
        F.count_if(~finite).alias("n_not_finite"), F.count_if(F.col("__n") == 0).alias("n_zero"), F.count_if(F.abs(F.col("__n") - 1) > tolerance).alias("n_not_unit"),
    )
