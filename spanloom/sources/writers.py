"""Writers: canonical JSON lines, linked tables and their reassembly, score files, manifests and vector indexes."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import index_quality, normalised
from . import readers


def canonical_lines(rows: DataFrame) -> DataFrame:
    """value: each row as compact JSON with its keys in order."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(rows: DataFrame, path: str, split: str | None = None) -> None:
    """Canonical JSON lines, in one folder for each value of the split column."""
    if split:
        own = rows.select(F.col(split).alias("__split"), F.to_json(F.struct(*sorted(rows.columns))).alias("value"))
        own.write.mode("overwrite").partitionBy("__split").text(path)
    else:
        canonical_lines(rows).write.mode("overwrite").text(path)


def flattened(windows: DataFrame) -> dict[str, DataFrame]:
    """examples, sentences and entities as three linked tables."""
    derived = {"character_count": F.length("text"), "entity_count": F.size("entities"), "section_count": F.size("sections")}
    names = lambda schema: [c.split(" ")[0] for c in schema.split(", ")]
    return {
        "examples": windows.withColumns(derived).select(*names(readers.EXAMPLES)),
        "sentences": windows.select("example_id", "doc_id", F.inline("sentences")).select(*names(readers.SENTENCES)),
        "entities": windows.select("example_id", "doc_id", F.inline("entities")).select(*names(readers.ENTITIES)),
    }


def write_flat(windows: DataFrame, folder: str) -> str:
    """The three tables as CSV, published together."""
    save = lambda rows: lambda path: rows.write.option("header", True).option("escape", '"').csv(path)
    return publish(windows.sparkSession, folder, {name: save(rows) for name, rows in flattened(windows).items()})


def reassembled(examples: DataFrame, sentences: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested windows from the three tables (sections empty), and the violations: counts and slices that differ, orphans."""
    pack = lambda rows, order: rows.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c not in ("example_id", "doc_id", order)]))).alias("x"))
    own = examples.join(pack(sentences, "relative_sentence_index").withColumnRenamed("x", "sentences"), "example_id", "left").join(pack(entities, "entity_id").withColumnRenamed("x", "entities"), "example_id", "left")
    sized = lambda c: F.coalesce(F.size(c), F.lit(0))
    off = lambda c: F.exists(c, lambda s: F.substring(F.col("text"), s["start_char"] + F.lit(1), s["end_char"] - s["start_char"]) != s["text"])
    broken = F.array_compact(F.array(
        F.when(sized("sentences") != F.col("sentence_count"), "sentence_count"), F.when(sized("entities") != F.col("entity_count"), "entity_count"), F.when(F.length("text") != F.col("character_count"), "character_count"),
        F.when(F.coalesce(off("sentences"), F.lit(False)), "sentence_text"), F.when(F.coalesce(off("entities"), F.lit(False)), "entity_text"),
    ))
    bad = own.select(F.explode(broken).alias("rule"), F.col("example_id").alias("key"))
    for name, rows in (("orphan_sentence", sentences), ("orphan_entity", entities)):
        bad = bad.unionByName(rows.join(examples.select("example_id"), "example_id", "left_anti").select(F.lit(name).alias("rule"), F.col("example_id").alias("key")).distinct())
    return own.withColumn("sections", F.array()).drop("character_count", "entity_count", "section_count"), bad


def _replace(spark: SparkSession, draft, place) -> None:
    """Renames a file over another in one step, so that readers see the old or the new one at any time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    if place.getFileSystem(conf).getUri().getScheme() == "file":  # Hadoop's local files are deleted, then renamed
        names = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (draft, place)]
        how = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 2)
        how[0], how[1] = jvm.java.nio.file.StandardCopyOption.REPLACE_EXISTING, jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
        jvm.java.nio.file.Files.move(*names, how)
        return
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(draft, place, how)


def put(spark: SparkSession, path: str, content: bytes, tries: int = 5, wait: float = 0.1) -> None:
    """A small file in one step: written beside its place and renamed over what is there, tried again after a growing wait if
    the store fails. What was there before stays until then."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    for attempt in range(1, tries + 1):
        try:
            fs = place.getFileSystem(conf)
            fs = fs.getRawFileSystem() if fs.getUri().getScheme() == "file" and hasattr(fs, "getRawFileSystem") else fs  # without a file of checksums beside it
            fs.mkdirs(place.getParent())
            out = fs.create(draft, True)
            out.write(bytearray(content))
            out.close()
            _replace(spark, fs.makeQualified(draft), fs.makeQualified(place))
            return
        except Exception:  # noqa: BLE001  any failure of the store
            if attempt == tries:
                raise
            time.sleep(wait * 2 ** (attempt - 1))


def get(spark: SparkSession, path: str) -> bytes | None:
    """A small file's content; None if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def publish(spark: SparkSession, folder: str, parts: dict[str, Callable[[str], None]], about: dict | None = None) -> str:
    """Several tables that belong together, in one step: each writer writes its part below a folder of this run, then one small
    manifest names the run. Readers go by the manifest, so they see all parts of one run, the last that was published whole.
    Of older runs the one before stays for readers that have begun; those before it are deleted."""
    folder, run = folder.rstrip("/"), uuid.uuid4().hex
    before = manifest_of(spark, folder)
    for name, write in parts.items():
        write(f"{folder}/runs/{run}/{name}")
    runs = [run, *(before["runs"] if before else [])][:2]
    put(spark, f"{folder}/CURRENT.json", json.dumps({"run": run, "runs": runs, "parts": sorted(parts), "about": about or {}}, sort_keys=True, ensure_ascii=False).encode())
    for old in before["runs"] if before else []:
        if old not in runs:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/runs/{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return run


def manifest_of(spark: SparkSession, folder: str) -> dict | None:
    """What was published last in a folder."""
    content = get(spark, f"{folder.rstrip('/')}/CURRENT.json")
    return None if content is None else json.loads(content)


def published(spark: SparkSession, folder: str, part: str) -> str:
    """The path of a part of the last run that was published."""
    found = manifest_of(spark, folder)
    if found is None or part not in found["parts"]:
        raise ValueError(f"{folder} has no published {part}")
    return f"{folder.rstrip('/')}/runs/{found['run']}/{part}"


def write_one_file(rows: DataFrame, path: str) -> None:
    """Lines as one file of a given name, which the layout of a corpus asks for; one task writes it, so it is for splits of
    a bounded size. Larger ones go through ``write_lines``."""
    draft = f"{path}.{uuid.uuid4().hex}"
    rows.coalesce(1).write.text(draft)
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(draft)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{draft}/part-*"))]
    fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(path))
    fs.delete(at, True)


def save_state(spark: SparkSession, folder: str, key: str, state: dict) -> str:
    """The state of one example as a small file named by the digest of its key."""
    path = f"{folder}/{hashlib.sha1(key.encode()).hexdigest()}.json"
    put(spark, path, json.dumps({"key": key} | state, sort_keys=True, ensure_ascii=False).encode())
    return path


def load_states(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All saved states below a folder."""
    return spark.read.schema(f"key string, {schema}").option("pathGlobFilter", "*.json").json(folder) if readers.exists(spark, folder) else spark.createDataFrame([], f"key string, {schema}")


def prediction_lines(records: DataFrame, path: str, debug: tuple[str, ...] = ("reply",)) -> None:
    """Predictions as JSON lines, and what only debugging needs beside them."""
    rest = [c for c in records.columns if c not in debug]
    records.select(*rest).write.mode("overwrite").json(f"{path}/predictions")
    records.select(rest[0], *(c for c in debug if c in records.columns)).write.mode("overwrite").json(f"{path}/debug")


def write_scores(scores: DataFrame, path: str) -> None:
    """CSV with arrays and structs as JSON."""
    nested = [f.name for f in scores.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    scores.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_bundle(parts: dict[str, DataFrame], folder: str) -> str:
    """A batch's summary, per-example scores, false positives and negatives, and failures, published together."""

    def save(name: str, rows: DataFrame) -> Callable[[str], None]:
        return (lambda path: rows.write.json(path)) if name in ("summary", "failed_examples") else (lambda path: write_scores(rows, path))

    return publish(next(iter(parts.values())).sparkSession, folder, {name: save(name, rows) for name, rows in parts.items()})


def parquet_to_csv(spark: SparkSession, source: str, to: str) -> None:
    write_scores(spark.read.parquet(source), to)


def manifest(spark: SparkSession, folder: str, config: dict, counts: dict[str, int]) -> str:
    """JSON with the digests of a folder's files, a configuration and counts. One entry for each file."""
    files = {r.path.rsplit("/", 1)[-1]: {"bytes": r.bytes, "sha256": r.sha256} for r in readers.file_digests(spark, folder).collect()}
    return json.dumps({"config": config, "counts": counts, "files": files}, sort_keys=True, ensure_ascii=False)


def write_index(rows: DataFrame, folder: str, key: str = "ticket_id", vector: str = "embedding", encoder: str = "given") -> dict:
    """Unit vectors as Parquet with a manifest; zero, non-finite or uneven vectors and repeated keys are refused."""
    found = index_quality(rows, key, vector).first()
    if found.n_zero or found.n_not_finite or found.n_rows != found.n_keys or found.min_dimension != found.max_dimension or not found.n_rows:
        raise ValueError(f"vectors cannot be indexed: {found.asDict()}")
    normalised(rows, vector).write.mode("overwrite").parquet(f"{folder}/vectors")
    about = {"version": 1, "encoder": encoder, "normalized": True, "count": found.n_rows, "dimension": found.min_dimension}
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return about


def open_index(spark: SparkSession, folder: str, key: str = "ticket_id", vector: str = "embedding") -> DataFrame:
    """A written index after its checks: count, dimension, finite unit vectors."""
    about = json.loads(spark.read.text(f"{folder}/manifest").first().value)
    rows = spark.read.parquet(f"{folder}/vectors")
    found = index_quality(rows, key, vector).first()
    if about.get("version") != 1 or found.n_rows != about["count"] or found.max_dimension != about["dimension"] or found.n_not_unit or found.n_not_finite:
        raise ValueError(f"the index does not agree with its manifest: {found.asDict()}")
    return rows
