"""Readers of corpora, tickets, exports and binary documents with declared schemas."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RAW = "doc_id string, words array<string>, sentences array<array<int>>, sections array<array<int>>, ner array<array<string>>"
REQUIRED = ["doc_id", "words", "sentences", "sections", "ner"]
SPLITS = ("train", "dev", "test")
EXAMPLES = "example_id string, doc_id string, source_split string, length_bucket string, sentence_count int, source_document_sentence_count int, source_sentence_start int, source_sentence_end_exclusive int, source_token_start int, source_token_end_exclusive int, character_count int, entity_count int, section_count int, text string"
SENTENCES = "example_id string, doc_id string, relative_sentence_index int, source_sentence_index int, start_char int, end_char int, text string"
ENTITIES = "example_id string, doc_id string, entity_id string, label string, text string, start_char int, end_char int, source_token_start int, source_token_end_exclusive int"


def exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(own) not in (None, [])


def split_files(spark: SparkSession, folder: str) -> DataFrame:
    """split and path of the corpus files below a folder; exactly one for each split."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder).select("path")
    own = own.withColumn("split", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)).filter(F.col("split").isin(*SPLITS))
    counts = {r.split: r.n for r in own.groupBy("split").agg(F.count("*").alias("n")).collect()}  # three rows
    wrong = [s for s in SPLITS if counts.get(s, 0) != 1]
    if wrong:
        raise ValueError(f"missing or ambiguous files for {', '.join(wrong)}")
    return own


def numbered_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, line (from 1) and value of text files, blank lines too, whatever ranges of bytes a file is read in.

    Files are cut where Spark plans it. A first pass counts the lines of each range (a row a range), their sums give the
    number of lines before it, and a line adds its place within its range. Lines are joined with those sums, which Spark
    broadcasts while they are small.
    """
    own = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__at"), "value", F.monotonically_increasing_id().alias("__id"))
    ranges = own.groupBy("path", "__at").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("path").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("path", "__at", (before - F.col("__first") + 1).alias("__offset"))
    return own.join(offsets, ["path", "__at"]).select("path", (F.col("__id") + F.col("__offset")).alias("line"), "value")


def raw_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Raw records with their split, and the violations, with path and line: lines that are no JSON or lack a required field."""
    own = numbered_lines(spark, paths).withColumn("source_split", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)).filter(F.trim("value") != "")
    own = own.withColumn("r", F.from_json("value", RAW + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    missing = F.array_compact(F.array(*(F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in REQUIRED)))
    own = own.withColumn("missing", F.when(F.col("r._corrupt_record").isNotNull(), F.array(F.lit("json"))).otherwise(missing))
    ner = F.transform("r.ner", lambda e: F.struct(F.get(e, F.lit(0)).try_cast("int").alias("start"), F.get(e, F.lit(1)).try_cast("int").alias("stop"), F.get(e, F.lit(2)).alias("label")))
    good = own.filter(F.size("missing") == 0).select("r.doc_id", "source_split", "r.words", "r.sentences", "r.sections", ner.alias("ner"))
    return good, own.filter(F.size("missing") > 0).select(F.lit("required_fields").alias("rule"), F.array_join("missing", ",").alias("key"), "source_split", "path", "line")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a bad line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing file is empty, blank lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def first_rows(rows: DataFrame, order: str, n: int = 1000) -> DataFrame:
    """The first n rows in an explicit order; 0 for all."""
    return rows.orderBy(order).limit(n) if n else rows


def mapped(rows: DataFrame, columns: dict[str, str], required: list[str]) -> DataFrame:
    """Columns under the names that the engine uses; the required ones must be there."""
    missing = [c for c in required if columns.get(c, c) not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*(F.col(source).alias(name) for name, source in columns.items() if source in rows.columns))


def parquet_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def exports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document for each file; broken ones are skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.json").json(folder)


def texts(spark: SparkSession, path: str, pdf_text=None) -> DataFrame:
    """path and text of text files (bad bytes replaced); PDF files through a function from bytes to text, where one is given."""
    own = spark.read.format("binaryFile").load(path).select("path", "content")
    plain = own.filter(~F.lower("path").endswith(".pdf")).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    if pdf_text is None:
        return plain
    from ..functions.text import clean_pdf


    @F.arrow_udf("string")
    def read(contents: pa.Array) -> pa.Array:
        return pa.array([None if c is None else pdf_text(c) for c in contents.to_pylist()], pa.string())

    pdf = own.filter(F.lower("path").endswith(".pdf")).select("path", clean_pdf(read("content")).alias("text"))
    return plain.unionByName(pdf)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of files, for manifests."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def prompt_template(spark: SparkSession, path: str) -> str:
    """A template's text; the same path is read once."""
    if path not in _TEMPLATES:
        _TEMPLATES[path] = spark.read.text(path, wholetext=True).first().value
    return _TEMPLATES[path]


_TEMPLATES: dict[str, str] = {}


def sample_texts(spark: SparkSession) -> DataFrame:
    """name and text of a few built-in examples to try the engine on."""
    rows = [("release note", "Ann Berg joined the Oslo office in May. She tests the new parser with two colleagues."), ("ticket", "The invoice of March is missing, and the portal shows an error."), ("empty", "")]
    return spark.createDataFrame(rows, "name string, text string")


def benchmark(spark: SparkSession, path: str, fallback: str, schema: str, required: list[str]) -> DataFrame:
    """The prepared benchmark as JSON lines or, where it is missing or empty, the small fixture. A line without a required
    field is an error that names it; the lines are checked where they are read."""
    for place in (path, fallback):
        if not exists(spark, place):
            continue
        own = numbered_lines(spark, place).filter(F.trim("value") != "").withColumn("r", F.from_json("value", schema))
        if own.isEmpty():
            continue
        missing = F.array_compact(F.array(*(F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in required)))
        said = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" lacks "), F.array_join(missing, ", "))
        checked = own.withColumn("r", F.when(F.size(missing) == 0, F.col("r")).otherwise(F.raise_error(said)))
        return checked.select("r.*")
    return spark.createDataFrame([], schema)


def lookup(spark: SparkSession, key: str, value, paths: list[str], schema: str, required: list[str]) -> DataFrame:
    """The rows of one key from the first of the files that has it; none if none does."""
    for path in paths:
        found = benchmark(spark, path, path, schema, required).filter(F.col(key) == value)
        if not found.isEmpty():
            return found
    return spark.createDataFrame([], schema)


def config(spark: SparkSession, path: str) -> dict:
    """The settings of a YAML or JSON file, without the key ``runner`` around them, if it is there."""
    text = spark.read.text(path, wholetext=True).first().value
    try:
        import yaml
    except ImportError:  # JSON needs no library
        own = json.loads(text)
    else:
        own = yaml.safe_load(text)
    if not isinstance(own, dict):
        raise ValueError(f"{path} holds no settings")
    return unwrapped(own)


def unwrapped(settings: dict) -> dict:
    own = settings.get("runner", settings)
    if not isinstance(own, dict):
        raise ValueError("runner holds no settings")
    return own


def template_config(config: dict) -> dict:
    """A use case's settings: a name, labels without repeats in their order, and optional departments and prompt."""
    own = unwrapped(config)
    labels = list(dict.fromkeys(str(x).strip() for x in own.get("labels") or [] if str(x).strip()))
    if not str(own.get("name") or "").strip() or not labels:
        raise ValueError("a use case needs a name and labels")
    return own | {"labels": labels, "departments": list(dict.fromkeys(own.get("departments") or []))}
