"""Ticket tables, label schemas and the short list of tags for a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_noisy_tag, label_words, words
from ..runtime import written


def clean_tickets(raw: DataFrame, order: str) -> DataFrame:
    """ticket_id (1 and on, in the order of a column), text, type and queue of the rows that have subject and body, and their tags."""
    own = raw.toDF(*(c.strip().lower() for c in raw.columns)).na.drop(subset=["subject", "body"])
    own = own.withColumn("text", F.concat(F.trim("subject"), F.lit("\n\n"), F.trim("body")))
    tags = [F.trim(F.col(c)) for c in own.columns if c.startswith("tag_")]
    own = own.withColumn("tags", F.array_distinct(F.filter(F.array(*tags), lambda t: t.isNotNull() & (t != ""))) if tags else F.array().cast("array<string>"))
    return dense_ids(own, order, "ticket_id")


def dense_ids(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers from 1 in the order of a column, without a window over all rows: partitions are counted and offset.

    The numbered rows are written first: evaluated twice, they could be dealt to other partitions each time."""
    own = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    own = written(own, "dense-ids").withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    sizes = own.groupBy("__p").agg(F.max("__i").alias("__n"))  # one row for each partition
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return own.join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__i") + F.col("__before")).cast("long")).drop("__m", "__p", "__i", "__before")


def label_schema(rows: DataFrame, fields: list[str], tags: str | None = None) -> DataFrame:
    """field and its sorted distinct values."""
    flat = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields))).alias("f")).select("f.*")
    if tags:
        flat = flat.unionByName(rows.select(F.lit("tags").alias("field"), F.explode(tags).alias("value")))
    return flat.filter("value is not null and value <> ''").distinct().groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("values"))


def tag_frequency(rows: DataFrame, tags: str) -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("frequency"))


def tag_list(x: Column, kind: str = "string") -> Column:
    """Tags of a JSON list or, of another kind than string, of a list, without blank ones; what is none gives no tags."""
    own = F.from_json(x, "array<string>") if kind == "string" else x
    return F.coalesce(F.filter(F.transform(own, lambda t: F.trim(t)), lambda t: t != ""), F.array().cast("array<string>"))


def _grams(x: Column, size: int) -> Column:
    """The different runs of ``size`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substring(x, i, F.lit(size))))


def suggested(texts: DataFrame, key: str, text: str, tags: DataFrame, gram: int = 4) -> DataFrame:
    """key, tag, low, pos, frequency and score of the tags that a text's words or a phrase in it suggest, by an inverted index.

    tags: tag, low, words, pos and frequency. Words of texts meet words of tags, and a tag that may stand in a text as a
    phrase is told by the characters with which it begins: ``gram`` of them, or all of a shorter one. Texts meet only the
    tags that share a word or a beginning with them; a tag of a beginning is then looked for in the text.
    """
    rows = texts.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("__low"), F.array_distinct(words(F.col(text))).alias("__words"))
    by_word = tags.select("pos", F.explode("words").alias("word")).groupBy("word", "pos").agg(F.count("*").alias("hits"))
    hits = rows.select(key, F.explode("__words").alias("word")).join(by_word, "word").groupBy(key, "pos").agg(F.sum("hits").alias("hits"))
    begins = tags.filter("low <> ''").select("pos", "low", F.left("low", F.lit(gram)).alias("gram"))
    sizes = [r.n for r in begins.select(F.length("gram").alias("n")).distinct().collect()]  # gram values at most
    parts = [F.when(F.length("__low") >= n, _grams(F.col("__low"), n)).otherwise(F.array().cast("array<string>")) for n in sorted(sizes)]
    met = rows.select(key, F.explode(F.concat(*parts) if parts else F.array().cast("array<string>")).alias("gram")).join(begins, "gram").groupBy(key).agg(F.collect_list(F.struct("pos", "low")).alias("__may"))
    inside = rows.join(met, key).select(key, F.explode(F.filter("__may", lambda t: F.contains("__low", t["low"]))).alias("t")).select(key, "t.pos", F.lit(2).cast("long").alias("hits"))
    found = hits.unionByName(inside).groupBy(key, "pos").agg(F.sum("hits").alias("hits"))
    return found.join(tags.filter(F.size("words") > 0), "pos").select(key, "tag", "low", "pos", "frequency", (F.col("hits") + (F.size("words") <= 2).cast("int")).alias("score"))


def indexed_candidate_tags(texts: DataFrame, key: str, text: str, tags: DataFrame, most: int, fallback: int) -> DataFrame:
    """The rows of ``candidate_tags`` for schemas of any size."""
    lexical = max(most - fallback, 0)
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), F.desc("frequency"), "low", "pos"))
    ranked = suggested(texts, key, text, tags).withColumn("__r", best).filter(F.col("__r") <= lexical)  # tasks keep their best before the shuffle
    first = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "tag"))), lambda t: t["tag"]).alias("__first"))
    listed = lambda n, *order: F.array(*(F.lit(r.tag) for r in tags.orderBy(*order).limit(n).collect())).cast("array<string>")  # noqa: E731  no more than most tags
    rest = F.concat(listed(fallback, F.desc("frequency"), "low", "pos"), listed(most, "pos"))
    own = texts.select(key).join(first, key, "left")
    picked = F.slice(F.array_distinct(F.concat(F.coalesce("__first", F.array().cast("array<string>")), rest)), 1, most)
    return own.select(key, F.posexplode(picked).alias("place", "tag"))


def candidate_tags(texts: DataFrame, key: str, text: str, tags: DataFrame, most: int = 40, fallback: int = 20, small: int = 2000) -> DataFrame:
    """key, tag and place of at most ``most`` tags for each text. tags: tag, pos (order of the schema, no two alike) and frequency.

    First the tags that the text's words suggest, then the most frequent (those taken already are passed over, not
    replaced), then the schema's order. A schema of ``small`` tags or fewer, which is counted, travels as one array, so no
    text is joined with it and nothing is shuffled; a larger one goes through an inverted index. The rows are the same.
    """
    fallback = min(max(fallback, 0), most)
    lexical = max(most - fallback, 0)
    if tags.limit(small + 1).count() > small:
        named = tags.filter(~is_noisy_tag(F.col("tag"))).select("tag", F.lower("tag").alias("low"), label_words(F.col("tag")).alias("words"), "pos", F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"))
        return indexed_candidate_tags(texts, key, text, written(named, "tags"), most, fallback)
    own = tags.filter(~is_noisy_tag(F.col("tag"))).select("tag", F.lower("tag").alias("low"), label_words(F.col("tag")).alias("words"), "pos", F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"))
    schema = own.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "low", "pos", "tag", "words"))).alias("__by_frequency"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda t: t["tag"]).alias("__by_pos"),
    )
    rows = texts.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("__low"), F.array_distinct(words(F.col(text))).alias("__words")).join(F.broadcast(schema))

    def score(t):
        hits = F.size(F.filter(t["words"], lambda w: F.array_contains("__words", w)))
        phrase = F.when(F.contains("__low", t["low"]), 2).otherwise(0)
        return F.when((F.size(t["words"]) > 0) & (hits + phrase > 0), hits + phrase + (F.size(t["words"]) <= 2).cast("int")).otherwise(0)

    scored = F.filter(F.transform("__by_frequency", lambda t: F.struct((-score(t)).alias("s"), t["f"].alias("f"), t["low"].alias("low"), t["pos"].alias("pos"), t["tag"].alias("tag"))), lambda t: t["s"] < 0)
    first = F.slice(F.transform(F.array_sort(scored), lambda t: t["tag"]), 1, lexical) if lexical else F.array().cast("array<string>")
    frequent = F.slice(F.transform("__by_frequency", lambda t: t["tag"]), 1, fallback) if fallback else F.array().cast("array<string>")
    picked = F.slice(F.array_distinct(F.concat(first, frequent, F.col("__by_pos"))), 1, most)
    return rows.select(key, F.posexplode(picked).alias("place", "tag"))


def wide_context(rows: DataFrame, columns: list[str]) -> Column:
    """``column: value`` paragraphs of the columns that are not blank."""
    return F.concat_ws("\n\n", *(F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))
