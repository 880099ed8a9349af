"""Tokens, sentences, detokenising and spans from tags, all with half-open character offsets counted from 0."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import BETWEEN_SENTENCES, SENTENCE_END, let, strip

# The tokeniser's pattern, and how detokenising puts blanks.
_TOKEN = re.compile(r"\w+(?:[-']\w+)*|[^\w\s]")
NO_BLANK_BEFORE = [".", ",", ";", ":", "?", "!", "%", ")", "]", "}"]
NO_BLANK_AFTER = ["(", "[", "{"]
JOINS = ["-", "–", "—", "/"]
SUFFIXES = ["'s", "'re", "'ve", "'ll", "'d", "'m", "n't"]

_END = re.compile(SENTENCE_END.removeprefix("(?U)"))  # Python's patterns know all white space without the mark


_SPAN = [StructField("text", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType())]


def _nested(lists: list[int], columns: list[list], fields: list[StructField]) -> pa.Array:
    """An array of lists of structs from flat columns, without an object for each struct."""
    kinds = [pa.string() if f.dataType == StringType() else pa.int32() for f in fields]
    structs = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.name for f in fields])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]).astype(np.int32)), structs)


def _pieces(x: pa.Array, most_bytes: int = 1 << 20) -> Iterator[pa.Array]:
    """The texts in runs of about most_bytes; a longer one is a run of its own."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(x), 0).to_pylist()):
        if i > start and total + n > most_bytes:
            yield x.slice(start, i - start)
            start, total = i, 0
        total += n
    yield x.slice(start)


def _in_pieces(x: pa.Array, of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """A function of texts over a piece at a time: Python's objects for tokens take some twenty times the bytes of the text,
    and a batch has ever more of it as tables grow."""
    return pa.concat_arrays([of(piece) for piece in _pieces(x)])


@F.arrow_udf(ArrayType(StructType(_SPAN)))
def tokenize(x: pa.Array) -> pa.Array:
    """Tokens of a text with their offsets."""
    return _in_pieces(x, _tokenize)


def _tokenize(x: pa.Array) -> pa.Array:
    sizes, texts, starts, stops = [], [], [], []
    for text in x.to_pylist():
        before = len(texts)
        for m in _TOKEN.finditer(text or ""):
            texts.append(m[0])
            start, stop = m.span()
            starts.append(start)
            stops.append(stop)
        sizes.append(len(texts) - before)
    return _nested(sizes, [texts, starts, stops], _SPAN)


_SENTENCE = [*_SPAN, StructField("n_tokens", IntegerType())]


@F.arrow_udf(ArrayType(StructType(_SENTENCE)))
def split_sentences(x: pa.Array) -> pa.Array:
    """Sentences with a token in them: trimmed text, offsets in the document and number of tokens."""
    return _in_pieces(x, _split_sentences)


def _split_sentences(x: pa.Array) -> pa.Array:
    sizes, columns = [], [[], [], [], []]
    for text in x.to_pylist():
        text, at, before = text or "", 0, len(columns[0])
        for stop, after in [*(m.span() for m in _END.finditer(text)), (len(text), None)]:
            part = text[at:stop]
            own = part.strip()
            n = len(_TOKEN.findall(own))
            if n:
                start = at + len(part) - len(part.lstrip())
                for column, value in zip(columns, (own, start, start + len(own), n), strict=True):
                    column.append(value)
            at = after
        sizes.append(len(columns[0]) - before)
    return _nested(sizes, columns, _SENTENCE)


def sentence_texts(x: Column) -> Column:
    """The same sentences alone, in Spark's own functions: what has a sign that is no white space has a token."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), SENTENCE_END, -1), strip), lambda s: s != "")


def sentence_count(x: Column) -> Column:
    """How many they are, without making them: one more than the runs of white space between two."""
    own = strip(F.coalesce(x, F.lit("")))
    return let(own, lambda t: F.when(t == "", 0).otherwise(F.regexp_count(t, F.lit(BETWEEN_SENTENCES)) + 1))


def indexed(tokens: Column) -> Column:
    """``index: token`` lines."""
    return F.array_join(F.transform(tokens, lambda t, i: F.concat(i.cast("string"), F.lit(": "), t)), "\n")


def span_of(tokens: Column, first: Column, last: Column) -> Column:
    """Characters of tokens first to last, both included; null out of range. tokens: structs with start and stop."""
    ok = (first >= 0) & (last >= first) & (last < F.size(tokens))
    return F.when(ok, F.struct(F.get(tokens, first)["start"].alias("start"), F.get(tokens, last)["stop"].alias("stop")))


def span_between(tokens: Column, start: Column, stop: Column, strict: bool = False) -> Column:
    """Characters of tokens start to stop, the last not included. Outside 0 <= start < stop <= number of tokens it is null or,
    if strict, an error that fails the query. tokens: structs with start and stop."""
    ok = F.coalesce((start >= 0) & (start < stop) & (stop <= F.size(tokens)), F.lit(False))
    span = F.struct(F.get(tokens, start)["start"].alias("start"), F.get(tokens, stop - 1)["stop"].alias("stop"))
    if not strict:
        return F.when(ok, span)
    said = F.concat(F.lit("no token span ["), F.coalesce(start.cast("string"), F.lit("null")), F.lit(", "), F.coalesce(stop.cast("string"), F.lit("null")), F.lit(") of "), F.size(tokens).cast("string"))
    return F.when(ok, span).otherwise(F.raise_error(said))


def touched(tokens: Column, start: Column, stop: Column, none: int = -10_000) -> Column:
    """First and last token that characters [start, stop) overlap; ``none`` twice if there is none."""
    hit = F.filter(F.transform(tokens, lambda t, i: F.when(F.greatest(t["start"], start) < F.least(t["stop"], stop), i)), lambda i: i.isNotNull())
    return F.struct(F.coalesce(F.array_min(hit), F.lit(none)).alias("first"), F.coalesce(F.array_max(hit), F.lit(none)).alias("last"))


def _blank(before: Column, token: Column) -> Column:
    joined = token.isin(NO_BLANK_BEFORE + JOINS + SUFFIXES) | before.isin(NO_BLANK_AFTER + JOINS) | token.startswith("'")
    return F.when(before.isNull() | joined, "").otherwise(" ")


def detokenize(tokens: Column) -> Column:
    """Readable text of an array of tokens."""
    return F.array_join(F.transform(tokens, lambda t, i: F.concat(_blank(F.when(i > 0, F.get(tokens, i - 1)), t), t)), "")


_TOKEN_AT = StructType([StructField("token_index", IntegerType()), StructField("text", StringType()), StructField("start_char", IntegerType()), StructField("end_char", IntegerType())])
_LAID_OUT = StructType([StructField("text", StringType()), StructField("tokens", ArrayType(_TOKEN_AT))])


@F.arrow_udf(ArrayType(_LAID_OUT))
def laid_out(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The readable text of an array of tokens and where each token is in it, in an array of one; an empty array without
    tokens. The same as ``detokenize`` and ``detokenized``, in one pass over a row, with no object for a token. What comes
    out has several times the bytes of what goes in, so it leaves in pieces and neither side holds a batch of it."""
    for x in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *np.flatnonzero(np.diff(ends // (1 << 17))) + 1, len(x)]  # rows of about so many tokens at a time
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _laid_out(x.slice(a, b - a))


def _laid_out(x: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, starts = x.flatten().cast(pa.string()), np.cumsum(sizes) - sizes
    first = np.zeros(len(flat), bool)
    first[starts[sizes > 0]] = True
    before = pa.concat_arrays([pa.nulls(min(1, len(flat)), pa.string()), flat.slice(0, max(0, len(flat) - 1))])
    isin = lambda c, values: pc.is_in(c, pa.array(values))
    joined = pc.or_(pc.or_(isin(flat, NO_BLANK_BEFORE + JOINS + SUFFIXES), isin(before, NO_BLANK_AFTER + JOINS)), pc.fill_null(pc.starts_with(flat, "'"), False))
    none = flat.is_null().to_numpy(zero_copy_only=False)
    gap = ~(joined.to_numpy(zero_copy_only=False) | before.is_null().to_numpy(zero_copy_only=False) | first | none)
    n = pc.fill_null(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    stop = np.cumsum(n + gap)
    stop -= np.repeat(np.concatenate([[0], stop])[starts], sizes)
    index = np.arange(len(flat)) - np.repeat(starts, sizes)
    tokens = pa.StructArray.from_arrays([pa.array(index.astype(np.int32)), flat, pa.array((stop - n).astype(np.int32), mask=none), pa.array(stop.astype(np.int32))], fields=[pa.field(f.name, pa.string() if f.dataType == StringType() else pa.int32()) for f in _TOKEN_AT])
    own = pc.fill_null(pc.if_else(pa.array(gap), pc.binary_join_element_wise(pa.scalar(" "), flat, ""), flat), "")
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
    ends = np.cumsum(sizes[sizes > 0])
    rows = pa.StructArray.from_arrays([pc.binary_join(lists(ends, own), ""), lists(ends, tokens)], names=["text", "tokens"])
    return lists(np.cumsum(sizes > 0), rows)


def detokenized(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, token_index, text, start_char and end_char of each token in the detokenised text."""
    # the blank before each token is found inside the array, so that the rows carry nothing but their token
    gap = lambda t, i: F.struct(t.alias("text"), F.length(_blank(F.when(i > 0, F.get(tokens, i - 1)), t)).alias("gap"))
    own = rows.select(key, F.posexplode(F.transform(tokens, gap)).alias("token_index", "t")).select(key, "token_index", "t.text", F.col("t.gap").alias("__gap"))
    order = W.partitionBy(key).orderBy("token_index")
    stop = F.sum(F.col("__gap") + F.length("text")).over(order)
    return own.select(key, "token_index", "text", (stop - F.length("text")).cast("int").alias("start_char"), stop.cast("int").alias("end_char"))


def tag_runs(rows: DataFrame, group: list[str], order: list[str], token: str, tag: str, outside: object = 0, only: object = None) -> DataFrame:
    """Runs of one tag as spans with inclusive token indices: a change of tag ends a run. ``only`` keeps the runs of one tag."""
    by = W.partitionBy(*group).orderBy(*order)
    own = rows.select(*group, F.col(token).alias("__token"), F.col(tag).alias("label"), (F.row_number().over(by) - 1).alias("__i"))
    by = W.partitionBy(*group).orderBy("__i")
    own = own.withColumn("__new", F.when(F.col("label") == F.lag("label").over(by), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(by))
    own = own.filter(F.col("label") == F.lit(only)) if only is not None else own.filter(F.col("label") != F.lit(outside))
    runs = own.groupBy(*group, "__run", "label").agg(F.min("__i").alias("start"), F.max("__i").alias("stop"), F.array_sort(F.collect_list(F.struct("__i", "__token"))).alias("__t"))
    return runs.select(*group, "label", F.array_join("__t.__token", " ").alias("text"), "start", "stop")


def parse_string_array(x: Column) -> Column:
    """'a' and "b" of a printed list."""
    one = F.regexp_extract_all(x, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(1))
    two = F.regexp_extract_all(x, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(2))
    return F.zip_with(one, two, lambda a, b: F.when(a != "", a).otherwise(b))


def parse_int_array(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"-?\d+"), F.lit(0)), lambda v: v.cast("int"))


def find_phrase(tokens: Column, phrase: Column) -> Column:
    """First and last index of the phrase's first occurrence in the tokens; null if there is none. The tokens are evaluated
    once, and only places that begin as the phrase does are compared in full."""
    n = F.size(phrase)

    def places(own: Column) -> Column:
        begins = lambda i: F.get(own, i).eqNullSafe(F.get(phrase, F.lit(0))) & (F.slice(own, i + 1, n) == phrase)
        return F.when((n > 0) & (F.size(own) >= n), F.get(F.filter(F.sequence(F.lit(0), F.size(own) - n), begins), F.lit(0)))

    return let(let(tokens, places), lambda at: F.when(at.isNotNull(), F.struct(at.alias("first"), (at + n - 1).alias("last"))))
