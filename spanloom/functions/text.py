"""Scalar functions on text, all built from Spark's own functions except where Python's exact behaviour is needed."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

# The tokeniser's and the sentence splitter's patterns, in classes that all engines read alike.
TOKEN = r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"
#: White space as Python's str methods and patterns see it; \s alone is ASCII in Spark.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
#: What is no white space; a text has a token if it has one.
SIGN = r"(?U)[^\s\x1c-\x1f]"
SENTENCE_END = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+(?=[A-Z0-9\"'])|\n+"


#: A run of white space between two sentences: it follows a full stop and precedes a capital, or has a line end.
BETWEEN_SENTENCES = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+(?=[A-Z0-9\"'])|\n[\s\x1c-\x1f]*"


def fold(x: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x.cast("string"), F.lit(""))), BLANKS, " "))


def squeeze(x: Column) -> Column:
    """As ``fold``, but case is kept."""
    return F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), BLANKS, " "))


def casefold(x: Column) -> Column:
    """Lower case with the sharp s and the Latin ligatures written out and one form of sigma and s. Scripts whose folding
    does more (Cherokee, Armenian ligatures) are left in lower case."""
    own = F.translate(F.lower(x), "ςſ", "σs")
    for sign, letters in (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        own = F.replace(own, F.lit(sign), F.lit(letters))
    return own


def strip(x: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(x, rf"^{BLANKS}|{BLANKS.removeprefix('(?U)')}\z", "")


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def label_words(x: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def is_noisy_tag(x: Column) -> Column:
    """Blank, with two commas or more, or over 60 characters."""
    commas = F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))
    return F.coalesce(F.trim(x) == "", F.lit(True)) | (commas >= 2) | (F.length(x) > 60)


def strip_fences(x: Column) -> Column:
    """Without the marks of a Markdown code block around the text."""
    bare = F.regexp_replace(x, f"^{BLANKS}|{BLANKS.removeprefix('(?U)')}$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?iU)^```(?:json)?[\s\x1c-\x1f]*", ""), r"(?U)[\s\x1c-\x1f]*```$", "")
    return F.regexp_replace(bare, f"^{BLANKS}|{BLANKS.removeprefix('(?U)')}$", "")


def object_slice(x: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    inner = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner)


def contains_evidence(evidence: Column, text: Column) -> Column:
    own = fold(evidence)
    return (own != "") & F.contains(fold(text), own)


def clean_pdf(x: Column) -> Column:
    """Words joined over line ends, blanks and empty lines collapsed."""
    out = F.regexp_replace(x, r"-\n([\p{L}\p{N}_])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def excerpt(x: Column, n: int = 180) -> Column:
    return F.left(F.trim(x), F.lit(n))


#: The colours of labels in the order in which they are given out.
PALETTE = ["#ffd166", "#8ecae6", "#b5e48c", "#f4a6c1", "#cdb4db", "#f7b267", "#a0e7e5", "#e2e2a0"]


def label_colour(label: Column, labels: list[str]) -> Column:
    """A colour for each label by its place in the list; one outside it by a hash that is the same in every run."""
    known = F.array_position(F.array(*map(F.lit, labels)).cast("array<string>"), label).cast("int")
    other = F.conv(F.substring(F.md5(label), 1, 6), 16, 10).cast("int")
    place = F.when(known > 0, known - 1).otherwise(other)
    return F.element_at(F.array(*map(F.lit, PALETTE)), place % len(PALETTE) + 1)


def darker(colour: Column, share: float = 0.5) -> Column:
    """A colour #rrggbb with each part at a share of itself, for text on it."""
    part = lambda at: F.lpad(F.lower(F.hex(F.floor(F.conv(F.substring(colour, at, 2), 16, 10).cast("int") * share).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(2), part(4), part(6))


def escape_html(x: Column) -> Column:
    for mark, form in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(mark), F.lit(form))
    return x


def highlighted(text: Column, spans: Column, labels: list[str]) -> Column:
    """HTML of a text with its spans (start, stop, label) as marks in the colour of their label; of spans that overlap the
    first is marked, of those with one start the longest."""
    mark = lambda s, x: F.concat(F.lit('<mark style="background:'), label_colour(s["label"], labels), F.lit('" title="'), escape_html(s["label"]), F.lit('">'), escape_html(x), F.lit("</mark>"))
    return rewritten(text, spans, mark, escape_html)


def model_name(x: Column) -> Column:
    """What follows the first colon; all of it without one."""
    at = F.instr(x, ":")
    return F.when(at > 0, F.substring(x, at + F.lit(1), F.length(x))).otherwise(x)


def cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """Rates are for a million tokens."""
    return tokens_in * F.lit(rate_in) / F.lit(1e6) + tokens_out * F.lit(rate_out) / F.lit(1e6)


def canonical_label(x: Column) -> Column:
    """Material and Dataset are one label."""
    own = casefold(x)
    return F.when(own.isin("material", "dataset"), "dataset").otherwise(own)


def slice_text(text: Column, start: Column, stop: Column) -> Column:
    """Characters [start, stop), counted from 0."""
    return F.substring(text, start + F.lit(1), stop - start)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """A function of a value that is evaluated once, however often the function names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def running(sizes: Column, most: int = 32) -> Column:
    """For each number of an array the sum of those before it. Arrays grow by copying, so sums run within blocks of ``most``
    numbers and over the blocks' totals."""
    grown = lambda own: F.aggregate(own, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
    starts = lambda own: F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(most))).otherwise(F.array().cast("array<int>"))
    blocks = let(sizes, lambda own: F.transform(starts(own), lambda at: grown(F.slice(own, at, F.lit(most)))))
    of = lambda own, before: F.transform(F.slice(own, F.lit(1), F.size(own) - 1), lambda n: n + before)
    ends = lambda own: grown(F.transform(own, lambda b: F.element_at(b, -1)))
    return let(blocks, lambda own: let(ends(own), lambda sums: F.flatten(F.transform(own, lambda b, i: of(b, F.get(sums, i))))))


def find_all(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, as structs of start, stop (code points, half-open), match, and what stands
    before and after, up to the next match. Null for null. Matches must not be empty.

    What stands between the matches gives the places: one split, one extraction, and sums that run."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    sizes = lambda p: F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["found"])), p["found"], lambda gap, m: F.length(gap) + F.length(m))

    def one(p: Column, before: Column):
        def at(m: Column, i: Column) -> Column:
            gap = F.get(p["gaps"], i)
            start = F.get(before, i) + F.length(gap)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("match"), gap.alias("before"), F.get(p["gaps"], i + 1).alias("after"))

        return F.transform(p["found"], at)

    return F.when(text.isNotNull(), let(parts, lambda p: let(running(sizes(p)), lambda before: one(p, before))))


def apart(spans: Column) -> Column:
    """Structs with start and stop in order, without those that begin before the end of one that is kept; of spans with one
    start the longest is kept. Spans that are empty, null or begin before the text are left out."""
    ranked = F.array_sort(F.transform(F.filter(spans, lambda s: (s["start"] >= 0) & (s["stop"] > s["start"])), lambda s: F.struct(s["start"].alias("a"), (-s["stop"]).alias("b"), s.alias("s"))))
    zero = F.slice(ranked, F.lit(1), F.lit(0))
    free = lambda kept, s: (F.size(kept) == 0) | (F.get(kept, F.size(kept) - 1)["s"]["stop"] <= s["a"])
    return F.transform(F.aggregate(ranked, zero, lambda kept, s: F.when(free(kept, s), F.concat(kept, F.array(s))).otherwise(kept)), lambda k: k["s"])


def rewritten(text: Column, spans: Column, span: Callable[[Column, Column], Column], rest: Callable[[Column], Column] = lambda x: x) -> Column:
    """The text with each of the spans that ``apart`` keeps as ``span`` writes it, of the struct and its characters, and
    what lies between as ``rest`` writes it."""
    cut = lambda start, stop: F.substring(text, start + F.lit(1), stop - start)
    end = lambda kept, i: F.coalesce(F.get(kept, i)["stop"], F.lit(0))

    def whole(kept: Column) -> Column:
        parts = F.transform(kept, lambda s, i: F.concat(rest(cut(F.when(i > 0, end(kept, i - 1)).otherwise(0), s["start"])), span(s, cut(s["start"], s["stop"]))))
        last = end(kept, F.size(kept) - 1)
        return F.concat(F.array_join(parts, ""), rest(cut(F.least(last, F.length(text)), F.length(text))))

    return F.when(text.isNotNull(), F.when(spans.isNull(), rest(text)).otherwise(let(apart(spans), whole)))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


@F.pandas_udf(StructType([StructField("value", StringType()), StructField("valid", BooleanType()), StructField("error", StringType())]))
def strict_json(x: pd.Series) -> pd.DataFrame:
    """The value as JSON text again, whether the text is JSON to the last character, and the error."""

    def one(text):
        try:
            return json.dumps(json.loads(text), ensure_ascii=False), True, None
        except (ValueError, TypeError) as error:
            return None, False, str(error)

    return pd.DataFrame([one(t) for t in x], columns=["value", "valid", "error"])


def exact_round(digits: int):
    """Rounding of the exact binary value, halves to even."""

    @F.pandas_udf(DoubleType())
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else float(round(v, digits)))

    return rounded
