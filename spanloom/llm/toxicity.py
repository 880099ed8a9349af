"""Toxicity by a weighted lexicon.

Words are compared in a folded form: lower case, accents dropped, look-alike letters of other scripts, digits and
signs read as the Latin letters they imitate. Matching is one Aho-Corasick pass over the folded text; a hit counts
only as a whole word, or as the beginning of one for stems (written stem*), and outside the exception phrases. The score is a logistic function of the summed weights, raw
and normalised by length.

Lexicon, weights, exception phrases and the logistic function are learned from a sample of labelled rows that
``most_rows`` bounds; every document is scored over its whole text.

Results on odd input: null and empty texts have no hits and get the score of a text without hits; without labelled
rows of both kinds the lexicon is empty and all scores are 0; repeated rows are scored alike, and a document labelled
more than once counts once, as toxic if any of its labels says so; labels without a value are left out. A text is searched whole, whatever its length;
equal scores stand beside each other, as nothing is ranked; an empty table has no rows; other columns are kept by ``scored(keep=True)`` alone.
An exception phrase has one blank between its words, so words at a line's end and the next line's start are no such phrase.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .. import runtime
from .workers import cached, forget, slices

# Characters and the letters they stand for. l, 1 and | are one letter with i, as they imitate each other.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "|": "i", "l": "i", "ı": "i",
}
SIGNS = {"@": "a", "$": "s", "!": "i"}


def _table() -> dict[int, str]:
    """Look-alikes, and each accented Latin letter as its base letter."""
    table = {}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0].lower()
        if "a" <= base <= "z":
            table[code] = LOOKALIKES.get(base, base)
    return table | {ord(c): to for c, to in LOOKALIKES.items()} | {c: None for c in range(0x300, 0x370)}


TABLE = _table()
SIGN = re.compile(r"(?<=[a-z])[@$!](?=[a-z])")
WORD = re.compile(r"[a-z]+")


def fold(text: str) -> str:
    folded = text.lower().translate(TABLE)
    if "@" in folded or "$" in folded or "!" in folded:
        folded = SIGN.sub(lambda m: SIGNS[m[0]], folded)
    return folded


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = ()

    def automaton(self):
        import ahocorasick

        own, entries = ahocorasick.Automaton(), {}
        for word, weight in self.weights.items():
            stem = word.rstrip("*")
            entries.setdefault(stem, []).append((len(stem), weight, stem != word))
        for phrase in self.exceptions:
            entries.setdefault(phrase, []).append((len(phrase), None, False))
        for text, several in entries.items():  # a text may be a word, a stem and an exception at once
            own.add_word(text, tuple(several))
        own.make_automaton()
        return own

    def hits(self, automaton, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the words and stems outside exception phrases."""
        found, spared, n = [], [], len(folded)
        for end, entries in automaton.iter(folded):
            for size, weight, stem in entries:
                begin = end - size + 1
                if (begin and "a" <= folded[begin - 1] <= "z") or (not stem and end + 1 < n and "a" <= folded[end + 1] <= "z"):
                    continue
                (spared if weight is None else found).append((begin, end + 1, weight))
        return [h for h in found if not any(s[0] <= h[0] and h[1] <= s[1] for s in spared)] if spared else found

    def features(self, hits: list, n_words: int) -> tuple[float, float, float, float]:
        total = sum(weight for _, _, weight in hits)
        return 1.0, float(bool(hits)), math.log1p(total), total / math.sqrt(1 + n_words)

    def score(self, features: tuple[float, ...]) -> float:
        if not self.coefficients:
            return 0.0
        x = sum(c * f for c, f in zip(self.coefficients, features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """label and text of at most most_rows labelled documents, taken by a hash of the id."""
    own = labels.filter("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # at most most_rows rows of two numbers
    return runtime.written(texts.selectExpr("cast(toxic as int) toxic", "coalesce(text, '') text"), "toxicity-sample")


def _counted(rows: DataFrame, terms) -> DataFrame:
    """term, toxic and clean: in how many texts of either kind terms(text) holds the term."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts[int(label > 0)].update(terms(fold(text)))
        for label, own in counts.items():
            items = list(own.items())
            for at in range(0, len(items), 50_000):
                cut = items[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"term": pa.array([k for k, _ in cut], pa.string()), "toxic": pa.array([v * label for _, v in cut], pa.int64()), "clean": pa.array([v * (1 - label) for _, v in cut], pa.int64())})

    return rows.mapInArrow(part, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _terms(folded: str) -> set[str]:
    """The words, and their beginnings of 4 to 8 letters as stems."""
    words = set(WORD.findall(folded))
    return words | {f"{word[:n]}*" for word in words for n in range(4, min(8, len(word) - 1) + 1)}


def _chosen(found: dict[str, tuple[int, float]], least_toxic: int) -> dict[str, float]:
    """Words and stems that tell toxic texts, from term to number of toxic texts and log odds. A stem is one only if it is
    in half as many texts again as the most frequent of its words; of stems inside each other the longest that loses few
    texts stays, and words that a stem covers go."""
    words = {t: n for t, (n, _) in found.items() if t[-1] != "*"}
    most: dict[str, int] = {}
    for word, n in words.items():
        for size in range(4, min(8, len(word)) + 1):
            most[word[:size]] = max(n, most.get(word[:size], 0))
    stems: list[str] = []
    for stem in sorted((t[:-1] for t in found if t[-1] == "*"), key=lambda s: (len(s), s)):
        n = found[f"{stem}*"][0]
        if n < max(least_toxic, 1.5 * most.get(stem, 0)):
            continue
        above = next((s for s in stems if stem.startswith(s)), None)
        if above is None:
            stems.append(stem)
        elif n >= 0.95 * found[f"{above}*"][0]:
            stems[stems.index(above)] = stem
    kept = [w for w, n in words.items() if n >= least_toxic and len(w) >= 3 and not any(w.startswith(s) for s in stems)]
    return {t: found[t][1] for t in [*kept, *(f"{s}*" for s in stems)]}


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_terms: int = 500, least_share: float = 0.02, least_log_odds: float = 2.5) -> Lexicon:
    """A lexicon of at most most_terms words and stems, and as many exception phrases: those in least_share of the toxic
    texts at least, with that log odds ratio."""
    rows = sample(docs, labels, most_rows)
    n = {int(r.toxic > 0): r.n for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon()
    odds = F.log((F.col("toxic") + 0.5) / (n[1] - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (n[0] - F.col("clean") + 0.5))
    least = max(3, math.ceil(least_share * n[1]))
    # terms in fewer texts change no choice below; at most 1.5 / least_share times as many as a toxic text has
    terms = _counted(rows, _terms).withColumn("odds", odds).filter(F.col("toxic") >= least / 1.5).filter(F.col("odds") >= least_log_odds)
    found = {r.term: (r.toxic, r.odds) for r in terms.collect()}
    best = sorted(_chosen(found, least).items(), key=lambda t: (-t[1], t[0]))[:most_terms]
    lexicon = Lexicon(dict(best))
    if not lexicon.weights:
        return lexicon
    one = "|".join(re.escape(w.rstrip("*")) + ("[a-z]*" if w[-1] == "*" else "") for w in sorted(lexicon.weights, key=len, reverse=True))
    around = re.compile(rf"(?=((?<![a-z])[a-z]+ (?:{one})(?![a-z])))|(?=((?<![a-z])(?:{one}) [a-z]+(?![a-z])))")
    phrases = _counted(rows, lambda folded: {a or b for a, b in around.findall(folded)})
    kind = phrases.filter((F.col("clean") >= 5) & (F.col("clean") / n[0] > 4 * F.col("toxic") / n[1]))
    lexicon.exceptions = tuple(r.term for r in kind.orderBy(F.desc("clean"), "term").limit(most_terms).collect())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = []
            for text in batch.column("text").to_pylist():
                folded = fold(text)
                x.append(lexicon.features(lexicon.hits(automaton, folded), len(folded.split())))
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "x": pa.array(x, pa.list_(pa.float64()))})

    found = rows.mapInArrow(part, "toxic int, x array<double>").groupBy("toxic", "x").count().collect()  # at most most_rows
    x, y, w = np.array([r.x for r in found]), np.array([float(r.toxic > 0) for r in found]), np.array([float(r["count"]) for r in found])
    order = np.lexsort((y, *x.T))
    x, y, w, c = x[order], y[order], w[order], np.zeros(x.shape[1])
    ridge = 0.05 * np.diag([0.0, 1.0, 1.0, 1.0])  # the intercept is free
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ c)
        c += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    lexicon.coefficients = tuple(float(round(v, 9)) for v in c)
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, keep: bool = False, names: tuple[str, str] = ("score", "n_hits")) -> DataFrame:
    """doc_id, score and n_hits; with keep, all columns of docs and these two under the names given, which docs must not have."""
    key = ("toxicity", repr(lexicon))
    columns = docs.columns if keep else ["doc_id"]
    own = docs if keep else docs.selectExpr("cast(doc_id as long) doc_id", "text")
    fields = StructType([*(f for f in own.schema.fields if keep or f.name == "doc_id"), StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = cached(key, lexicon.automaton) if lexicon.weights else None
        none = lexicon.score((1.0, 0.0, 0.0, 0.0)) if lexicon.coefficients else 0.0
        for batch in batches:
            for rows in slices(batch, "text", 8 << 20):
                scores, counts = [], []
                for text in rows.column("text").to_pylist():
                    hits = ()
                    if automaton and text:
                        folded = fold(text)
                        hits = lexicon.hits(automaton, folded)
                    scores.append(lexicon.score(lexicon.features(hits, len(folded.split()))) if hits else none)
                    counts.append(len(hits))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(columns))), pa.array(scores, pa.float64()), pa.array(counts, pa.int32())], [*columns, *names])

    return own.mapInArrow(part, fields)
