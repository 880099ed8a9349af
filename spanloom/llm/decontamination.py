"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur with up to floor(rate * n) edits. Cut into one piece more than that, one piece
at least is free of edits, so exact hits of the pieces (one Aho-Corasick pass over a text) find every occurrence; the
places they point to are verified with Myers' bit-parallel distance. Texts and items are compared in lower case with
runs of white space as one blank. begin and stop are characters of the normalised text: stop is where the first best match
ends, and begin lies an item's length before it, so it is exact where the distance is 0.

Results on odd input: null or blank items and texts take no part; an item too short for an edit must occur exactly;
repeated items count once, under their smallest id; repeated documents each get their rows; a text is searched whole,
whatever its length; of equally good places the first is given; an empty table on either side has no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .workers import cached, slices

LINKS = "item_id long, distance int, begin int, stop int, n_chars int"
Items = tuple[tuple[int, str], ...]


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(n: int, rate: float) -> int:
    return int(rate * n + 1e-9)


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """Offset and text of budget + 1 pieces of nearly equal length."""
    parts = budget(len(item), rate) + 1
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(item: str, masks: dict[str, int], text: str, begin: int, stop: int, most: int) -> tuple[int, int] | None:
    """Least edit distance of the item to a substring of text[begin:stop] and the first end that has it, if most or less."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, at = full, 0, m, most + 1, -1
    for i in range(begin, stop):
        equal = masks.get(text[i], 0)
        x = equal | minus
        d0 = ((((equal & plus) + plus) ^ plus) | x) & full
        up, down = minus | ~(d0 | plus) & full, plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | ~(d0 | up) & full, up & d0
        if score < best:
            best, at = score, i + 1
            if not best:
                break
    return (best, at) if at >= 0 else None


class Matcher:
    def __init__(self, items: Items, rate: float):
        import ahocorasick

        self.items, self.rate = dict(items), rate
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, item in items:
            for offset, piece in pieces(item, rate):
                where[piece].append((item_id, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}
        self.verified = 0

    def _masks(self, item_id: int) -> dict[str, int]:
        if item_id not in self.masks:
            own: dict[str, int] = defaultdict(int)
            for i, c in enumerate(self.items[item_id]):
                own[c] |= 1 << i
            self.masks[item_id] = dict(own)
        return self.masks[item_id]

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """For each item found: id, least distance, begin and end in the normalised text."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text):
            for item_id, offset in places:
                starts[item_id].add(end + 1 - size - offset)
        out = []
        for item_id, own in starts.items():
            item = self.items[item_id]
            n, most = len(item), budget(len(item), self.rate)
            if (at := text.find(item)) >= 0:
                out.append((item_id, 0, at, at + n))
                continue
            best, ordered, i = None, sorted(own), 0
            while i < len(ordered) and most:
                begin = stop = ordered[i]
                while i < len(ordered) and ordered[i] <= stop + n:  # windows that overlap are read once
                    stop = ordered[i]
                    i += 1
                low, high = max(0, begin - most), min(len(text), stop + n + most)
                self.verified += 1
                found = myers(item, self._masks(item_id), text, low, high, most if best is None else best[0] - 1)
                if found:
                    best = found
            if best:
                out.append((item_id, best[0], max(0, best[1] - n), best[1]))
        return sorted(out)


def item_files(benchmark: DataFrame, most_bytes: int) -> list[str]:
    """The distinct normalised items with their smallest ids, as files of about most_bytes in the shared folder. The driver
    sees their names alone."""
    item = F.trim(F.regexp_replace(F.lower("text"), r"(?U)[\s\x1c-\x1f]+", " "))
    own = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), item.alias("item")).filter("item <> ''")
    own = runtime.written(own.groupBy("item").agg(F.min("item_id").alias("item_id")), "items")
    total = own.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    return runtime.written(own.repartition(max(1, -(-total // most_bytes))), "item-files").inputFiles()


def _items(path: str) -> Items:
    fs, place = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(place) as source:
        rows = pq.read_table(source).to_pydict()
    return tuple(sorted((i, normal(item)) for i, item in zip(rows["item_id"], rows["item"], strict=True)))


def _runs(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and normalised texts of rows that hold about most_bytes; a longer text is a run of its own."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for rows in slices(batch, "text", most_bytes):
            if size + rows.nbytes > most_bytes and ids:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids += rows.column("doc_id").to_pylist()
            texts += [normal(text or "") for text in rows.column("text").to_pylist()]
            size += rows.nbytes
    if ids:
        yield ids, texts


def links(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, most_bytes: int = 16 << 20) -> DataFrame:
    """A row for each document and item that occurs in it within its budget. Documents are read once; a task holds some of
    their texts and one file of items at a time. doc_id: a number, or a string that tells documents apart."""
    paths = item_files(benchmark, most_bytes)
    named = dict(docs.dtypes)["doc_id"] == "string"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _runs(batches, (8 if len(paths) == 1 else 32) << 20):
            out: list[list] = [[] for _ in range(6)]  # doc_id and LINKS
            for path in paths:
                matcher = cached(("decontamination", path, rate), lambda path=path: Matcher(_items(path), rate))
                if matcher.items:
                    for doc_id, text in zip(ids, texts, strict=True):
                        for found in matcher.search(text) if text else ():
                            for column, value in zip(out, (doc_id, *found, len(text)), strict=True):
                                column.append(value)
            kinds = [pa.string() if named else pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", *(f.split(" ")[0] for f in LINKS.split(", "))])

    kind = "string" if named else "long"
    return docs.selectExpr(f"cast(doc_id as {kind}) doc_id", "text").mapInArrow(part, f"doc_id {kind}, {LINKS}")
