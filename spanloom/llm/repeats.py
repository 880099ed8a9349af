"""Repeated byte strings: removal of what a string of ``width`` bytes covers that also starts earlier.

Texts are UTF-8 bytes and matches never cross documents. Every window of ``width`` bytes is represented by its anchor,
the leftmost of its 16-byte strings with the least hash, so equal windows have equal anchors at the same offset. A run
of windows with one anchor occurrence is a record (a string of width to width + 84 bytes); records meet by anchor:

* records with equal bytes are put together first (within a task, then by bucket), and all but the first are repeats;
* different records of one anchor, if they also agree on 42 bytes beside it, may share some windows. Their bytes are
  fetched and the bucket's strings go through the threshold-bounded interval expansion of ``bwt``, which gives the
  classes of equal windows; all but the first window of a class are repeats. Strings beyond the bounded size of one
  transform go through several, whose classes are then matched by the windows' hashes.

An anchor that a task's fair share of records would not hold (one passage in a third of all documents) is dealt over
several buckets by document. A sample of the documents tells which anchors these are; it decides where records go, never
what is found. Each bucket then names the first window of each class, and these are matched between buckets by a
128-bit hash of their bytes, which spreads them evenly.

Buckets hold packed records; text moves only to be joined with what was found in it.

Results on odd input: null and empty texts have no bytes and lose none, their digest is that of no bytes; texts shorter
than the width lose none; rows that repeat a doc_id and its text are one document and each keep their row; different
texts of one doc_id are ordered by a digest of the text; a null doc_id comes before all others; very long texts are read
in overlapping parts, whole; an empty table has no rows; other columns are kept by ``without_repeats`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import dense_ids
from ..runtime import written
from .bwt import window_classes
from .shingles import mix
from .workers import forget, fresh, slices

GRAM = 16
RECORD = np.dtype([("anchor", "u8"), ("same", "u8"), ("left", "u4"), ("right", "u4"), ("doc", "i8"), ("start", "u4"), ("windows", "u1")])
MARK = "doc_key long, place long, anchor long"  # place: 256 * start + windows
ONE_TRANSFORM = 2 << 20  # bytes
_U = np.uint64
_B, _B2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
FIRST = np.dtype([("h1", "u8"), ("h2", "u8"), ("doc", "i8"), ("start", "u4")])
SAMPLE = 16  # one document in so many tells the frequent anchors
#: Bytes of text to a bucket, whose records and strings one task holds.
BUCKET_BYTES = 16 << 20
Hot = tuple[np.ndarray, np.ndarray]  # sorted anchors, and over how many buckets each is dealt


def _tasks(spark: SparkSession, buckets: int) -> np.ndarray:
    """A number for each bucket that repartition(buckets, number) sends to a task of its own; hashing the buckets
    themselves would leave a third of the tasks idle and give others several."""
    numbers = spark.range(32 * buckets).select(F.col("id").cast("int").alias("number"))
    rows = numbers.groupBy(F.pmod(F.hash("number"), F.lit(buckets)).alias("task")).agg(F.min("number").alias("number")).collect()
    own = np.arange(buckets, dtype=np.int32)
    for row in rows:
        own[row.task] = row.number
    return own


def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, base), np.full(n + 1, _U(pow(int(base), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hashes:
    """Hashes of any substring of the data, from sums of powers."""

    def __init__(self, data: np.ndarray, base: np.uint64 = _B):
        up, self.down = _powers(len(data), base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * up[:-1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each run of span values."""
    have = 1
    while have < span:
        step = min(have, span - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def records(data: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of the windows that start where valid says so: first window and number of each run, and its anchor's hash, bytes'
    hash, and the hashes of the bytes that reach from the anchor to the left and right (0 where no window has them)."""
    own, span = Hashes(data), width - GRAM + 1
    side = span // 2
    low = _U((1 << 21) - 1)  # data is shorter than that
    grams = own.grams(GRAM)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(keys, span) & low).astype(np.int64)
    starts = np.nonzero(valid[: len(at)])[0]
    if not len(starts):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 4
    anchors = at[starts]
    first = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)])
    edge = np.nonzero(first)[0]
    count = np.diff(np.concatenate([edge, [len(starts)]]))
    begin, anchor = starts[edge], anchors[edge]
    end = begin + count - 1 + width
    left, right = np.zeros(len(edge), np.uint64), np.zeros(len(edge), np.uint64)
    has = anchor - begin >= side
    left[has] = own.of(anchor[has] - side, anchor[has] + GRAM) | _U(1)
    has = end - anchor - GRAM >= span - 1 - side
    right[has] = own.of(anchor[has], anchor[has] + GRAM + span - 1 - side) | _U(1)
    return begin, count, grams[anchor], own.of(begin, end), left, right


def _parts(texts: list[bytes], keys: list[int], width: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Data of several documents, where windows may start, and the document and its offset of each stretch. Longer texts come in overlapping parts."""
    buffer, stretches, size = [], [], 0

    def out():
        data = np.frombuffer(b"".join(buffer), np.uint8)
        valid = np.ones(len(data), bool)
        at = 0
        for part in buffer:
            at += len(part)
            valid[max(0, at - width + 1) : at] = False
        begins = np.concatenate([[0], np.cumsum([len(p) for p in buffer])[:-1]]).astype(np.int64)
        return data, valid, begins, np.array(stretches, np.int64)

    for text, key in zip(texts, keys, strict=True):
        for at in range(0, max(1, len(text) - width + 1), most):
            part = text[at : at + most + width - 1]
            if len(part) < width:
                continue
            if size + len(part) > most and buffer:
                yield out()
                buffer, stretches, size = [], [], 0
            buffer.append(part)
            stretches.append((key, at))
            size += len(part)
    if buffer:
        yield out()


def _dealt(anchors: np.ndarray, docs: np.ndarray, hot: Hot, tasks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each record's bucket, and whether its anchor is dealt over several."""
    own, parts = hot
    at = np.minimum(np.searchsorted(own, anchors), max(0, len(own) - 1))
    is_hot = (own[at] == anchors) if len(own) else np.zeros(len(anchors), bool)
    bucket = anchors >> _U(20)
    if is_hot.any():
        salt = mix(docs[is_hot].astype(np.int64).view(np.uint64) + _B) % parts[at[is_hot]]
        bucket[is_hot] += mix(anchors[is_hot] ^ (salt * _B2)) * (salt > 0)
    return tasks[(bucket % _U(len(tasks))).astype(np.int64)], is_hot


def _hot(docs: DataFrame, width: int, buckets: int, least: int = 12) -> Hot:
    """Anchors with more records than a bucket's share, by a sample of the documents: fewer than there are buckets."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                for data, valid, _, _ in _parts(rows.column("text").cast(pa.binary()).to_pylist(), rows.column("doc_key").to_pylist(), width):
                    _, _, anchor, same, _, _ = records(data, valid, width)
                    own, counts = np.unique(anchor[np.unique(same, return_index=True)[1]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(counts.astype(np.int64))], ["anchor", "n"])

    sampled = docs.filter(F.pmod(F.xxhash64("doc_key"), F.lit(SAMPLE)) == 0).mapInArrow(part, "anchor long, n long")
    counts = written(sampled.groupBy("anchor").agg(F.sum("n").alias("n")), "anchor-sample")
    share = (counts.agg(F.sum("n")).first()[0] or 0) / buckets
    rows = counts.filter(F.col("n") > max(share, least)).collect()
    own = np.array([r.anchor for r in rows], np.int64).view(np.uint64)
    parts = np.array([min(buckets, 1 + int(2 * r.n / max(share, 1))) for r in rows], np.uint64)
    order = np.argsort(own)
    return own[order], parts[order]


def _packed(docs: DataFrame, width: int, tasks: np.ndarray, hot: Hot) -> DataFrame:
    """bucket and records. Of equal strings within a slice only the first goes on; the others are marked at once (anchor 0)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                found = []
                for data, valid, begins, stretches in _parts(rows.column("text").cast(pa.binary()).to_pylist(), rows.column("doc_key").to_pylist(), width):
                    begin, count, anchor, same, left, right = records(data, valid, width)
                    which = np.searchsorted(begins, begin, "right") - 1
                    own = np.empty(len(begin), RECORD)
                    own["anchor"], own["same"], own["left"], own["right"] = anchor, same, (left >> _U(32)).astype(np.uint32), (right >> _U(32)).astype(np.uint32)
                    own["left"][left == 0] = own["right"][right == 0] = 0
                    own["doc"], own["start"], own["windows"] = stretches[which, 0], begin - begins[which] + stretches[which, 1], count
                    found.append(own)
                if not found:
                    continue
                own = np.concatenate(found)
                own = own[np.lexsort((own["start"], own["doc"], own["same"], own["anchor"]))]
                again = np.concatenate([[False], (own["anchor"][1:] == own["anchor"][:-1]) & (own["same"][1:] == own["same"][:-1])])
                bucket, _ = _dealt(own["anchor"], own["doc"], hot, tasks)
                own["same"][again] = 0  # a repeat of the one before it, unless that is the same place of a repeated row
                same_place = np.concatenate([[False], (own["doc"][1:] == own["doc"][:-1]) & (own["start"][1:] == own["start"][:-1])]) & again
                own, bucket = own[~same_place], bucket[~same_place]
                order = np.argsort(bucket, kind="stable")
                own, bucket = own[order], bucket[order]
                cuts = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, [len(own)]])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["bucket", "packed"])

    return docs.mapInArrow(part, "bucket int, packed binary")


def _marks(own: np.ndarray, opened: bool) -> pa.RecordBatch:
    places = (own["start"].astype(np.int64) << 8) | own["windows"]
    anchors = pa.array(own["anchor"].view(np.int64)) if opened else pa.nulls(len(own), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(own["doc"]), pa.array(places), anchors], ["doc_key", "place", "anchor"])


def _compare(packed: DataFrame, hot: Hot) -> DataFrame:
    """Marks: repeats of whole strings (anchor null), and strings whose windows must be compared (with their anchor)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                held.setdefault(bucket, []).append(blob)
        for bucket in sorted(held):
            own = np.frombuffer(b"".join(held.pop(bucket)), RECORD)
            repeat = own["same"] == 0
            yield _marks(own[repeat], False)
            own = own[~repeat]
            own = own[np.lexsort((own["start"], own["doc"], own["same"], own["anchor"]))]
            again = np.concatenate([[False], (own["anchor"][1:] == own["anchor"][:-1]) & (own["same"][1:] == own["same"][:-1])])[: len(own)]
            place = np.concatenate([[False], (own["doc"][1:] == own["doc"][:-1]) & (own["start"][1:] == own["start"][:-1])])[: len(own)]
            yield _marks(own[again & ~place], False)
            own = own[~again]
            shared = np.isin(own["anchor"], hot[0])  # other buckets may have their like
            for side in ("left", "right"):
                has = np.nonzero(own[side])[0]
                _, inverse, counts = np.unique(mix(own["anchor"][has] ^ (own[side][has].astype(np.uint64) * _B)), return_inverse=True, return_counts=True)
                shared[has[counts[inverse] > 1]] = True
            yield _marks(own[shared], True)

    return packed.mapInArrow(part, MARK)


def _fetched(docs: DataFrame, opened: DataFrame, width: int, tasks: np.ndarray, hot: Hot) -> DataFrame:
    """bucket and strings: anchor, document, start and windows of each (a record) and their bytes, one after the other."""
    wanted = opened.groupBy("doc_key").agg(F.collect_list(F.struct("place", "anchor")).alias("marks")).select("doc_key", F.col("marks.place").alias("places"), F.col("marks.anchor").alias("anchors"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[tuple]] = {}
            seen = set()
            for key, text, places, anchors in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "text", "places", "anchors")), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                text = text.encode()
                to, _ = _dealt(np.array(anchors, np.int64).view(np.uint64), np.full(len(anchors), key, np.int64), hot, tasks)
                for place, anchor, bucket in zip(places, anchors, to.tolist(), strict=True):
                    start, windows = place >> 8, place & 255
                    by.setdefault(bucket, []).append((anchor, key, start, windows, text[start : start + windows + width - 1]))
            keys, heads, texts = [], [], []
            for bucket, items in by.items():
                keys.append(bucket)
                heads.append(np.array([i[:4] for i in items], np.int64).tobytes())
                texts.append(b"".join(i[4] for i in items))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(heads, pa.binary()), pa.array(texts, pa.binary())], ["bucket", "heads", "texts"])

    return docs.join(wanted, "doc_key").select("doc_key", "text", "places", "anchors").mapInArrow(part, "bucket int, heads binary, texts binary")


def _hash_windows(strings: list[bytes], width: int, base: np.uint64 = _B) -> np.ndarray:
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    begins = np.cumsum(sizes) - sizes
    starts = np.concatenate([np.arange(b, b + n - width + 1) for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)])
    return Hashes(data, base).of(starts, starts + width)


def windows_by_class(heads: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Document, start and index among all windows of each window, and whether it also starts earlier, among strings sorted
    by anchor; ordered by class, first windows first."""
    docs, starts, classes, base, a = [], [], [], 0, 0
    sizes = np.cumsum([len(s) for s in strings])
    edges = [*(np.nonzero(heads[1:, 0] != heads[:-1, 0])[0] + 1).tolist(), len(strings)]  # a transform ends with an anchor
    pieces, split = [], False
    for edge in edges:
        while edge > a and sizes[edge - 1] - (sizes[a - 1] if a else 0) > ONE_TRANSFORM:
            before = [e for e in edges if a < e < edge][-1:] if not split else []
            stop = before[0] if before else int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + ONE_TRANSFORM, "right"))
            stop = min(edge, max(stop, a + 1))
            split = stop not in edges
            pieces.append((a, stop))
            a = stop
        split = False
    if a < len(strings):
        pieces.append((a, len(strings)))
    for a, b in pieces:
        own = window_classes(strings[a:b], width)
        flat = np.concatenate(own)
        _, flat = np.unique(flat, return_inverse=True)
        classes.append(flat + base)
        base += int(flat.max(initial=-1)) + 1
        counts = [len(c) for c in own]
        docs.append(np.repeat(heads[a:b, 1], counts))
        starts.append(np.concatenate([np.arange(s, s + n) for s, n in zip(heads[a:b, 2].tolist(), counts, strict=True)]))
    docs, starts, classes = np.concatenate(docs), np.concatenate(starts), np.concatenate(classes)
    if len(pieces) > 1:  # an anchor's strings may lie in several transforms
        _, one = np.unique(classes, return_index=True)
        both = np.empty(len(one), [("h1", "u8"), ("h2", "u8")])
        both["h1"], both["h2"] = _hash_windows(strings, width)[one], _hash_windows(strings, width, _B2)[one]
        _, joint = np.unique(both, return_inverse=True)
        classes = joint[classes]
    order = np.lexsort((starts, docs, classes))
    docs, starts, classes = docs[order], starts[order], classes[order]
    again = np.concatenate([[False], classes[1:] == classes[:-1]])
    again[1:] &= (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1])
    return docs, starts, order, again


def repeated_windows(heads: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of the windows that also start earlier."""
    docs, starts, _, again = windows_by_class(heads, strings, width)
    return docs[again], starts[again]


def _firsts(heads: np.ndarray, strings: list[bytes], width: int, firsts: np.ndarray, docs: np.ndarray, starts: np.ndarray, tasks: np.ndarray) -> pa.RecordBatch:
    """The first windows of classes under the hashes of their bytes, for the buckets in which they are matched."""
    own = np.empty(len(firsts), FIRST)
    own["h1"], own["h2"] = _hash_windows(strings, width)[firsts], _hash_windows(strings, width, _B2)[firsts]
    own["doc"], own["start"] = docs, starts
    bucket = tasks[((own["h1"] >> _U(17)) % _U(len(tasks))).astype(np.int64)]
    order = np.argsort(bucket, kind="stable")
    own, bucket = own[order], bucket[order]
    cuts = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, [len(own)]])
    n = len(cuts) - 1
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(bucket[cuts[:-1]]), pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], EXPANDED)


def _runs(docs: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Marks of windows, those in a row together."""
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    edge = np.nonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1)])[: len(docs)])[0]
    count = np.diff(np.concatenate([edge, [len(docs)]]))
    times = -(-count // 255)  # a place holds up to 255 windows
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    begin, left = np.repeat(starts[edge], times) + 255 * nth, np.repeat(count, times) - 255 * nth
    n = len(begin)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(docs[edge], times)), pa.array((begin << 8) | np.minimum(left, 255)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], EXPANDED)


EXPANDED = ["doc_key", "place", "bucket", "packed"]
EXPANDED_SCHEMA = "doc_key long, place long, bucket int, packed binary"


def _matched(firsts: DataFrame) -> DataFrame:
    """Marks of the first windows that start earlier in another bucket."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                held.setdefault(bucket, []).append(blob)
        for bucket in sorted(held):
            own = np.frombuffer(b"".join(held.pop(bucket)), FIRST)
            own = own[np.lexsort((own["start"], own["doc"], own["h2"], own["h1"]))]
            again = np.concatenate([[False], (own["h1"][1:] == own["h1"][:-1]) & (own["h2"][1:] == own["h2"][:-1])])
            again[1:] &= (own["doc"][1:] != own["doc"][:-1]) | (own["start"][1:] != own["start"][:-1])
            yield _runs(own["doc"][again], own["start"][again].astype(np.int64))

    return firsts.mapInArrow(part, EXPANDED_SCHEMA)


def _expanded(fetched: DataFrame, width: int, tasks: np.ndarray, hot: Hot) -> DataFrame:
    """Marks of windows that start earlier in the bucket (doc_key and place), and packed first windows of dealt anchors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for bucket, heads, texts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "heads", "texts")), strict=True):
                held.setdefault(bucket, []).append((heads, texts))
        for bucket in sorted(held):
            own = held.pop(bucket)
            heads = np.frombuffer(b"".join(h for h, _ in own), np.int64).reshape(-1, 4)
            joined, ends = b"".join(t for _, t in own), np.cumsum(heads[:, 3] + width - 1).tolist()
            strings = [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            order = np.lexsort((heads[:, 2], heads[:, 1], heads[:, 0]))
            heads, strings = heads[order], [strings[i] for i in order.tolist()]
            docs, starts, index, again = windows_by_class(heads, strings, width)
            yield _runs(docs[again], starts[again])
            _, is_hot = _dealt(heads[:, 0].view(np.uint64), heads[:, 1], hot, tasks)
            first = ~again & np.repeat(is_hot, heads[:, 3])[index] if is_hot.any() else np.zeros(0, bool)
            if first.any():
                yield _firsts(heads, strings, width, index[first], docs[first], starts[first], tasks)

    return fetched.mapInArrow(part, EXPANDED_SCHEMA)


def _keyed(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """docs with a column that orders documents. It is the doc_id unless ids repeat or are missing; then documents, told
    apart by id and a 128-bit digest of their text, are numbered by range partitions."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), False
    digest = F.md5("text")
    ids = written(docs.select(F.struct("doc_id", digest.alias("digest")).alias("document")).distinct(), "documents-told")
    ids = written(dense_ids(ids, "document", "number"), "document-keys")
    row, own = fresh(docs.columns, "__row"), fresh(docs.columns, "__own")
    ids = ids.select(F.col("document").alias(own), F.col("number").alias(key))
    keyed = docs.withColumn(row, F.struct("doc_id", digest.alias("digest")))
    same = F.col(f"{row}.doc_id").eqNullSafe(F.col(f"{own}.doc_id")) & F.col(f"{row}.digest").eqNullSafe(F.col(f"{own}.digest"))
    return keyed.join(ids, same).drop(row, own), True


def marked(docs: DataFrame, key: str, places: str, width: int = 100) -> DataFrame:
    """docs (doc_id, text and others) with two columns of the given names: a key that orders documents, and the runs of
    windows that start earlier elsewhere."""
    if not GRAM < width <= 255 + GRAM:
        raise ValueError("width")
    spark = docs.sparkSession
    docs, replaced = _keyed(docs, key)
    if replaced:
        docs = written(docs, "documents")
    texts = docs.select(F.col(key).alias("doc_key"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") >= width)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))  # a task holds one
    hot, tasks = _hot(texts, width, buckets), _tasks(spark, buckets)
    compared = written(_compare(_packed(texts, width, tasks, hot).repartition(buckets, "bucket"), hot), "repeat-marks")
    opened = compared.filter("anchor is not null")
    expanded = written(_expanded(_fetched(texts, opened, width, tasks, hot).repartition(buckets, "bucket"), width, tasks, hot), "window-marks")
    marks = compared.filter("anchor is null").select("doc_key", "place").unionByName(expanded.filter("packed is null").select("doc_key", "place"))
    if len(hot[0]):
        between = _matched(expanded.filter("packed is not null").select("bucket", "packed").repartition(buckets, "bucket"))
        marks = marks.unionByName(between.select("doc_key", "place"))
    return docs.join(marks.groupBy(F.col("doc_key").alias(key)).agg(F.collect_list("place").alias(places)), key, "left")


def removed(size: int, places: list[int] | None, width: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the windows cover."""
    if not places:
        return []
    own = np.sort(np.array(places, np.int64))
    begin, end = own >> 8, (own >> 8) + (own & 255) - 1 + width
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    covered = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    edge = np.diff(covered)
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for begin, end in runs:
        out.append(raw[at:begin])
        at = end
    return b"".join([*out, raw[at:]])


def report(docs: DataFrame, width: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes left."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, places in zip(batch.column("text"), batch.column("__places"), strict=True):
                raw = (text.as_py() or "").encode()
                runs = removed(len(raw), places.as_py(), width)
                for column, value in zip(out, (len(raw), sum(e - b for b, e in runs), len(runs), hashlib.sha256(_kept(raw, runs) if runs else raw).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "__key", "__places", width)
    return own.select("doc_id", "text", "__places").mapInArrow(part, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """docs with the repeats cut from their texts. A character that is cut in part goes whole. Texts that lose nothing,
    null ones too, stay as they are; all rows and columns stay."""
    columns, schema = docs.columns, docs.schema
    text_at, key, marks = columns.index("text"), fresh(columns, "__key"), fresh(columns, "__places")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, places in zip(batch.column("text"), batch.column(marks), strict=True):
                text = text.as_py()
                if text and (found := places.as_py()):
                    raw = text.encode()
                    text = _kept(raw, removed(len(raw), found, width)).decode("utf-8", "ignore")
                texts.append(text)
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return marked(docs, key, marks, width).select(*(F.col(f"`{c}`") for c in [*columns, marks])).mapInArrow(part, schema)
