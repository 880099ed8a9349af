"""Near-duplicate documents by SetSketch registers.

A sketch has m registers; each holds the minimum of an exponentially distributed hash over the text's shingles, on an
exponentially spaced scale cut to 16 bits. Sketches of parts merge by the register-wise maximum, and registers of two
sets agree about as often as the sets do. Bands of registers give candidates, the joint likelihood of two sketches
(with the known set sizes) rules out far ones, and the rest are confirmed on their full sets, so that a link is exact.

Documents with equal sets are one class from the start. Where a band holds many classes, pairs are not listed:

1. each class is compared with the hub it shares most bands with; a band's hub is its class that shares most overall,
   which in a group of copies is the text that they were copied from;
2. what these links leave apart within a band is compared exhaustively: pairs of small bands after the likelihood test,
   large bands in blocks of bounded size, in which the classes outside the band's largest component meet all others.

Two kinds of pairs can be missed, both by the sketch's chance alone: those that share no band of registers (at a similarity
of 0.75, 2 in 100 000 pairs, and fewer above), and of the listed pairs of small bands those whose estimate lies under
LIKELY, four standard deviations below 0.75 (3 in 100 000 at 0.75). Either is lost only if no other class links the two.

Results on odd input: texts that are null, empty or without words have no shingles and are linked with nothing; shorter
texts count as one shingle; a null doc_id gets a null component unless linked to others; repeated rows are one class and
each keep their row; very long texts are read whole; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .components import components
from .shingles import mix, sets
from .workers import forget, slices

BANDS, ROWS = 40, 5
M = BANDS * ROWS
BASE, RATE, TOP = 1.02, 20.0, 65_535
_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(0, 2**64, M, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**64, M, dtype=np.uint64)
SALTS = 16  # parts of a band where its rows meet what is known of it
SMALL = 48  # classes of a band up to which pairs are listed
R_BLOCK, M_BLOCK = 256, 1024
LIKELY = 0.63  # 0.75 less four standard deviations of the estimate


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set: the larger, the smaller the least hash; 0 for the empty set."""
    if not len(shingles):
        return np.zeros(M, np.uint16)
    least = np.full(M, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * _FACTORS + _SHIFTS).min(0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity under which rows of registers a and b are most likely, given the set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    for j in np.linspace(0, 1, 101):
        s = np.minimum(j, top)
        up, down = np.maximum(p(u - v * s), 1e-12), np.maximum(p(v - u * s), 1e-12)
        value = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
        better = value > best
        best[better], at[better] = value[better], s[better]
    return at


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        key = mix(key + parts[:, :, k])
    return key.view(np.int64)


def _rid(shingles: np.ndarray) -> tuple[int, int]:
    """Both halves of a 128-bit digest of a set."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def row_key() -> Column:
    """Tells rows of docs apart that have no id, or the same, unless their texts are the same, too: 128 bits of both."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))).alias("row_key")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class and check (halves of the set's digest, null without shingles), registers and row_key."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                own = sets(rows.column("text").cast(pa.binary()).to_pylist())
                classes, checks = zip(*(_rid(s) if len(s) else (None, None) for s in own), strict=True) if own else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([len(s) for s in own], pa.int64()), pa.array(classes, pa.int64()), pa.array(checks, pa.int64()), pa.array([sketch(s).tobytes() if len(s) else None for s in own], pa.binary()), rows.column("row_key")],
                    ["doc_id", "n_shingles", "class", "check", "registers", "row_key"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key()).mapInArrow(part, "doc_id long, n_shingles long, class long, check long, registers binary, row_key string")


def _banded(classes: DataFrame) -> DataFrame:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                keys = band_keys(np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, M))
                ids = np.repeat(rows.column("class").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["band", "class"])

    return classes.select("class", "registers").mapInArrow(part, "band long, class long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and its set, for the classes and documents wanted."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                own = sets(rows.column("text").cast(pa.binary()).to_pylist())
                # rows may repeat an id with other texts: only the class's own text counts
                right = [(c, s.tobytes()) for c, s in zip(rows.column("class").to_pylist(), own, strict=True) if len(s) and c in _rid(s)]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in right], pa.int64()), pa.array([s for _, s in right], pa.binary())], ["class", "set"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                own = [s for s in sets(rows.column("text").cast(pa.binary()).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([half for s in own for half in _rid(s)], pa.int64()), pa.array([s.tobytes() for s in own for _ in range(2)], pa.binary())], ["class", "set"])

    own = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    found = own.join(wanted, "doc_id").select("class", "text").mapInArrow(part, "class long, set binary")
    # a null id names no row, so the classes that have no other are found by the sets of all rows without an id
    unnamed = own.filter("doc_id is null").select("text").mapInArrow(every, "class long, set binary")
    found = found.unionByName(unnamed.join(wanted.filter("doc_id is null").select("class"), "class", "left_semi"))
    return found.groupBy("class").agg(F.first("set").alias("set"))


def _alike(shared: int, n_a: int, n_b: int) -> bool:
    return 100 * shared >= 75 * (n_a + n_b - shared)


def _confirmed(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, p, q in zip(*(batch.column(c) for c in ("a", "b", "set_a", "set_b")), strict=True):
                p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                if min(len(p), len(q)) * 100 >= 75 * max(len(p), len(q)) and _alike(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    both = pairs.join(own.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a").join(own.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    return both.mapInArrow(part, "a long, b long")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("r_a", "r_b"))
                n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                keep = pa.array(likely_similarity(a, b, n_a, n_b) >= LIKELY)
                yield batch.select(["a", "b"]).filter(keep)

    side = lambda x: classes.select(F.col("class").alias(x), F.col("registers").alias(f"r_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
    return both.mapInArrow(part, "a long, b long")


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the block's outer classes and its others, enough of them to join what they join."""
    rows = rows.sort_values(["outer", "class"], kind="stable")
    own = [np.frombuffer(s, np.uint64) for s in rows["set"]]
    root = {c: c for c in rows["component"]}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    members = np.nonzero(~rows["outer"].to_numpy())[0]
    if not len(members):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    sizes = np.array([len(own[m]) for m in members])
    flat, owner = np.concatenate([own[m] for m in members]), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    component, ids, out = rows["component"].tolist(), rows["class"].tolist(), []
    for x in np.nonzero(rows["outer"].to_numpy())[0]:
        low, high = np.searchsorted(flat, own[x], "left"), np.searchsorted(flat, own[x], "right")
        counts = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        shared = np.bincount(owner[at], minlength=len(members))
        for k in np.nonzero(100 * shared >= 75 * (len(own[x]) + sizes - shared))[0]:
            y = members[k]
            if find(component[x]) != find(component[y]):
                root[find(component[x])] = find(component[y])
                out.append((ids[x], ids[y]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _in_blocks(apart: DataFrame, own: DataFrame) -> DataFrame:
    """apart: band, class, component. In each band the classes outside its largest component against all of it."""
    sizes = apart.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("total"))
    main = main.select("band", F.col("m.component").alias("main"), F.ceil(F.col("total") / M_BLOCK).cast("int").alias("m_blocks"), F.ceil((F.col("total") - F.col("m.n")) / R_BLOCK).cast("int").alias("r_blocks"))
    # a large band's rows meet its line on several salts, so that no task gets them all
    main = main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = apart.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(main, ["band", "salt"]).drop("salt").withColumn("h", F.xxhash64("class", "band"))
    members = rows.withColumn("m", F.pmod("h", F.col("m_blocks"))).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1))).withColumn("outer", F.lit(False))
    outer = rows.filter("component <> main").withColumn("r", F.pmod("h", F.col("r_blocks"))).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1))).withColumn("outer", F.lit(True))
    both = members.select("band", "m", "r", "outer", "class", "component").unionByName(outer.select("band", "m", "r", "outer", "class", "component"))
    return both.join(own, "class").groupBy("band", "m", "r").applyInPandas(_block, "a long, b long")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes that join all that is alike. classes: class, first_doc, n_shingles, registers."""
    banded = _banded(classes)
    full = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(banded.join(full, "band"), "shared-bands")
    own = written(_sets(docs, classes.join(shared.select("class").distinct(), "class", "left_semi").selectExpr("first_doc doc_id", "class")), "sets")
    reach = shared.groupBy("class").agg(F.sum("n").alias("reach"))
    hubs = shared.join(reach, "class").groupBy("band").agg(F.max(F.struct("reach", "class")).alias("top")).select("band", F.col("top.class").alias("hub"))
    tries = shared.join(hubs, "band").filter("class <> hub").groupBy("class", "hub").agg(F.count("*").alias("n"))
    tries = tries.groupBy("class").agg(F.max(F.struct("n", "hub")).alias("top")).select(F.least("class", "top.hub").alias("a"), F.greatest("class", "top.hub").alias("b")).distinct()
    tries = written(tries, "tried-pairs")
    first = written(_confirmed(tries, own), "links")
    labels = components(first)
    placed = shared.join(labels.withColumnRenamed("v", "class"), "class", "left").select("band", "class", "n", F.coalesce("root", "class").alias("component"))
    open_bands = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band")
    apart = written(placed.join(open_bands, "band"), "apart")
    small = apart.filter(F.col("n") <= SMALL)
    a, b = (small.select("band", F.col("class").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab")
    pairs = a.join(b, "band").filter("a < b and c_a <> c_b").select("a", "b").distinct().join(tries, ["a", "b"], "left_anti")
    likely = written(_likely(pairs, classes), "likely-pairs")
    return first.unionByName(_confirmed(likely, own)).unionByName(_in_blocks(apart.filter(F.col("n") > SMALL).drop("n"), own))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    return labelled(docs).drop("row_key")


def _classes(found: DataFrame) -> DataFrame:
    """A row for each class; least and most differ where documents of different digests share it."""
    return found.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.min("check").alias("least"), F.max("check").alias("most"))


def told_apart(found: DataFrame, classes: DataFrame) -> DataFrame:
    """found with the digest's other half as the class where the first is that of different sets."""
    shared = classes.filter("least <> most").select("class", F.lit(True).alias("shared"))
    return found.join(shared, "class", "left").withColumn("class", F.when(F.col("shared"), F.col("check")).otherwise(F.col("class"))).drop("shared").select(*found.columns)


def labelled(docs: DataFrame) -> DataFrame:
    """The same with row_key."""
    found = written(signatures(docs), "signatures")
    classes = written(_classes(found), "classes")
    if not classes.filter("least <> most").isEmpty():  # different sets under one half of their digests
        found = written(told_apart(found, classes), "signatures")
        classes = written(_classes(found), "classes")
    classes = classes.drop("least", "most")
    labels = components(links(docs, classes))
    named = classes.select("class", "first_doc").join(labels.withColumnRenamed("v", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = named.join(smallest, "root").select("class", "component_id")
    out = found.select("doc_id", "n_shingles", "class", "row_key").join(named, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(False)).alias("kept"), "row_key")


#: The same rows from all pairs that share a shingle, for small tables.
SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) s from d),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id v, doc_id root from n union select e.b, r.root from r join e on r.v = e.a),
c as (select v, min(root) root from r group by v)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.root, d.doc_id) component_id, coalesce(c.root, d.doc_id) = d.doc_id kept from d left join n using (doc_id) left join c on c.v = d.doc_id"""
