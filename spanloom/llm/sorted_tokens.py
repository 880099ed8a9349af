"""Token ids in sorted-string-table shards.

A shard is a run of compressed blocks, a sparse index with the first key of each block, a Bloom filter of all keys
and a footer. Keys are document ids as eight big-endian bytes (sign bit flipped, so that byte order is id order);
within a block a key is stored as the length of the prefix that it shares with the key before and the rest. Values
are the ids, in two bytes each where the vocabulary allows. ``Shard.get`` finds a document by the filter, a binary
search in the index and one block.

Results on odd input: a null text counts as empty and gets the end id alone; a null doc_id sorts before all others;
rows that repeat a doc_id are all kept, ordered by text; no documents give no shard and no rows; other columns are ignored; the
content of an added token in a text, such as <|endoftext|>, is that token, as by the library's default.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from .pieces import Memo, parts, values, words
from .workers import cached, no_cycles, slices

MAGIC = b"SLSST001"
FOOTER = struct.Struct("<QQQQQ8s")  # index offset and size, filter offset, documents, tokens
#: Fixed value: the pieces of the tokenizers for which ``by_words`` holds.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bits(key: bytes, n_bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [((a + i * b) & 0xFFFFFFFF) % n_bits for i in range(7)]


class Writer:
    def __init__(self, out, wide: bool, block_bytes: int = 1 << 18):
        self.out, self.kind, self.block_bytes = out, b"\x04" if wide else b"\x02", block_bytes
        self.keys, self.index, self.block, self.at = [], [], bytearray(), 0
        self.last, self.first, self.in_block, self.tokens, self.block_start = b"", b"", 0, 0, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, ids: bytes) -> None:
        n = len(ids) // self.kind[0]
        if not self.in_block:
            self.first, self.last, self.block_start = key, b"", self.tokens
        same = 0
        while same < min(len(key), len(self.last)) and key[same] == self.last[same]:
            same += 1
        self.block += struct.pack("<BBQ", same, len(key) - same, n) + key[same:] + ids
        self.last, self.in_block, self.tokens = key, self.in_block + 1, self.tokens + n
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            data = self.pack(bytes(self.block))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data), self.in_block, self.block_start))
            self.at += len(data)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> tuple[int, int]:
        self._flush()
        index = b"".join(struct.pack("<BQQIQ", len(k), *rest) + k for k, *rest in self.index)
        n_bits = max(64, 10 * len(self.keys))
        filter_ = bytearray(-(-n_bits // 8))
        for key in self.keys:
            for bit in _bits(key, n_bits):
                filter_[bit >> 3] |= 1 << (bit & 7)
        self.out.write(self.kind + index + struct.pack("<Q", n_bits) + bytes(filter_))
        self.out.write(FOOTER.pack(self.at, 1 + len(index), self.at + 1 + len(index), len(self.keys), self.tokens, MAGIC))
        return len(self.keys), self.tokens


class Shard:
    """Reads a shard through any file object that can seek."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        source.seek(source.tell() - FOOTER.size)
        at, size, filter_at, self.n_docs, self.n_tokens, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(at)
        raw = source.read(size)
        self.width, self.blocks, i = raw[0], [], 1
        while i < len(raw):
            n, *rest = struct.unpack_from("<BQQIQ", raw, i)
            i += struct.calcsize("<BQQIQ")
            self.blocks.append((raw[i : i + n], *rest))
            i += n
        source.seek(filter_at)
        self.n_bits = struct.unpack("<Q", source.read(8))[0]
        self.filter = source.read(-(-self.n_bits // 8))

    def _block(self, at: int, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
        self.source.seek(at)
        data, i, key = zstandard.ZstdDecompressor().decompress(self.source.read(size)), 0, b""
        while i < len(data):
            same, rest, n = struct.unpack_from("<BBQ", data, i)
            i += 10
            key = key[:same] + data[i : i + rest]
            i += rest
            yield key, np.frombuffer(data, f"<u{self.width}", n, i)
            i += n * self.width

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, at, size, _, _ in self.blocks:
            for key, ids in self._block(at, size):
                yield id_of(key), ids

    def get(self, doc_id: int) -> list[int] | None:
        key = key_of(doc_id)
        if not all(self.filter[bit >> 3] >> (bit & 7) & 1 for bit in _bits(key, self.n_bits)):
            return None
        for i in range(max(0, bisect.bisect_left([b[0] for b in self.blocks], key) - 1), len(self.blocks)):
            if self.blocks[i][0] > key:
                break
            for found, ids in self._block(self.blocks[i][1], self.blocks[i][2]):
                if found == key:
                    return ids.tolist()
        return None


class Encoder:
    """The tokenizers library with a memo of words between ASCII white space.

    The memo holds where the tokenizer's own file says that words are encoded one by one (``by_words``); with any other
    tokenizer the library encodes whole texts. split_special: added tokens in a text are split like any other characters,
    the library's encode_special_tokens. Where it is False, the library's default, texts that hold the content of one are
    encoded whole by the library.
    """

    MARK = "|"

    def __init__(self, path: str, most_words: int = 150_000, split_special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has given out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = split_special
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.wide = self.tokenizer.get_vocab_size() > 65_536
        self.added = None if split_special else self._added()
        self.form, self.memo = "<u4" if self.wide else "<u2", None
        if by_words(json.loads(self.tokenizer.to_str())):
            (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
            self.memo = Memo(self._learn, most_words)

    def _added(self) -> re.Pattern | None:
        """Finds the added tokens in any case, as the library may look for them before or after it lowers the text."""
        contents = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        return re.compile("|".join(map(re.escape, contents)), re.IGNORECASE) if contents else None

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.form)

    def _learn(self, words: list[str]) -> list[bytes]:
        """Many words in one call, with a mark between them that is a token of its own and in none of them."""
        plain = [word for word in words if self.MARK not in word]
        known = {word: self._whole(word).tobytes() for word in words if self.MARK in word}
        for at in range(0, len(plain), 5_000):
            some = plain[at : at + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(some)], add_special_tokens=False)[0].ids, self.form)
            edges, packed, width = (np.flatnonzero(ids == self.mark) * ids.itemsize).tolist(), ids.tobytes(), ids.itemsize
            known.update(zip(some, [packed[a:b] for a, b in zip([0, *(e + width for e in edges)], [*edges, len(packed)], strict=True)], strict=True))
        return list(map(known.__getitem__, words))

    @staticmethod
    def _folded(text: str) -> str:
        """Lower case where that is what the library does to each character anyway, so that spellings share an entry."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def encode(self, texts: list[str], most: int = 4 << 20) -> list[np.ndarray]:
        """The ids of each text. A text of over ``most`` characters is encoded in parts, cut between words."""
        if self.memo is None:
            return list(map(self._whole, texts))
        whole = {} if self.added is None else {i: self._whole(text) for i, text in enumerate(texts) if self.added.search(text)}
        rest = ["" if i in whole else self._folded(text) for i, text in enumerate(texts)]
        if any(len(text) > most for text in rest):
            return [whole[i] if i in whole else np.concatenate([self._words([part])[0] for part in parts(text, most)]) for i, text in enumerate(rest)]
        out = self._words(rest)
        for i, ids in whole.items():
            out[i] = ids
        return out

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        found, begins = words(texts)
        ids, ends = values(found, self.memo, self.form)
        edges = ends[begins].tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def by_words(settings: dict) -> bool:
    """Whether a tokenizer is known to encode words between ASCII white space one by one and in lower case: a byte-level BPE
    with word ends, whose normaliser composes, joins white space and lowers, whose pre-tokenizer drops white space and
    keeps a run of punctuation together, and which knows "|"."""
    steps = settings.get("normalizer") or {}
    split = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = settings.get("model") or {}
    return (
        [step.get("type") for step in steps.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and steps["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        and [part.get("type") for part in split] == ["Split", "ByteLevel"]
        and split[0]["pattern"] == {"Regex": WORD_PATTERN}
        and (split[0]["behavior"], split[0]["invert"], split[1]["add_prefix_space"]) == ("Removed", True, False)
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout"), model.get("continuing_subword_prefix") or "") == ("BPE", "</w>", None, "")
        and "|</w>" in model["vocab"]
    )


def encoder(path: str) -> Encoder:
    return cached(("sorted_tokens", path), lambda: Encoder(path, split_special=False))


def write_shards(docs: DataFrame, path: str, to: str, end_id: int = 2) -> DataFrame:
    """Tokenises and writes one shard for each range of ids; a task that runs again replaces its shard with equal bytes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = out = writer = None
        task = TaskContext.get()
        for batch in batches:
            for rows in slices(batch, "text", 4 << 20):
                if writer is None:
                    own = encoder(path)
                    end = np.array([end_id], own.form).tobytes()
                    fs, folder = pafs.FileSystem.from_uri(to)
                    fs.create_dir(folder, recursive=True)
                    final = f"{folder}/shard-{task.partitionId():06d}.sst"
                    draft = f"{final}.{task.taskAttemptId()}"
                    out = fs.open_output_stream(draft)
                    writer = Writer(out, own.wide)
                texts = [text or "" for text in rows.column("text").to_pylist()]
                with no_cycles():
                    packed = own.encode(texts)
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), packed, strict=True):
                    writer.add(key_of(doc_id), ids.tobytes() + end)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            out.close()
            fs.move(draft, final)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [final], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return runtime.written(ordered.mapInArrow(part, MANIFEST), "token-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame, to: str) -> DataFrame:
    """Rows from the shards' files. The manifest has one row for each shard; their token counts are summed on the driver."""
    total, starts = 0, []
    for row in sorted(manifest.collect(), key=lambda r: r.shard):
        starts.append((row.path, total))
        total += row.n_tokens
    if not starts:
        return spark.createDataFrame([], READ)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(to)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                out: list[list] = [[], [], [], []]
                with fs.open_input_file(path) as source:
                    for doc_id, ids in Shard(source).scan():
                        for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(value)
                        start += len(ids)
                        if len(out[0]) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            out = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(starts, "path string, start long").repartition(len(starts))
    return files.mapInArrow(part, READ)


def tokenised(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    to = runtime.scratch(docs.sparkSession, "token-shards")
    return read_shards(docs.sparkSession, write_shards(docs, path, to, end_id), to)
