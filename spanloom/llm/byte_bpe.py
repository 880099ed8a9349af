"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The merges (ranks of byte strings) are compiled on demand: a state holds the last token that is settled and the
bytes read since. Reading a byte leads to one other state and emits the tokens that no continuation can change. A
token boundary is settled once every boundary at which a token could still be growing descends from it; tokens have
a bounded length, so the lookahead is bounded too. Transitions are computed once and kept up to a fixed number of states,
which changes no result.

Results on odd input: a null text counts as empty and has no tokens; empty ids decode to empty bytes; repeated
documents each get their row; very long texts are cut only at matches of the pattern, never shortened; an empty
table has no rows; other columns are ignored by ``encode_documents``.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import Cutter, Memo, parts, values
from .workers import cached, no_cycles, slices

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """packed(piece) gives the ids of one match of the splitting pattern.

    A state is the last settled token (NONE before the first and where it no longer matters) and the live boundaries:
    those at which a token may still be growing, each as the node of the tokens' trie that the bytes since lead to and the
    tokens from the settled one up to it. Moves are kept by 256 * state + byte: 256 * the next state, or its complement
    where tokens are emitted.
    """

    NONE = 1 << 20

    def __init__(self, ranks: dict[bytes, int], most_states: int = 60_000):
        self.ranks, self.most_states = ranks, most_states
        self.token = {rank: token for token, rank in ranks.items()}
        self.children: dict[int, int] = {}
        self.ends_token, self.inner = [-1], bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                at = node << 8 | byte
                if (node := self.children.get(at, -1)) < 0:
                    node = self.children[at] = len(self.ends_token)
                    self.ends_token.append(-1)
                    self.inner.append(0)
            self.ends_token[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.index: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, int] = {}
        self.emits: dict[int, tuple[int, ...]] = {}
        self.passing = 0
        self.start = self._kept((self.NONE, ((0, ()),)))

    def _kept(self, key: tuple) -> int:
        at = self.index[key] = len(self.states) << 8
        self.states.append(key)
        return at

    def _merged(self, parts: list[bytes], below: float) -> list[bytes]:
        """The merges of a rank under ``below``, lowest first."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for what no merge gives."""
        if token not in self.halves:
            data = self.token[token]
            parts = self._merged([data[i : i + 1] for i in range(len(data))], token)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _fit(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens side by side: none that spans the seam comes before those that
        build them. Undone from the latest merge on, each pair at the seam must not have merged first."""
        known = len(self.token[right]) == 1 or self._split(right) is not None
        a, b, limit = left, right, float("inf")
        while known and left != self.NONE:
            across = self.ranks.get(self.token[a] + self.token[b])
            if across is not None and across < limit:
                known = False
                break
            halves_a, halves_b = self._split(a), self._split(b)
            if halves_a and (not halves_b or a > b):
                limit, a = a, halves_a[1]
            elif halves_b:
                limit, b = b + 0.5, halves_b[0]  # of two equal merges the left one comes first
            else:
                break
        self.fits[left << 20 | right] = known
        return known

    def _move(self, key: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The state that a byte leads to, and the tokens emitted on the way."""
        settled, live = key
        children, ends_token, inner, fits, still, last = self.children, self.ends_token, self.inner, self.fits, [], None
        for node, path in live:
            child = children.get(node << 8 | byte)
            if child is None:
                continue
            if last is None and (token := ends_token[child]) >= 0:
                before = path[-1] if path else settled
                if (fit := fits.get(before << 20 | token)) is None:
                    fit = self._fit(before, token)
                if fit:
                    last = (*path, token)
            if inner[child]:
                still.append((child, path))
        if last is not None:
            still.append((0, last))
        if not still:
            raise ValueError("the ranks do not cover every byte")
        common = still[0][1]
        if common:
            for _, path in still[1:]:
                same = 0
                while same < len(common) and same < len(path) and common[same] == path[same]:
                    same += 1
                common = common[:same]
            if done := len(common):
                settled, still = common[-1], [(node, path[done:]) for node, path in still]
        if still[0][1]:
            settled = self.NONE  # no token can start at the settled boundary any more, so what precedes it makes no difference
        return (settled, tuple(still)), common

    def run(self, data: bytes) -> list[int]:
        """The ids of one piece. States beyond most_states are passed through without being kept; the tables start anew
        when that has happened four times as often, as other texts may use other states."""
        if self.passing > 4 * self.most_states:
            self._reset()
        moves, index, states, emits, out = self.moves, self.index, self.states, self.emits, []
        state: int | None = self.start
        key = states[0]
        for byte in data:
            if state is not None:
                if (move := moves.get(state | byte)) is not None:
                    if move < 0:
                        out += emits[state | byte]
                        move = ~move
                    state = move
                    continue
                key = states[state >> 8]
            key, emitted = self._move(key, byte)
            out += emitted
            if (to := index.get(key)) is None:
                if len(states) < self.most_states:
                    to = self._kept(key)
                else:
                    self.passing += 1
            if state is not None and to is not None:
                moves[state | byte] = ~to if emitted else to
                if emitted:
                    emits[state | byte] = emitted
            state = to
        node, path = (key if state is None else states[state >> 8])[1][-1]
        if node:
            raise ValueError("the ranks do not cover every byte")
        out += path
        return out

    def packed(self, piece: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        ids = self.run(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)


class StreamDecoder:
    """Bytes and text of ids that come in parts; a character split between tokens is held back until it is whole."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.state = codecs.getincrementaldecoder("utf-8")("strict")
        self.valid = True

    def feed(self, ids: Iterable[int], last: bool = False) -> tuple[bytes, str]:
        raw = b"".join(map(self.tokens.__getitem__, ids))
        try:
            return raw, self.state.decode(raw, last)
        except UnicodeDecodeError:
            self.valid = False
            self.state = codecs.getincrementaldecoder("utf-8")("replace")
            return raw, self.state.decode(raw, last)


class Codec:
    def __init__(self, path: str, pattern: str, most_pieces: int = 150_000):
        self.ranks = load_ranks(path)
        self.cutter = Cutter(pattern)
        self.transducer = Transducer(self.ranks)
        self.memo = Memo(lambda pieces: list(map(self.transducer.packed, pieces)), most_pieces)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, texts: list[str], most: int = 4 << 20) -> list[np.ndarray]:
        """The ids of each text. A text of over ``most`` characters is encoded in parts, cut where a match begins for sure."""
        if any(len(text) > most for text in texts) and self.cutter.kinds is not None:
            if len(texts) > 1:
                return [ids for text in texts for ids in self.encode([text], most)]
            return [np.concatenate([self.encode([part], len(part))[0] for part in parts(texts[0], most)])]
        pieces, begins = self.cutter.split(texts)
        ids, ends = values(pieces, self.memo, "<u4")
        edges = ends[begins].tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def decode(self, ids: np.ndarray, part: int = 65_536) -> Iterator[tuple[bytes, str, bool]]:
        decoder = StreamDecoder(self.tokens)
        for at in range(0, max(1, len(ids)), part):
            raw, text = decoder.feed(ids[at : at + part].tolist(), at + part >= len(ids))
            yield raw, text, decoder.valid


def codec(path: str, pattern: str) -> Codec:
    return cached(("byte_bpe", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each document with the digests of its ids and of the bytes decoded from them."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        with no_cycles():
            for batch in batches:
                for rows in slices(batch, "text", 4 << 20):
                    out: list[list] = [[], [], [], []]
                    for ids in own.encode([text or "" for text in rows.column("text").to_pylist()]):
                        digest, valid = hashlib.sha256(), True
                        for raw, _, valid in own.decode(ids):
                            digest.update(raw)
                        for to, value in zip(out, (len(ids), hashlib.sha256(ids).hexdigest(), digest.hexdigest(), valid), strict=True):
                            to.append(value)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, out[:1]), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(part, ENCODED)
