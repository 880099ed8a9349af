"""Pieces of many texts at once: cut with NumPy over the joined characters, told apart by Arrow, looked up once each."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: The pattern whose matches ``Cutter`` finds without a regular expression; it is the usual one of byte-level BPE.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, SPACE = 1, 2, 3
_SAFE = re.compile(r"[!-~] (?=[!-~])")

_BLANK, _PUNCT, _ALNUM = (np.zeros(256, bool) for _ in range(3))
_BLANK[[*range(9, 14), 32]] = True
_PUNCT[list(string.punctuation.encode())] = True
_ALNUM[list((string.ascii_letters + string.digits).encode())] = True


def parts(text: str, most: int) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut before single spaces between visible ASCII characters only."""
    at = 0
    while len(text) - at > most and (found := _SAFE.search(text, at + most)):
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:] if at else text


def _strings(starts: np.ndarray, data: np.ndarray | bytes) -> pa.StringArray:
    """Strings that begin at ``starts`` and fill data; bytes before the first are none's."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))


class Cutter:
    """split(texts) gives the matches of a pattern in all texts as one Arrow array, and where each text's begin in it."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.kinds = None
        if pattern == USUAL:
            self.kinds = np.zeros(0x110000, np.uint8)
            every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
            for kind, of in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
                for found in regex.finditer(of, every):
                    self.kinds[ord(every[found.start()]) : ord(every[found.end() - 1]) + 1] = kind

    def split(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        if self.kinds is None:
            found = [self.find(text) for text in texts]
            return pa.array(chain.from_iterable(found), pa.string()), np.cumsum([0, *map(len, found)])
        joined = "".join(texts)
        begins = np.cumsum([0, *map(len, texts)])
        if not joined:
            return pa.array([], pa.string()), begins
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cuts = np.flatnonzero(self._cuts(points, begins))
        data = joined.encode()
        if len(data) == len(points):
            starts = cuts
        else:
            raw = np.frombuffer(data, np.uint8)
            starts = np.flatnonzero((raw & 0xC0) != 0x80)[cuts]
        return _strings(starts, data), np.searchsorted(cuts, begins)

    def _cuts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Whether a match of USUAL begins at each character.

        Of white space before something visible, the last character begins a match, and that match goes on to the visible
        ones if it is a plain space. White space at a text's end is one match. Else matches change with the kind.
        """
        n, first = len(points), np.zeros(len(points) + 1, bool)
        first[begins] = True
        kinds = self.kinds[points]
        space, plain = kinds == SPACE, points == 32
        cut = first[:n].copy()
        changes, before_visible = kinds[1:] != kinds[:-1], np.append(~space[1:], False) & ~first[1:]
        cut[1:] |= changes & ~plain[:-1]  # after a plain space only what comes below, or another kind of space
        cut[1:] |= space[1:] & space[:-1] & before_visible[1:]
        # An apostrophe that begins a match takes some endings with it.
        marks = np.flatnonzero((points == 39) & cut)
        if len(marks):
            after = np.concatenate((points, np.zeros(3, points.dtype)))
            one, two = after[marks + 1], after[marks + 2]
            ended = np.concatenate((first, np.ones(3, bool)))
            short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32)) & ~ended[marks + 1]
            long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~ended[marks + 1] & ~ended[marks + 2]
            for which, length in ((short, 2), (long, 3)):
                at = marks[which]
                cut[at + 1] = False
                cut[(at + length)[at + length < n]] = True
        return cut


def words(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The words between ASCII white space, those of all texts in one array, and where each text's begin in it. A run of
    ASCII punctuation that ends a word and follows an ASCII letter or digit is a word of its own."""
    data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    blank, punct = _BLANK[data], _PUNCT[data]
    start = ~blank
    start[1:] &= blank[:-1]
    edges = np.flatnonzero(np.diff(punct, prepend=False))  # data ends with a line break, so runs come in pairs
    runs, ends = edges[::2], edges[1::2]
    tails = runs[blank[ends] & (runs > 0)]
    start[tails[_ALNUM[data[tails - 1]]]] = True
    visible = ~blank
    place = np.cumsum(visible) - visible
    lines = np.cumsum([0, *(len(text) + 1 if text.isascii() else len(text.encode()) + 1 for text in texts)])
    at = np.flatnonzero(start)
    return _strings(place[at], data[visible]), np.searchsorted(at, lines)


class Memo:
    """What ``learn`` gives for strings, looked up by lists of different ones. Two generations of ``most`` entries are kept;
    what is asked for again moves to the younger. Strings over 48 characters are learned anew."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], most: int):
        self.learn, self.most = learn, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, strings: list[str]) -> list[bytes]:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, strings))
        missing = [one for one, value in zip(strings, found, strict=True) if value is None]
        if not missing:
            return found
        old = self.old
        got = {one: value for one in missing if (value := old.get(one)) is not None}
        fresh = [one for one in missing if one not in got]
        got.update(zip(fresh, self.learn(fresh), strict=True))
        self.young.update((one, value) for one, value in got.items() if len(one) <= 48)
        return [got[one] if value is None else value for one, value in zip(strings, found, strict=True)]


def values(pieces: pa.StringArray, memo: Memo, form: str) -> tuple[np.ndarray, np.ndarray]:
    """What the memo gives for the pieces, one after the other, as an array, and where each piece's begin in it."""
    told = pieces.dictionary_encode()
    found = memo.get(told.dictionary.to_pylist())
    pool, which = np.frombuffer(b"".join(found), form), told.indices.to_numpy()
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // pool.itemsize
    counts = sizes[which]
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    return pool[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], counts)], ends
