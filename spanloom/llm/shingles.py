"""Word shingles of whole texts as sorted 64-bit hashes.

A-Z are lowered and words are runs of bytes other than white space (0x20, 0x09-0x0D). A text's set holds the distinct
sequences of five consecutive words; a text of fewer words has its whole sequence as its one element, and a text without
words has none.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE, _STEPS = _U(0x9E3779B97F4A7C15 | 1), tuple(_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which each input bit reaches all output bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each word: a polynomial of its bytes, 8 at a time, mixed."""
    size = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = size.astype(np.uint64) * _STEPS[4]
    at, left, rows = begin.copy(), size.copy(), np.arange(len(begin))
    while len(rows):
        part = np.ascontiguousarray(words[at]).view("<u8").ravel()
        short = left < 8
        keep = np.where(short, (_U(1) << (_U(8) * left.astype(np.uint64) * short)) - _U(1), _U(0xFFFFFFFFFFFFFFFF))
        out[rows] = mix(out[rows] * _BASE + (part & keep))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def sets(texts: list[bytes | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    joined = b" ".join(text.lower() if text else b"" for text in texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    gap = _SPACE[data]
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    begin, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    ends = np.cumsum([len(text or b"") + 1 for text in texts])
    hashes = _word_hashes(data, begin, end)
    last = np.searchsorted(begin, ends)
    whole = None
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        whole = hashes[:n] * _STEPS[0]
        for k in range(1, width):
            whole = mix(whole + hashes[k : k + n]) * _STEPS[k]
        whole = mix(whole)
    out, first = [], 0
    for stop in last.tolist():
        n = stop - first
        if n >= width:
            out.append(np.unique(whole[first : stop - width + 1]))
        elif n:
            value = np.array([n], np.uint64) * _STEPS[0]
            for k in range(first, stop):
                value = mix(value + hashes[k : k + 1]) * _STEPS[1]
            out.append(mix(value))
        else:
            out.append(np.empty(0, np.uint64))
        first = stop
    return out
