"""Classes of equal windows by interval expansion on a Burrows-Wheeler transform.

The suffixes of a text are sorted as far as the window length needs. From the whole range on, every interval of suffixes
with a common prefix w is extended backwards by each symbol c before it, which gives the interval of cw; the boundary
behind an interval that nothing set before gets the length of the common prefix. Working breadth first, these lengths
come in increasing order, so the expansion stops at the window length: boundaries still unset then separate suffixes that
agree over a window. The work for each boundary is done once.
"""

from __future__ import annotations

import numpy as np


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), bool)
    new[0] = True
    ordered = keys[order]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return order, ranks, int(new.sum())


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the cyclic suffixes, sorted by their first depth symbols at least, equal ones by start."""
    n = len(text)
    keys = np.zeros(n, np.uint64)
    for k in range(4):
        keys = (keys << np.uint64(16)) | np.roll(text, -k).astype(np.uint64)
    order, ranks, distinct = _ranks(keys)
    length = 4
    while length < depth and distinct < n:
        order, ranks, distinct = _ranks((ranks.astype(np.uint64) << np.uint64(32)) | np.roll(ranks, -length).astype(np.uint64))
        length *= 2
    return order


def shared_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each of its places whether the suffix there shares ``least`` symbols with the one before."""
    n = len(text)
    order = suffix_order(text, least + 1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = place[(order - 1) % n]  # of each suffix, the place of the one a symbol longer
    before = text[(order - 1) % n]  # the transform
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        if not len(low):
            break
        size = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(low)), size)
        symbols, to = before[at], back[at]
        if len(low) < len(at):
            key = np.argsort((owner.astype(np.uint64) << np.uint64(16)) | symbols.astype(np.uint64), kind="stable")
            owner, symbols, to = owner[key], symbols[key], to[key]
            cut = np.concatenate([[0], np.nonzero((owner[1:] != owner[:-1]) | (symbols[1:] != symbols[:-1]))[0] + 1])
            low, high = np.minimum.reduceat(to, cut), np.maximum.reduceat(to, cut) + 1
        else:
            low, high = to, to + 1
        fresh = unset[high]
        low, high = low[fresh], high[fresh]
        unset[high] = False
        if len(high) > 1:  # intervals of one length are disjoint, so each boundary comes from one of them
            order_ = np.argsort(high, kind="stable")
            low, high = low[order_], high[order_]
    return order, unset[:n]


def window_classes(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string a class number for each of its windows; windows are of one class exactly if they are equal."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]), np.uint16)
    begins = ends - sizes - 1
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    order, same = shared_prefixes(text, width)
    classes = np.empty(len(text), np.int64)
    classes[order] = np.cumsum(~same)
    return [classes[b : b + max(0, n - width + 1)] for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
