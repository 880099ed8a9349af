"""Helpers of the Arrow-based operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

_HOME = "_spanloom_worker_cache"


def cached(key, build: Callable):
    """A value kept for the life of the Python worker, so that reused workers build tokenizers and automata once. Only the
    last one is kept: what an earlier stage built would only take memory from this one."""
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME)).__dict__.setdefault("values", {})
    if key not in home:
        forget()
        home[key] = build()
    return home[key]


def forget() -> None:
    """Drops what ``cached`` holds and gives back what the allocators keep, for stages that need the memory for themselves."""
    sys.modules.setdefault(_HOME, types.ModuleType(_HOME)).__dict__.setdefault("values", {}).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores behind it until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextlib.contextmanager
def no_cycles():
    """Large tables that hold no reference cycles are not walked in search of some while this lasts."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about most_bytes of the text column; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
