"""Giving freed memory back to the system between groups: allocators keep it, and two workers share an executor."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def trimmed(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``task``, and its memory given back once it has ended: a worker that waits for its next task would keep it."""

    def run(*args) -> Iterator:
        yield from task(*args)
        release()

    return run
