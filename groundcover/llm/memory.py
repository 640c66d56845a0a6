"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def given_back() -> None:
    """Returns what the allocators hold but do not use to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A generator over batches that gives memory back when it ends."""
    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            given_back()

    return wrapped
