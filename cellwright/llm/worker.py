"""What a Python worker keeps between tasks: one cache at a time, given up when tasks of another operator begin."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[Any, Any] = {}


def keep(key: Any, make: Callable[[], Any]) -> Any:
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Memory goes back to the system, too: an executor's workers share its limit with the JVM."""
    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
