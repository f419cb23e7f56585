"""What a process remembers between tasks.

Functions travel by value, with the globals of their modules, so a global of
this package begins anew with each task and everything in it would be sent. What
is kept here stays in the process and is never sent.
"""

import ctypes
import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any

import pyarrow as pa

_NAME = "procsight_memory"


def remembered(name: str) -> dict:
    """The process's own dictionary of that name."""
    return vars(sys.modules.setdefault(_NAME, ModuleType(_NAME))).setdefault(name, {})


def give_back() -> None:
    """Return to the system what earlier batches took: Arrow and malloc keep it, but workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def once(name: str, key: Any, make: Callable[[], Any]) -> Any:
    """What `make` gave for this name and key; only the latest of all is kept, so that one job's tables don't burden the next."""
    latest = remembered("latest")
    if (name, key) not in latest:
        latest.clear()
        latest[name, key] = make()
    return latest[name, key]
