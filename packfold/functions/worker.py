"""What a Python worker loads once and keeps for all later tasks.

The functions that Spark sends to a worker are unpickled anew for every task, and with them
any cache they carry. This module is imported, so its cache lives as long as the process.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_kept: dict[str, Any] = {}


def kept(key: str, load: Callable[[], Any]) -> Any:
    """``load()`` of the first call with this key in this process."""
    if key not in _kept:
        _kept[key] = load()
    return _kept[key]
