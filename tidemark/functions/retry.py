"""Retries for live sources (plain Python, driver side)."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
TRANSIENT = frozenset({429, 500, 502, 503, 504})


class Permanent(RuntimeError):
    """Another try would not help."""


def retried(call: Callable[[], tuple[int, T]], attempts: int = 5, base_s: float = 1.0, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> T:
    """call gives (status, result). Transient statuses and connection errors are tried again after a doubling, jittered wait; other failures are permanent."""
    rng = rng or random.Random()
    for n in range(attempts):
        try:
            status, result = call()
        except (ConnectionError, TimeoutError) as e:
            status, result, why = None, None, e
        else:
            if status < 400:
                return result
            if status not in TRANSIENT:
                raise Permanent(f"status {status}")
            why = RuntimeError(f"status {status}")
        if n + 1 == attempts:
            raise why
        sleep(base_s * 2**n * (0.5 + rng.random() / 2))
    raise AssertionError("no attempt")
