"""Calls that are tried again."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


def retried(action: Callable[[], T], attempts: int, pause: float, sleep: Callable[[float], None], retry_on: Callable[[Exception], bool] = lambda e: True, say: Callable[[str], None] = lambda text: None) -> T:
    """What action returns; an error for which retry_on holds lets it run again,
    after a pause that grows by `pause` each time. The last error is raised."""
    failed = 0
    while True:
        try:
            return action()
        except Exception as e:
            failed += 1
            if failed >= attempts or not retry_on(e):
                raise
            say(f"{e}; attempt {failed + 1} in {pause * failed:.1f} s")
            sleep(pause * failed)
