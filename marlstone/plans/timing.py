"""Seconds of the stages of a run."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class Stages:
    """Adds up what each named stage took; a stage may come several times."""

    def __init__(self) -> None:
        self.began, self.taken = time.monotonic(), {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        at = time.monotonic()
        try:
            yield
        finally:
            self.taken[name] = self.taken.get(name, 0.0) + time.monotonic() - at

    def seconds(self) -> dict[str, float]:
        """Seconds by stage and in all, to the millisecond."""
        return {name: round(s, 3) for name, s in self.taken.items()} | {"total": round(time.monotonic() - self.began, 3)}
