"""Configuration that is read again when it is old, on the driver of a stream."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Hashable
from typing import Generic, TypeVar

V = TypeVar("V")


class Refreshed(Generic[V]):
    """Values of ``load(key)``, each good for ``seconds`` from when it was loaded. A ``foreachBatch`` function asks for
    the rules, terms or profile of a batch here, so a change reaches a running stream within that time. One key is
    loaded once at a time; an error of ``load`` is raised and nothing is kept."""

    def __init__(self, load: Callable[[Hashable], V], seconds: float = 300, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock = load, seconds, clock
        self.values: dict[Hashable, tuple[float, V]] = {}
        self.locks: dict[Hashable, threading.Lock] = {}
        self.lock = threading.Lock()

    def _good(self, key: Hashable) -> bool:
        return key in self.values and self.clock() - self.values[key][0] < self.seconds

    def get(self, key: Hashable) -> V:
        if not self._good(key):
            with self.lock:
                own = self.locks.setdefault(key, threading.Lock())
            with own:
                if not self._good(key):
                    self.values[key] = self.clock(), self.load(key)
        return self.values[key][1]

    def drop(self, key: Hashable) -> None:
        self.values.pop(key, None)
