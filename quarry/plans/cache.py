"""A bounded cache of results in the driver's memory."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class TTLCache:
    """Keeps `most` entries, those used last, for `seconds` each; safe to share among threads."""

    def __init__(self, most: int = 128, seconds: float = 900, clock: Callable[[], float] = time.monotonic):
        if most < 1 or seconds < 1:
            raise ValueError("a cache keeps one entry for one second at least")
        self.most, self.seconds, self.clock = most, seconds, clock
        self._held: dict[str, tuple[float, object]] = {}  # in the order of use
        self._lock = threading.RLock()

    def get(self, key: str) -> object | None:
        """The value, null if there is none or its time is over."""
        with self._lock:
            held = self._held.pop(key, None)
            if held is None or held[0] <= self.clock():
                return None
            self._held[key] = held
            return held[1]

    def set(self, key: str, value: object) -> None:
        with self._lock:
            self._held.pop(key, None)
            self._held[key] = (self.clock() + self.seconds, value)
            while len(self._held) > self.most:
                del self._held[next(iter(self._held))]

    def clear(self) -> None:
        with self._lock:
            self._held.clear()

    def __len__(self) -> int:
        with self._lock:
            return len(self._held)
