"""A bounded memory of what a service has read lately."""

from __future__ import annotations

import threading
from collections.abc import Hashable, Iterable


class Memo:
    """Values by key, up to ``most`` bytes in all: the longest unused go first.  A value larger than that is not kept."""

    def __init__(self, most: int):
        self.most, self.size, self.rows, self.lock = most, 0, {}, threading.Lock()

    def found(self, keys: Iterable[Hashable]) -> dict:
        """What is held of the keys, which then counts as just used."""
        with self.lock:
            out = {}
            for k in keys:
                if k in self.rows:
                    self.rows[k] = self.rows.pop(k)
                    out[k] = self.rows[k][0]
            return out

    def put(self, key: Hashable, value, size: int) -> None:
        with self.lock:
            if key in self.rows:
                self.size -= self.rows.pop(key)[1]
            if size > self.most:
                return
            self.rows[key] = (value, size)
            self.size += size
            while self.size > self.most:
                self.size -= self.rows.pop(next(iter(self.rows)))[1]
