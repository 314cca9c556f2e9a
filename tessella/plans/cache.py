"""Results of graph statements, kept until an edge of their table changes."""

from __future__ import annotations

from collections import OrderedDict
from typing import Any

CAPACITY = 5000
MOST_BYTES = 1 << 30


class ResultCache:
    """Least recently used entries go first; an entry of an older version of its table is never found."""

    def __init__(self, capacity: int = CAPACITY, most_bytes: int = MOST_BYTES):
        self.capacity, self.most_bytes, self.bytes = capacity, most_bytes, 0
        self.entries: OrderedDict[Any, tuple[int, Any, int]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Any, version: int) -> Any:
        found = self.entries.get(key)
        if found is None or found[0] != version:
            if found is not None:
                self._drop(key)
            self.misses += 1
            return None
        self.entries.move_to_end(key)
        self.hits += 1
        return found[1]

    def put(self, key: Any, version: int, value: Any, size: int) -> None:
        """version is that from before the computation: what was written meanwhile makes the entry stale."""
        if key in self.entries:
            self._drop(key)
        if size > self.most_bytes or self.capacity < 1:
            return
        self.entries[key] = (version, value, size)
        self.bytes += size
        while len(self.entries) > self.capacity or self.bytes > self.most_bytes:
            self._drop(next(iter(self.entries)))

    def _drop(self, key: Any) -> None:
        self.bytes -= self.entries.pop(key)[2]
