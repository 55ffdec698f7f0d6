"""A bounded table of what a tokenizer made of each distinct chunk."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class ChunkTable:
    """chunk -> value in two generations: full, the young one becomes the old one, and what is met again moves back.

    Memory is bounded by 2 * limit entries; a chunk longer than longest is never kept, so values are
    right at any size and only repeated work changes.
    """

    def __init__(self, compute: Callable[[list], list], limit: int = 250_000, longest: int = 80) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.compute, self.limit, self.longest = compute, limit, longest

    def load(self, chunks: set) -> dict[Any, Any]:
        """A mapping that holds every one of chunks."""
        missing = chunks.difference(self.young)
        if missing:
            if len(self.young) + len(missing) > self.limit:
                self.old, self.young = self.young, {}
                missing = chunks
            if self.old:
                again = missing & self.old.keys()
                self.young.update((c, self.old[c]) for c in again)
                missing = missing - again
            fresh = list(missing)
            made = dict(zip(fresh, self.compute(fresh))) if fresh else {}
            long = [c for c in fresh if len(c) > self.longest]
            if long:
                some = {c: made.pop(c) for c in long}
                self.young.update(made)
                return {**{c: self.young[c] for c in chunks if c not in some}, **some}
            self.young.update(made)
        return self.young
