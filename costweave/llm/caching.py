"""What a worker keeps between batches and tasks: one operator's tool at a time, with a bounded memory of words."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Bytes of a generation of remembered words, and what an entry takes beside its word and its value.
KEPT_BYTES = 75_000_000
ENTRY_BYTES = 200
#: Longer words are worked out for their batch only: they hardly come again, and text without blanks is full of them.
LONGEST_KEPT = 200

_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """The tool of this key. A worker that turns to another operator lets go of the one it had, with its memory."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


class RecentWords:
    """Two generations of about ``limit`` bytes each; words of the older one are carried over when they come again.
    ``prepare`` makes every word of a batch present, working out the missing ones in one call."""

    def __init__(self, work_out: Callable[[list[str]], Iterable], limit: int = KEPT_BYTES):
        self.work_out, self.limit = work_out, limit
        self.new: dict = {}
        self.old: dict = {}
        self.size = 0
        self.passing: list[str] = []

    def keep(self, found: dict) -> None:
        self.new.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)
        self.passing.extend(w for w in found if len(w) > LONGEST_KEPT)

    def prepare(self, words: set[str]) -> dict:
        for word in self.passing:
            value = self.new.pop(word, None)
            self.size -= 0 if value is None else len(word) + len(value) + ENTRY_BYTES
        self.passing = []
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        missing = words.difference(self.new)
        if missing:
            old = self.old
            known = {w: old[w] for w in missing if w in old} if old else {}
            self.keep(known)
            todo = [w for w in missing if w not in known] if known else list(missing)
            if todo:
                self.keep(dict(zip(todo, self.work_out(todo))))
        return self.new


def in_pieces(texts: list[str], characters: int) -> Iterable[tuple[int, int]]:
    """Ranges of whole texts, each of about so many characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= characters:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
