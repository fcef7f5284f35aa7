"""Values that a task remembers for words it has met, in bounded memory."""

from __future__ import annotations

WORDS, LENGTH = 400_000, 64


class Remembered(dict):
    """``self[word]`` is ``make(word)``, made once while it is remembered; speed only, never a different value.

    Words up to LENGTH are kept in two generations of WORDS entries: a full one becomes the old one, and words that
    are met again return from there.
    """

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def make(self, word):
        raise NotImplementedError

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > LENGTH:
                return value
        if len(self) >= WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value
