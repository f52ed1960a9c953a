"""Cutting texts into chunks that tokenizers treat independently, and a bounded memo of their encodings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: A space followed by white space or by the end: there, a plain split at spaces is not a boundary of pre-tokens.
ODD_SPACE = re.compile(r" (?:\s|\Z)")
BEFORE_WORD = re.compile(r" (?=\S)")


def space_chunks(text: str) -> list[str]:
    """Consecutive pieces of ``text``, cut before each space that a word follows.

    The byte-level pattern takes a space only as the first character of a word
    or in a run of white space that ends before the last one, so every such
    place is a boundary of its matches and each piece has the matches that it
    has inside the text.
    """
    if not text:
        return []
    parts = BEFORE_WORD.split(text) if ODD_SPACE.search(text) else text.split(" ")
    chunks = [" " + p for p in parts]
    chunks[0] = parts[0]
    if not chunks[0]:
        del chunks[0]
    return chunks


class Memo:
    """Encodings by chunk in two generations of at most ``limit`` entries each.

    When the young generation is full, it becomes the old one; an entry that is
    asked for again moves back. Forgetting costs time only: what is missing is encoded
    again.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable], limit: int = 400_000, step: int = 20_000):
        self.encode_many, self.limit, self.step = encode_many, limit, step
        self.young: dict = {}
        self.old: dict = {}

    def forget(self) -> None:
        """Free what is held; Python workers outlive their tasks."""
        self.young, self.old = {}, {}

    def fill(self, chunks: set) -> dict:
        """A dictionary that has all of ``chunks``; it holds until the next call."""
        young = self.young
        missing = [c for c in chunks if c not in young]
        if missing:
            if len(self.young) + len(missing) > self.limit:
                self.old, self.young = self.young, {}
                missing = chunks
            known = {c: self.old[c] for c in missing if c in self.old}
            self.young.update(known)
            rest = [c for c in missing if c not in known]
            for at in range(0, len(rest), self.step):
                part = rest[at : at + self.step]
                self.young.update(zip(part, self.encode_many(part), strict=True))
        return self.young


def batches_of(texts: Iterable[str], size: int = 2 << 20) -> Iterable[list[str]]:
    """``texts`` in lists of about ``size`` characters (a longer text stands alone)."""
    part, chars = [], 0
    for text in texts:
        if part and chars + len(text) > size:
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text)
    if part:
        yield part
