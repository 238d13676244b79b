"""Token ids of whole texts from remembered ids of what stands between their spaces.

A tokenizer whose pattern lets a piece begin with one space, and ends letters, digits
and signs at white space, cuts a text before each single space. So a text's ids are
those of its first stretch up to a space, then those of each further stretch with its
space, and a stretch met before need not be encoded again. That does not hold at a
space with white space on both sides, or at the end after other white space; texts with
one are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: Stretches in the newer half of a cache; when it is full it becomes the older half, whose
#: entries go unless they are met again. Longer stretches are never remembered.
REMEMBERED = 400_000
LONGEST = 64
_BROKEN = re.compile(r"\s (?:\s|\Z)")


class ChunkCache(dict):
    """Bytes of a stretch's ids (unsigned 32-bit, little-endian), made when first asked for."""

    def __init__(self, encode: Callable[[str], bytes], before: str):
        super().__init__()
        self.encode, self.before = encode, before
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.encode(self.before + part)
        if len(part) <= LONGEST:
            self.remember({part: ids})
        return ids

    def remember(self, more: dict[str, bytes]) -> None:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self.update(more)


class TextEncoder:
    """Ids of whole texts; ``encode`` gives those of a string without any memory.

    ``whole`` are strings that may not be cut from their surroundings, such as special
    tokens. ``encode_many``, if given, encodes a list of strings at once.
    """

    def __init__(
        self,
        encode: Callable[[str], bytes],
        whole: Iterable[str] = (),
        encode_many: Callable[[list[str]], list[bytes]] | None = None,
    ):
        self.encode, self.whole, self.encode_many = encode, tuple(whole), encode_many
        self.first, self.rest = ChunkCache(encode, ""), ChunkCache(encode, " ")

    def __call__(self, text: str) -> bytes:
        if _BROKEN.search(text) or any(w in text for w in self.whole):
            return self.encode(text)
        first, *rest = text.split(" ")
        if self.encode_many:
            self._prepare(set(rest))
        return self.first[first] + b"".join(map(self.rest.__getitem__, rest))

    def _prepare(self, parts: set[str]) -> None:
        known, older = self.rest, self.rest.older
        new = [p for p in parts if p not in known and p not in older and len(p) <= LONGEST]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.rest.remember(dict(zip(some, self.encode_many([" " + p for p in some]))))
