"""Lower-cased words of a text's UTF-8 bytes, and where they stand in the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Digits, small letters and every byte of a character beyond ASCII belong to words; A-Z become a-z; all else separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
# A longer text is cut into slices of about so many bytes, between words, which bounds the list of its words.
SLICE_BYTES = 1 << 20


def word_lists(data: bytes, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, in lists that stand for about ``limit`` bytes each."""
    data = data.translate(_WORD_BYTES)
    first, n = 0, len(data)
    while first < n:
        last = n
        if n - first > limit:
            last = data.rfind(b" ", first, first + limit)
            if last < 0:
                last = data.find(b" ", first + limit)
                last = n if last < 0 else last
        yield data[first:last].split()
        first = last + 1


def word_places(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of each word of ``text``."""
    return [m.span() for m in _WORD.finditer(text)]
