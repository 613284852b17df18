"""Words as several operators define them: runs of a-z, 0-9 and all non-ASCII letters.

A-Z is lower-cased first.  On UTF-8 bytes both steps are one table lookup per byte.
"""

from __future__ import annotations

_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets [start, end) of the words of a text, in order."""
    spans, start = [], -1
    for i, ch in enumerate(text):
        inside = ch >= "\x80" or ch.isalnum()
        if inside and start < 0:
            start = i
        elif not inside and start >= 0:
            spans.append((start, i))
            start = -1
    if start >= 0:
        spans.append((start, len(text)))
    return spans
