"""Cutting a batch of texts into parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: Characters that are worked on at once, whatever the number of texts.
MOST_CHARS = 4_000_000


def parts(texts: list[str | None], rows: int, chars: int = MOST_CHARS) -> Iterator[slice]:
    """Slices that cover all texts in order: at most `rows` texts each, and at most
    `chars` characters unless a single text has more."""
    start = total = 0
    for n, t in enumerate(texts):
        size = len(t) if isinstance(t, str) else 0
        if n > start and (n - start >= rows or total + size > chars):
            yield slice(start, n)
            start, total = n, 0
        total += size
    if start < len(texts):
        yield slice(start, len(texts))
