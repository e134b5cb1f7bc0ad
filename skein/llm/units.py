"""Texts cut into units that tokenizers code independently, so that each different unit is coded once.

A unit is a run of text that begins with one space or line feed and a character that isn't white space, and ends before the
next such place. Neither the words of a byte-level pattern nor pieces that begin with their space cross such a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Text bytes whose new units are learned at once.
CHUNK_BYTES = 4 << 20
#: Words that stay remembered when a worker's memory, of twice as many, is full.
KNOWN = 150_000


def runs(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """(row, texts from there on) in runs of about ``most`` bytes; a null is an empty text."""
    run: list[str] = []
    begin = size = 0
    for k, t in enumerate(texts):
        text = t.as_py() or b""
        run.append(text.decode("utf-8", "replace"))
        size += len(text)
        if size >= most:
            yield begin, run
            begin, run, size = k + 1, [], 0
    if run:
        yield begin, run


def plain(unit: str) -> bool:
    """Whether there is no white space beside a unit's space or line feed, or at its end."""
    return len(unit) > 1 and not unit[1].isspace() and not unit[-1].isspace()
