"""Terms of texts as bytes: runs of letters (and digits, if asked for) and of all characters beyond ASCII, A-Z in lower case.

A text is UTF-8, in which such runs end at single bytes, so one translation and
one split find them, whatever else the bytes hold.
"""

from __future__ import annotations

from collections.abc import Callable


def splitter(digits: bool) -> Callable[[bytes | None], list[bytes]]:
    """A function from a text (None: no terms) to its terms."""
    to = bytearray(b" " * 128) + bytes(range(128, 256))
    for c in range(26):
        to[65 + c] = to[97 + c] = 97 + c
    if digits:
        to[48:58] = b"0123456789"
    table = bytes(to)
    return lambda text: text.translate(table).split() if text else []
