"""Terms of whole texts as bytes: only A-Z lower-cased, ASCII outside a set of signs parts them.

Every byte of a character beyond ASCII belongs to terms, so cutting bytes cuts characters alike.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pyarrow as pa

LETTERS = string.ascii_letters
LETTERS_DIGITS = string.ascii_letters + string.digits


def cutter(signs: str) -> Callable[[bytes], list[bytes]]:
    """A function from UTF-8 text to its terms: runs of `signs` and of characters beyond ASCII."""
    kept = set(signs.encode())
    table = bytes((i + 32 if 65 <= i <= 90 else i) if i in kept or i > 127 else 32 for i in range(256))
    return lambda data: data.translate(table).split()


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    for text in column.cast(pa.large_binary()):
        yield text.as_py() or b""
