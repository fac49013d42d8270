"""Compatibility composition of text (form KC), by the character database of the running Python.

Bytes that are no UTF-8 stay as they are.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Blocks of the characters that the tests take one by one; so with the pairs.
BLOCKS = (range(0, 0x3400), range(0xF900, 0x10000))


@lru_cache(maxsize=1)
def _pairs() -> dict[str, str]:
    """Two characters in a row, and the one they compose to."""
    found = {}
    for code in range(0xA0, 0x10000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == chr(code):
                found[pair] = chr(code)
    return found


def _form(text: bytes) -> bytes:
    return unicodedata.normalize("NFKC", text.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


@F.arrow_udf(BinaryType())
def _forms(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t if t.isascii() else _form(t) for t in texts.to_pylist()], pa.binary())


def composed(col: Column) -> Column:
    """Form KC of a text; null for null."""
    return _forms(col.cast("binary")).cast("string")
