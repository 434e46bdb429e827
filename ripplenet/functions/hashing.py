"""Reproducible draws: every random choice is a pure function of its own labels.

A task that is re-run on another executor draws the same numbers again, and any SQL engine with md5 can check them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_int(*parts: Column | str, digits: int = 15) -> Column:
    """The first ``digits`` hex digits of md5 over the labels joined by ``|``, as BIGINT (15 digits are 60 bits)."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def draw_below(bound: Column | int, *parts: Column | str) -> Column:
    """An integer in ``0 .. bound-1``; with 60 bits the modulo bias is below bound / 2**60."""
    return F.pmod(hash_int(*parts), bound if isinstance(bound, Column) else F.lit(bound))


def uniform(*parts: Column | str) -> Column:
    """A double strictly between 0 and 1."""
    return (hash_int(*parts, digits=8) + F.lit(0.5)) / F.lit(4294967296.0)


# Constants of md5 (RFC 1321): what each step adds and by how many bits it turns, and the state it starts from.
_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)


def _block_heads(prefix: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """``numbered_heads`` of numbers of the same length: one block of md5 for all of them side by side."""
    length = len(prefix) + digits
    if length > 55:  # more than a block
        return np.array([int(hashlib.md5(prefix + b"%d" % n).hexdigest()[:15], 16) for n in numbers.tolist()], dtype=np.int64)
    text = prefix + bytes(digits) + b"\x80" + bytes(55 - length) + (8 * length).to_bytes(8, "little")
    # A word is one number where it is the same for all.
    words = [np.frombuffer(text, dtype="<u4")[i : i + 1].astype(np.uint32) for i in range(16)]
    for place in range(digits):
        at = length - 1 - place
        words[at // 4] = words[at // 4] | ((numbers // 10**place % 10 + 48).astype(np.uint32) << 8 * (at % 4))
    a, b, c, d = (_START[i : i + 1] for i in range(4))
    for i in range(64):
        if i < 16:
            mixed, word = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, word = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, word = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, word = c ^ (b | ~d), 7 * i % 16
        x = a + mixed + (words[word] + _ADDED[i : i + 1])
        a, d, c, b = d, c, b, b + (x << _TURNS[i] | x >> 32 - _TURNS[i])
    high, low = (a + _START[0:1]).byteswap(), (b + _START[1:2]).byteswap()
    return ((high.astype(np.uint64) << 32 | low) >> 4).astype(np.int64)


def numbered_heads(prefix: str, first: int, last: int) -> np.ndarray:
    """``hash_int`` of the labels in ``prefix``, which ends in ``|``, and each number from ``first`` (0 or more) to ``last``."""
    parts, text = [], prefix.encode()
    while first <= last:
        digits = len(str(first))
        upto = min(last, 10**digits - 1)
        parts.append(_block_heads(text, np.arange(first, upto + 1, dtype=np.int64), digits))
        first = upto + 1
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
