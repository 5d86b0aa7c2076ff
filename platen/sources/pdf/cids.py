"""Texts of the numbers of Adobe's public character collections, as far as they follow national standards in order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

#: By collection, the codec of its standard, ranges of lead bytes with the first number, how many there are, and codes left out.
ORDERS = {
    "Japan1": ("euc_jp", ((0xA1, 0xA7, 633, 492), (0xB0, 0xF4, 1125, 6353)), {0xF4A5, 0xF4A6}),
    "Korea1": ("euc_kr", ((0xA1, 0xAC, 101, 985), (0xB0, 0xC8, 1086, 2350), (0xCA, 0xFD, 3436, 4888)), {0xA2E6, 0xA2E7, 0xA2E8}),
    "CNS1": ("big5", ((0xA4, 0xC6, 595, 5401), (0xC9, 0xF9, 5996, 7650)), {0xC94A, 0xDDFC}),
}
#: Where the collections' Latin letters begin, and the signs that stand in place of ASCII ones.
LATIN = {"Japan1": ((1, {0x5C: "¥", 0x7E: "‾"}), (231, {0x5C: "¥", 0x7E: "‾"})), "Korea1": ((1, {0x5C: "₩"}), (8094, {0x5C: "₩"})), "CNS1": ((1, {}), (13648, {}))}
#: Fixed value: the first of Japan1's half-width Katakana.
HALF_WIDTH = 327


def _codes(codec: str, first: int, last: int, without: set[int]) -> Iterator[str]:
    """Signs of two-byte codes in order."""
    trails = (*range(0x40, 0x7F), *range(0xA1, 0xFF)) if codec == "big5" else range(0xA1, 0xFF)
    for lead in range(first, last + 1):
        for trail in trails:
            if lead << 8 | trail in without:
                continue
            try:
                yield bytes((lead, trail)).decode(codec)
            except UnicodeDecodeError:
                continue


@lru_cache(maxsize=4)
def texts(ordering: str) -> dict[int, str]:
    """Text by number; none for a collection that is not known."""
    out: dict[int, str] = {}
    for start, other in LATIN.get(ordering, ()):
        out |= {start + i: other.get(32 + i, chr(32 + i)) for i in range(95)}
    if ordering == "Japan1":
        out |= {HALF_WIDTH + i: chr(0xFF61 + i) for i in range(63)}
    if ordering in ORDERS:
        codec, ranges, without = ORDERS[ordering]
        for first, last, start, count in ranges:
            for i, sign in zip(range(count), _codes(codec, first, last, without), strict=False):
                out[start + i] = sign
    return out
