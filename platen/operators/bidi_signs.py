"""Character classes shared by the page kernels."""

from __future__ import annotations

# Ranges of Arabic combining marks.
ARABIC_MARKS = ((0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x06DF, 0x06E4), (0x06E7, 0x06E8), (0x06EA, 0x06ED))


def is_arabic_mark_text(text: str) -> bool:
    return bool(text) and all(any(a <= ord(c) <= b for a, b in ARABIC_MARKS) for c in text)
