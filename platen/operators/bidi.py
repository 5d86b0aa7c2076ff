"""Directions of characters after the Unicode bidirectional algorithm, line by line."""

from __future__ import annotations

import unicodedata

from platen.operators.bidi_signs import is_arabic_mark_text

__all__ = ["is_arabic_mark_text", "levels", "mark_directions"]


def levels(text: str, base: int | None = None) -> list[int]:
    """Embedding levels of a line without explicit formatting characters (rules W1 to W7, N1, N2, I1, I2); base None: by the first strong character."""
    kinds = [unicodedata.bidirectional(c) or "L" for c in text]
    if base is None:
        base = next((int(k in ("R", "AL")) for k in kinds if k in ("L", "R", "AL")), 0)
    edge = "R" if base else "L"
    last = edge
    for i, k in enumerate(kinds):
        if k == "NSM":
            kinds[i] = kinds[i - 1] if i else edge
    for i, k in enumerate(kinds):
        if k in ("L", "R", "AL"):
            last = k
        elif k == "EN" and last == "AL":
            kinds[i] = "AN"
    kinds = ["R" if k == "AL" else k for k in kinds]
    for i in range(1, len(kinds) - 1):
        if kinds[i] in ("ES", "CS") and kinds[i - 1] == kinds[i + 1] == "EN":
            kinds[i] = "EN"
        elif kinds[i] == "CS" and kinds[i - 1] == kinds[i + 1] == "AN":
            kinds[i] = "AN"
    i = 0
    while i < len(kinds):
        j = i
        while j < len(kinds) and kinds[j] == "ET":
            j += 1
        if j > i and ((i and kinds[i - 1] == "EN") or (j < len(kinds) and kinds[j] == "EN")):
            kinds[i:j] = ["EN"] * (j - i)
        i = max(j, i + 1)
    kinds = ["ON" if k in ("ES", "ET", "CS", "B", "S", "WS", "BN") else k for k in kinds]
    last = edge
    for i, k in enumerate(kinds):
        if k in ("L", "R"):
            last = k
        elif k == "EN" and last == "L":
            kinds[i] = "L"
    i = 0
    side = lambda k: "R" if k in ("R", "EN", "AN") else "L"
    while i < len(kinds):
        j = i
        while j < len(kinds) and kinds[j] not in ("L", "R", "EN", "AN"):
            j += 1
        if j > i:
            a = side(kinds[i - 1]) if i else edge
            b = side(kinds[j]) if j < len(kinds) else edge
            kinds[i:j] = [a if a == b else edge] * (j - i)
        i = max(j, i + 1)
    out = []
    for k in kinds:
        up = {"R": 1, "AN": 2, "EN": 2}.get(k, 0) if base % 2 == 0 else {"L": 1, "AN": 1, "EN": 1}.get(k, 0)
        out.append(base + up)
    return out


def mark_directions(chars: list[dict], tolerance: float = 3.0) -> list[dict]:
    """Sets rtl on upright characters of odd level; a page without right-to-left letters is left alone."""
    if not any(unicodedata.bidirectional(ch) in ("R", "AL") for c in chars for ch in c["text"]):
        return chars
    lines: list[list[dict]] = []
    for c in sorted((c for c in chars if c["upright"] and c["direction"] in ("ltr", "rtl")), key=lambda c: c["top"]):
        if lines and abs(c["top"] - lines[-1][0]["top"]) <= tolerance:
            lines[-1].append(c)
        else:
            lines.append([c])
    for line in lines:
        line.sort(key=lambda c: c["x0"])
        signs = [(ch, c) for c in line for ch in c["text"]]
        for (_, c), level in zip(signs, levels("".join(ch for ch, _ in signs)), strict=True):
            if level % 2:
                c["direction"] = "rtl"
    return chars
