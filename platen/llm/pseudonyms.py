"""PII: format-preserving pseudonyms by keyed Feistel permutations.

Each kind of value is validated (check digits, calendar, ranges) and mapped by a
permutation of all values of its format under a key, so the same value gets the
same pseudonym in every document, two values never share one, and the result is
again valid: separators, lengths and check digits hold.
"""

from __future__ import annotations

import hmac
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.common import blocks

ROUNDS = 10
KEY = b"platen example key"
BLOCK_BYTES = 4 << 20
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1
_LOWER = "0123456789abcdefghijklmnopqrstuvwxyz"
_IBAN_SIGNS = {
    c: int(n)
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Least and most digits after the country code, where they are other than 6 and what 15 leave.
_NATIONAL = {"1": (10, 10), "7": (10, 10), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "41": (9, 9), "44": (7, 10), "45": (8, 8), "47": (8, 8), "48": (9, 9), "49": (6, 11), "55": (10, 11), "61": (9, 9), "81": (9, 10), "86": (9, 11), "91": (10, 10), "351": (9, 9)}


def _round(key: bytes, tweak: str, i: int, size: int, value: int) -> int:
    """A keyed number of 192 bits; numbers go in by their bytes, which takes time in proportion to their length."""
    said = f"{tweak}|{i}|".encode() + size.to_bytes(-(-size.bit_length() // 8)) + b"|" + value.to_bytes(-(-value.bit_length() // 8))
    return int.from_bytes(hmac.digest(key, said, "sha256")[:24], "big")


@lru_cache(maxsize=1 << 16)
def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of range(size): a Feistel network over a * b >= size, walked until it is back in range."""
    if size < 2:
        return value
    a = 1
    while a * a < size:
        a *= 2
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + _round(key, tweak, i, size, left)) % b
            else:
                left = (left + _round(key, tweak, i, size, right)) % a
        value = left * b + right
        if value < size:
            return value


def _put(pattern: str, signs: str, new: str) -> str:
    """The pattern with its characters out of signs replaced in order."""
    it = iter(new)
    return "".join(next(it) if c in signs else c for c in pattern)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> int:
    """0 for a valid number; else what is over."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def card(key: bytes, s: str) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn(d) or len(set(d)) == 1 or d[0] not in "23456":
        return None
    body = str(permute(key, f"card{d[0]}", int(d[1:-1]), 10 ** (len(d) - 2))).zfill(len(d) - 2)
    new = d[0] + body
    return _put(s, "0123456789", new + str((10 - luhn(new + "0")) % 10))


def _is_nanp(own: str) -> bool:
    """Ten digits whose area and exchange codes begin with 2 to 9."""
    return len(own) == 10 and own[0] not in "01" and own[3] not in "01"


def phone(key: bytes, s: str) -> str | None:
    """By format and length alone; the country code and a trunk 0 stay, as does the set (North American or other) a number is in."""
    d = _digits(s)
    head, code, own = "", "", d
    if s[0] == "+" or d.startswith("00"):
        head = "" if s[0] == "+" else "00"
        d = d[len(head) :]
        code = d[: 1 if d[0] in "17" else 2 if d[:2] in _TWO_DIGIT_CODES else 3]
        own = d[len(code) :]
        head += code
        if "(0)" in s and own[:1] == "0":
            head, own = head + "0", own[1:]
        low, high = _NATIONAL.get(code, (6, 15 - len(code)))
        if not low <= len(own) <= high:
            return None
    elif len(d) == 11 and d[0] == "1":
        head, code, own = "1", "1", d[1:]
    elif d[0] == "0":
        head, own = "0", d[1:]
    elif len(d) != 10:
        return None
    if code in ("", "1") and _is_nanp(own) and head != "0":
        value = ((int(own[0]) - 2) * 100 + int(own[1:3])) * 8_000_000 + (int(own[3]) - 2) * 1_000_000 + int(own[4:])
        area, rest = divmod(permute(key, "phone" + code, value, 800 * 8_000_000), 8_000_000)
        return _put(s, "0123456789", head + str(area + 200) + str(rest + 2_000_000))
    tweak, new = f"phone{head[:1] if head == '0' else code}other", own
    while True:
        # walked until it is back in the set, so that no two numbers meet
        new = str(permute(key, tweak, int(new), 10 ** len(own))).zfill(len(own))
        if head == "0" or not (code in ("", "1") and _is_nanp(new) or not code and new[0] == "0"):
            return _put(s, "0123456789", head + new)


def ssn(key: bytes, s: str) -> str | None:
    d = _digits(s)
    if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000":
        return None
    areas = int(d[:3]) - 1 - (int(d[:3]) > 666)
    value = (areas * 99 + int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1
    rest, serial = divmod(permute(key, "ssn", value, 898 * 99 * 9999), 9999)
    area, group = divmod(rest, 99)
    return _put(s, "0123456789", f"{area + 1 + (area + 1 > 665):03d}{group + 1:02d}{serial + 1:04d}")


def iban(key: bytes, s: str) -> str | None:
    c = s.replace(" ", "")
    number = lambda x: int("".join(str(int(ch, 36)) for ch in x))
    if not 15 <= len(c) <= 34 or number(c[4:] + c[:4]) % 97 != 1:
        return None
    digits = _digits(c[4:])
    body = _put(c[4:], "0123456789", str(permute(key, "iban" + c[:2], int(digits or 0), 10 ** len(digits))).zfill(len(digits)) if digits else "")
    new = c[:2] + f"{98 - number(body + c[:2] + '00') % 97:02d}" + body
    return _put(s, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", new)


def ipv4(key: bytes, s: str) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    value = permute(key, "ipv4", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(year: int, month: int, day: int) -> int | None:
    """Days since the first one; None if there is no such date in range."""
    try:
        n = (date(year, month, day) - FIRST_DAY).days
    except ValueError:
        return None
    return n if 0 <= n < DAYS else None


def _show(s: str, n: int, order: str) -> str:
    new = FIRST_DAY + timedelta(n)
    text = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return _put(s, "0123456789", "".join(text[c] for c in order))


def iso_date(key: bytes, s: str) -> str | None:
    n = _date(int(s[:4]), int(s[5:7]), int(s[8:]))
    return None if n is None else _show(s, permute(key, "date", n, DAYS), "ymd")


@lru_cache(maxsize=1)
def _late_days() -> list[int]:
    """Days that only the month can come before: those after a month's twelfth."""
    return [n for n in range(DAYS) if (FIRST_DAY + timedelta(n)).day > 12]


def local_date(key: bytes, s: str) -> str | None:
    """Points and slashes. Day first, where that is a date; else month first, with a permutation of the dates that can only be read so."""
    a, b, year = int(s[:2]), int(s[3:5]), int(s[6:])
    if (n := _date(year, b, a)) is not None:
        return _show(s, permute(key, "date", n, DAYS), "dmy")
    if (n := _date(year, a, b)) is None or b <= 12:
        return None
    late = _late_days()
    return _show(s, late[permute(key, "month first", bisect_left(late, n), len(late))], "mdy")


#: Signs of a word that are permuted as one number.
PIECE = 48


def _word(key: bytes, tweak: str, s: str, signs: str) -> str:
    """Permutes the words of one length. Long ones piece by piece, each under what stands before it, so time follows the length."""
    n, s, out = len(s), s.lower(), []
    before = hmac.new(key, f"{tweak}|{n}".encode(), "sha256")
    for at in range(0, n, PIECE):
        piece = s[at : at + PIECE]
        value = 0
        for c in piece:
            value = value * len(signs) + signs.index(c)
        value = permute(key, f"{tweak}{n}" if n <= PIECE else before.hexdigest(), value, len(signs) ** len(piece))
        before.update(piece.encode())
        new = []
        for _ in piece:
            value, r = divmod(value, len(signs))
            new.append(signs[r])
        out += reversed(new)
    return "".join(out)


def email(key: bytes, s: str) -> str | None:
    """Letters and digits of the mailbox and of the domain but its last two labels, in lower case."""
    name, _, domain = s.rpartition("@")
    labels = domain.split(".")
    hidden = "@".join([name, ".".join(labels[:-2])])
    plain = "".join(c for c in hidden.lower() if c in _LOWER)
    if not plain:
        return None
    new = iter(_word(key, "email", plain, _LOWER))
    hidden = "".join(next(new) if c.lower() in _LOWER and c.isascii() else c for c in hidden)
    name, _, front = hidden.rpartition("@")
    return f"{name}@{'.'.join([*([front] if front else []), *labels[-2:]])}"


def secret(key: bytes, s: str) -> str | None:
    """Hexadecimal keys of 32 digits and more with letters and digits."""
    if not (re.search("[a-f]", s) and re.search("[0-9]", s)):
        return None
    return _word(key, "hex", s, "0123456789abcdef")


def _cuts(s: str) -> Iterator[int]:
    """Where groups of signs end, the last first."""
    return reversed([m.end() for m in re.finditer("[0-9A-Z]+", s)])


def _card_cuts(s: str) -> Iterator[int]:
    """The usual length of the card's kind first; 19 digits and fewer where the first digits leave it open."""
    d = _digits(s)
    usual = 15 if d[:2] in ("34", "37") else 14 if d[:2] in ("30", "36", "38", "39") else 19 if d[0] == "6" or d[:2] in ("50", "56", "57", "58") else 16
    return iter(sorted(_cuts(s), key=lambda stop: len(_digits(s[:stop])) != usual))


def _iban_cuts(s: str) -> Iterator[int]:
    """The length of the country first; for a country not known, every length."""
    size = lambda stop: stop - s.count(" ", 0, stop)
    usual = _IBAN_SIGNS.get(s[:2])
    own = [stop for stop in _cuts(s) if size(stop) == usual]
    return iter([*own, len(s)] if usual else list(_cuts(s)))


#: With a country code; groups of 3-3-4; ten digits in a run; with a trunk 0, in pairs or after an area code.
_PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+ ?[1-9](?:[ ./-]?[0-9]|[ ./-]?\([0-9]{1,5}\)){6,14}(?![0-9])"
    r"|(?<![0-9][:.,])00[ -]?[1-9](?:[ ./-]?[0-9]|[ ./-]?\(0\)){7,14}(?![0-9])"
    r"|(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])"
    r"|1?[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z]|[.,-][0-9])"
    r"|(?<![0-9][:.,/-])(?<![0-9]{4} )(?:0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})|\(?0[1-9][0-9]{1,4}\)?[ /-]{1,2}[0-9]{3,4}[ -]?[0-9]{3,5})(?![0-9]|[.-][0-9]))"
)
#: Earlier kinds win where two match at one place.
KINDS: dict[str, tuple[str, Callable[[bytes, str], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    "secret": (r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])", secret),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", iban),
    "ipv4": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", ipv4),
    "iso_date": (r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])", iso_date),
    "local_date": (r"(?<![0-9/.])[0-9]{2}([/.])[0-9]{2}\g<sep>[0-9]{4}(?![0-9/]|\.[0-9])", local_date),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn),
    "phone": (_PHONE, phone),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", card),
}
_PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items()).replace("([/.])", "(?P<sep>[/.])").replace(r"\g<sep>", "(?P=sep)"))
_ORDER = list(KINDS)
_EACH = {k: re.compile(p.replace("([/.])", "(?P<sep>[/.])").replace(r"\g<sep>", "(?P=sep)")) for k, (p, _) in KINDS.items()}
#: Kinds that may have matched beyond their end: where else they may end, what is likeliest first.
ENDS: dict[str, Callable[[str], Iterator[int]]] = {"phone": _cuts, "card": _card_cuts, "iban": _iban_cuts}
_SIGN = re.compile("[0-9@]")


def _first(text: str, start: int, kinds: list[str], key: bytes) -> tuple[str, int, str] | None:
    """(kind, stop, pseudonym) of the first of these kinds that holds a valid value at the start."""
    for kind in kinds:
        if m := _EACH[kind].match(text, start):
            s = m.group(0)
            for stop in ENDS[kind](s) if kind in ENDS else (len(s),):
                if (new := KINDS[kind][1](key, s[:stop])) is not None:
                    return kind, start + stop, new
    return None


def pseudonymise(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its private values replaced, and (kind, start, stop) of each in the text given."""
    if not _SIGN.search(text):
        return text, []
    out, found, at, look = [], [], 0, 0
    while m := _PATTERN.search(text, look):
        kind = m.lastgroup if m.lastgroup in KINDS else "local_date"
        hit = _first(text, m.start(), _ORDER[_ORDER.index(kind) :], key)
        if hit is None:
            # what looked like one kind may still hold another further on
            look = m.start() + 1
            continue
        kind, stop, new = hit
        out += [text[at : m.start()], new]
        found.append((kind, m.start(), stop))
        at = look = stop
    return ("".join(out) + text[at:], found) if found else (text, [])


SPANS = "array<struct<kind:string,start:int,stop:int>>"


def _masked(key: bytes):
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            texts, spans, counts = [], [], []
            for text in block.column("text").to_pylist():
                new, found = (None, []) if text is None else pseudonymise(text, key)
                texts.append(new)
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in found])
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, spans_type)], names=["doc_id", "text", "n_found", "spans"])

    return run


def mask_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """Columns doc_id, text (with pseudonyms), n_found, spans (in code points of the text given); one row per input row.

    A null text stays null with nothing found; repeated rows get the same
    pseudonyms. Numbers that fail their check are left alone. An empty table
    gives no rows. Other columns are not read. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_masked(key), f"doc_id long, text string, n_found long, spans {SPANS}")


def op10_query(spark, sf_dir):
    from platen.llm.common import read

    return mask_private(read(spark, sf_dir, "documents"))


