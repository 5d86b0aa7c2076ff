"""Fonts: from codes in a string to text, advance and vertical extent."""

from __future__ import annotations

import re
import struct
import unicodedata
from binascii import unhexlify

from platen.sources.pdf import cids
from platen.sources.pdf.objects import NULL, Document, Keyword, Lexer, Name, Stream
from platen.sources.pdf.standard_fonts import DESCENTS, advances, face, own_encoding

# Glyph names that are not their letter.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=",
    "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|",
    "braceright": "}", "asciitilde": "~", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "fraction": "⁄", "yen": "¥", "florin": "ƒ", "section": "§", "currency": "¤", "quotedblleft": "“", "quotedblright": "”", "guillemotleft": "«",
    "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "endash": "–", "emdash": "—", "dagger": "†", "daggerdbl": "‡",
    "periodcentered": "·", "paragraph": "¶", "bullet": "•", "quotesinglbase": "‚", "quotedblbase": "„", "ellipsis": "…", "perthousand": "‰", "questiondown": "¿", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ",
    "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "germandbls": "ß", "dotlessi": "ı", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "Euro": "€", "trademark": "™", "copyright": "©",
    "registered": "®", "degree": "°", "plusminus": "±", "multiply": "×", "divide": "÷", "mu": "µ", "minus": "−", "logicalnot": "¬", "brokenbar": "¦", "onehalf": "½", "onequarter": "¼", "threequarters": "¾",
}
# Accents as they end glyph names.
ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "cedilla": "̧", "caron": "̌", "ring": "̊", "macron": "̄", "breve": "̆", "ogonek": "̨"}
# Where StandardEncoding leaves ASCII and Latin.
STANDARD = dict(enumerate("¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ", 161)) | {39: "’", 96: "‘", 177: "–", 178: "†", 179: "‡", 180: "·", 182: "¶", 183: "•", 184: "‚", 185: "„", 186: "”", 187: "»", 188: "…", 189: "‰", 191: "¿", 208: "—", 225: "Æ", 232: "Ł", 233: "Ø", 234: "Œ", 241: "æ", 245: "ı", 248: "ł", 249: "ø", 250: "œ", 251: "ß"}
# Codecs of predefined CMaps by name, without the writing mode.
CODECS = {
    "GBK-EUC": "gb18030", "GBKp-EUC": "gb18030", "GBK2K": "gb18030", "GBpc-EUC": "gb18030", "GB-EUC": "gb18030",
    "B5pc": "big5", "ETen-B5": "big5", "ETenms-B5": "big5", "HKscs-B5": "big5hkscs",
    "78-RKSJ": "cp932", "83pv-RKSJ": "cp932", "90ms-RKSJ": "cp932", "90msp-RKSJ": "cp932", "90pv-RKSJ": "cp932", "Add-RKSJ": "cp932", "Ext-RKSJ": "cp932",
    "EUC": "euc_jp", "": "jis", "KSC-EUC": "euc_kr", "KSCpc-EUC": "euc_kr", "KSCms-UHC": "cp949", "KSCms-UHC-HW": "cp949",
}
#: Unicode CMaps: those of each collection end alike.
UNICODE = {"UCS2": "utf-16-be", "UCS2-HW": "utf-16-be", "UTF16": "utf-16-be", "UTF8": "utf-8", "UTF32": "utf-32-be"}


def codec_of(name: str) -> str | None:
    base = "" if name in ("H", "V") else name[:-2] if name.endswith(("-H", "-V")) else name
    if m := re.fullmatch(r"Uni(?:GB|CNS|JIS|JISX0213|JIS2004|KS)-(.+)", base):
        return UNICODE.get(m[1])
    return CODECS.get(base) if base or name in ("H", "V") else None


def code_size(codec: str, data: bytes, i: int) -> int:
    """How many bytes the code at i takes."""
    c, after = data[i], data[i + 1] if i + 1 < len(data) else 0
    if codec == "utf-32-be":
        return 4
    if codec == "utf-16-be":
        return 4 if 0xD8 <= c < 0xDC else 2
    if codec == "utf-8":
        return 1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
    if codec == "jis":
        return 2
    if codec == "cp932":
        return 2 if 0x81 <= c <= 0x9F or 0xE0 <= c <= 0xFC else 1
    if codec == "euc_jp":
        return 3 if c == 0x8F else 2 if c == 0x8E or c >= 0xA1 else 1
    if codec == "gb18030":
        return 1 if c < 0x81 else 4 if 0x30 <= after <= 0x39 else 2
    return 2 if c >= 0x81 else 1


def code_text(codec: str, part: bytes) -> str | None:
    if codec == "jis":  # rows of the plain character set
        codec, part = "euc_jp", bytes(b | 0x80 for b in part)
    return part.decode(codec, "ignore") or None


def glyph_text(name: str) -> str | None:
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    base = name.split(".")[0]
    if base != name:
        return glyph_text(base)
    if m := re.fullmatch(r"uni([0-9A-F]{4})+|u([0-9A-F]{4,6})", name):
        digits = name[3:] if name.startswith("uni") else name[1:]
        try:
            return "".join(chr(int(digits[i : i + 4], 16)) for i in range(0, len(digits), 4)) if m[1] else chr(int(digits, 16))
        except (ValueError, OverflowError):
            return None
    if name[1:] in ACCENTS:
        return unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
    return None


#: Texts of the first glyph numbers of compact fonts: those of StandardEncoding in order.
STANDARD_ORDER = [t for _, t in sorted(({i: chr(i) for i in range(32, 127)} | STANDARD).items())]


def base_table(name: str | None) -> dict[int, str]:
    if name in ("MacRomanEncoding", "MacExpertEncoding"):
        return {i: bytes([i]).decode("mac_roman") for i in range(32, 256)}
    if name == "StandardEncoding":
        return {i: chr(i) for i in range(32, 127)} | STANDARD
    return {i: t for i in range(32, 256) if (t := bytes([i]).decode("cp1252", "ignore"))}


#: Single codes and their texts, as most files write them.
PAIR = re.compile(rb"<((?:[0-9A-Fa-f]{2})+)>[\t\n\r ]*<((?:[0-9A-Fa-f]{2})*)>")
PAIRS = re.compile(rb"(?:[\t\n\r ]*" + PAIR.pattern + rb")+(?=[\t\n\r ]*endbfchar)")


class CMap:
    """ToUnicode and code-to-CID maps: single codes, ranges with a start or an array."""

    def __init__(self, data: bytes):
        self.text: dict[int, str] = {}
        self.cid: dict[int, int] = {}
        self.ranges: list[tuple[int, int, int]] = []
        self.spaces: list[tuple[bytes, bytes]] = []
        lex, stack = Lexer(data), []
        while (x := lex.next()) is not None:
            if not isinstance(x, Keyword):
                stack.append(x)
                continue
            number = lambda v: int.from_bytes(v, "big")
            if x == b"beginbfchar" and (m := PAIRS.match(data, lex.pos)):
                self.text |= {int(a, 16): unhexlify(b).decode("utf-16-be", "replace") for a, b in PAIR.findall(m[0])}
                lex.pos = m.end()
            if x == b"endcodespacerange":
                self.spaces += [(a, b) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes) and len(a) == len(b) and a]
            elif x == b"endbfchar":
                for a, b in zip(stack[::2], stack[1::2], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        self.text[number(a)] = b.decode("utf-16-be", "replace")
            elif x == b"endbfrange":
                for a, b, c in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    if not (isinstance(a, bytes) and isinstance(b, bytes)):
                        continue
                    for i, code in enumerate(range(number(a), min(number(b), number(a) + 65535) + 1)):
                        if isinstance(c, list):
                            if i < len(c) and isinstance(c[i], bytes):
                                self.text[code] = c[i].decode("utf-16-be", "replace")
                        elif isinstance(c, bytes) and c:
                            last = (number(c[-2:]) + i) & 0xFFFF if len(c) > 1 else c[0] + i
                            self.text[code] = (c[:-2] + last.to_bytes(2, "big")).decode("utf-16-be", "replace")
            elif x == b"endcidchar":
                self.cid |= {number(a): b for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, int)}
            elif x == b"endcidrange":
                self.ranges += [(number(a), number(b), c) for a, b, c in zip(stack[::3], stack[1::3], stack[2::3], strict=False) if isinstance(a, bytes) and isinstance(b, bytes) and isinstance(c, int)]
            if x.startswith((b"begin", b"end")) or x == b"def":
                stack = []

    def size(self, data: bytes, i: int) -> int:
        """How many bytes the code at i takes: the code space ranges say so byte by byte; two where none fits."""
        for a, b in sorted(self.spaces, key=lambda r: len(r[0])):
            part = data[i : i + len(a)]
            if len(part) == len(a) and all(x <= c <= y for x, c, y in zip(a, part, b, strict=True)):
                return len(a)
        return min((len(a) for a, _ in self.spaces), default=2)

    def to_cid(self, code: int) -> int:
        if code in self.cid:
            return self.cid[code]
        return next((c + code - a for a, b, c in self.ranges if a <= code <= b), code)


def _sfnt(data: bytes) -> dict[bytes, int]:
    return {data[12 + 16 * i : 16 + 16 * i]: struct.unpack(">I", data[20 + 16 * i : 24 + 16 * i])[0] for i in range(struct.unpack(">H", data[4:6])[0])}


def _advances(data: bytes, header: bytes, metrics: bytes) -> dict[int, float]:
    """Advances by glyph in thousandths, from the tables of one direction; the last one goes for all further glyphs."""
    tables = _sfnt(data)
    head, own, rows = (tables[t] for t in (b"head", header, metrics))
    scale = 1000 / struct.unpack(">H", data[head + 18 : head + 20])[0]
    n = struct.unpack(">H", data[own + 34 : own + 36])[0]
    out = {i: struct.unpack(">H", data[rows + 4 * i : rows + 4 * i + 2])[0] * scale for i in range(n)}
    if b"maxp" in tables and n:
        out |= dict.fromkeys(range(n, struct.unpack(">H", data[tables[b"maxp"] + 4 : tables[b"maxp"] + 6])[0]), out[n - 1])
    return out


def truetype_widths(data: bytes) -> dict[int, float] | None:
    try:
        return _advances(data, b"hhea", b"hmtx")
    except (KeyError, struct.error, ZeroDivisionError):
        return None


def truetype_heights(data: bytes) -> dict[int, float] | None:
    try:
        return _advances(data, b"vhea", b"vmtx")
    except (KeyError, struct.error, ZeroDivisionError):
        return None


class Cff:
    """Advances of a compact font by the texts of its glyphs, as far as their names tell."""

    def __init__(self, data: bytes):
        self.data = data
        _, at = self._index(data[2])
        tops, at = self._index(at)
        strings, at = self._index(at)
        top = self._dict(tops[0])
        glyphs, _ = self._index(int(top[17][0]))
        size, start = (int(v) for v in top[18])
        private = self._dict(data[start : start + size])
        default, nominal = private.get(20, [0.0])[0], private.get(21, [0.0])[0]
        scale = top[(12, 7)][0] * 1000 if (12, 7) in top else 1.0
        self.widths: dict[str, float] = {}
        for sid, code in zip(self._charset(int(top.get(15, [0])[0]), len(glyphs)), glyphs, strict=False):
            text = STANDARD_ORDER[sid - 1] if 0 < sid <= len(STANDARD_ORDER) else glyph_text(strings[sid - 391].decode("latin-1")) if 391 <= sid < 391 + len(strings) else None
            if text is not None:
                own = self._width(code)
                self.widths.setdefault(text, (default if own is None else nominal + own) * scale)

    def _index(self, at: int) -> tuple[list[bytes], int]:
        count = int.from_bytes(self.data[at : at + 2], "big")
        if not count:
            return [], at + 2
        n = self.data[at + 2]
        ends = [int.from_bytes(self.data[at + 3 + i * n : at + 3 + (i + 1) * n], "big") for i in range(count + 1)]
        base = at + 2 + (count + 1) * n
        return [self.data[base + a : base + b] for a, b in zip(ends[:-1], ends[1:], strict=True)], base + ends[-1]

    @staticmethod
    def _dict(data: bytes) -> dict:
        out, args, i = {}, [], 0
        while i < len(data):
            c = data[i]
            if c <= 21:
                key = c
                if c == 12:
                    i += 1
                    key = (12, data[i])
                out[key], args = args, []
            elif c == 30:
                digits = ""
                while "f" not in digits:
                    i += 1
                    digits += f"{data[i]:02x}"
                text = "".join({"a": ".", "b": "E", "c": "E-", "e": "-"}.get(d, d) for d in digits.split("f")[0])
                args.append(float(text or 0))
            elif c in (28, 29):
                n = 2 if c == 28 else 4
                args.append(int.from_bytes(data[i + 1 : i + 1 + n], "big", signed=True))
                i += n
            elif c >= 32:
                args.append(c - 139 if c < 247 else (c - 247) * 256 + data[i + 1] + 108 if c < 251 else -(c - 251) * 256 - data[i + 1] - 108)
                i += c >= 247
            i += 1
        return out

    def _charset(self, at: int, count: int) -> list[int]:
        if at <= 2:
            return list(range(count))
        out, kind, at = [0], self.data[at], at + 1
        while len(out) < count:
            first = int.from_bytes(self.data[at : at + 2], "big")
            left = 0 if kind == 0 else int.from_bytes(self.data[at + 2 : at + 2 + kind], "big")
            out += range(first, first + left + 1)
            at += 2 + kind
        return out[:count]

    @staticmethod
    def _width(code: bytes) -> float | None:
        """What stands before the arguments of the first operator that clears the stack."""
        n, first, i = 0, 0.0, 0
        while i < len(code):
            c = code[i]
            if c == 28 or c >= 32:
                size = 3 if c == 28 else 1 if c < 247 else 2 if c < 255 else 5
                part = code[i : i + size]
                if len(part) < size:
                    return None
                value = int.from_bytes(part[1:], "big", signed=True) if c == 28 else c - 139 if c < 247 else (c - 247) * 256 + part[1] + 108 if c < 251 else -(c - 251) * 256 - part[1] - 108 if c < 255 else int.from_bytes(part[1:], "big", signed=True) / 65536
                first = value if n == 0 else first
                n, i = n + 1, i + size
                continue
            wanted = {21: 2, 22: 1, 4: 1, 14: 0}.get(c)
            if wanted is not None:
                return first if n > wanted and not (c == 14 and n == 4) else None
            return first if c in (1, 3, 18, 23, 19, 20) and n % 2 else None
        return None


def cff_widths(data: bytes) -> dict[str, float] | None:
    try:
        return Cff(data).widths
    except (KeyError, IndexError, ValueError, TypeError, OverflowError):
        return None


class Font:
    """decode(bytes) gives (code, bytes used, text, advance, vertical origin, is a space)."""

    def __init__(self, doc: Document, d: dict):
        get = doc.get
        self.name = str(get(d.get("BaseFont")) or "Unknown")
        self.composite = get(d.get("Subtype")) == "Type0"
        self.vertical = False
        self.codec = self.signs = None
        cmap = get(d.get("ToUnicode"))
        self.to_unicode = CMap(doc.decode(cmap)) if isinstance(cmap, Stream) else None
        own = d
        if self.composite:
            kids = get(d.get("DescendantFonts")) or [{}]
            own = get(kids[0]) or {}
            self._composite(doc, d, own)
        else:
            self._simple(doc, d)
        desc = get(own.get("FontDescriptor"))
        desc = desc if isinstance(desc, dict) else {}
        number = lambda x, default=0.0: float(v) if isinstance(v := get(x), (int, float)) else default
        ascent, descent = number(desc.get("Ascent"), 750.0 if not desc else 0.0), number(desc.get("Descent"), -250.0 if not desc else 0.0)
        descent = -abs(descent)
        self.missing = number(desc.get("MissingWidth"), 0.0 if self.widths else 600.0)
        if not desc and (standard := face(self.name)):
            descent = DESCENTS.get(standard.split("-")[0], descent)
        # the height of a character is the font size
        self.ascent, self.descent = (1000.0, 0.0) if self.vertical or (ascent == 0 and descent == 0) else (1000.0 + descent, descent)

    def _simple(self, doc: Document, d: dict) -> None:
        get = doc.get
        enc = get(d.get("Encoding"))
        base = str(enc) if isinstance(enc, Name) else str(get(enc.get("BaseEncoding")) or "") if isinstance(enc, dict) else ""
        standard = face(self.name)
        own, own_widths = own_encoding(standard) if standard in ("Symbol", "ZapfDingbats") else ({}, {})
        self.table = own if own and not base else base_table(base or ("StandardEncoding" if standard else None))
        if isinstance(enc, dict):
            code = 0
            for x in get(enc.get("Differences")) or []:
                x = get(x)
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    if (t := glyph_text(str(x))) is not None:
                        self.table[code] = t
                    code += 1
        first = get(d.get("FirstChar")) or 0
        widths = get(d.get("Widths"))
        self.widths: dict[int, float] = {}
        if isinstance(widths, list):
            self.widths = {first + i: float(v) for i, w in enumerate(widths) if isinstance(v := get(w), (int, float))}
        elif standard == "Courier":
            self.widths = dict.fromkeys(range(256), 600.0)
        elif own:
            by_text = {t: own_widths[c] for c, t in own.items()}
            self.widths = {c: by_text[t] for c, t in self.table.items() if t in by_text}
        elif standard:
            by_text = advances(standard)
            self.widths = {c: by_text[t] for c, t in self.table.items() if t in by_text}
        else:
            desc = get(d.get("FontDescriptor")) or {}
            program = lambda key: doc.decode(x) if isinstance(desc, dict) and isinstance(x := get(desc.get(key)), Stream) else b""
            self.widths = truetype_widths(program("FontFile2")) or {}
            if not self.widths and (found := cff_widths(program("FontFile3"))):
                self.widths = {c: found[t] for c, t in self.table.items() if t in found}

    def _composite(self, doc: Document, d: dict, own: dict) -> None:
        get = doc.get
        enc = get(d.get("Encoding"))
        self.code_map = None
        if isinstance(enc, Stream):
            self.code_map = CMap(doc.decode(enc))
            self.vertical = get(enc.dict.get("WMode")) == 1
        elif isinstance(enc, Name):
            self.vertical = enc.endswith("-V")
            self.vertical = self.vertical or enc == "V"
            self.codec = codec_of(enc)
        info = get(own.get("CIDSystemInfo"))
        ordering = get(info.get("Ordering")) if isinstance(info, dict) else None
        self.cid_texts = cids.texts(ordering.decode("latin-1")) if isinstance(ordering, bytes) else {}
        number = get(own.get("DW"))
        self.default = float(number) if isinstance(number, (int, float)) else 1000.0
        self.widths = {}
        items = [get(x) for x in get(own.get("W")) or []]
        i = 0
        while i + 1 < len(items):
            if isinstance(items[i + 1], list):
                self.widths |= {items[i] + k: float(get(w) or 0) for k, w in enumerate(items[i + 1])}
                i += 2
            elif i + 2 < len(items):
                self.widths |= dict.fromkeys(range(items[i], min(items[i + 1], items[i] + 65535) + 1), float(items[i + 2] or 0))
                i += 3
            else:
                break
        down = get(own.get("DW2")) or [880, -1000]
        self.down = (float(down[0]), float(down[1]))
        #: By CID: advance down the page, and where the vertical origin lies.
        self.columns: dict[int, tuple[float, float, float]] = {}
        if self.vertical:
            self._vertical(doc, own)

    def _vertical(self, doc: Document, own: dict) -> None:
        get = doc.get
        number = lambda x: float(v) if isinstance(v := get(x), (int, float)) else 0.0
        items = [get(x) for x in get(own.get("W2")) or []]
        i = 0
        while i + 1 < len(items) and isinstance(items[i], int):
            if isinstance(items[i + 1], list):
                three = [number(v) for v in items[i + 1]]
                self.columns |= {items[i] + k: tuple(three[3 * k : 3 * k + 3]) for k in range(len(three) // 3)}
                i += 2
            elif i + 4 < len(items) and isinstance(items[i + 1], int):
                self.columns |= dict.fromkeys(range(items[i], min(items[i + 1], items[i] + 65535) + 1), tuple(number(v) for v in items[i + 2 : i + 5]))
                i += 5
            else:
                break
        desc = get(own.get("FontDescriptor"))
        program = get(desc.get("FontFile2")) if isinstance(desc, dict) else None
        if not self.columns and "DW2" not in own and isinstance(program, Stream) and (heights := truetype_heights(doc.decode(program))):
            glyph = get(own.get("CIDToGIDMap"))
            glyph = doc.decode(glyph) if isinstance(glyph, Stream) else None
            of = {int.from_bytes(glyph[i : i + 2], "big"): i // 2 for i in range(0, len(glyph) - 1, 2)} if glyph else {g: g for g in heights}
            self.columns = {cid: (-heights[g], self.widths.get(cid, self.default) / 2, self.down[0]) for g, cid in of.items() if g in heights}

    def plain_run(self, data: bytes) -> tuple[str, float] | None:
        """The text and the one advance of codes of two bytes, if each stands for one sign; else None: see decode."""
        if not self.composite or self.codec or self.code_map or self.vertical or self.widths or self.to_unicode is None or not data or len(data) % 2:
            return None
        if self.signs is None:
            self.signs = {code: t for code, t in self.to_unicode.text.items() if len(t) == 1 and not 0xD800 <= code < 0xE000 and code < 0x10000}
            self.codes = frozenset(map(chr, self.signs))
        try:
            codes = data.decode("utf-16-be")
        except UnicodeDecodeError:
            return None
        return (codes.translate(self.signs), self.default) if self.codes.issuperset(codes) else None

    def decode(self, data: bytes):
        if not self.composite:
            for c in data:
                text = (self.to_unicode.text.get(c) if self.to_unicode else None) or self.table.get(c) or chr(c)
                yield c, text, self.widths.get(c, self.missing), (0.0, 0.0), c == 32
            return
        i = 0
        while i < len(data):
            n = code_size(self.codec, data, i) if self.codec else self.code_map.size(data, i) if self.code_map else 2
            part = data[i : i + n]
            code = int.from_bytes(part, "big")
            cid = self.code_map.to_cid(code) if self.code_map else code
            text = self.to_unicode.text.get(code) if self.to_unicode else None
            if text is None and self.codec:
                text = code_text(self.codec, part)
            if text is None:
                text = self.cid_texts.get(cid)
            width = self.widths.get(cid, self.default)
            if self.vertical:
                down, x, y = self.columns.get(cid, (self.down[1], width / 2, self.down[0]))
                yield code, text or f"(cid:{cid})", down, (x, y), part == b" "
            else:
                yield code, text or f"(cid:{cid})", width, (0.0, 0.0), part == b" "
            i += n


def font_of(doc: Document, ref) -> Font | None:
    d = doc.get(ref)
    return Font(doc, d) if isinstance(d, dict) else None


__all__ = ["NULL", "CMap", "Font", "cff_widths", "codec_of", "font_of", "glyph_text", "truetype_heights", "truetype_widths"]
