"""Everything a PDF file holds, as plain rows by relation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from platen.operators.bidi import mark_directions
from platen.operators.text_ops import keep_first
from platen.options import ExtractOptions, RepairOptions
from platen.sources.pdf.content import Interpreter, NoRuns, exact, shapes
from platen.sources.pdf.objects import MAX_DEPTH, NULL, Document, Lexer, Name, PdfError, Ref, Stream, text_of

MAX_SIBLINGS = 10_000
# Annotation types by subtype.
ANNOTATIONS = {"Text": "text", "Link": "link", "FreeText": "free_text", "Highlight": "highlight", "Underline": "underline", "StrikeOut": "strike_out", "Stamp": "stamp", "Square": "square", "Circle": "circle", "Ink": "ink", "Popup": "popup", "Widget": "widget"}
FIELDS = {"Tx": "text", "Btn": "button", "Ch": "choice", "Sig": "signature"}
#: Relations that only the interpreter can fill.
CONTENT = frozenset(("chars", "lines", "rects", "curves", "images", "warnings"))
TURNS = ("ltr", "ttb", "rtl", "btt")


class Pdf:
    def __init__(self, data: bytes, options: ExtractOptions | None = None):
        self.options = options or ExtractOptions()
        o = self.options
        if o.max_input_bytes is not None and len(data) > o.max_input_bytes:
            raise PdfError(f"larger than {o.max_input_bytes} bytes")
        self.repair_log: list[str] = []
        whole = None
        if o.repair:
            whole, self.repair_log = mended(data, o.repair if isinstance(o.repair, RepairOptions) else None)
        # as the written file would be read
        self.doc = Document(data, o.password) if whole is None else Document.of({num: as_read(x) for num, x in whole[0].items()}, {k: Ref(num, 0) for k, num in zip(("Root", "Info"), whole[1:], strict=True) if num is not None})
        self._tops: list[float] | None = None
        self.fonts: dict = {}
        self.get = self.doc.get
        self.root = self.get(self.doc.trailer.get("Root"))
        self.pages = list(self._pages())
        if o.max_pages is not None and len(self.pages) > o.max_pages:
            raise PdfError(f"more than {o.max_pages} pages")
        self.number = {ref.num: i for i, (ref, _) in enumerate(self.pages) if isinstance(ref, Ref)}

    def _pages(self) -> Iterator[tuple[object, dict]]:
        seen: set[int] = set()
        stack = [(self.root.get("Pages"), {}, 0)]
        while stack:
            ref, above, depth = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or depth > MAX_DEPTH or (isinstance(ref, Ref) and ref.num in seen):
                continue
            if isinstance(ref, Ref):
                seen.add(ref.num)
            passed = above | {k: node[k] for k in ("MediaBox", "TrimBox", "BleedBox", "ArtBox", "Rotate", "Resources") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and self.get(node.get("Type")) != "Page":
                stack += [(k, passed, depth + 1) for k in reversed(kids)]
            else:
                yield ref, passed | {k: v for k, v in node.items() if k not in passed}

    def box(self, page: dict, key: str) -> list[float] | None:
        got = self.get(page.get(key))
        if not isinstance(got, list) or len(got) < 4:
            return None
        values = [self.get(v) for v in got[:4]]
        return [float(v) for v in values] if all(isinstance(v, (int, float)) for v in values) else None

    def geometry(self, page: dict) -> dict:
        media = self.box(page, "MediaBox") or [0.0, 0.0, 612.0, 792.0]
        turn = self.get(page.get("Rotate")) or 0
        turn = int(turn) % 360 if isinstance(turn, (int, float)) else 0
        w, h = abs(media[2] - media[0]), abs(media[3] - media[1])
        wide, tall = (h, w) if turn in (90, 270) else (w, h)
        return {"width": wide, "height": tall, "rotation": turn, "media_box": media, "crop_box": self.box(page, "CropBox"), "trim_box": self.box(page, "TrimBox"), "bleed_box": self.box(page, "BleedBox"), "art_box": self.box(page, "ArtBox"), "x": min(media[0], media[2]), "y": min(media[1], media[3]), "w": w, "h": h}

    def _turned(self, g: dict, x0: float, top: float, x1: float, bottom: float) -> tuple:
        """A box of the page as written, y down, on the page as shown."""
        w, h, turn = g["w"], g["h"], g["rotation"]
        x0, x1 = x0 - g["x"], x1 - g["x"]
        if turn == 90:
            return h - bottom, x0, h - top, x1
        if turn == 180:
            return w - x1, h - bottom, w - x0, h - top
        if turn == 270:
            return top, w - x1, bottom, w - x0
        return x0, top, x1, bottom

    def content(self, page: dict) -> bytes:
        got = self.get(page.get("Contents"))
        parts = got if isinstance(got, list) else [got]
        return b" ".join(self.doc.decode(s) for p in parts if isinstance(s := self.get(p), Stream))

    def doctop(self, i: int) -> float:
        """Height of all pages before one."""
        if self._tops is None:
            self._tops = [0.0]
            for _, page in self.pages:
                self._tops.append(self._tops[-1] + self.geometry(page)["height"])
        return self._tops[i]

    def page_rows(self, i: int, kinds: frozenset[str] | None = None) -> Iterator[tuple[str, dict]]:
        """(relation, row) of one page; with kinds, contents are interpreted only if one of these needs it."""
        _, page = self.pages[i]
        g = self.geometry(page)
        yield "pages", {k: g[k] for k in ("width", "height", "rotation", "media_box", "crop_box", "trim_box", "bleed_box", "art_box")}
        if kinds is None or kinds & CONTENT:
            yield from self._content_rows(page, g, i, kinds is None or bool(kinds & {"chars", "warnings"}))
        if kinds is None or kinds & {"annotations", "hyperlinks"}:
            yield from self._annotations(page)

    def _content_rows(self, page: dict, g: dict, i: int, with_chars: bool) -> Iterator[tuple[str, dict]]:
        doctop = self.doctop(i)
        high = g["h"] + g["y"]
        try:
            run = self._interpreted(page, with_chars, self.options.runs and with_chars)
            if run.runs:
                self._place_runs(run.found.chars, g, high, doctop)
        except NoRuns:
            run = self._interpreted(page, with_chars, False)
        chars = run.found.chars
        if run.runs:
            for c in chars:
                yield "chars", c
            chars = []
        for n, c in enumerate(chars):
            c["char_index"] = n
            c["x0"], c["top"], c["x1"], c["bottom"] = self._turned(g, c["x0"], high - c.pop("y1"), c["x1"], high - c.pop("y0"))
            c["doctop"] = c["top"] + doctop
            if g["rotation"]:
                c["direction"] = TURNS[(TURNS.index(c["direction"]) + g["rotation"] // 90) % 4]
                c["upright"] = c["upright"] != (g["rotation"] in (90, 270))
        if not all(c["text"].isascii() for c in chars):
            mark_directions(chars)
            if self.options.unicode_norm:
                for c in chars:
                    c["text"] = unicodedata.normalize(self.options.unicode_norm, c["text"])
        for c in keep_first(chars) if self.options.dedupe and chars else chars:
            yield "chars", c
        for path in run.found.paths:
            for kind, found in zip(("lines", "rects", "curves"), shapes(path, high), strict=True):
                for row in found:
                    if kind == "curves":
                        row["pts"] = [dict(zip(("x", "y"), self._turned(g, p["x"], p["y"], p["x"], p["y"])[:2], strict=True)) for p in row["pts"]]
                    box = self._turned(g, row["x0"], row["top"], row["x1"], row["bottom"])
                    yield kind, row | dict(zip(("x0", "top", "x1", "bottom"), box, strict=True))
        for row in run.found.images:
            x0, top, x1, bottom = self._turned(g, row.pop("x0"), high - row.pop("y1"), row.pop("x1"), high - row.pop("y0"))
            yield "images", {"x0": x0, "top": top, "x1": x1, "bottom": bottom, "width": x1 - x0, "height": bottom - top} | row
        for row in run.found.warnings:
            yield "warnings", row

    def _interpreted(self, page: dict, with_chars: bool, runs: bool) -> Interpreter:
        run = Interpreter(self.doc, self.options.max_recursion_depth, self.options.extract_image_data, with_chars, runs, dict(self.fonts))
        resources = self.get(page.get("Resources"))
        try:
            run.run(self.content(page), resources if isinstance(resources, dict) else {})
        except PdfError as e:
            run.warn("CONTENT_ERROR", str(e))
        finally:
            # a font that can't be read is a warning of each page
            self.fonts |= {k: font for k, font in run.fonts.items() if isinstance(k, Ref) and font is not None}
        return run

    def _place_runs(self, runs: list[dict], g: dict, high: float, doctop: float) -> None:
        """Runs on the page as shown. NoRuns where characters of a run differ in what is said of them all, or where one may be dropped as a duplicate."""
        turn, o = g["rotation"], self.options
        if turn not in (0, 90, 180, 270) or (turn in (90, 270) and not o.turned_runs) or not exact(g["x"], g["w"], g["h"], high):
            raise NoRuns
        signs = "".join(c["text"] for c in runs)
        if not signs.isascii() and any(unicodedata.bidirectional(x) in ("R", "AL") or (o.unicode_norm and unicodedata.normalize(o.unicode_norm, x) != x) for x in set(signs)):
            raise NoRuns
        at = 0
        for c in runs:
            c["char_index"], at = at, at + len(c["text"])
            c["x0"], c["top"], c["x1"], c["bottom"] = self._turned(g, c["x0"], high - c.pop("y1"), c["x1"], high - c.pop("y0"))
            c["doctop"] = c["top"] + doctop
            if turn:
                step = c["step_x"]
                c["step_x"], c["step_y"] = {90: (0.0, step), 180: (-step, 0.0), 270: (0.0, -step)}[turn]
                c["direction"] = TURNS[(TURNS.index(c["direction"]) + turn // 90) % 4]
                c["upright"] = c["upright"] != (turn in (90, 270))
        if o.dedupe:
            spans = []
            for c in runs:
                along, across, step = (c["top"], c["x0"], c["step_y"]) if turn in (90, 270) else (c["x0"], c["top"], c["step_x"])
                end = along + step * (len(c["text"]) - 1)
                if abs(step) <= 1.0 and len(c["text"]) > 1:
                    raise NoRuns
                spans.append((across, min(along, end), max(along, end)))
            spans.sort()
            begin = 0
            for k in range(1, len(spans) + 1):
                if k == len(spans) or spans[k][0] - spans[k - 1][0] > 1.0:
                    near = sorted(spans[begin:k], key=lambda s: s[1]) if k - begin > 1 else ()
                    if any(b[1] - a[2] <= 1.0 for a, b in zip(near, near[1:], strict=False)):
                        raise NoRuns
                    begin = k

    def _annotations(self, page: dict) -> Iterator[tuple[str, dict]]:
        """Boxes stay as the file has them."""
        for a in self.get(page.get("Annots")) or []:
            a = self.get(a)
            box = self.box(a, "Rect") if isinstance(a, dict) else None
            if box is None:
                continue
            kind = str(self.get(a.get("Subtype")) or "")
            place = {"x0": min(box[0], box[2]), "top": min(box[1], box[3]), "x1": max(box[0], box[2]), "bottom": max(box[1], box[3])}
            yield "annotations", place | {"type": ANNOTATIONS.get(kind, "other"), "contents": text_of(self.get(a.get("Contents"))), "author": text_of(self.get(a.get("T"))), "date": text_of(self.get(a.get("M"))), "raw_subtype": kind}
            if kind == "Link" and (uri := self._uri(a)):
                yield "hyperlinks", place | {"uri": uri}

    def _uri(self, a: dict) -> str | None:
        act = self.get(a.get("A"))
        if isinstance(act, dict):
            kind = self.get(act.get("S"))
            if kind == "URI":
                return text_of(self.get(act.get("URI")))
            if kind == "GoToR":
                target = self.get(act.get("F"))
                return text_of(self.get(target.get("F")) if isinstance(target, dict) else target)
            dest = act.get("D") if kind == "GoTo" else None
        else:
            dest = a.get("Dest")
        page, _ = self.destination(dest)
        return None if page is None else f"#page={page + 1}"

    def destination(self, dest) -> tuple[int | None, float | None]:
        """Page (from 0) and height of an explicit or named destination."""
        dest = self.get(dest)
        if isinstance(dest, (bytes, Name)):
            dest = self._named(text_of(dest))
        if isinstance(dest, dict):
            dest = self.get(dest.get("D"))
        if not isinstance(dest, list) or not dest:
            return None, None
        page = self.number.get(dest[0].num) if isinstance(dest[0], Ref) else dest[0] if isinstance(dest[0], int) else None
        kind = str(self.get(dest[1])) if len(dest) > 1 else ""
        k = {"XYZ": 3, "FitH": 2, "FitBH": 2, "FitR": 5}.get(kind)
        top = self.get(dest[k]) if k is not None and len(dest) > k else None
        return page, float(top) if isinstance(top, (int, float)) else None

    def _named(self, name: str | None):
        old = self.get(self.root.get("Dests"))
        if isinstance(old, dict) and name in old:
            return self.get(old[name])
        names = self.get(self.root.get("Names"))
        stack = [(names.get("Dests") if isinstance(names, dict) else None, 0)]
        while stack:
            node, depth = stack.pop()
            node = self.get(node)
            if not isinstance(node, dict) or depth > MAX_DEPTH:
                continue
            pairs = self.get(node.get("Names")) or []
            for k, v in zip(pairs[::2], pairs[1::2], strict=False):
                if text_of(self.get(k)) == name:
                    return self.get(v)
            stack += [(k, depth + 1) for k in self.get(node.get("Kids")) or []]
        return None

    def document_rows(self, kinds: frozenset[str] | None = None) -> Iterator[tuple[str, int | None, dict]]:
        """(relation, page or None, row) of the whole document; with kinds, of no others."""
        wanted = lambda *names: kinds is None or not kinds.isdisjoint(names)
        if wanted("metadata"):
            info = self.get(self.doc.trailer.get("Info"))
            info = info if isinstance(info, dict) else {}
            keys = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "creation_date": "CreationDate", "mod_date": "ModDate"}
            yield "metadata", None, {k: text_of(self.get(info.get(v))) for k, v in keys.items()} | {"page_count": len(self.pages)}
        outlines = self.get(self.root.get("Outlines"))
        if wanted("bookmarks") and isinstance(outlines, dict):
            for n, row in enumerate(self._outline(outlines.get("First"), 0, set())):
                yield "bookmarks", None, {"ordinal": n} | row
        form = self.get(self.root.get("AcroForm"))
        if wanted("form_fields", "signatures") and isinstance(form, dict):
            for f in self.get(form.get("Fields")) or []:
                for kind, page, row in self._fields(f, "", {}, 0):
                    yield kind, page, row
        tree = self.get(self.root.get("StructTreeRoot"))
        if wanted("struct_elements") and isinstance(tree, dict):
            counter = [0]
            for page, row in self._structure(tree.get("K"), (), 0, None, counter):
                yield "struct_elements", page, row
        for line in self.repair_log:
            yield "repair_log", None, {"entry": line}
        if wanted("validation_issues"):
            for row in validate(self):
                yield "validation_issues", None, row

    def _outline(self, ref, level: int, seen: set) -> Iterator[dict]:
        count = 0
        while ref is not None and level <= MAX_DEPTH and count < MAX_SIBLINGS:
            if isinstance(ref, Ref):
                if ref.num in seen:
                    return
                seen.add(ref.num)
            node = self.get(ref)
            if not isinstance(node, dict):
                return
            act = self.get(node.get("A"))
            dest = node.get("Dest", act.get("D") if isinstance(act, dict) and self.get(act.get("S")) == "GoTo" else None)
            page, top = self.destination(dest)
            yield {"title": text_of(self.get(node.get("Title"))) or "", "level": level, "page": page, "dest_top": top}
            yield from self._outline(node.get("First"), level + 1, seen)
            ref, count = node.get("Next"), count + 1

    def _fields(self, ref, prefix: str, above: dict, depth: int) -> Iterator[tuple[str, int | None, dict]]:
        node = self.get(ref)
        if not isinstance(node, dict) or depth > MAX_DEPTH:
            return
        part = text_of(self.get(node.get("T")))
        name = ".".join(x for x in (prefix, part) if x)
        passed = above | {k: node[k] for k in ("FT", "V", "DV", "Ff", "Opt") if k in node}
        kids = [k for k in self.get(node.get("Kids")) or [] if isinstance(self.get(k), dict)]
        if any("T" in self.get(k) for k in kids):
            for k in kids:
                yield from self._fields(k, name, passed, depth + 1)
            return
        kind = str(self.get(passed.get("FT")) or "")
        if kind not in FIELDS:
            return
        widget = node if "Rect" in node or not kids else self.get(kids[0])
        page = widget.get("P", node.get("P"))
        number = self.number.get(page.num) if isinstance(page, Ref) else None
        if number is None:
            own = {x.num for x in [ref, *kids] if isinstance(x, Ref)}
            number = next((i for i, (_, p) in enumerate(self.pages) if any(isinstance(a, Ref) and a.num in own for a in self.get(p.get("Annots")) or [])), None)
        if kind == "Sig":
            v = self.get(passed.get("V"))
            signed = isinstance(v, dict)
            v = v if signed else {}
            yield "signatures", number, {"name": name, "signer": text_of(self.get(v.get("Name"))), "date": text_of(self.get(v.get("M"))), "reason": text_of(self.get(v.get("Reason"))), "location": text_of(self.get(v.get("Location"))), "contact": text_of(self.get(v.get("ContactInfo"))), "is_signed": signed}
        value = lambda x: ", ".join(t for y in x if (t := text_of(self.get(y)))) if isinstance(x := self.get(x), list) else text_of(x)
        box = self.box(widget, "Rect") or [0.0, 0.0, 0.0, 0.0]
        options = [text_of(self.get(self.get(x)[-1] if isinstance(self.get(x), list) else x)) for x in self.get(passed.get("Opt")) or []]
        flags = self.get(passed.get("Ff"))
        yield "form_fields", number, {"name": name, "type": FIELDS[kind], "value": value(passed.get("V")) if kind != "Sig" else None, "default_value": value(passed.get("DV")), "x0": box[0], "top": box[1], "x1": box[2], "bottom": box[3], "options": options, "flags": int(flags) if isinstance(flags, (int, float)) else 0}

    def _structure(self, kids, above: tuple[int, ...], depth: int, page: int | None, counter: list[int]) -> Iterator[tuple[int | None, dict]]:
        if depth > MAX_DEPTH:
            return
        kids = self.get(kids)
        for k in kids if isinstance(kids, list) else [kids]:
            node = self.get(k)
            if not isinstance(node, dict) or "S" not in node:
                continue
            own = node.get("Pg")
            here = self.number.get(own.num, page) if isinstance(own, Ref) else page
            inner = self.get(node.get("K"))
            inner = inner if isinstance(inner, list) else [inner]
            mcids = []
            for x in inner:
                x = self.get(x)
                if isinstance(x, int) and not isinstance(x, bool):
                    mcids.append(x)
                elif isinstance(x, dict) and isinstance(self.get(x.get("MCID")), int):
                    mcids.append(self.get(x["MCID"]))
            number = counter[0]
            counter[0] += 1
            yield here, {"node_id": number, "parent_id": above[-1] if above else None, "ancestors": list(above), "depth": depth, "preorder": number, "type": str(self.get(node["S"])), "mcids": mcids, "alt": text_of(self.get(node.get("Alt"))), "actual_text": text_of(self.get(node.get("ActualText"))), "lang": text_of(self.get(node.get("Lang")))}
            yield from self._structure(node.get("K"), (*above, number), depth + 1, here, counter)


def _refs(x, depth: int = 0) -> Iterator[Ref]:
    if depth > MAX_DEPTH:
        return
    if isinstance(x, Ref):
        yield x
    elif isinstance(x, Stream):
        yield from _refs(x.dict, depth + 1)
    elif isinstance(x, dict):
        for v in x.values():
            yield from _refs(v, depth + 1)
    elif isinstance(x, list):
        for v in x:
            yield from _refs(v, depth + 1)


def validate(pdf: Pdf) -> Iterator[dict]:
    issue = lambda severity, code, message, location=None: {"severity": severity, "code": code, "message": message, "location": location}
    root, get = pdf.root, pdf.get
    kind = get(root.get("Type"))
    if kind is None:
        yield issue("warning", "MISSING_TYPE", "the catalog has no type", "catalog")
    elif kind != "Catalog":
        yield issue("error", "WRONG_CATALOG_TYPE", f"the catalog's type is {kind}", "catalog")
    if get(root.get("Pages")) is None:
        yield issue("error", "MISSING_PAGES", "the catalog has no pages", "catalog")
    for i, (_, page) in enumerate(pdf.pages):
        where = f"page {i + 1}"
        if get(page.get("Type")) not in (None, "Page"):
            yield issue("error", "WRONG_PAGE_TYPE", f"the page's type is {get(page.get('Type'))}", where)
        if pdf.box(page, "MediaBox") is None:
            yield issue("error", "MISSING_MEDIABOX", "no media box here or above", where)
        resources = get(page.get("Resources"))
        fonts = get(resources.get("Font")) if isinstance(resources, dict) else None
        try:
            used = {m.decode("latin-1") for m in re.findall(rb"/([^\s/<>\[\]()]+)\s+[-+.\d]+\s+Tf\b", pdf.content(page))}
        except PdfError:
            yield issue("error", "INVALID_PAGE", "the content can't be read", where)
            continue
        for name in sorted(used - set(fonts if isinstance(fonts, dict) else ())):
            yield issue("warning", "MISSING_FONT", f"font {name} is not among the resources", where)
    broken = set()
    for num in list(pdf.doc.where):
        try:
            broken |= {(num, r.num) for r in _refs(get(Ref(num, 0))) if r.num not in pdf.doc.where}
        except PdfError:
            continue
    for num, missing in sorted(broken):
        yield issue("warning", "BROKEN_REF", f"object {missing} does not exist", f"object {num}")


@lru_cache(10_000)
def _name(x: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in x.encode())


def write_object(x) -> bytes:
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, Ref):
        return b"%d %d R" % (x.num, x.gen)
    if isinstance(x, (int, float)):
        return (f"{x:.6f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)).encode()
    if isinstance(x, (Name, str)):
        return _name(str(x))
    if isinstance(x, bytes):
        return b"<" + x.hex().encode() + b">"
    if isinstance(x, list):
        return b"[" + b" ".join(map(write_object, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b" ".join([_name(k) + b" " + write_object(v) for k, v in x.items()]) + b">>"
    if isinstance(x, Stream):
        return write_object(x.dict | {"Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
    return b"null"


def write_pdf(objects: dict[int, object], root: int, info: int | None = None) -> bytes:
    """A file with the given objects and a fresh cross-reference table."""
    out, where = bytearray(b"%PDF-1.7\n"), {}
    for num, obj in sorted(objects.items()):
        where[num] = len(out)
        out += b"%d 0 obj\n" % num + write_object(obj) + b"\nendobj\n"
    start, size = len(out), max(objects, default=0) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 n \n" % where[n] if n in where else b"0000000000 00000 f \n"
    trailer = {"Size": size, "Root": Ref(root, 0)} | ({"Info": Ref(info, 0)} if info else {})
    return bytes(out + b"trailer\n" + write_object(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def as_read(x):
    """An object as it is when write_object has written it and a lexer has read it."""
    kind = type(x)
    if kind is Name or kind is int or kind is Ref or kind is bytes or kind is bool:
        return x
    if kind is dict:
        return {k: as_read(v) for k, v in x.items()}
    if kind is list:
        return [as_read(v) for v in x]
    if isinstance(x, float):
        got = Lexer(write_object(x)).next()
        return NULL if isinstance(got, bytes) else got
    if isinstance(x, Stream):
        return Stream({k: as_read(v) for k, v in x.dict.items()} | {"Length": len(x.raw)}, x.raw)
    return bytes(x) if isinstance(x, bytes) else NULL


def mended(data: bytes, options: RepairOptions | None = None) -> tuple[tuple[dict[int, object], int, int | None] | None, list[str]]:
    """The objects, the number of the catalog and that of the information, or None where the file stays as it is; and what was mended."""
    o = options or RepairOptions()
    doc, log = Document(data), []
    if doc.rebuilt:
        if not o.rebuild_xref:
            return None, []
        log.append("rebuilt the cross references")
    objects: dict[int, object] = {}
    for num in sorted(doc.where):
        try:
            obj = doc.get(Ref(num, 0))
        except PdfError:
            continue
        kind = obj.dict.get("Type") if isinstance(obj, Stream) else None
        if obj is None or kind in ("XRef", "ObjStm"):
            continue
        if isinstance(obj, Stream) and o.fix_stream_lengths and doc.get(obj.dict.get("Length")) != len(obj.raw):
            log.append(f"object {num}: length of the stream")
        objects[num] = obj

    def clean(x, num: int):
        if isinstance(x, Ref) and x.num not in objects and o.remove_broken_objects:
            log.append(f"object {num}: reference to {x.num} as null")
            return None
        if isinstance(x, list):
            return [clean(v, num) for v in x]
        if isinstance(x, dict):
            return {k: clean(v, num) for k, v in x.items()}
        return Stream({k: clean(v, num) for k, v in x.dict.items() if k != "Length"}, x.raw) if isinstance(x, Stream) else x

    objects = {num: clean(obj, num) for num, obj in objects.items()}
    root, info = doc.trailer.get("Root"), doc.trailer.get("Info")
    return (objects, root.num, info.num if isinstance(info, Ref) and info.num in objects else None), log


def repair(data: bytes, options: RepairOptions | None = None) -> tuple[bytes, list[str]]:
    """The file written anew: lengths right, references to nothing as null, as far as the options ask for it; and what was mended."""
    whole, log = mended(data, options)
    return data if whole is None else write_pdf(*whole), log
