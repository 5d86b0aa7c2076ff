"""The content-stream interpreter: operators to characters, painted paths and images of one page."""

from __future__ import annotations

import re
from binascii import unhexlify
from dataclasses import dataclass, field, replace

from platen.sources.pdf.fonts import Font, font_of
from platen.sources.pdf.objects import CODED, Document, Keyword, Lexer, Name, PdfError, Stream

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
AXIS = 1e-6
# Abbreviations of inline images.
SHORT = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width", "G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK"}


def times(m, n):
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def point(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


# Names of colour spaces that stand for their components.
DEVICE = {"DeviceGray": "gray", "G": "gray", "CalGray": "gray", "DeviceRGB": "rgb", "RGB": "rgb", "CalRGB": "rgb", "DeviceCMYK": "cmyk", "CMYK": "cmyk"}
COUNTS = {1: "gray", 3: "rgb", 4: "cmyk"}


def color_space(doc: Document, x, depth: int = 0) -> tuple | None:
    """("gray" | "rgb" | "cmyk" | "other",), ("indexed", base, last, table) or ("tint", count, base) of a colour space object."""
    x = doc.get(x)
    if x is None or depth > 8:
        return None
    if not isinstance(x, list):
        return (DEVICE.get(str(x), "other"),)
    kind = str(doc.get(x[0])) if x else ""
    if kind == "ICCBased":
        d = doc.get(x[1]).dict
        return color_space(doc, d.get("Alternate"), depth + 1) or (COUNTS.get(doc.get(d.get("N")), "other"),)
    if kind in ("Indexed", "I"):
        table = doc.get(x[3])
        return ("indexed", color_space(doc, x[1], depth + 1), int(doc.get(x[2])), doc.decode(table) if isinstance(table, Stream) else bytes(table))
    if kind in ("Separation", "DeviceN"):
        return ("tint", 1 if kind == "Separation" else len(doc.get(x[1])), color_space(doc, x[2], depth + 1))
    return (DEVICE.get(kind, "other"),)


def resolved(n: list[float], space: tuple | None) -> dict | None:
    """A colour by its device components. An index gives its table's entry; one tint is taken for grey, several for the base's components, without the tint function."""
    if not n:
        return None
    kind = space[0] if space else COUNTS.get(len(n), "other")
    if kind == "indexed":
        base, last, table = space[1:]
        size = {"gray": 1, "rgb": 3, "cmyk": 4}.get(base[0] if base else "", 0)
        i = min(max(int(n[0]), 0), last)
        part = table[i * size : (i + 1) * size]
        return resolved([v / 255 for v in part], base) if size and len(part) == size else {"space": "other", "components": n}
    if kind == "tint":
        count, base = space[1:]
        if count > 1:
            return resolved(n, base)
        shades = {"gray": [n[0]], "rgb": [n[0]] * 3, "cmyk": [0.0, 0.0, 0.0, 1.0 - n[0]]}
        return {"space": base[0], "components": shades[base[0]]} if base and base[0] in shades else {"space": "other", "components": n}
    size = {"gray": 1, "rgb": 3, "cmyk": 4}.get(kind)
    return {"space": kind, "components": (n + [0.0] * size)[:size] if size else n}


@dataclass
class State:
    ctm: tuple = IDENTITY
    line_width: float = 1.0
    fill: dict | None = None
    stroke: dict | None = None
    #: Colour spaces of strokes and fills; None: what the number of components says.
    spaces: tuple = (None, None)
    font: Font | None = None
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0


@dataclass
class Found:
    """What a page holds, in stream order, with y up."""

    chars: list[dict] = field(default_factory=list)
    paths: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)


_NUMBER = rb"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))[\t\n\r ]+"
#: A text that is shown at a place, as many writers put it.
_PLACED = re.compile(rb"[\t\n\r ]*" + 6 * _NUMBER + rb"Tm[\t\n\r ]*<((?:[0-9A-Fa-f]{2})*)>[\t\n\r ]*Tj(?=[\t\n\r /<(\[]|\Z)")


class NoRuns(Exception):
    """Characters of this page don't go on by equal steps."""


def exact(*numbers: float) -> bool:
    """Whether sums and whole multiples of these numbers have no rounding."""
    for v in numbers:
        if not (-1e9 < v < 1e9 and (v * 1024).is_integer()):
            return False
    return True


class Interpreter:
    def __init__(self, doc: Document, max_depth: int = 10, image_data: bool = False, chars: bool = True, runs: bool = False, fonts: dict | None = None):
        """Without chars, texts are passed over: nothing else depends on where they stand.

        runs: a shown text is one row, of the box of its first character and the step to
        the next; NoRuns if one has no equal steps without rounding. fonts: those that
        other pages of the file had.
        """
        self.doc, self.max_depth, self.image_data, self.chars, self.runs = doc, max_depth, image_data, chars, runs
        self.fonts: dict = {} if fonts is None else fonts
        self.found = Found()

    def warn(self, code: str, text: str, **more) -> None:
        self.found.warnings.append({"code": code, "description": text} | more)

    def run(self, data: bytes, resources: dict, state: State | None = None, depth: int = 0) -> None:
        if depth > self.max_depth:
            raise PdfError("forms nested too deep")
        self_state = state or State()
        stack: list[State] = []
        marks: list[tuple[str, int | None]] = getattr(self, "marks", [])
        self.marks = marks
        s, args = self_state, []
        tm = tlm = IDENTITY
        path: list[tuple] = []
        here = (0.0, 0.0)
        lex, index = Lexer(data), 0
        num = lambda i: float(args[i]) if i < len(args) and isinstance(args[i], (int, float)) else 0.0

        def show(text: bytes) -> None:
            nonlocal tm
            font = s.font
            if font is None:
                self.warn("MISSING_FONT", "text without a font", operator_index=index)
                return
            if not self.chars:
                return
            if self.runs:
                show_run(font, text)
                return
            mcid = next((m for _, m in reversed(marks) if m is not None), None)
            tag = marks[-1][0] if marks else None
            a, b, c, d, e, f = times(times((s.size * s.scale, 0.0, 0.0, s.size, 0.0, s.rise), tm), s.ctm)
            direction = ("ltr" if a >= 0 else "rtl") if abs(a) >= abs(b) else "btt" if b > 0 else "ttb"
            direction = "ttb" if font.vertical and direction == "ltr" else direction
            upright, flat, ctm = abs(b) < 1e-6 and abs(c) < 1e-6, b == 0 and c == 0, list(s.ctm)
            # what a step of one along the text moves on the page
            along = (tm[2], tm[3]) if font.vertical else (tm[0], tm[1])
            dx, dy = along[0] * s.ctm[0] + along[1] * s.ctm[2], along[0] * s.ctm[1] + along[1] * s.ctm[3]
            low, high, moved, put = font.descent / 1000, font.ascent / 1000, 0.0, self.found.chars.append
            for code, uni, w, origin, space in font.decode(text):
                x, y = e + moved * dx, f + moved * dy
                ox, oy = -origin[0] / 1000, -origin[1] / 1000
                wide = 1.0 if font.vertical else w / 1000
                if flat:
                    x0, x1, y0, y1 = x + a * ox, x + a * (ox + wide), y + d * (oy + low), y + d * (oy + high)
                    x0, x1, y0, y1 = (x0, x1, y0, y1) if x0 <= x1 and y0 <= y1 else (min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1))
                else:
                    corners = [(a * u + c * v + x, b * u + d * v + y) for u in (ox, ox + wide) for v in (oy + low, oy + high)]
                    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
                    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
                put({
                    "text": uni, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "fontname": font.name, "size": s.size, "upright": upright, "direction": direction,
                    "ctm": ctm, "char_code": code, "mcid": mcid, "tag": tag, "stroking_color": s.stroke, "non_stroking_color": s.fill,
                })
                step = w / 1000 * s.size + s.char_space + (s.word_space if space else 0.0)
                moved += step if font.vertical else step * s.scale
            tm = times((1, 0, 0, 1, 0.0, moved), tm) if font.vertical else times((1, 0, 0, 1, moved, 0.0), tm)

        look = known = None

        def show_run(font: Font, text: bytes) -> None:
            nonlocal tm, look, known
            if not text:
                return
            signs, w = font.plain_run(text) or ("", 0.0)
            if not signs:
                raise NoRuns
            m, n = tm, s.ctm
            # what texts that are set alike have in common
            alike = (font, w, s.size, s.scale, s.char_space, s.rise, m[0], m[1], m[2], m[3], n, s.stroke, s.fill, tuple(marks))
            if alike != look:
                a, b, c, d, _, _ = times(times((s.size * s.scale, 0.0, 0.0, s.size, 0.0, s.rise), m), n)
                dx, dy = m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3]
                step, wide = (w / 1000 * s.size + s.char_space) * s.scale, a * (w / 1000)
                if b or c or dy or not exact(step, dx, wide):
                    raise NoRuns
                mcid = next((k for _, k in reversed(marks) if k is not None), None)
                same = {
                    "fontname": font.name, "size": s.size, "upright": True, "direction": "ltr" if a >= 0 else "rtl", "ctm": list(n), "mcid": mcid, "tag": marks[-1][0] if marks else None,
                    "stroking_color": s.stroke, "non_stroking_color": s.fill, "step_x": step * dx, "step_y": 0.0, "step_index": 1,
                }
                look, known = alike, (step, step * dx, min(wide, 0.0), max(wide, 0.0), *sorted((d * (font.descent / 1000), d * (font.ascent / 1000))), same)
            step, along, left, right, low, high, same = known
            x, y = s.rise * m[2] + m[4], s.rise * m[3] + m[5]
            x, y = x * n[0] + y * n[2] + n[4], x * n[1] + y * n[3] + n[5]
            if not exact(x, along * len(signs)):
                raise NoRuns
            self.found.chars.append(same | {"text": signs, "x0": x + left, "x1": x + right, "y0": y + low, "y1": y + high})
            moved = step * len(signs)
            tm = (m[0], m[1], m[2], m[3], moved * m[0] + m[4], moved * m[1] + m[5])

        def color(values: list, space) -> dict | None:
            return resolved([float(v) for v in values if isinstance(v, (int, float))], space)

        def paint(stroke: bool, fill: bool) -> None:
            nonlocal path
            if path:
                self.found.paths.append({"segments": path, "stroke": stroke, "fill": fill, "line_width": s.line_width, "stroke_color": s.stroke, "fill_color": s.fill})
            path = []

        def at(x, y):
            return point(s.ctm, x, y)

        while True:
            if not args and (m := _PLACED.match(data, lex.pos)):
                lex.pos, index = m.end(), index + 2
                tm = tlm = tuple(map(float, m.groups()[:6]))
                show(unhexlify(m[7]))
                continue
            try:
                x = lex.next()
            except (PdfError, ValueError, IndexError):
                lex.pos += 1
                args = []
                continue
            if x is None:
                break
            if not isinstance(x, Keyword):
                args.append(x)
                continue
            op, index = bytes(x), index + 1
            if op == b"q":
                stack.append(replace(s))
            elif op == b"Q":
                s = stack.pop() if stack else s
            elif op == b"cm":
                s.ctm = times(tuple(num(i) for i in range(6)), s.ctm)
            elif op == b"w":
                s.line_width = num(0)
            elif op == b"gs":
                gs = self.doc.get(self._resource(resources, "ExtGState", args))
                if isinstance(gs, dict) and isinstance(self.doc.get(gs.get("LW")), (int, float)):
                    s.line_width = float(self.doc.get(gs["LW"]))
            elif op in (b"g", b"rg", b"k"):
                s.fill, s.spaces = color(args, None), (s.spaces[0], None)
            elif op in (b"G", b"RG", b"K"):
                s.stroke, s.spaces = color(args, None), (None, s.spaces[1])
            elif op in (b"CS", b"cs"):
                space = self._space(resources, args)
                s.spaces = (space, s.spaces[1]) if op == b"CS" else (s.spaces[0], space)
            elif op in (b"SC", b"SCN"):
                s.stroke = color(args, s.spaces[0])
            elif op in (b"sc", b"scn"):
                s.fill = color(args, s.spaces[1])
            elif op == b"BT":
                tm = tlm = IDENTITY
            elif op == b"Tf":
                s.size = num(1)
                s.font = self._font(resources, args, index)
            elif op == b"Tm":
                tm = tlm = tuple(num(i) for i in range(6))
            elif op in (b"Td", b"TD"):
                if op == b"TD":
                    s.leading = -num(1)
                tm = tlm = times((1, 0, 0, 1, num(0), num(1)), tlm)
            elif op == b"T*":
                tm = tlm = times((1, 0, 0, 1, 0, -s.leading), tlm)
            elif op == b"Tc":
                s.char_space = num(0)
            elif op == b"Tw":
                s.word_space = num(0)
            elif op == b"Tz":
                s.scale = num(0) / 100
            elif op == b"TL":
                s.leading = num(0)
            elif op == b"Ts":
                s.rise = num(0)
            elif op == b"Tj" and args and isinstance(args[-1], bytes):
                show(args[-1])
            elif op in (b"'", b'"'):
                if op == b'"' and len(args) >= 3:
                    s.word_space, s.char_space = num(0), num(1)
                tm = tlm = times((1, 0, 0, 1, 0, -s.leading), tlm)
                if args and isinstance(args[-1], bytes):
                    show(args[-1])
            elif op == b"TJ" and args and isinstance(args[-1], list):
                for part in args[-1]:
                    if isinstance(part, bytes):
                        show(part)
                    elif isinstance(part, (int, float)):
                        step = -part / 1000 * s.size
                        tm = times((1, 0, 0, 1, 0.0, step), tm) if s.font and s.font.vertical else times((1, 0, 0, 1, step * s.scale, 0.0), tm)
            elif op == b"Do":
                self._object(resources, args, s, depth, index)
            elif op == b"m":
                here = at(num(0), num(1))
                path.append(("m", here))
            elif op == b"l":
                here = at(num(0), num(1))
                path.append(("l", here))
            elif op in (b"c", b"v", b"y"):
                pts = [at(num(i), num(i + 1)) for i in range(0, 6 if op == b"c" else 4, 2)]
                pts = [here, *pts] if op == b"v" else [*pts, pts[-1]] if op == b"y" else pts
                here = pts[-1]
                path.append(("c", *pts))
            elif op == b"re":
                x0, y0, w, h = (num(i) for i in range(4))
                here = at(x0, y0)
                path += [("m", here), ("l", at(x0 + w, y0)), ("l", at(x0 + w, y0 + h)), ("l", at(x0, y0 + h)), ("h",)]
            elif op == b"h":
                path.append(("h",))
            elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"):
                if op in (b"s", b"b", b"b*"):
                    path.append(("h",))
                if op == b"n":
                    path = []
                else:
                    paint(op in (b"S", b"s", b"B", b"B*", b"b", b"b*"), op not in (b"S", b"s"))
            elif op == b"BMC":
                marks.append((str(args[0]) if args else "", None))
            elif op == b"BDC":
                props = args[1] if len(args) > 1 else None
                if isinstance(props, Name):
                    props = self.doc.get(self._resource(resources, "Properties", [props]))
                mcid = self.doc.get(props.get("MCID")) if isinstance(props, dict) else None
                marks.append((str(args[0]) if args else "", mcid if isinstance(mcid, int) else None))
            elif op == b"EMC":
                if marks:
                    marks.pop()
            elif op == b"BI":
                self._inline(lex, s, index)
            args = []

    def _resource(self, resources: dict, kind: str, args: list):
        group = self.doc.get(resources.get(kind))
        return group.get(str(args[0])) if isinstance(group, dict) and args else None

    def _space(self, resources: dict, args: list):
        own = self.doc.get(self._resource(resources, "ColorSpace", args))
        try:
            return color_space(self.doc, own if own is not None else args[0] if args else None)
        except (PdfError, ValueError, TypeError, IndexError, AttributeError):
            return ("other",)

    def _font(self, resources: dict, args: list, index: int) -> Font | None:
        ref = self._resource(resources, "Font", args)
        key = ref if ref.__hash__ else id(ref)
        if key not in self.fonts:
            try:
                self.fonts[key] = font_of(self.doc, ref)
            except (PdfError, ValueError, TypeError, KeyError, IndexError, AttributeError) as e:
                self.fonts[key] = None
                self.warn("FONT_ERROR", str(e), operator_index=index)
        if self.fonts[key] is None:
            self.warn("MISSING_FONT", f"no font {args[0] if args else ''}", operator_index=index)
        return self.fonts[key]

    def _object(self, resources: dict, args: list, s: State, depth: int, index: int) -> None:
        obj = self.doc.get(self._resource(resources, "XObject", args))
        if not isinstance(obj, Stream):
            self.warn("MISSING_XOBJECT", f"no object {args[0] if args else ''}", operator_index=index)
            return
        kind = self.doc.get(obj.dict.get("Subtype"))
        if kind == "Image":
            self._image(obj, str(args[0]), s)
        elif kind == "Form":
            m = self.doc.get(obj.dict.get("Matrix")) or list(IDENTITY)
            inner = replace(s, ctm=times(tuple(float(self.doc.get(v) or 0) for v in m), s.ctm))
            own = self.doc.get(obj.dict.get("Resources"))
            if depth >= self.max_depth:
                raise PdfError("forms nested too deep")
            try:
                self.run(self.doc.decode(obj), own if isinstance(own, dict) else resources, inner, depth + 1)
            except PdfError as e:
                if "too deep" in str(e):
                    raise
                self.warn("XOBJECT_ERROR", str(e), operator_index=index)

    def _image(self, obj: Stream, name: str, s: State) -> None:
        d = {k: self.doc.get(v) for k, v in obj.dict.items()}
        corners = [point(s.ctm, x, y) for x in (0, 1) for y in (0, 1)]
        xs, ys = [p[0] for p in corners], [p[1] for p in corners]
        space = d.get("ColorSpace")
        space = self.doc.get(space[0]) if isinstance(space, list) and space else space
        filters = [f for f, _ in self.doc.filters(obj)]
        row = {"name": name, "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "src_width": d.get("Width"), "src_height": d.get("Height"), "bits_per_component": d.get("BitsPerComponent"), "color_space": str(space) if space else None, "filter": filters[-1] if filters else None, "data": None}
        if self.image_data:
            try:
                row["data"] = obj.raw if filters and filters[-1] in CODED and len(filters) == 1 else self.doc.decode(obj)
            except (PdfError, ValueError) as e:
                self.warn("IMAGE_ERROR", str(e), element=name)
        self.found.images.append(row)

    def _inline(self, lex: Lexer, s: State, index: int) -> None:
        items = []
        while True:
            x = lex.next()
            if x is None or (isinstance(x, Keyword) and x == b"ID"):
                break
            items.append(x)
        d = {SHORT.get(str(k), str(k)): (Name(SHORT.get(str(v), str(v))) if isinstance(v, Name) else v) for k, v in zip(items[::2], items[1::2], strict=False)}
        begin = lex.pos + 1
        m = re.compile(rb"[\s]EI(?=[\s]|\Z)").search(lex.data, begin)
        end = m.start() if m else len(lex.data)
        lex.pos = m.end() if m else len(lex.data)
        self._image(Stream(d, lex.data[begin:end]), f"inline-{index}", s)


def shapes(path: dict, height: float) -> tuple[list[dict], list[dict], list[dict]]:
    """Lines, rectangles and curves of a painted path, with y down."""
    lines, rects, curves = [], [], []
    look = {k: path[k] for k in ("line_width", "stroke_color")}
    parts: list[list[tuple]] = []
    for seg in path["segments"]:
        if seg[0] == "m" or not parts:
            parts.append([])
        parts[-1].append(seg)
    flip = lambda p: (p[0], height - p[1])

    def line(a, b):
        kind = "horizontal" if abs(a[1] - b[1]) < AXIS else "vertical" if abs(a[0] - b[0]) < AXIS else "diagonal"
        lines.append({"x0": min(a[0], b[0]), "top": min(a[1], b[1]), "x1": max(a[0], b[0]), "bottom": max(a[1], b[1]), "orientation": kind} | look)

    for part in parts:
        ends = [flip(seg[-1]) for seg in part if seg[0] != "h"]
        closed = any(seg[0] == "h" for seg in part)
        if any(seg[0] == "c" for seg in part):
            here = ends[0] if ends else (0.0, height)
            for seg in part:
                if seg[0] == "c":
                    pts = [here, *map(flip, seg[1:])]
                    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
                    curves.append({"x0": min(xs), "top": min(ys), "x1": max(xs), "bottom": max(ys), "pts": [{"x": x, "y": y} for x, y in pts], "stroke": path["stroke"], "fill": path["fill"], "fill_color": path["fill_color"]} | look)
                elif seg[0] == "l" and path["stroke"]:
                    line(here, flip(seg[1]))
                if seg[0] != "h":
                    here = flip(seg[-1])
            continue
        if not ends:
            continue
        corner = ends
        if len(ends) == 5 and abs(ends[0][0] - ends[4][0]) < AXIS and abs(ends[0][1] - ends[4][1]) < AXIS:
            corner, closed = ends[:4], True
        if closed and len(corner) == 4 and _is_box(corner):
            xs, ys = [p[0] for p in corner], [p[1] for p in corner]
            rects.append({"x0": min(xs), "top": min(ys), "x1": max(xs), "bottom": max(ys), "stroke": path["stroke"], "fill": path["fill"], "fill_color": path["fill_color"]} | look)
        elif path["stroke"]:
            for a, b in zip(ends, [*ends[1:], ends[0]] if closed and len(ends) > 2 else ends[1:], strict=False):
                line(a, b)
    return lines, rects, curves


def _is_box(c: list[tuple]) -> bool:
    sides = list(zip(c, [*c[1:], c[0]], strict=True))
    flat = [abs(a[1] - b[1]) < AXIS for a, b in sides]
    tall = [abs(a[0] - b[0]) < AXIS for a, b in sides]
    return (flat[0] and tall[1] and flat[2] and tall[3]) or (tall[0] and flat[1] and tall[2] and flat[3])
