"""The table finder of one page in memory: what find_tables runs per page.

Snapping, joining, crossing and gathering cells all work on the few edges of a
page, so one exchange by page and one kernel replace a dozen joins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from platen.operators.bidi_signs import is_arabic_mark_text
from platen.options import TableSettings, WordOptions

Edge = tuple[float, float, float, float, str]
Rect = tuple[float, float, float, float]
_SPACES = set("\t\n\x0b\x0c\r \x85\xa0       　") | {chr(c) for c in range(0x2000, 0x200B)}


def blank(text: str) -> bool:
    return all(c in _SPACES for c in text)


def anchored(values: list[float], tolerance: float) -> dict[float, int]:
    """Group of each value: a new one where the distance to the group's first passes the tolerance."""
    out: dict[float, int] = {}
    anchor, no = None, -1
    for v in sorted(set(values)):
        if anchor is None or abs(v - anchor) > tolerance:
            anchor, no = v, no + 1
        out[v] = no
    return out


def snap(edges: list[Edge], x_tol: float, y_tol: float) -> list[Edge]:
    out = [e for e in edges if e[4] == "diagonal"]
    for direction, k, tolerance in (("horizontal", 1, y_tol), ("vertical", 0, x_tol)):
        own = [e for e in edges if e[4] == direction]
        group = anchored([e[k] for e in own], tolerance)
        sums: dict[int, list[float]] = {}
        for e in own:
            sums.setdefault(group[e[k]], []).append(e[k])
        mean = {g: sum(v) / len(v) for g, v in sums.items()}
        for e in own:
            m = mean[group[e[k]]]
            out.append((e[0], m, e[2], m, direction) if k else (m, e[1], m, e[3], direction))
    return out


def join(edges: list[Edge], x_tol: float, y_tol: float) -> list[Edge]:
    out = [e for e in edges if e[4] == "diagonal"]
    for direction, k, a, b, tolerance in (("horizontal", 1, 0, 2, x_tol), ("vertical", 0, 1, 3, y_tol)):
        own = sorted((e[k], e[a], e[b]) for e in edges if e[4] == direction)
        runs: list[list[float]] = []
        for at, start, stop in own:
            if runs and runs[-1][0] == at and start <= runs[-1][2] + tolerance:
                runs[-1][2] = max(runs[-1][2], stop)
            else:
                runs.append([at, start, stop])
        out += [(s, at, e, at, direction) if k else (at, s, at, e, direction) for at, s, e in runs]
    return out


def cells(edges: list[Edge], x_tol: float, y_tol: float) -> list[Rect]:
    """Whole grid cells, then cells merged along a row over columns some whole cell has."""
    h = [e for e in edges if e[4] == "horizontal"]
    v = [e for e in edges if e[4] == "vertical"]
    points = {(b[0], a[1]) for a in h for b in v if a[0] - x_tol <= b[0] <= a[2] + x_tol and b[1] - y_tol <= a[1] <= b[3] + y_tol}
    xs, ys = sorted({p[0] for p in points}), sorted({p[1] for p in points})
    rows: dict[float, list[Edge]] = {y: [e for e in h if abs(e[1] - y) <= y_tol] for y in ys}
    cols: dict[float, list[Edge]] = {x: [e for e in v if abs(e[0] - x) <= x_tol] for x in xs}
    across = lambda x0, x1, y: any(e[0] <= x0 + x_tol and e[2] >= x1 - x_tol for e in rows[y])
    down = lambda x, top, bottom: any(e[1] <= top + y_tol and e[3] >= bottom - y_tol for e in cols[x])
    bands, spans = list(zip(ys, ys[1:], strict=False)), list(zip(xs, xs[1:], strict=False))
    whole = [(x0, top, x1, bottom) for top, bottom in bands for x0, x1 in spans if across(x0, x1, top) and across(x0, x1, bottom) and down(x0, top, bottom) and down(x1, top, bottom)]
    known = {round(x * 1000) for c in whole for x in (c[0], c[2])}
    found, have = list(whole), set(whole)
    for top, bottom in bands:
        ruled = [x for x in xs if round(x * 1000) in known and down(x, top, bottom)]
        for x0, x1 in zip(ruled, ruled[1:], strict=False):
            if (x0, top, x1, bottom) not in have and across(x0, x1, top) and across(x0, x1, bottom):
                found.append((x0, top, x1, bottom))
    return found


def tables(found: list[Rect]) -> list[list[Rect]]:
    """Cells that share a boundary, as tables by top and x0. Neighbours are sought by shared coordinates."""
    parent = list(range(len(found)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    eps = 1e-6
    by: dict[tuple[int, int], list[int]] = {}
    for i, c in enumerate(found):
        for axis in (0, 1):
            for value in {round(c[axis] * 1000), round(c[axis + 2] * 1000)}:
                by.setdefault((axis, value), []).append(i)
    for (axis, _), group in by.items():
        other = 1 - axis
        group.sort(key=lambda i: found[i][other])
        for n, i in enumerate(group):
            a = found[i]
            for j in group[n + 1 :]:
                b = found[j]
                if b[other] >= a[other + 2] + eps:
                    break
                if abs(a[axis + 2] - b[axis]) < eps or abs(a[axis] - b[axis + 2]) < eps:
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    groups: dict[int, list[Rect]] = {}
    for i, c in enumerate(found):
        groups.setdefault(find(i), []).append(c)
    return sorted(groups.values(), key=lambda g: (min(c[1] for c in g), min(c[0] for c in g)))


def words_of(chars: list[dict], o: WordOptions) -> list[dict]:
    """Words of characters in stream order."""
    out: list[dict] = []
    for down in (False, True):
        own = [c for c in chars if (c["direction"] in ("ttb", "btt")) == down]
        if own:
            out += _words(own, o, down or o.text_direction in ("ttb", "btt"), "ttb" if down else o.text_direction)
    return out


def _words(chars: list[dict], o: WordOptions, down: bool, direction: str) -> list[dict]:
    if not o.use_text_flow:
        across = (lambda c: -c["x0"]) if down else (lambda c: c["top"])
        tolerance = o.x_tolerance if down else o.y_tolerance
        chars = sorted(chars, key=across)
        rows: list[list[dict]] = []
        for c in chars:
            if rows and abs(across(c) - across(rows[-1][-1])) <= tolerance:
                rows[-1].append(c)
            else:
                rows.append([c])
        along = {"ttb": lambda c: c["top"], "btt": lambda c: -c["bottom"]}.get(direction, lambda c: c["x0"])
        chars = []
        for row in rows:
            backward = direction == "rtl" and len(row) > 1 and sum(b["x0"] >= a["x0"] for a, b in zip(row, row[1:], strict=False)) < len(row) // 2
            chars += sorted(row, key=(lambda c: -c["x0"]) if backward else along)
    words: list[list[dict]] = []
    fresh = True
    for c in chars:
        if not o.keep_blank_chars and blank(c["text"]):
            fresh = True
            continue
        if not fresh and not _parted(words[-1][-1], c, o, down):
            words[-1].append(c)
        else:
            words.append([c])
        fresh = False
    return [{"text": "".join(c["text"] for c in w), "x0": min(c["x0"] for c in w), "top": min(c["top"] for c in w), "x1": max(c["x1"] for c in w), "bottom": max(c["bottom"] for c in w), "direction": w[0]["direction"]} for w in words]


def _parted(a: dict, b: dict, o: WordOptions, down: bool) -> bool:
    if down:
        return max(a["top"], b["top"]) - min(a["bottom"], b["bottom"]) > max(o.y_tolerance, 0) or abs(a["x0"] - b["x0"]) > o.x_tolerance
    if is_arabic_mark_text(a["text"]) or is_arabic_mark_text(b["text"]):
        return False
    return max(max(a["x0"], b["x0"]) - min(a["x1"], b["x1"]), 0) > o.x_tolerance or abs(a["top"] - b["top"]) > o.y_tolerance


def _row_text(chars: list[dict], x_tol: float) -> str | None:
    """Text of left-to-right characters of one top: words by gaps."""
    words: list[str] = []
    x0 = x1 = None
    for c in sorted(chars, key=lambda c: c["x0"]):
        text = c["text"]
        if blank(text):
            x0 = None
            continue
        if x0 is not None and max(x0, c["x0"]) - min(x1, c["x1"]) <= max(x_tol, 0):
            words[-1] += text
        else:
            words.append(text)
        x0, x1 = c["x0"], c["x1"]
    return " ".join(words) if words else None


def cell_text(chars: list[dict], x_tol: float, y_tol: float) -> str | None:
    if not chars:
        return None
    top = chars[0]["top"]
    if x_tol >= 0 and all(c["top"] == top and c["direction"] == "ltr" and c["text"].isascii() for c in chars):
        return _row_text(chars, x_tol)
    words = words_of(chars, WordOptions(x_tolerance=x_tol, y_tolerance=y_tol))
    if not words:
        return None
    down = sum(w["direction"] in ("ttb", "btt") for w in words) * 2 > len(words)
    place, along = ("x0", "top") if down else ("top", "x0")
    lines: list[list[dict]] = []
    for w in sorted(words, key=lambda w: (w[place], w[along])):
        if lines and abs(w[place] - lines[-1][0][place]) <= (x_tol if down else y_tol):
            lines[-1].append(w)
        else:
            lines.append([w])
    return "\n".join(" ".join(w["text"] for w in sorted(line, key=lambda w: w[along])) for line in lines)


def gridded(filled: list[tuple[Rect, str | None]], copy: bool) -> list[tuple[Rect, str | None]]:
    """Merged cells cut into the parts of their table's grid."""
    def coordinates(values):
        out: list[float] = []
        for x in sorted(values):
            if not out or x - out[-1] >= 1e-6:
                out.append(x)
        return out

    xs = coordinates(x for c, _ in filled for x in (c[0], c[2]))
    ys = coordinates(y for c, _ in filled for y in (c[1], c[3]))
    out = []
    for top, bottom in zip(ys, ys[1:], strict=False):
        for x0, x1 in zip(xs, xs[1:], strict=False):
            x, y = (x0 + x1) / 2, (top + bottom) / 2
            own = next(((c, t) for c, t in filled if c[0] - 1e-6 <= x <= c[2] + 1e-6 and c[1] - 1e-6 <= y <= c[3] + 1e-6), None)
            if own:
                first = abs(x0 - own[0][0]) < 1e-6 and abs(top - own[0][1]) < 1e-6
                out.append(((x0, top, x1, bottom), own[1] if copy or first else None))
    return out


def page_cells(edges: list[Edge], chars: list[dict], s: TableSettings) -> list[tuple]:
    """(table_index, row_index, col_index, x0, top, x1, bottom, text) of a page."""
    edges = [e for e in edges if ((e[2] - e[0]) ** 2 + (e[3] - e[1]) ** 2) ** 0.5 >= s.edge_min_length]
    edges = join(snap(edges, s.snap_x_tolerance, s.snap_y_tolerance), s.join_x_tolerance, s.join_y_tolerance)
    # by height, so that a cell looks at the characters of its band alone, in their order
    middles = sorted(((c["top"] + c["bottom"]) / 2, i, (c["x0"] + c["x1"]) / 2, c) for i, c in enumerate(chars))
    heights = [m[0] for m in middles]

    def inside(c: Rect) -> list[dict]:
        band = middles[bisect_left(heights, c[1]) : bisect_right(heights, c[3])]
        return [m[3] for m in sorted((m for m in band if c[0] <= m[2] <= c[2]), key=lambda m: m[1])]

    out, index = [], 0
    for group in tables(cells(edges, s.intersection_x_tolerance, s.intersection_y_tolerance)):
        filled = [(c, cell_text(inside(c), s.text_x_tolerance, s.text_y_tolerance)) for c in group]
        filled = gridded(filled, s.duplicate_merged_content)
        if s.min_accuracy is not None:
            share = sum(t is not None and not blank(t) for _, t in filled) / len(filled) if filled else 0.0
            if share < s.min_accuracy:
                continue
        rows = {k: i for i, k in enumerate(sorted({round(c[1] * 1000) for c, _ in filled}))}
        cols = {k: i for i, k in enumerate(sorted({round(c[0] * 1000) for c, _ in filled}))}
        out += [(index, rows[round(c[1] * 1000)], cols[round(c[0] * 1000)], *c, t) for c, t in filled]
        index += 1
    return out


