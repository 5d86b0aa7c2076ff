"""Lines, blocks, columns and page text. Lines and blocks grow greedily, so they are page kernels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from platen.operators.batches import joined, lists, page_batches, page_numbers, run_starts
from platen.operators.pages import PAGE, page_kernel
from platen.operators.words import needed, order_of, words_of_pages
from platen.options import TextOptions, WordOptions

BOX = ["x0", "top", "x1", "bottom"]


class Box:
    """Something with a box that grows as members join."""

    __slots__ = ("bottom", "items", "top", "x0", "x1")

    def __init__(self, item, box):
        self.items = [item]
        self.x0, self.top, self.x1, self.bottom = box

    def add(self, item, box):
        self.items.append(item)
        self.x0, self.top = min(self.x0, box[0]), min(self.top, box[1])
        self.x1, self.bottom = max(self.x1, box[2]), max(self.bottom, box[3])

    @property
    def middle(self) -> float:
        return (self.top + self.bottom) / 2

    @property
    def box(self) -> tuple:
        return self.x0, self.top, self.x1, self.bottom


def lines_of(words: list[dict], tolerance: float) -> list[Box]:
    """Each word joins the first open line whose middle, as it is then, is within tolerance; lines are sought by slices of the page near the word."""
    slice_height = tolerance if tolerance > 0 else 1e-9
    where = lambda y: math.floor(y / slice_height)
    lines: list[Box] = []
    slices: dict[int, list[int]] = {}
    for w in sorted(words, key=lambda w: (w["top"], w["x0"])):
        box = tuple(w[c] for c in BOX)
        middle = (w["top"] + w["bottom"]) / 2
        near = (i for d in (-1, 0, 1) for i in slices.get(where(middle) + d, ()))
        i = next((i for i in near if abs(middle - lines[i].middle) <= tolerance), None)
        if i is None:
            slices.setdefault(where(middle), []).append(len(lines))
            lines.append(Box(w, box))
            continue
        old = where(lines[i].middle)
        lines[i].add(w, box)
        if (new := where(lines[i].middle)) != old:
            slices[old].remove(i)
            slices.setdefault(new, []).append(i)
    for line in lines:
        backward = sum(w["direction"] == "rtl" for w in line.items) > len(line.items) // 2
        line.items.sort(key=lambda w: -w["x0"] if backward else w["x0"])
    return sorted(lines, key=lambda x: x.top)


def split_at_columns(lines: list[Box], x_density: float) -> list[Box]:
    out = []
    for line in lines:
        part = None
        for w in line.items:
            box = tuple(w[c] for c in BOX)
            if part is not None and w["x0"] - part.x1 <= x_density:
                part.add(w, box)
            else:
                out.append(part := Box(w, box))
    return sorted(out, key=lambda x: (x.top, x.x0))


def blocks_of(lines: list[Box], y_density: float) -> list[Box]:
    """Each line joins the closest block above that it overlaps in x."""
    blocks: list[Box] = []
    for line in lines:
        near = [(gap, i) for i, b in enumerate(blocks) if 0 <= (gap := line.top - b.bottom) <= y_density and line.x0 < b.x1 and b.x0 < line.x1]
        if near:
            blocks[min(near)[1]].add(line, line.box)
        else:
            blocks.append(Box(line, line.box))
    for b in blocks:
        b.items.sort(key=lambda x: x.top)
    return blocks


def column_boundaries(words: list[dict], min_gap: float, max_columns: int) -> list[float]:
    """Middles of wide gaps within lines, gathered while near the running mean of their group."""
    if not words or max_columns <= 1:
        return []
    return gathered(sorted((a["x1"] + b["x0"]) / 2 for line in lines_of(words, 3.0) for a, b in zip(line.items, line.items[1:], strict=False) if b["x0"] - a["x1"] >= min_gap), min_gap, max_columns)


def gathered(middles: list[float], min_gap: float, max_columns: int) -> list[float]:
    means, total, count = [], 0.0, 0
    for m in middles:
        if count and abs(m - total / count) > min_gap:
            means.append(total / count)
            total, count = 0.0, 0
        total, count = total + m, count + 1
    if count:
        means.append(total / count)
    return means[: max_columns - 1]


def reading_order(blocks: list[Box], boundaries: list[float]) -> list[Box]:
    """By top and x0; a run of blocks that stand beside others goes column by column."""
    blocks = list(blocks)
    rank = sorted(range(len(blocks)), key=lambda i: (blocks[i].top, blocks[i].x0))
    if not boundaries:
        return [blocks[i] for i in rank]
    column = [sum(b.x0 >= x for x in boundaries) for b in blocks]
    beside = [any(column[i] != column[j] and a.top < b.bottom and b.top < a.bottom for j, b in enumerate(blocks)) for i, a in enumerate(blocks)]
    out: list[int] = []
    run: list[int] = []
    for i in [*rank, None]:
        if i is not None and beside[i]:
            run.append(i)
            continue
        out += sorted(run, key=lambda k: (column[k], blocks[k].top))
        run = []
        if i is not None:
            out.append(i)
    return [blocks[i] for i in out]


WORD_COLUMNS = [*PAGE, "word_index", "text", *BOX, "direction", "fontname", "size"]
LINES = "doc_id long, page_number int, line_index long, text string, x0 double, top double, x1 double, bottom double, word_ids array<long>"


def line_order(words: pa.Table, page: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words by page and line, and the first words of lines: (order, starts, page of each word in order).

    Where the words of a page stand in rows of equal top and bottom whose middles
    lie more than the tolerance apart, the rows are the lines; other pages, and
    those with text from right to left, grow their lines word by word.
    """
    x0, top, bottom, index = (np.asarray(words.column(c)) for c in ("x0", "top", "bottom", "word_index"))
    middle = (top + bottom) / 2
    rtl = np.asarray(pc.fill_null(pc.equal(words.column("direction"), "rtl"), False))
    order = np.lexsort((index, x0, bottom, top, page))
    p, t, b, m = page[order], top[order], bottom[order], middle[order]
    starts = run_starts(p, t, b)
    by_middle = np.lexsort((m[starts], p[starts]))
    q, y = p[starts][by_middle], m[starts][by_middle]
    near = (q[1:] == q[:-1]) & ~(y[1:] - y[:-1] > tolerance)
    odd = np.zeros(int(page.max(initial=-1)) + 1, bool)
    odd[q[1:][near]] = True
    odd[page[rtl]] = True
    # lines go by top
    if not odd.any():
        return order, starts, p
    plain = ~odd[p]
    head = np.zeros(len(order), bool)
    head[starts] = True
    parts, heads = [order[plain]], [head[plain]]
    for k in np.flatnonzero(odd).tolist():
        own = np.flatnonzero(page == k)
        own = own[np.argsort(index[own], kind="stable")]
        rows = words.take(pa.array(own)).select(["x0", "top", "x1", "bottom", "direction"]).to_pylist()
        for i, r in enumerate(rows):
            r["at"] = int(own[i])
        for line in lines_of(rows, tolerance):
            parts.append(np.array([w["at"] for w in line.items]))
            heads.append(np.arange(len(line.items)) == 0)
    order, head = np.concatenate(parts), np.concatenate(heads)
    stable = np.argsort(page[order], kind="stable")
    order, head = order[stable], head[stable]
    return order, np.flatnonzero(head), page[order]


def lines_of_pages(words: pa.Table, page: np.ndarray, tolerance: float) -> pa.Table:
    order, starts, p = line_order(words, page, tolerance)
    words = words.take(pa.array(order))
    last = np.zeros(len(order), bool)
    last[np.append(starts[1:], len(order)) - 1] = True
    text = pc.binary_join_element_wise(words.column("text"), pa.array(np.where(last, "", " ")), "")
    least = lambda c: np.minimum.reduceat(np.asarray(words.column(c)), starts)
    most = lambda c: np.maximum.reduceat(np.asarray(words.column(c)), starts)
    own = p[starts]
    first = run_starts(own)
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    heads = words.take(pa.array(starts))
    return pa.table({
        "doc_id": heads.column("doc_id"), "page_number": heads.column("page_number"), "line_index": pa.array(nth), "text": joined(text, starts),
        "x0": pa.array(least("x0")), "top": pa.array(least("top")), "x1": pa.array(most("x1")), "bottom": pa.array(most("bottom")), "word_ids": lists(np.asarray(words.column("word_index")), starts),
    })


def text_of_pages(words: pa.Table, page: np.ndarray, tolerance: float) -> pa.Table:
    """Lines of each page, one under another."""
    order, starts, p = line_order(words, page, tolerance)
    words = words.take(pa.array(order))
    pages = run_starts(p)
    between = np.full(len(order), " ", object)
    between[starts - 1] = "\n"
    between[np.append(pages[1:], len(order)) - 1] = ""
    text = pc.binary_join_element_wise(words.column("text"), pa.array(between, pa.string()), "")
    heads = words.take(pa.array(pages))
    return pa.table({"doc_id": heads.column("doc_id"), "page_number": heads.column("page_number"), "text": joined(text, pages)})


def columns_of_pages(words: pa.Table, page: np.ndarray, min_gap: float, max_columns: int) -> pa.Table:
    """column_boundaries of many pages."""
    order, starts, p = line_order(words, page, 3.0)
    x0, x1 = (np.asarray(words.column(c))[order] for c in ("x0", "x1"))
    head = np.zeros(len(order), bool)
    head[starts] = True
    wide = np.flatnonzero(~head[1:] & (x0[1:] - x1[:-1] >= min_gap))
    middles: dict[int, list[float]] = {}
    for k, m in zip(p[wide].tolist(), ((x1[wide] + x0[wide + 1]) / 2).tolist(), strict=True):
        middles.setdefault(k, []).append(m)
    pages = run_starts(page)
    heads = words.take(pa.array(pages))
    found = [gathered(sorted(middles.get(k, [])), min_gap, max_columns) if max_columns > 1 else [] for k in page[pages].tolist()]
    return pa.table({"doc_id": heads.column("doc_id"), "page_number": heads.column("page_number"), "boundaries": pa.array(found, pa.list_(pa.float64()))})


def text_lines(words: DataFrame, y_tolerance: float = 3.0) -> DataFrame:
    """doc_id, page_number, line_index, text, box, word_ids."""
    return page_batches(words.select(*WORD_COLUMNS), lambda table, page: lines_of_pages(table, page, y_tolerance), LINES)


def blocks_on_page(rows: list[dict], o: TextOptions) -> list[Box]:
    blocks = blocks_of(split_at_columns(lines_of(rows, o.y_tolerance), o.x_density), o.y_density)
    if o.columns is None:
        return reading_order(blocks, [])
    if o.columns == "auto":
        return reading_order(blocks, column_boundaries(rows, o.min_column_gap, o.max_columns))
    return reading_order(blocks, sorted(o.columns))


def line_text(line: Box) -> str:
    return " ".join(w["text"] for w in line.items)


BLOCKS = "doc_id long, page_number int, block_index long, text string, x0 double, top double, x1 double, bottom double, n_lines long, word_ids array<long>"


def blocks_kernel(o: TextOptions) -> Callable[[list[dict]], list[tuple]]:
    def kernel(rows: list[dict]) -> list[tuple]:
        return [(i, "\n".join(map(line_text, b.items)), *b.box, len(b.items), [w["word_index"] for x in b.items for w in x.items]) for i, b in enumerate(blocks_on_page(rows, o))]

    return kernel


def text_blocks(words: DataFrame, options: TextOptions | None = None) -> DataFrame:
    """doc_id, page_number, block_index, text, box, n_lines, word_ids; in reading order."""
    return page_kernel(words.select(*WORD_COLUMNS), blocks_kernel(options or TextOptions(layout=True)), BLOCKS, ["word_index"])


def columns(words: DataFrame, min_gap: float = 20.0, max_columns: int = 6) -> DataFrame:
    """doc_id, page_number, boundaries."""
    return page_batches(words.select(*WORD_COLUMNS), lambda table, page: columns_of_pages(table, page, min_gap, max_columns), COLUMNS)


COLUMNS = "doc_id long, page_number int, boundaries array<double>"
TEXT = "doc_id long, page_number int, text string"


def layout_kernel(o: TextOptions) -> Callable[[list[dict]], list[tuple]]:
    def kernel(rows: list[dict]) -> list[tuple]:
        return [("\n\n".join("\n".join(map(line_text, b.items)) for b in blocks_on_page(rows, o)),)]

    return kernel


def page_text(words: DataFrame, options: TextOptions | None = None) -> DataFrame:
    """doc_id, page_number, text: lines in order, or with layout blocks parted by an empty line."""
    o = options or TextOptions()
    if not o.layout:
        return page_batches(words.select(*WORD_COLUMNS), lambda table, page: text_of_pages(table, page, o.y_tolerance), TEXT)
    return page_kernel(words.select(*WORD_COLUMNS), layout_kernel(o), TEXT, ["word_index"])


# The same of characters or runs of them: words are made where they are used, so that only the input moves.


def over_words(chars: DataFrame, kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, words: WordOptions | None = None, fonts: bool = False) -> DataFrame:
    """kernel(words of whole pages, number of each word's page) -> rows of the schema, in one exchange."""
    w = words or WordOptions()

    def run(table: pa.Table, page: np.ndarray) -> pa.Table | None:
        found = words_of_pages(table, page, w, ids=False)
        return kernel(found, page_numbers(found, PAGE)) if found.num_rows else None

    return page_batches(needed(chars, text_only=not fonts), run, schema, order=order_of(chars))


def each_page(kernel: Callable[[list[dict]], list[tuple]], schema: str) -> Callable[[pa.Table, np.ndarray], pa.Table | None]:
    """kernel(words of one page, in order) -> tuples of what follows the page in the schema."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(words: pa.Table, page: np.ndarray) -> pa.Table | None:
        starts = run_starts(page).tolist()
        keys = words.select(PAGE).take(pa.array(starts)).to_pylist()
        rows = words.drop_columns(PAGE).to_pylist()
        out = [(*key.values(), *t) for key, a, b in zip(keys, starts, [*starts[1:], len(rows)], strict=True) for t in kernel(rows[a:b])]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds) if out else None

    return run


def chars_lines(chars: DataFrame, words: WordOptions | None = None, y_tolerance: float = 3.0) -> DataFrame:
    """text_lines without word_ids."""
    return over_words(chars, lambda table, page: lines_of_pages(table, page, y_tolerance).drop_columns(["word_ids"]), LINES.replace(", word_ids array<long>", ""), words)


def chars_blocks(chars: DataFrame, words: WordOptions | None = None, options: TextOptions | None = None) -> DataFrame:
    """text_blocks."""
    return over_words(chars, each_page(blocks_kernel(options or TextOptions(layout=True)), BLOCKS), BLOCKS, words)


def chars_columns(chars: DataFrame, min_gap: float = 20.0, max_columns: int = 6, words: WordOptions | None = None) -> DataFrame:
    """columns."""
    return over_words(chars, lambda table, page: columns_of_pages(table, page, min_gap, max_columns), COLUMNS, words)


def chars_text(chars: DataFrame, words: WordOptions | None = None, options: TextOptions | None = None) -> DataFrame:
    """page_text."""
    o = options or TextOptions()
    w = words or WordOptions(expand_ligatures=o.expand_ligatures)
    if o.layout:
        return over_words(chars, each_page(layout_kernel(o), TEXT), TEXT, w)
    return over_words(chars, lambda table, page: text_of_pages(table, page, o.y_tolerance), TEXT, w)


def document_text(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """doc_id, text: pages in order."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"))
