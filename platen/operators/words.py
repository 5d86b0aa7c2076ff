"""Words from positioned characters: one exchange by page, then many pages at once as arrays."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from platen.functions.scalars import ARABIC_MARK, LIGATURES, WHITE_SPACE
from platen.operators.batches import STEP_COLUMNS, characters, flags, in_order, joined, lists, page_batches
from platen.operators.pages import PAGE
from platen.options import WordOptions

WORDS = "doc_id long, page_number int, word_index long, text string, x0 double, top double, x1 double, bottom double, doctop double, direction string, fontname string, size double, char_ids array<long>"
NAMES = [part.split(" ")[0] for part in WORDS.split(", ")]
_BLANK, _MARK = re.compile(rf"{WHITE_SPACE}*"), re.compile(rf"{ARABIC_MARK}+")
DOWN = ("ttb", "btt")


def reading_order(group: np.ndarray, vertical: np.ndarray, index: np.ndarray, box: dict[str, np.ndarray], o: WordOptions) -> np.ndarray:
    """Characters by group (those of a page and direction), in reading order: rows are cut at gaps from one character to the next."""
    if o.use_text_flow:
        return in_order(index, group)
    down = vertical | (o.text_direction in DOWN)
    across = np.where(down, -box["x0"], box["top"])
    rough = in_order(index, across, group)
    g, a = group[rough], across[rough]
    new = np.ones(len(rough), bool)
    new[1:] = (g[1:] != g[:-1]) | (a[1:] - a[:-1] > np.where(down, o.x_tolerance, o.y_tolerance)[rough][1:])
    row = np.empty(len(rough), np.int64)
    row[rough] = np.cumsum(new)
    if o.text_direction == "btt":
        along = np.where(vertical, box["top"], -box["bottom"])
    elif o.text_direction == "ttb":
        along = box["top"]
    elif o.text_direction == "rtl":
        # a row that runs from right to left in page order is read that way
        x, r = box["x0"][rough], row[rough]
        rising = np.zeros(len(rough), np.int64)
        rising[1:] = (r[1:] == r[:-1]) & (x[1:] >= x[:-1])
        members, rises = np.bincount(r), np.bincount(r, rising)
        forward = (members < 2) | (rises >= members // 2)
        along = np.where(vertical, box["top"], np.where(forward[row], box["x0"], -box["x0"]))
    else:
        along = np.where(vertical, box["top"], box["x0"])
    return in_order(index, across, along, row)


def words_of_pages(table: pa.Table, page: np.ndarray, o: WordOptions, vertical_first: bool = False, ids: bool = True) -> pa.Table:
    text, row, of = characters(table)
    vertical = np.asarray(pc.fill_null(pc.is_in(table.column("direction"), pa.array(DOWN)), False)).astype(bool)[row]
    page, index = page[row], of("char_index")
    box = {c: of(c) for c in ("x0", "top", "x1", "bottom", "doctop") if c in table.column_names}
    group = page * 2 + (vertical != vertical_first)
    order = reading_order(group, vertical, index, box, o)
    if (order[1:] < order[:-1]).any():
        text, row, page, group, vertical, index = text.take(pa.array(order)), row[order], page[order], group[order], vertical[order], index[order]
        box = {c: v[order] for c, v in box.items()}
    blank, mark = flags(text, lambda t: t is not None and bool(_BLANK.fullmatch(t)), lambda t: t is not None and bool(_MARK.fullmatch(t)))
    x0, top, x1, bottom = (box[c] for c in ("x0", "top", "x1", "bottom"))
    begin = np.ones(len(group), bool)
    same = group[1:] == group[:-1]
    x_gap = np.maximum(np.maximum(x0[:-1], x0[1:]) - np.minimum(x1[:-1], x1[1:]), 0)
    y_gap = np.maximum(np.maximum(top[:-1], top[1:]) - np.minimum(bottom[:-1], bottom[1:]), 0)
    level = ~(mark[1:] | mark[:-1]) & ((x_gap > o.x_tolerance) | (np.abs(top[1:] - top[:-1]) > o.y_tolerance))
    upright = (y_gap > o.y_tolerance) | (np.abs(x0[1:] - x0[:-1]) > o.x_tolerance)
    begin[1:] = ~same | np.where(vertical[1:] | (o.text_direction in DOWN), upright, level)
    if not o.keep_blank_chars:
        begin[1:] |= blank[:-1]
        # a word begins where its first character that is not blank stands
        kept = ~blank
        number = np.cumsum(begin & kept)[kept]
        text, row, page, index = text.filter(pa.array(kept)), row[kept], page[kept], index[kept]
        box = {c: v[kept] for c, v in box.items()}
        starts = np.flatnonzero(np.diff(number, prepend=-1))
    else:
        starts = np.flatnonzero(begin)
    if not len(starts):
        return pa.table({f: [] for f in ("doc_id",)}).slice(0, 0)
    if o.expand_ligatures and any(flags(text, lambda t: t is not None and any(c in LIGATURES for c in t))[0]):
        for sign, letters in LIGATURES.items():
            text = pc.replace_substring(text, sign, letters)
    least = lambda c: np.minimum.reduceat(box[c], starts)
    most = lambda c: np.maximum.reduceat(box[c], starts)
    own = page[starts]
    first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    heads = table.take(pa.array(row[starts]))
    out = {
        "doc_id": heads.column("doc_id"), "page_number": heads.column("page_number"), "word_index": pa.array(nth), "text": joined(text, starts),
        "x0": pa.array(least("x0")), "top": pa.array(least("top")), "x1": pa.array(most("x1")), "bottom": pa.array(most("bottom")), "direction": heads.column("direction"),
    }
    if "doctop" in box:
        out |= {"doctop": pa.array(least("doctop")), "fontname": heads.column("fontname"), "size": heads.column("size")}
        if ids:
            out["char_ids"] = lists(index, starts)
    return pa.table(out)


def extract_words(chars: DataFrame, options: WordOptions | None = None, columns: list[str] | None = None, vertical_first: bool = False, together: bool = False) -> DataFrame:
    """doc_id, page_number, word_index, text, x0, top, x1, bottom, doctop, direction, fontname, size, char_ids, or the columns asked for.

    Horizontal words come before vertical ones, or after them. fontname and size
    are those of the first character. The input needs text, x0, top, x1, bottom,
    doctop, direction, char_index, fontname and size; its rows are characters or,
    with step_x, step_y and step_index, runs of them: box and index are those of
    the first one and go on by the steps, doctop is that of them all. together:
    as in page_batches.
    """
    o = options or WordOptions()
    names = [n for n in NAMES if columns is None or n in columns]

    def kernel(table: pa.Table, page: np.ndarray) -> pa.Table | None:
        out = words_of_pages(table, page, o, vertical_first, "char_ids" in names)
        return out.select(names) if out.num_rows else None

    found = page_batches(needed(chars), kernel, ", ".join(part for part in WORDS.split(", ") if part.split(" ")[0] in names), order=order_of(chars), together=together)
    return found if columns is None else found.select(*columns)


def order_of(chars: DataFrame) -> list[str]:
    """Runs are sorted by their pages' order, which costs little and spares sorting their characters."""
    return ["char_index"] if STEP_COLUMNS[0] in chars.columns else []


def needed(chars: DataFrame, text_only: bool = False) -> DataFrame:
    """The columns that words are made of, or their texts and boxes alone."""
    kinds = {"doc_id": "long", "page_number": "int", "char_index": "long"}
    more = [] if text_only else ["doctop", "fontname", "size"]
    more += [c for c in STEP_COLUMNS if c in chars.columns]
    return chars.select(*[chars[c].cast(kinds[c]).alias(c) for c in (*PAGE, "char_index")], "text", "x0", "top", "x1", "bottom", "direction", *more)
