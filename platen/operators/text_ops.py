"""Duplicate characters, search, repeating page regions, bidi and structure order."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.functions.scalars import is_strong_rtl, mask_variable, unicode_normalise
from platen.operators.batches import STEP_COLUMNS, characters, in_order, joined, lists, page_batches, run_starts
from platen.operators.bidi import mark_directions
from platen.operators.pages import PAGE, page_kernel
from platen.options import DedupeOptions, PageRegionOptions, SearchOptions


def keep_first(chars: list[dict], tolerance: float = 1.0, attrs: tuple[str, ...] = ("fontname", "size")) -> list[dict]:
    """Characters without those that lie within tolerance of one kept before, with equal text and attributes; sought by cells of the page."""
    step = max(tolerance, 1e-9)
    if _alone(chars, step):
        return list(chars)
    kept, cells = [], {}
    for c in chars:
        key = (c["text"], *(c[a] for a in attrs))
        i, j = int(c["x0"] // step), int(c["top"] // step)
        if any(abs(k["x0"] - c["x0"]) <= tolerance and abs(k["top"] - c["top"]) <= tolerance for a in (-1, 0, 1) for b in (-1, 0, 1) for k in cells.get((key, i + a, j + b), ())):
            continue
        cells.setdefault((key, i, j), []).append(c)
        kept.append(c)
    return kept


def _alone(chars: list[dict], step: float) -> bool:
    """Whether every character has its cell of the page and those around it to itself, as on most pages."""
    x, y = (np.floor(np.array([c[k] for c in chars], float) / step) for k in ("x0", "top"))
    if not (np.abs(x) < 1 << 30).all() or not (np.abs(y) < 1 << 30).all():
        return False
    key = x.astype(np.int64) * (1 << 32) + y.astype(np.int64)
    key.sort()
    if (key[1:] == key[:-1]).any():
        return False
    for around in (1, (1 << 32) - 1, 1 << 32, (1 << 32) + 1):
        at = np.searchsorted(key, key + around)
        at[at == len(key)] = 0
        if (key[at] == key + around).any():
            return False
    return True


def dedupe_chars(chars: DataFrame, options: DedupeOptions | None = None) -> DataFrame:
    """Drops a character that lies within tolerance of one kept before it, with equal text and attributes.

    What is kept depends on what was kept before, so this runs page by page.
    """
    o = options or DedupeOptions()
    kinds = {f.name: f.dataType.simpleString() for f in chars.schema}
    rest = [c for c in chars.columns if c not in PAGE]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*PAGE, *rest])

    def kernel(rows: list[dict]) -> list[tuple]:
        return [tuple(r[c] for c in rest) for r in keep_first(rows, o.tolerance, o.extra_attrs)]

    return page_kernel(chars.select(*PAGE, *rest), kernel, schema, ["char_index"]).select(*chars.columns)


def search(chars: DataFrame, pattern: str, options: SearchOptions | None = None) -> DataFrame:
    """doc_id, page_number, match_index, text, box, char_ids: matches in a page's characters in stream order, joined without separators.

    A pattern that is not valid, or that uses look-around or back references,
    matches nothing. Matches without characters are left out. The rows are characters
    or runs of them: see extract_words.
    """
    o = options or SearchOptions()
    source = pattern if o.regex else re.escape(pattern)
    try:
        if o.regex and re.search(r"\(\?(=|!|<=|<!|P=)|\\[1-9]", pattern):
            raise re.error("not supported")
        compiled = re.compile(source, 0 if o.case_sensitive else re.IGNORECASE)
    except re.error:
        compiled = None

    schema = "doc_id long, page_number int, match_index long, text string, x0 double, top double, x1 double, bottom double, char_ids array<long>"

    def kernel(table: pa.Table, page: np.ndarray) -> pa.Table | None:
        if runs:
            text, row, of = characters(table)
            table = table.select(PAGE).take(pa.array(row)).append_column("text", text)
            for c in ("char_index", "x0", "top", "x1", "bottom"):
                table = table.append_column(c, pa.array(of(c)))
            page = page[row]
        order = in_order(np.asarray(table.column("char_index")), page)
        if (order[1:] < order[:-1]).any():
            table, page = table.take(pa.array(order)), page[order]
        if not table.num_rows:
            return None
        texts = table.column("text").combine_chunks().fill_null("")
        sizes = np.asarray(pc.utf8_length(texts)).astype(np.int64)
        ends = np.cumsum(sizes)
        pages = run_starts(page)
        begin, stop, nth, found = [], [], [], []
        for at, to, whole in zip(pages.tolist(), np.append(pages[1:], len(page)).tolist(), joined(texts, pages).to_pylist(), strict=True):
            base = int(ends[at] - sizes[at])
            n = 0
            for m in compiled.finditer(whole):
                if m.end() > m.start():
                    begin.append(base + m.start())
                    stop.append(base + m.end() - 1)
                    nth.append(n)
                    found.append(m.group(0))
                    n += 1
        if not found:
            return None
        # the characters that hold a match's first and last sign
        first, last = np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, stop, side="right")
        size = last - first + 1
        starts = np.cumsum(size) - size
        rows = np.repeat(first - starts, size) + np.arange(int(size.sum()))
        own = table.take(pa.array(rows))
        least = lambda c: pa.array(np.minimum.reduceat(np.asarray(own.column(c)), starts))
        most = lambda c: pa.array(np.maximum.reduceat(np.asarray(own.column(c)), starts))
        heads = own.take(pa.array(starts))
        return pa.table({
            "doc_id": heads.column("doc_id"), "page_number": heads.column("page_number"), "match_index": pa.array(nth, pa.int64()), "text": pa.array(found, pa.string()),
            "x0": least("x0"), "top": least("top"), "x1": most("x1"), "bottom": most("bottom"), "char_ids": lists(np.asarray(own.column("char_index")), starts),
        })

    runs = STEP_COLUMNS[0] in chars.columns
    chars = chars.select(*PAGE, chars["char_index"].cast("long").alias("char_index"), "text", "x0", "top", "x1", "bottom", *(STEP_COLUMNS if runs else ()))
    if compiled is None:
        return page_batches(chars.limit(0), kernel, schema)
    return page_batches(chars, kernel, schema, order=["char_index"] if runs else [])


def page_regions(pages: DataFrame, lines: DataFrame, options: PageRegionOptions | None = None) -> DataFrame:
    """doc_id, page_number, header, footer, body_top, body_bottom: margins whose text repeats over a document's pages.

    Runs of digits count as equal. A text must stand on min_pages pages, or one
    on the odd and one on the even pages. header and footer are null elsewhere.
    """
    o = options or PageRegionOptions()
    sized = lines.join(pages.select(*PAGE, "width", "height"), PAGE)
    zone = F.when(F.col("bottom") <= F.col("height") * o.header_margin, "header").when(F.col("top") >= F.col("height") * (1 - o.footer_margin), "footer")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda x: x["text"]), " ")
    zones = sized.withColumn("zone", zone).filter("zone IS NOT NULL").groupBy(*PAGE, "zone").agg(text.alias("text"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    zones = zones.withColumn("masked", mask_variable(F.col("text"))).withColumn("odd", F.col("page_number") % 2)
    counts = zones.groupBy("doc_id", "zone", "masked").agg(F.count(F.lit(1)).alias("n"), F.min("odd").alias("first_odd"), F.max("odd").alias("last_odd"))
    # a text that stands on all odd or all even pages of its zone, where both sides have one
    sides = zones.groupBy("doc_id", "zone", "odd").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("masked").alias("texts"))
    both = sides.groupBy("doc_id", "zone").agg(F.sum("pages").alias("pages"), F.max("texts").alias("texts"), F.count(F.lit(1)).alias("sides"))
    turns = both.filter((F.col("sides") == 2) & (F.col("texts") == 1) & (F.col("pages") >= o.min_pages)).select("doc_id", "zone", F.lit(True).alias("turns"))
    good = counts.join(turns, ["doc_id", "zone"], "left").filter((F.col("n") >= o.min_pages) | F.col("turns")).select("doc_id", "zone", "masked")
    found = zones.join(good, ["doc_id", "zone", "masked"], "left_semi")
    box = lambda z, c: F.max(F.when(F.col("zone") == z, F.col(c)))
    per_page = found.groupBy(*PAGE).agg(box("header", "text").alias("header"), box("footer", "text").alias("footer"), box("header", "bottom").alias("h"), box("footer", "top").alias("f"))
    out = pages.select(*PAGE, "height").join(per_page, PAGE, "left")
    return out.select(*PAGE, "header", "footer", F.coalesce("h", F.lit(0.0)).alias("body_top"), F.coalesce("f", "height").alias("body_bottom"))


def body_only(objects: DataFrame, regions: DataFrame) -> DataFrame:
    """Objects whose middle lies in their page's body."""
    middle = (F.col("top") + F.col("bottom")) / 2
    return objects.join(regions.select(*PAGE, "body_top", "body_bottom"), PAGE).filter(middle.between(F.col("body_top"), F.col("body_bottom"))).drop("body_top", "body_bottom")


def bidi_directions(chars: DataFrame) -> DataFrame:
    """Sets rtl by the bidirectional algorithm; pages without right-to-left letters never reach Python."""
    rtl = chars.filter(is_strong_rtl(F.col("text"))).select(*PAGE).distinct()
    other = chars.join(rtl, PAGE, "left_anti")
    kinds = {f.name: f.dataType.simpleString() for f in chars.schema}
    rest = [c for c in chars.columns if c not in PAGE]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*PAGE, *rest])

    def kernel(rows: list[dict]) -> list[tuple]:
        return [tuple(r[c] for c in rest) for r in mark_directions(rows)]

    return page_kernel(chars.join(rtl, PAGE, "left_semi").select(*PAGE, *rest), kernel, schema, ["char_index"]).select(*chars.columns).unionByName(other)


def normalise_chars(chars: DataFrame, form: str | None = "NFC") -> DataFrame:
    return chars.withColumn("text", unicode_normalise(F.col("text"), form))


def semantic_chars(chars: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds semantic_order: characters by the structure tree, then untagged ones; those of an MCID that the tree lacks are dropped.

    The first element that names an MCID has it.
    """
    named = elements.select(*PAGE, "preorder", F.posexplode("mcids").alias("at", "mcid"))
    first = Window.partitionBy(*PAGE, "mcid").orderBy("preorder", "at")
    named = named.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    tagged = chars.filter("mcid IS NOT NULL").join(named, [*PAGE, "mcid"])
    late = chars.filter("mcid IS NULL").withColumn("preorder", F.lit(None).cast("long")).withColumn("at", F.lit(0))
    order = Window.partitionBy(*PAGE).orderBy(F.col("preorder").asc_nulls_last(), "at", "char_index")
    return tagged.select(*chars.columns, "preorder", "at").unionByName(late.select(*chars.columns, "preorder", "at")).withColumn("semantic_order", F.row_number().over(order) - 1).drop("preorder", "at")


def structure_of_pages(elements: DataFrame) -> DataFrame:
    """The structure tree of each page: elements that stand on it and those above them; on_page is the page, page_number the element's own."""
    own = elements.filter("page_number IS NOT NULL")
    nodes = own.select("doc_id", F.col("page_number").alias("on_page"), F.explode(F.array_append("ancestors", F.col("node_id"))).alias("node_id")).distinct()
    return elements.join(nodes, ["doc_id", "node_id"])
