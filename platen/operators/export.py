"""HTML, SVG, CSV, JSON lines, text grids and image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.functions.scalars import WHITE_SPACE, csv_escape, escape_html, image_extension, is_blank, is_bold, is_italic
from platen.operators.layout import WORD_COLUMNS, blocks_on_page, each_page, line_text, over_words
from platen.operators.pages import PAGE, page_kernel
from platen.options import DrawStyle, HtmlOptions, ImageExportOptions, TextOptions


def ordered(items: list[Column] | Column, order: list[str], separator: str = "") -> Column:
    """Strings of a group joined in an order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, items.alias("__s"))))
    return F.array_join(F.transform(rows, lambda x: x["__s"]), separator)


def median_font_size(chars: DataFrame) -> DataFrame:
    """doc_id, page_number, median_size of sized characters that are not blank; 12 where there is none."""
    if "step_x" in chars.columns:
        # a run counts as its characters that are not blank
        signs = F.length(F.regexp_replace("text", WHITE_SPACE, ""))
        return chars.groupBy(*PAGE).agg(F.coalesce(F.percentile(F.when(F.col("size") > 0, F.col("size")), F.lit(0.5), signs), F.lit(12.0)).alias("median_size"))
    size = F.when((F.col("size") > 0) & ~is_blank(F.col("text")), F.col("size"))
    return chars.groupBy(*PAGE).agg(F.coalesce(F.median(size), F.lit(12.0)).alias("median_size"))


def heading_level(ratio: Column, least: float = 1.2) -> Column:
    """1 to 4 for a size relative to the page's median; 0 for other text."""
    return F.when(ratio < least, 0).when(ratio >= 2.0, 1).when(ratio >= 1.6, 2).when(ratio >= 1.3, 3).otherwise(4)


_ITEM = r"\A\s*(?:([•‣◦⁃\-*])\s+|([0-9]+|[A-Za-z])[.)]\s+)"


def list_item(line: Column) -> Column:
    """ul, ol or null."""
    return F.when(F.regexp_extract(line, _ITEM, 1) != "", "ul").when(F.regexp_extract(line, _ITEM, 2) != "", "ol")


HTML_BLOCKS = "doc_id long, page_number int, block_index long, lines array<string>, size double, fontname string, n_words long"


def html_blocks(words: DataFrame | None, options: HtmlOptions | None = None, chars: DataFrame | None = None) -> DataFrame:
    """doc_id, page_number, block_index, lines, size (the commonest), fontname (of the first word), n_words (of the longest line); of words, or else of the words of characters."""
    o = options or HtmlOptions()
    t = TextOptions(layout=True, y_tolerance=o.y_tolerance, y_density=o.y_density, x_density=o.x_density)

    def kernel(rows: list[dict]) -> list[tuple]:
        out = []
        for i, b in enumerate(blocks_on_page(rows, t)):
            own = [w for line in b.items for w in line.items]
            sizes = sorted(w["size"] for w in own for _ in w["text"])
            runs: list[list[float]] = []
            for s in sizes:
                if runs and s - runs[-1][-1] <= 0.1:
                    runs[-1].append(s)
                else:
                    runs.append([s])
            best = max(runs, key=len)[-1] if runs else 0.0
            out.append((i, [line_text(line) for line in b.items], best, own[0]["fontname"], max(len(line.items) for line in b.items)))
        return out

    if words is None:
        return over_words(chars, each_page(kernel, HTML_BLOCKS), HTML_BLOCKS, fonts=True)
    return page_kernel(words.select(*WORD_COLUMNS), kernel, HTML_BLOCKS, ["word_index"])


def html_text(words: DataFrame | None, chars: DataFrame, options: HtmlOptions | None = None) -> DataFrame:
    """doc_id, page_number, html of headings, lists and paragraphs; consecutive lists of one kind are one."""
    o = options or HtmlOptions()
    b = html_blocks(words, o, chars).join(median_font_size(chars), PAGE)
    level = F.when((F.size("lines") <= 2) & (F.col("n_words") <= 15), heading_level(F.col("size") / F.col("median_size"), o.heading_min_ratio)).otherwise(0)
    kinds = F.transform("lines", list_item)
    as_list = F.lit(o.detect_lists) & F.forall(kinds, lambda k: k.isNotNull())
    b = b.withColumn("level", level).withColumn("kind", F.when(F.col("level") > 0, "h").when(as_list, F.element_at(kinds, 1)).otherwise("p"))
    body = escape_html(F.array_join("lines", "\n"))
    if o.detect_emphasis:
        body = F.when(is_bold(F.col("fontname")) & is_italic(F.col("fontname")), F.concat(F.lit("<strong><em>"), body, F.lit("</em></strong>"))).when(is_bold(F.col("fontname")), F.concat(F.lit("<strong>"), body, F.lit("</strong>"))).when(is_italic(F.col("fontname")), F.concat(F.lit("<em>"), body, F.lit("</em>"))).otherwise(body)
    tag = F.concat(F.lit("h"), F.col("level"))
    heading = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.array_join("lines", " ")), F.lit("</"), tag, F.lit(">"))
    items = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<li>"), escape_html(F.regexp_replace(x, _ITEM, "")), F.lit("</li>"))), "\n")
    b = b.withColumn("part", F.when(F.col("kind") == "h", heading).when(F.col("kind") == "p", F.concat(F.lit("<p>"), body, F.lit("</p>"))).otherwise(items))
    order = Window.partitionBy(*PAGE).orderBy("block_index")
    new = F.when((F.col("kind") == F.lag("kind").over(order)) & F.col("kind").isin("ul", "ol"), 0).otherwise(1)
    b = b.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    runs = b.groupBy(*PAGE, "run", "kind").agg(ordered(F.col("part"), ["block_index"], "\n").alias("part"))
    wrapped = F.when(F.col("kind").isin("ul", "ol"), F.concat(F.lit("<"), F.col("kind"), F.lit(">\n"), F.col("part"), F.lit("\n</"), F.col("kind"), F.lit(">"))).otherwise(F.col("part"))
    return runs.groupBy(*PAGE).agg(ordered(wrapped, ["run"], "\n").alias("html"))


def table_html(cells: DataFrame) -> DataFrame:
    """doc_id, page_number, table_index, html: the first row as head."""
    tag = F.when(F.col("row_index") == 0, "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    rows = cells.groupBy(*PAGE, "table_index", "row_index").agg(F.concat(F.lit("<tr>"), ordered(cell, ["col_index"]), F.lit("</tr>")).alias("row"))
    row = F.when(F.col("row_index") == 0, F.concat(F.lit("<thead>\n"), F.col("row"), F.lit("\n</thead>\n<tbody>"))).otherwise(F.col("row"))
    return rows.groupBy(*PAGE, "table_index").agg(F.concat(F.lit("<table>\n"), ordered(row, ["row_index"], "\n"), F.lit("\n</tbody>\n</table>")).alias("html"))


def page_html(words: DataFrame | None, chars: DataFrame, cells: DataFrame | None = None, options: HtmlOptions | None = None) -> DataFrame:
    """Text of the words, or of the characters' own ones if None, then the page's tables."""
    text = html_text(words, chars, options)
    if cells is None:
        return text
    tables = table_html(cells).groupBy(*PAGE).agg(ordered(F.col("html"), ["table_index"], "\n").alias("tables"))
    return text.join(tables, PAGE, "full").select(*PAGE, F.concat_ws("\n", "html", "tables").alias("html"))


# SVG

STYLES = {"chars": DrawStyle(stroke="red"), "rects": DrawStyle(stroke="blue"), "lines": DrawStyle(stroke="green", stroke_width=1.0), "edges": DrawStyle(stroke="orange", stroke_width=1.0), "intersections": DrawStyle(fill="purple", stroke=None), "cells": DrawStyle(fill="pink", stroke="blue"), "tables": DrawStyle(fill="lightblue", stroke="navy", stroke_width=1.0)}


def _look(s: DrawStyle) -> str:
    return f'fill="{s.fill or "none"}" stroke="{s.stroke or "none"}" stroke-width="{s.stroke_width}" opacity="{s.opacity}"'


def svg_shapes(objects: DataFrame, kind: str, style: DrawStyle | None = None) -> DataFrame:
    """doc_id, page_number, layer, svg: one element per object."""
    s = style or STYLES[kind]
    n = lambda c: F.format_string("%.2f", c)
    if kind == "intersections":
        shape = F.concat(F.lit('<circle cx="'), n(F.col("x")), F.lit('" cy="'), n(F.col("y")), F.lit(f'" r="2" {_look(s)}/>'))
    elif kind in ("lines", "edges"):
        shape = F.concat(F.lit('<line x1="'), n(F.col("x0")), F.lit('" y1="'), n(F.col("top")), F.lit('" x2="'), n(F.col("x1")), F.lit('" y2="'), n(F.col("bottom")), F.lit(f'" {_look(s)}/>'))
    else:
        shape = F.concat(F.lit('<rect x="'), n(F.col("x0")), F.lit('" y="'), n(F.col("top")), F.lit('" width="'), n(F.col("x1") - F.col("x0")), F.lit('" height="'), n(F.col("bottom") - F.col("top")), F.lit(f'" {_look(s)}/>'))
    return objects.select(*PAGE, F.lit(list(STYLES).index(kind)).alias("layer"), shape.alias("svg"))


def page_svg(pages: DataFrame, **layers: DataFrame) -> DataFrame:
    """doc_id, page_number, svg: the page's frame and the named layers; page_svg(pages) is the frame alone."""
    drawn = None
    for kind, objects in layers.items():
        part = svg_shapes(objects, kind)
        drawn = part if drawn is None else drawn.unionByName(part)
    size = lambda c: F.format_string("%.2f", F.col(c))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), size("width"), F.lit('" height="'), size("height"), F.lit('" viewBox="0 0 '), size("width"), F.lit(" "), size("height"), F.lit('">\n<rect x="0" y="0" width="'), size("width"), F.lit('" height="'), size("height"), F.lit('" fill="white" stroke="black"/>\n'))
    if drawn is None:
        return pages.select(*PAGE, F.concat(head, F.lit("</svg>")).alias("svg"))
    body = drawn.groupBy(*PAGE).agg(ordered(F.col("svg"), ["layer"], "\n").alias("body"))
    return pages.join(body, PAGE, "left").select(*PAGE, F.concat(head, F.coalesce(F.concat("body", F.lit("\n")), F.lit("")), F.lit("</svg>")).alias("svg"))


# rows as text


def csv_lines(df: DataFrame, columns: list[str], decimals: int | None = 2) -> DataFrame:
    """line: one CSV record per row; texts are quoted where they must be."""
    kinds = dict(df.dtypes)
    text = lambda c: F.format_string(f"%.{decimals}f", c) if kinds[c] == "double" and decimals is not None else F.col(c).cast("string")
    return df.select(*PAGE, F.concat_ws(",", *[csv_escape(F.coalesce(text(c), F.lit(""))) for c in columns]).alias("line"))


def tsv_lines(df: DataFrame, columns: list[str], decimals: int = 2) -> DataFrame:
    kinds = dict(df.dtypes)
    text = lambda c: F.format_string(f"%.{decimals}f", c) if kinds[c] == "double" else F.col(c).cast("string")
    return df.select(*PAGE, F.concat_ws("\t", *[F.coalesce(text(c), F.lit("")) for c in columns]).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(*PAGE, F.to_json(F.struct(*df.columns)).alias("line"))


def table_csv(cells: DataFrame) -> DataFrame:
    rows = cells.groupBy(*PAGE, "table_index", "row_index").agg(ordered(csv_escape(F.coalesce("text", F.lit(""))), ["col_index"], ",").alias("row"))
    return rows.groupBy(*PAGE, "table_index").agg(ordered(F.col("row"), ["row_index"], "\n").alias("csv"))


def table_grid(cells: DataFrame) -> DataFrame:
    """doc_id, page_number, table_index, grid: columns padded to their widest cell, between bars."""
    key = [*PAGE, "table_index"]
    flat = cells.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    width = F.greatest(F.max(F.length("text")).over(Window.partitionBy(*key, "col_index")), F.lit(1))
    cell = F.rpad(F.col("text"), F.col("width"), F.lit(" "))
    rows = flat.withColumn("width", width).groupBy(*key, "row_index").agg(F.concat(F.lit("| "), ordered(cell, ["col_index"], " | "), F.lit(" |")).alias("row"))
    return rows.groupBy(*key).agg(ordered(F.col("row"), ["row_index"], "\n").alias("grid"))


def export_images(images: DataFrame, options: ImageExportOptions | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, page_number, idx, filename, data and the columns to keep: names by pattern, pages from 1. With deduplicate equal contents share the first name; every record stays."""
    o = options or ImageExportOptions()
    digest = F.lower(F.substring(F.hex(F.xxhash64("data")), 1, 8))
    name = F.lit(o.pattern)
    for key, value in (("page", F.col("page_number") + 1), ("index", F.col("idx")), ("ext", image_extension(F.col("filter"))), ("hash", digest)):
        name = F.replace(name, F.lit("{" + key + "}"), value.cast("string"))
    out = images.filter("data IS NOT NULL").withColumn("filename", name)
    if o.deduplicate:
        out = out.withColumn("filename", F.first_value("filename").over(Window.partitionBy("doc_id", F.sha2("data", 256)).orderBy("page_number", "idx")))
    return out.select(*PAGE, "idx", "filename", "data", *keep)


def page_info(pages: DataFrame, **relations: DataFrame) -> DataFrame:
    """Counts of each relation per page, with totals per document (page null) and of all (both null)."""
    counted = pages.select(*PAGE)
    for name, df in relations.items():
        counted = counted.join(df.groupBy(*PAGE).agg(F.count(F.lit(1)).alias(f"n_{name}")), PAGE, "left")
    return counted.fillna(0).rollup(*PAGE).agg(*[F.sum(f"n_{name}").alias(f"n_{name}") for name in relations])
