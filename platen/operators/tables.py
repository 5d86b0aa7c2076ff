"""Cells and tables from edges; their text, normal form and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.functions.scalars import is_blank
from platen.operators.edges import chosen_edges
from platen.operators.page_tables import cell_text, page_cells, tables
from platen.operators.pages import PAGE, page_kernel
from platen.operators.words import extract_words
from platen.options import TableSettings, WordOptions

BOX = ["x0", "top", "x1", "bottom"]


def _covered(cells: DataFrame, edges: DataFrame, side: str, x_tol: float, y_tol: float) -> DataFrame:
    """Cells whose top, bottom, left or right some edge covers."""
    e = edges.select(*PAGE, *[F.col(c).alias(f"e_{c}") for c in (*BOX, "orientation")])
    if side in ("top", "bottom"):
        on = (F.col("e_orientation") == "horizontal") & (F.abs(F.col("e_top") - F.col(side)) <= y_tol) & (F.col("e_x0") <= F.col("x0") + x_tol) & (F.col("e_x1") >= F.col("x1") - x_tol)
    else:
        on = (F.col("e_orientation") == "vertical") & (F.abs(F.col("e_x0") - F.col(side)) <= x_tol) & (F.col("e_top") <= F.col("top") + y_tol) & (F.col("e_bottom") >= F.col("bottom") - y_tol)
    same = (cells["doc_id"] == e["doc_id"]) & (cells["page_number"] == e["page_number"])
    return cells.join(e, same & on, "left_semi")


def _grid_lines(points: DataFrame, axis: str, low: str, high: str) -> DataFrame:
    order = Window.partitionBy(*PAGE).orderBy(axis)
    return points.select(*PAGE, axis).distinct().select(*PAGE, F.col(axis).alias(low), F.lead(axis).over(order).alias(high)).filter(F.col(high).isNotNull())


def find_cells(points: DataFrame, edges: DataFrame, x_tol: float = 3.0, y_tol: float = 3.0) -> DataFrame:
    """doc_id, page_number, box: grid cells with all four sides, then cells merged along a row whose inner rules are missing."""
    spans, bands = _grid_lines(points, "x", "x0", "x1"), _grid_lines(points, "y", "top", "bottom")
    cells = spans.join(bands, PAGE)
    for side in ("top", "bottom", "x0", "x1"):
        cells = _covered(cells, edges, side, x_tol, y_tol)
    # columns that some whole cell has established
    known = cells.select(*PAGE, F.explode(F.array(F.round(F.col("x0") * 1000), F.round(F.col("x1") * 1000))).alias("key")).distinct()
    xs = points.select(*PAGE, F.col("x").alias("x0")).distinct().withColumn("key", F.round(F.col("x0") * 1000)).join(known, [*PAGE, "key"], "left_semi").drop("key")
    ruled = _covered(xs.join(bands, PAGE).withColumn("x1", F.col("x0")), edges, "x0", x_tol, y_tol)
    order = Window.partitionBy(*PAGE, "top", "bottom").orderBy("x0")
    merged = ruled.select(*PAGE, "x0", "top", F.lead("x0").over(order).alias("x1"), "bottom").filter("x1 IS NOT NULL")
    for side in ("top", "bottom"):
        merged = _covered(merged, edges, side, x_tol, y_tol)
    merged = merged.join(cells, [*PAGE, *BOX], "left_anti")
    return cells.select(*PAGE, *BOX).unionByName(merged.select(*PAGE, *BOX))


def cells_by_corners(points: DataFrame) -> DataFrame:
    """The plainer way: cells of the grid whose four corners are crossings."""
    cells = _grid_lines(points, "x", "x0", "x1").join(_grid_lines(points, "y", "top", "bottom"), PAGE)
    for x, y in (("x0", "top"), ("x1", "top"), ("x0", "bottom"), ("x1", "bottom")):
        cells = cells.join(points.select(*PAGE, F.col("x").alias(x), F.col("y").alias(y)), [*PAGE, x, y], "left_semi")
    return cells.select(*PAGE, *BOX)


def group_cells(cells: DataFrame) -> DataFrame:
    """Adds table_index, row_index and col_index: cells that share a boundary form a table; tables go by top and x0."""

    def kernel(rows: list[dict]) -> list[tuple]:
        return [(*c, i) for i, group in enumerate(tables([tuple(r[x] for x in BOX) for r in rows])) for c in group]

    grouped = page_kernel(cells.select(*PAGE, *BOX), kernel, "doc_id long, page_number int, x0 double, top double, x1 double, bottom double, table_index long", ["top", "x0", "x1", "bottom"])
    return number_cells(grouped)


def number_cells(cells: DataFrame) -> DataFrame:
    """row_index and col_index from rounded tops and left sides."""
    of = Window.partitionBy(*PAGE, "table_index")
    return cells.withColumn("row_index", F.dense_rank().over(of.orderBy(F.round(F.col("top") * 1000))).cast("long") - 1).withColumn("col_index", F.dense_rank().over(of.orderBy(F.round(F.col("x0") * 1000))).cast("long") - 1)


def fill_text(cells: DataFrame, chars: DataFrame, x_tol: float = 3.0, y_tol: float = 3.0) -> DataFrame:
    """Adds text: words of the characters whose middle lies in the cell (a border belongs to both sides), in lines; null if none."""
    key = [*PAGE, "table_index", "row_index", "col_index"]
    c = cells.select(*key, *[F.col(x).alias(f"c_{x}") for x in BOX])
    mid_x, mid_y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = chars.join(c, PAGE).filter(mid_x.between(F.col("c_x0"), F.col("c_x1")) & mid_y.between(F.col("c_top"), F.col("c_bottom")))

    def kernel(rows: list[dict]) -> list[tuple]:
        return [(cell_text(rows, x_tol, y_tol),)]

    text = page_kernel(inside.select(*key, "char_index", "text", *BOX, "direction"), kernel, "doc_id long, page_number int, table_index long, row_index long, col_index long, text string", ["char_index"], key)
    return cells.join(text, key, "left")


def _grid(cells: DataFrame, first_only: bool) -> DataFrame:
    """Splits merged cells over their table's whole grid; the text goes to the first part or to all."""
    key = [*PAGE, "table_index"]
    line = lambda a, b: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.round(a, 6), F.round(b, 6))))))
    lines = cells.groupBy(*key).agg(line("x0", "x1").alias("xs"), line("top", "bottom").alias("ys"))
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.element_at(c, i).alias("a"), F.element_at(c, i + 1).alias("b")))
    parts = lines.select(*key, F.explode(pairs("ys")).alias("y"), "xs").select(*key, "y", F.explode(pairs("xs")).alias("x"))
    parts = parts.select(*key, F.col("x.a").alias("sx0"), F.col("y.a").alias("stop"), F.col("x.b").alias("sx1"), F.col("y.b").alias("sbottom"))
    mid_x, mid_y, eps = (F.col("sx0") + F.col("sx1")) / 2, (F.col("stop") + F.col("sbottom")) / 2, 1e-6
    within = mid_x.between(F.col("x0") - eps, F.col("x1") + eps) & mid_y.between(F.col("top") - eps, F.col("bottom") + eps)
    found = parts.join(cells, key).filter(within)
    one = Window.partitionBy(*key, "sx0", "stop").orderBy("top", "x0")
    found = found.withColumn("nth", F.row_number().over(one)).filter("nth = 1")
    own = (F.abs(F.col("sx0") - F.col("x0")) < eps) & (F.abs(F.col("stop") - F.col("top")) < eps)
    text = F.when(own, F.col("text")) if first_only else F.col("text")
    return number_cells(found.select(*key, F.col("sx0").alias("x0"), F.col("stop").alias("top"), F.col("sx1").alias("x1"), F.col("sbottom").alias("bottom"), text.alias("text")))


def normalise_columns(cells: DataFrame) -> DataFrame:
    return _grid(cells, True)


def duplicate_merged(cells: DataFrame) -> DataFrame:
    return _grid(cells, False)


def table_quality(cells: DataFrame) -> DataFrame:
    """Per table: box, n_cells, accuracy (share of cells with text), whitespace (mean share of white space, by bytes, of texts)."""
    filled = F.when(F.col("text").isNotNull() & ~is_blank(F.col("text")), 1.0).otherwise(0.0)
    spaces = F.regexp_count("text", F.lit(r"\s")) / F.octet_length("text")
    return cells.groupBy(*PAGE, "table_index").agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
        F.count(F.lit(1)).alias("n_cells"), F.avg(filled).alias("accuracy"), F.coalesce(F.avg(F.when(F.octet_length("text") > 0, spaces)), F.lit(0.0)).alias("whitespace"),
    )


def find_tables(pages: DataFrame, chars: DataFrame | None = None, edges: DataFrame | None = None, words: DataFrame | None = None, settings: TableSettings | None = None) -> DataFrame:
    """One row per cell: doc_id, page_number, table_index, row_index, col_index, box, text.

    Text needs chars. min_accuracy drops tables below it. Edges and characters
    of a page meet in one exchange; the finder runs page by page.
    """
    s = settings or TableSettings()
    if words is None and s.strategy == "stream":
        words = extract_words(chars)
    chosen = chosen_edges(s, pages, edges, words)
    num, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    both = chosen.select(*PAGE, num.alias("char_index"), *BOX, F.col("orientation").alias("text"), text.alias("direction"))
    if chars is not None:
        both = both.unionByName(chars.select(*PAGE, F.col("char_index").cast("long").alias("char_index"), *BOX, "text", "direction"))

    def kernel(rows: list[dict]) -> list[tuple]:
        rules = [(r["x0"], r["top"], r["x1"], r["bottom"], r["text"]) for r in rows if r["direction"] is None]
        return page_cells(rules, [r for r in rows if r["direction"] is not None], s) if rules else []

    schema = "doc_id long, page_number int, table_index long, row_index long, col_index long, x0 double, top double, x1 double, bottom double, text string"
    return page_kernel(both, kernel, schema, ["char_index"])


def table_rows(cells: DataFrame) -> DataFrame:
    """Per table: rows, an array of arrays of nullable strings."""
    row = cells.groupBy(*PAGE, "table_index", "row_index").agg(F.array_sort(F.collect_list(F.struct("col_index", "text"))).alias("r"))
    row = row.select(*PAGE, "table_index", "row_index", F.transform("r", lambda c: c["text"]).alias("r"))
    table = row.groupBy(*PAGE, "table_index").agg(F.array_sort(F.collect_list(F.struct("row_index", "r"))).alias("t"))
    return table.select(*PAGE, "table_index", F.transform("t", lambda x: x["r"]).alias("rows"))


def largest_table(cells: DataFrame) -> DataFrame:
    """The cells of each page's table with most cells, then most area; of equals the last.

    Windows over one exchange by page: cells are found once, and not joined to themselves.
    """
    own = Window.partitionBy(*PAGE, "table_index")
    area = (F.max("x1").over(own) - F.min("x0").over(own)) * (F.max("bottom").over(own) - F.min("top").over(own))
    sized = cells.repartition(*PAGE).withColumn("__size", F.struct(F.count(F.lit(1)).over(own).alias("n_cells"), area.alias("area"), "table_index"))
    best = sized.withColumn("__best", F.max("__size").over(Window.partitionBy(*PAGE)))
    return best.filter("__size = __best").select(*cells.columns)
