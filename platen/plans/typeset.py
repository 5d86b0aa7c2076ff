"""A deterministic typesetter: text and rows become positioned characters and rules.

Courier of size 10: characters 6 wide, lines 12 apart, 78 columns and 54 rows on
pages of 612 by 792 with margins of 72. All coordinates are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLS, ROWS, WIDTH, HEIGHT, MARGIN, ADVANCE, LEADING, SIZE = 78, 54, 612.0, 792.0, 72, 6, 12, 10


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer splits than there are: a row becomes thousands, so they are dealt before that and not after."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def wrapped(text_col: str = "text", width: int = COLS):
    """The lines of a text, cut to so many columns."""
    length = lambda x: F.greatest(F.length(x) - 1, F.lit(0))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor(length(x) / width).cast("int")), lambda i: F.substring(x, i * width + 1, F.lit(width)))
    return F.flatten(F.transform(F.split(F.col(text_col), "\n"), cut))


def typeset_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (of the document), line: wrapped lines; no shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(wrapped(text_col)).alias("line_no", "line"))


def typeset_together(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same, with the lines of an id one after another and in order, as page kernels take them.

    A text is one row, so nothing moves where ids differ and as many splits as
    there are cores hold rows. Else whole texts move, once and by id, and only
    those of repeated ids need their lines sorted.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = docs.select("doc_id", F.spark_partition_id().alias("split")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("split"))
    most, filled = ids.agg(F.max("n"), F.count_distinct("split")).first()
    if (most or 0) > 1:
        return typeset_rows(docs.repartition("doc_id")).sortWithinPartitions("doc_id", "line_no")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return typeset_rows(docs.repartition(4 * cores, "doc_id") if filled < cores else docs)


def place(rows: DataFrame) -> DataFrame:
    """Characters of lines (doc_id, line_no, line)."""
    chars = rows.select("doc_id", "line_no", F.posexplode(F.split("line", "")).alias("c", "text")).filter("text <> ''")
    r, page = F.col("line_no") % ROWS, F.floor(F.col("line_no") / ROWS).cast("int")
    x0, top = (F.lit(MARGIN) + F.col("c") * ADVANCE).cast("double"), (F.lit(MARGIN) + r * LEADING).cast("double")
    return chars.select(
        "doc_id", page.alias("page_number"), (r * COLS + F.col("c")).cast("long").alias("char_index"), "text",
        x0.alias("x0"), top.alias("top"), (x0 + ADVANCE).alias("x1"), (top + SIZE).alias("bottom"), (top + page * HEIGHT).alias("doctop"),
        F.lit("Courier").alias("fontname"), F.lit(float(SIZE)).alias("size"), F.lit(True).alias("upright"), F.lit("ltr").alias("direction"),
    )


def place_runs(rows: DataFrame) -> DataFrame:
    """The same characters, those of a line as one run: what moves between tasks is lines."""
    r, page = F.col("line_no") % ROWS, F.floor(F.col("line_no") / ROWS).cast("int")
    x0, top = F.lit(MARGIN).cast("double"), (F.lit(MARGIN) + r * LEADING).cast("double")
    return rows.filter("line <> ''").select(
        "doc_id", page.alias("page_number"), (r * COLS).cast("long").alias("char_index"), F.col("line").alias("text"),
        x0.alias("x0"), top.alias("top"), (x0 + ADVANCE).alias("x1"), (top + SIZE).alias("bottom"), (top + page * HEIGHT).alias("doctop"),
        F.lit("Courier").alias("fontname"), F.lit(float(SIZE)).alias("size"), F.lit(True).alias("upright"), F.lit("ltr").alias("direction"), *steps(),
    )


def steps() -> list:
    return [F.lit(float(ADVANCE)).alias("step_x"), F.lit(0.0).alias("step_y"), F.lit(1).cast("long").alias("step_index")]


def typeset(docs: DataFrame) -> DataFrame:
    return place(typeset_rows(docs))


def typeset_pages(docs: DataFrame) -> DataFrame:
    rows = typeset_rows(docs).groupBy("doc_id").agg((F.floor(F.max("line_no") / ROWS) + 1).cast("int").alias("n"))
    return rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page_number")).select("doc_id", "page_number", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(0).alias("rotation"))


COLUMNS = ("l_linenumber", "l_partkey", "l_suppkey")


def order_rows(lineitem: DataFrame, columns: tuple[str, ...] = COLUMNS, merged_header: bool = False) -> DataFrame:
    """doc_id, rows (texts of cells): each order as a grid; with merged_header a title row first."""
    n = len(columns)
    items = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)]))).alias("items"))
    head = F.array(F.array(F.lit("order"), *[F.lit("") for _ in range(n - 1)])) if merged_header else F.array().cast("array<array<string>>")
    body = F.transform("items", lambda x: F.array(*[x[f"v{i}"].cast("string") for i in range(n)]))
    return items.select("doc_id", F.concat(head, body).alias("rows"))


def order_grid(lineitem: DataFrame, columns: tuple[str, ...] = COLUMNS, merged_header: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chars, lines): each order's rows as a ruled table of 80 by 12 cells; with merged_header a title row without inner rules."""
    n = len(columns)
    grid = order_rows(lineitem, columns, merged_header).withColumn("page_number", F.lit(0))
    return place_grids(grid, n, merged_header)


def place_grids(grid: DataFrame, n: int, merged_header: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chars, lines) of ruled tables (doc_id, page_number, rows) of n columns; base, if there, says how many rows down the page each begins."""
    base = F.col("base") if "base" in grid.columns else F.lit(0)
    grid = grid.select("doc_id", "page_number", "rows", base.alias("base"))
    cell = grid.select("doc_id", "page_number", "base", F.posexplode("rows").alias("r", "row")).select("doc_id", "page_number", (F.col("base") + F.col("r")).alias("r"), F.posexplode("row").alias("k", "cell"))
    char = cell.select("doc_id", "page_number", "r", "k", F.posexplode(F.split("cell", "")).alias("c", "text")).filter("text <> ''")
    x0, top = (F.lit(MARGIN + 2) + F.col("k") * 80 + F.col("c") * ADVANCE).cast("double"), (F.lit(MARGIN + 1) + F.col("r") * LEADING).cast("double")
    chars = char.select(
        "doc_id", "page_number", ((F.col("r") * n + F.col("k")) * 100 + F.col("c")).cast("long").alias("char_index"), "text",
        x0.alias("x0"), top.alias("top"), (x0 + ADVANCE).alias("x1"), (top + SIZE).alias("bottom"), top.alias("doctop"),
        F.lit("Courier").alias("fontname"), F.lit(float(SIZE)).alias("size"), F.lit(True).alias("upright"), F.lit("ltr").alias("direction"),
    )
    size = F.size("rows")
    y = lambda i: (F.lit(MARGIN) + (F.col("base") + i) * LEADING).cast("double")
    right, low = float(MARGIN + 80 * n), y(size)
    rule = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("top"), c.alias("x1"), d.alias("bottom"))
    across = F.transform(F.sequence(F.lit(0), size), lambda i: rule(F.lit(float(MARGIN)), y(i), F.lit(right), y(i)))
    first = F.lit(1 if merged_header else 0)
    down = F.array(*[rule(F.lit(float(MARGIN + 80 * k)), y(F.lit(0) if k in (0, n) else first), F.lit(float(MARGIN + 80 * k)), low) for k in range(n + 1)])
    lines = grid.select("doc_id", "page_number", F.inline(F.concat(across, down))).withColumn("line_width", F.lit(1.0))
    return chars, lines


def with_running_heads(docs: DataFrame, title: str = "Report") -> DataFrame:
    """Lines (doc_id, line_no, line) of pages with a head in the first row and a page number in the last; text takes the rows between."""
    inner = ROWS - 4
    rows = typeset_rows(docs)
    page = F.floor(F.col("line_no") / inner)
    body = rows.select("doc_id", (page * ROWS + 2 + F.col("line_no") % inner).cast("int").alias("line_no"), "line")
    pages = rows.groupBy("doc_id").agg((F.floor(F.max("line_no") / inner) + 1).cast("int").alias("n"))
    heads = pages.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    head = heads.select("doc_id", (F.col("p") * ROWS).alias("line_no"), F.concat(F.lit(title + " "), F.col("doc_id").cast("string")).alias("line"))
    foot = heads.select("doc_id", (F.col("p") * ROWS + ROWS - 1).alias("line_no"), F.concat(F.lit("Page "), (F.col("p") + 1).cast("string"), F.lit(" of "), F.col("n").cast("string")).alias("line"))
    return body.unionByName(head).unionByName(foot)


# The same in DuckDB: common table expressions for the checks.
ROWS_SQL = f"""
typeset_pieces AS (
  SELECT doc_id, flatten([[substr(l, i * {COLS} + 1, {COLS}) FOR i IN range(0, greatest(length(l) - 1, 0) // {COLS} + 1)] FOR l IN string_split(text, chr(10))]) AS pieces
  FROM documents WHERE text IS NOT NULL),
typeset_rows AS (SELECT doc_id, generate_subscripts(pieces, 1) - 1 AS line_no, unnest(pieces) AS line FROM typeset_pieces)"""


def chars_sql(rows: str = "typeset_rows") -> str:
    return f"""
exploded AS (SELECT doc_id, line_no, generate_subscripts(string_split(line, ''), 1) - 1 AS c, unnest(string_split(line, '')) AS text FROM {rows} WHERE line <> ''),
chars AS (
  SELECT doc_id, (line_no // {ROWS})::INTEGER AS page_number, ((line_no % {ROWS}) * {COLS} + c)::BIGINT AS char_index, text,
    ({MARGIN} + c * {ADVANCE})::DOUBLE AS x0, ({MARGIN} + (line_no % {ROWS}) * {LEADING})::DOUBLE AS top,
    ({MARGIN} + c * {ADVANCE} + {ADVANCE})::DOUBLE AS x1, ({MARGIN} + (line_no % {ROWS}) * {LEADING} + {SIZE})::DOUBLE AS bottom,
    ({MARGIN} + (line_no % {ROWS}) * {LEADING} + (line_no // {ROWS}) * {int(HEIGHT)})::DOUBLE AS doctop
  FROM exploded WHERE text <> '')"""


CHARS_SQL = ROWS_SQL + "," + chars_sql()

_SPACE = "9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288"


def words_sql(x_tolerance: float = 3.0, y_tolerance: float = 3.0, source: str = "chars", name: str = "words", keep_blank: bool = False, flow: bool = False) -> str:
    """Words of horizontal characters: rows by gaps in top, then gaps in x."""
    order = "char_index" if flow else "cluster, x0, top, char_index"
    blank = "FALSE" if keep_blank else f"unicode(text) IN ({_SPACE})"
    return f"""
{name}_gap AS (SELECT *, top - lag(top) OVER (PARTITION BY doc_id, page_number ORDER BY top, char_index) AS gap FROM {source}),
{name}_cluster AS (SELECT *, sum(CASE WHEN gap > {y_tolerance} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY top, char_index ROWS UNBOUNDED PRECEDING) AS cluster FROM {name}_gap),
{name}_place AS (SELECT *, {blank} AS blank, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY {order}) AS place FROM {name}_cluster),
{name}_before AS (
  SELECT *, lag(x0) OVER w AS p_x0, lag(x1) OVER w AS p_x1, lag(top) OVER w AS p_top, coalesce(lag(blank) OVER w, TRUE) AS p_blank, lag(place) OVER w IS NULL AS is_first
  FROM {name}_place WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY place)),
{name}_begin AS (
  SELECT *, NOT blank AND (is_first OR p_blank OR greatest(greatest(p_x0, x0) - least(p_x1, x1), 0) > {x_tolerance} OR abs(top - p_top) > {y_tolerance}) AS begins FROM {name}_before),
{name}_no AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY place ROWS UNBOUNDED PRECEDING) AS word_no FROM {name}_begin),
{name} AS (
  SELECT doc_id, page_number, (word_no - 1)::BIGINT AS word_index, string_agg(text, '' ORDER BY place) AS text, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, min(doctop) AS doctop
  FROM {name}_no WHERE NOT blank GROUP BY doc_id, page_number, word_no)"""


WORDS_SQL = CHARS_SQL + "," + words_sql()
#: On typeset pages a row of words is a line.
LINES_OF_WORDS = """
lines AS (
  SELECT doc_id, page_number, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY top) - 1)::BIGINT AS line_index,
    string_agg(text, ' ' ORDER BY x0) AS text, min(x0) AS x0, top, max(x1) AS x1, max(bottom) AS bottom
  FROM words GROUP BY doc_id, page_number, top)"""
LINES_SQL = WORDS_SQL + "," + LINES_OF_WORDS
