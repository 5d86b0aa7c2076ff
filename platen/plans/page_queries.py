"""Queries over pages that differ from the plain typeset ones: several tables, empty cells, fonts of several sizes, other directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.operators import edges as E
from platen.operators import export as X
from platen.operators import layout as L
from platen.operators import tables as T
from platen.operators.words import extract_words
from platen.options import WordOptions
from platen.plans import typeset as ts
from platen.plans.queries import BOX, CELL, WORD, chars_of, query, runs_of, table

PAIRS_SQL = """
orders2 AS (SELECT l_orderkey, l_orderkey // 2 AS doc_id, list([l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR] ORDER BY l_linenumber, l_partkey, l_suppkey) AS rows FROM lineitem GROUP BY l_orderkey),
pairs AS (SELECT doc_id, rows, row_number() OVER w - 1 AS table_index, coalesce(sum(len(rows) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM orders2 WINDOW w AS (PARTITION BY doc_id ORDER BY l_orderkey)),
cells AS (
  SELECT doc_id, 0 AS page_number, table_index, r AS row_index, k::BIGINT AS col_index, (72 + 80 * k)::DOUBLE AS x0, (72 + 12 * (base + r))::DOUBLE AS top, (152 + 80 * k)::DOUBLE AS x1, (84 + 12 * (base + r))::DOUBLE AS bottom, rows[r + 1][k + 1] AS text
  FROM (SELECT *, unnest(range(0, len(rows))) AS r FROM pairs), (SELECT unnest([0, 1, 2]) AS k))"""


def pairs_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two orders' tables on a page, one under the other."""
    rows = ts.order_rows(table(spark, sf_dir, "lineitem")).withColumn("order", F.col("doc_id")).withColumn("doc_id", F.floor(F.col("doc_id") / 2).cast("long"))
    before = Window.partitionBy("doc_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    grids = rows.select("doc_id", F.lit(0).alias("page_number"), "rows", F.coalesce(F.sum(F.size("rows") + 2).over(before), F.lit(0)).cast("int").alias("base"))
    return ts.place_grids(grids, len(ts.COLUMNS))


def cells_of(chars: DataFrame, lines: DataFrame) -> DataFrame:
    return T.find_tables(chars.select("doc_id", "page_number").distinct(), chars, E.derive_edges(lines=lines))


@query(f"WITH {PAIRS_SQL} SELECT * FROM cells")
def tables_two_a_page(spark, sf_dir):
    return cells_of(*pairs_of(spark, sf_dir)).select(*CELL)


@query(f"""WITH {PAIRS_SQL}, q AS (SELECT doc_id, table_index, count(*) AS n FROM cells GROUP BY ALL), best AS (SELECT doc_id, arg_max(table_index, n * 10 + table_index) AS table_index FROM q GROUP BY doc_id)
SELECT cells.* FROM cells JOIN best USING (doc_id, table_index)""")
def largest_of_two(spark, sf_dir):
    # a page without an id has no best table in the SQL, whose join drops it
    return T.largest_table(cells_of(*pairs_of(spark, sf_dir))).filter("doc_id IS NOT NULL").select(*CELL)


@query("""WITH items AS (SELECT l_orderkey AS doc_id, unnest([l_linenumber::VARCHAR, l_linestatus || ' ' || l_linenumber, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END]) AS text FROM lineitem)
SELECT doc_id, 0 AS page_number, 0::BIGINT AS table_index, count(*) AS n_cells, round(avg(CASE WHEN trim(text) <> '' THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS accuracy,
  round(coalesce(avg(CASE WHEN text <> '' THEN (length(text) - length(replace(text, ' ', '')))::DOUBLE / length(text) END), 0), 9) AS whitespace FROM items GROUP BY doc_id""")
def quality_with_gaps(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))).withColumn("status", F.concat_ws(" ", "l_linestatus", "l_linenumber"))
    chars, lines = ts.order_grid(items, ("l_linenumber", "status", "flag"))
    found = T.table_quality(cells_of(chars, lines))
    return found.select("doc_id", "page_number", "table_index", "n_cells", F.round("accuracy", 9).alias("accuracy"), F.round("whitespace", 9).alias("whitespace"))


#: Lines of 33 characters in two columns, 54 rows each.
COLUMNS_SQL = f"""
narrow_pieces AS (SELECT doc_id, flatten([[substr(l, i * 33 + 1, 33) FOR i IN range(0, greatest(length(l) - 1, 0) // 33 + 1)] FOR l IN string_split(text, chr(10))]) AS pieces FROM documents WHERE text IS NOT NULL),
narrow AS (SELECT doc_id, generate_subscripts(pieces, 1) - 1 AS n, unnest(pieces) AS line FROM narrow_pieces),
signs AS (SELECT doc_id, n, generate_subscripts(string_split(line, ''), 1) - 1 AS c, unnest(string_split(line, '')) AS text FROM narrow WHERE line <> ''),
chars AS (
  SELECT doc_id, (n // 108)::INTEGER AS page_number, ((n % 54 * 2 + n // 54 % 2) * 100 + c)::BIGINT AS char_index, text, (72 + 6 * c + 240 * (n // 54 % 2))::DOUBLE AS x0, (72 + 12 * (n % 54))::DOUBLE AS top,
    (78 + 6 * c + 240 * (n // 54 % 2))::DOUBLE AS x1, (82 + 12 * (n % 54))::DOUBLE AS bottom, (72 + 12 * (n % 54))::DOUBLE AS doctop
  FROM signs WHERE text <> '')"""


def two_columns(spark, sf_dir) -> DataFrame:
    docs = ts.spread(table(spark, sf_dir, "documents")).filter("text IS NOT NULL")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(ts.wrapped(width=33)).alias("n", "line"))
    column, row = F.floor(F.col("n") / 54) % 2, F.col("n") % 54
    x0, top = (F.lit(72) + column * 240).cast("double"), (F.lit(72) + row * 12).cast("double")
    return lines.filter("line <> ''").select(
        "doc_id", F.floor(F.col("n") / 108).cast("int").alias("page_number"), ((row * 2 + column) * 100).cast("long").alias("char_index"), F.col("line").alias("text"), x0.alias("x0"), top.alias("top"), (x0 + 6).alias("x1"), (top + 10).alias("bottom"), top.alias("doctop"),
        F.lit("Courier").alias("fontname"), F.lit(10.0).alias("size"), F.lit(True).alias("upright"), F.lit("ltr").alias("direction"), *ts.steps(),
    )


@query(f"WITH {COLUMNS_SQL}, {ts.words_sql()}, {ts.LINES_OF_WORDS} SELECT * FROM lines")
def lines_over_columns(spark, sf_dir):
    return L.chars_lines(two_columns(spark, sf_dir)).select("doc_id", "page_number", "line_index", "text", *BOX)


@query(f"""WITH RECURSIVE {COLUMNS_SQL}, {ts.words_sql()},
g AS (SELECT doc_id, page_number, x0, lag(x1) OVER (PARTITION BY doc_id, page_number, top ORDER BY x0) AS before FROM words),
m AS (SELECT doc_id, page_number, (before + x0) / 2 AS m, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY (before + x0) / 2) AS n FROM g WHERE x0 - before >= 20),
r AS (
  SELECT doc_id, page_number, n, m AS total, 1 AS members, 0 AS no FROM m WHERE n = 1
  UNION ALL
  SELECT m.doc_id, m.page_number, m.n, CASE WHEN abs(m.m - r.total / r.members) > 20 THEN m.m ELSE r.total + m.m END, CASE WHEN abs(m.m - r.total / r.members) > 20 THEN 1 ELSE r.members + 1 END,
    r.no + CASE WHEN abs(m.m - r.total / r.members) > 20 THEN 1 ELSE 0 END
  FROM r JOIN m ON m.doc_id = r.doc_id AND m.page_number = r.page_number AND m.n = r.n + 1)
SELECT doc_id, page_number, no AS boundary_no, round(arg_max(total / members, n), 6) AS boundary FROM r WHERE no < 5 GROUP BY ALL""")
def column_boundaries(spark, sf_dir):
    found = L.chars_columns(two_columns(spark, sf_dir))
    return found.select("doc_id", "page_number", F.posexplode("boundaries").alias("boundary_no", "boundary")).withColumn("boundary", F.round("boundary", 6))


@query(f"""WITH {ts.CHARS_SQL} SELECT doc_id, page_number, coalesce(median(CASE WHEN trim(text) <> '' THEN 8.0::DOUBLE + (top::BIGINT // 12) % 5 END), 12.0) AS median_size FROM chars GROUP BY ALL""")
def median_of_sizes(spark, sf_dir):
    chars = chars_of(spark, sf_dir).withColumn("size", F.lit(8.0) + F.floor(F.col("top") / 12) % 5)
    return X.median_font_size(chars)


@query(f"WITH {ts.WORDS_SQL} SELECT doc_id, page_number, word_index, text, 700 - bottom AS x0, x0 AS top, 700 - top AS x1, x1 AS bottom, doctop FROM words")
def words_downward(spark, sf_dir):
    """The page turned: rows run down it, the first one at the right."""
    turned = {"x0": F.lit(700.0) - F.col("bottom"), "top": F.col("x0"), "x1": F.lit(700.0) - F.col("top"), "bottom": F.col("x1"), "step_x": F.col("step_y"), "step_y": F.col("step_x"), "direction": F.lit("ttb")}
    return extract_words(runs_of(spark, sf_dir).withColumns(turned), columns=WORD)


@query(f"""WITH {ts.WORDS_SQL} SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY top, CASE WHEN n > 1 THEN -x0 ELSE x0 END) - 1 AS word_index, CASE WHEN n > 1 THEN reverse(text) ELSE text END AS text, x0, top, x1, bottom, doctop
FROM words JOIN (SELECT doc_id, page_number, top, count(*) AS n FROM chars GROUP BY ALL) USING (doc_id, page_number, top)""")
def words_backward(spark, sf_dir):
    """Characters that a stream gives from right to left are read that way."""
    runs = runs_of(spark, sf_dir).withColumns({c: -F.col(c) for c in ("char_index", "step_index")})
    return extract_words(runs, WordOptions(text_direction="rtl"), WORD)


@query(f"WITH {ts.CHARS_SQL}, {ts.words_sql()} SELECT doc_id, page_number, word_index, text, x0, top, x1, bottom FROM words WHERE top >= 300 UNION ALL SELECT doc_id, page_number, word_index, text, 700 - bottom, x0, 700 - top, x1 FROM words WHERE top < 300")
def words_of_both_directions(spark, sf_dir):
    """The upper part of each page runs down it, the lower one across; here vertical words come first."""
    upper = F.col("top") < 300
    pick = lambda a, b: F.when(upper, a).otherwise(b)
    turned = {"x0": pick(F.lit(700.0) - F.col("bottom"), F.col("x0")), "top": pick(F.col("x0"), F.col("top")), "x1": pick(F.lit(700.0) - F.col("top"), F.col("x1")), "bottom": pick(F.col("x1"), F.col("bottom")), "direction": pick(F.lit("ttb"), F.lit("ltr"))}
    turned |= {"step_x": pick(F.col("step_y"), F.col("step_x")), "step_y": pick(F.col("step_x"), F.col("step_y"))}
    return extract_words(runs_of(spark, sf_dir).withColumns(turned), columns=["doc_id", "page_number", "word_index", "text", *BOX], vertical_first=True)
