"""Queries that write the test tables as PDF files and read these back, with what must be found in SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.operators import edges as E
from platen.operators import export as X
from platen.operators import layout as L
from platen.operators import tables as T
from platen.operators import text_ops as O
from platen.operators.batches import STEP_COLUMNS
from platen.operators.words import extract_words
from platen.options import ExtractOptions
from platen.plans import typeset as ts
from platen.plans import page_queries  # noqa: F401  fills the list as well
from platen.plans.queries import BOX, CELL, CHAR, GRID_SQL, QUERIES, SQL, WORD, query, table
from platen.sources.pdf.reader import characters_of, extract, relation
from platen.sources.pdf.writer import grid_files, named, text_files
from platen.streaming.ingest import drained

PAGES_SQL = f"{ts.ROWS_SQL}, pages AS (SELECT doc_id, unnest(range(0, max(line_no) // {ts.ROWS} + 1))::INTEGER AS page_number FROM typeset_rows GROUP BY doc_id)"
#: Of a page, characters are numbered as they are shown.
SHOWN_SQL = f"{ts.CHARS_SQL}, shown AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY char_index) - 1 AS char_index) FROM chars)"


def files_of(spark, sf_dir, **more) -> DataFrame:
    return written(table(spark, sf_dir, "documents"), **more)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores: a file costs far more than its text, so splits by bytes are too coarse."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "doc_id")


def written(docs: DataFrame, **more) -> DataFrame:
    docs = docs.filter("text IS NOT NULL")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ts.wrapped().alias("lines"), F.col("source").alias("title"), F.col("lang").alias("author"))
    return text_files(dealt(lines), ts.ROWS, ts.MARGIN, ts.LEADING, ts.WIDTH, ts.HEIGHT, **more)


def found(files: DataFrame, kind: str, columns: list[str] | None = None, runs: bool = False) -> DataFrame:
    return named(relation(extract(files, kinds=(kind,), columns={kind: columns} if columns else None, runs=runs), kind))


PLAIN = ["char_index", "text", *BOX, "doctop", "fontname", "size", "upright", "direction", "mcid"]


def runs_in(spark, sf_dir, columns: list[str] | None = None, **more) -> DataFrame:
    """The characters, those of a line as one run."""
    return found(files_of(spark, sf_dir, **more), "chars", columns or PLAIN, runs=True)


def signs(at: str = ""):
    """How many characters a row is: without steps it is one."""
    return F.when(F.col(f"{at}step_x").isNull(), 1).otherwise(F.length(f"{at}text")).cast("long")


@query(f"WITH {SHOWN_SQL} SELECT doc_id, page_number, char_index, text, x0, top, x1, bottom, doctop, 'Courier' AS fontname, 10.0::DOUBLE AS size, TRUE AS upright, 'ltr' AS direction, 0::BIGINT AS mcid FROM shown")
def pdf_chars(spark, sf_dir):
    return characters_of(runs_in(spark, sf_dir).select(*CHAR, "fontname", "size", "upright", "direction", "mcid", *STEP_COLUMNS))


@query(f"WITH {ts.WORDS_SQL} SELECT * FROM words")
def pdf_words(spark, sf_dir):
    return extract_words(runs_in(spark, sf_dir), columns=WORD)


@query(f"WITH {ts.LINES_SQL} SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY line_index) AS text FROM lines GROUP BY ALL")
def pdf_page_text(spark, sf_dir):
    return L.chars_text(runs_in(spark, sf_dir))


_TURNED = {
    0: ("x0", "top", "x1", "bottom"),
    1: ("792 - bottom", "x0", "792 - top", "x1"),
    2: ("612 - x1", "792 - bottom", "612 - x0", "792 - top"),
    3: ("top", "612 - x1", "bottom", "612 - x0"),
}


def _by_turn(k: int) -> str:
    return "CASE doc_id % 4 " + " ".join(f"WHEN {turn} THEN {boxes[k]}" for turn, boxes in _TURNED.items()) + " END"


@query(f"""WITH {SHOWN_SQL} SELECT doc_id, page_number, char_index, text, {_by_turn(0)} AS x0, {_by_turn(1)} AS top, {_by_turn(2)} AS x1, {_by_turn(3)} AS bottom,
  ['ltr', 'ttb', 'rtl', 'btt'][doc_id % 4 + 1] AS direction, doc_id % 2 = 0 AS upright FROM shown""")
def pdf_rotated(spark, sf_dir):
    own = ["char_index", "text", *BOX, "direction", "upright"]
    return characters_of(runs_in(spark, sf_dir, own, turned=True).select("doc_id", "page_number", *own, *STEP_COLUMNS))


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_number, CASE WHEN doc_id % 2 = 0 THEN 612.0 ELSE 792.0 END::DOUBLE AS width, CASE WHEN doc_id % 2 = 0 THEN 792.0 ELSE 612.0 END::DOUBLE AS height, (doc_id % 4 * 90)::INTEGER AS rotation FROM pages")
def pdf_pages(spark, sf_dir):
    return found(files_of(spark, sf_dir, turned=True), "pages").select("doc_id", "page_number", "width", "height", "rotation")


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_number, 10.0::DOUBLE AS x0, 20.0::DOUBLE AS top, 30.0::DOUBLE AS x1, 40.0::DOUBLE AS bottom, 'https://example.org/' || doc_id || '/' || (page_number + 1) AS uri FROM pages")
def pdf_links(spark, sf_dir):
    return found(files_of(spark, sf_dir), "hyperlinks").select("doc_id", "page_number", *BOX, "uri")


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_number, 'link' AS type, 'Link' AS raw_subtype FROM pages")
def pdf_annotations(spark, sf_dir):
    return found(files_of(spark, sf_dir), "annotations").select("doc_id", "page_number", "type", "raw_subtype")


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_number::BIGINT AS ordinal, 'Page ' || (page_number + 1) AS title, 0::BIGINT AS level, page_number::BIGINT AS page, 720.0::DOUBLE AS dest_top FROM pages")
def pdf_bookmarks(spark, sf_dir):
    return found(files_of(spark, sf_dir), "bookmarks").select("doc_id", "ordinal", "title", "level", "page", "dest_top")


@query("""SELECT doc_id, name, 'text' AS type, value, page_number::INTEGER AS page_number, flags::BIGINT AS flags FROM (
  SELECT doc_id, 'about.title' AS name, source AS value, 0 AS page_number, 0 AS flags FROM documents WHERE text IS NOT NULL AND source IS NOT NULL
  UNION ALL SELECT doc_id, 'about.author', lang, 0, CASE WHEN source IS NULL THEN 0 ELSE 1 END FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)""")
def pdf_fields(spark, sf_dir):
    return found(files_of(spark, sf_dir), "form_fields").select("doc_id", "name", "type", "value", "page_number", "flags")


@query(f"WITH {PAGES_SQL}, n AS (SELECT doc_id, count(*) AS page_count FROM pages GROUP BY doc_id) SELECT doc_id, source AS title, lang AS author, page_count FROM n JOIN documents USING (doc_id)")
def pdf_metadata(spark, sf_dir):
    return found(files_of(spark, sf_dir), "metadata").select("doc_id", "title", "author", "page_count")


@query(f"""WITH {PAGES_SQL} SELECT doc_id, (page_number + 1)::BIGINT AS node_id, 0::BIGINT AS parent_id, 1::BIGINT AS depth, 'P' AS type, page_number, '[0]' AS mcids FROM pages
UNION ALL SELECT DISTINCT doc_id, 0, -1, 0, 'Document', -1, '[]' FROM pages""")
def pdf_struct(spark, sf_dir):
    return found(files_of(spark, sf_dir), "struct_elements").select("doc_id", "node_id", "parent_id", "depth", "type", "page_number", F.to_json("mcids").alias("mcids")).fillna(-1)


@query(f"""WITH {PAGES_SQL} SELECT doc_id, page_number AS on_page, (page_number + 1)::BIGINT AS node_id, 'P' AS type FROM pages UNION ALL SELECT doc_id, page_number, 0, 'Document' FROM pages""")
def pdf_struct_by_page(spark, sf_dir):
    return O.structure_of_pages(found(files_of(spark, sf_dir), "struct_elements")).select("doc_id", "on_page", "node_id", "type")


@query(f"WITH {PAGES_SQL} SELECT doc_id, 'warning' AS severity, 'MISSING_FONT' AS code, 'page ' || (page_number + 1) AS location FROM pages JOIN (SELECT doc_id FROM typeset_rows GROUP BY doc_id) USING (doc_id) WHERE doc_id % 5 = 0")
def pdf_validate(spark, sf_dir):
    return found(files_of(spark, sf_dir, fontless=5), "validation_issues").select("doc_id", "severity", "code", "location")


def _colours(*columns: str):
    return [F.to_json(c).alias(c) for c in columns]


@query(f"""WITH {PAGES_SQL} SELECT doc_id, page_number, x0, top, x1, bottom, stroke, fill, line_width, stroke_color, fill_color FROM pages, (VALUES
  (100.0::DOUBLE, 272.0::DOUBLE, 150.0::DOUBLE, 292.0::DOUBLE, FALSE, TRUE, 1.0::DOUBLE, '-', '{{"space":"rgb","components":[1.0,0.0,0.0]}}'),
  (200.0, 252.0, 230.0, 292.0, TRUE, FALSE, 2.0, '{{"space":"rgb","components":[0.0,0.0,1.0]}}', '{{"space":"rgb","components":[1.0,0.0,0.0]}}')) AS r(x0, top, x1, bottom, stroke, fill, line_width, stroke_color, fill_color)""")
def pdf_rects(spark, sf_dir):
    return found(files_of(spark, sf_dir, figures=True), "rects").select("doc_id", "page_number", *BOX, "stroke", "fill", "line_width", *_colours("stroke_color", "fill_color")).fillna("-")


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_number, 10.0::DOUBLE AS x0, 762.0::DOUBLE AS top, 50.0::DOUBLE AS x1, 782.0::DOUBLE AS bottom, 4 AS points, TRUE AS stroke FROM pages")
def pdf_curves(spark, sf_dir):
    return found(files_of(spark, sf_dir, figures=True), "curves").select("doc_id", "page_number", *BOX, F.size("pts").alias("points"), "stroke")


@query(f"""WITH {PAGES_SQL} SELECT doc_id, page_number, 100.0::DOUBLE AS x0, 152.0::DOUBLE AS top, 150.0::DOUBLE AS x1, 192.0::DOUBLE AS bottom, 2::BIGINT AS src_width, 'DeviceRGB' AS color_space, '000102030405060708090A0B' AS data,
  'page' || (page_number + 1) || '_img0.png' AS filename FROM pages""")
def pdf_images(spark, sf_dir):
    rows = extract(files_of(spark, sf_dir, figures=True), ExtractOptions(extract_image_data=True), kinds=("images",))
    files = X.export_images(named(relation(rows, "images")), keep=(*BOX, "src_width", "color_space"))
    return files.select("doc_id", "page_number", *BOX, "src_width", "color_space", F.hex("data").alias("data"), "filename")


@query(f"WITH {ts.CHARS_SQL}, n AS (SELECT doc_id, count(*) AS n FROM chars GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n_chars, 'rebuilt the cross references' AS entry FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN n USING (doc_id)")
def pdf_repaired(spark, sf_dir):
    rows = extract(files_of(spark, sf_dir, broken=True), ExtractOptions(repair=True), kinds=("chars", "repair_log"), columns={"chars": ["text"]}, runs=True)
    # both relations in one aggregate: a join of them would write and read the files twice
    rows = named(rows).select("doc_id", F.when(F.col("kind") == "chars", signs("chars.")).alias("n"), F.col("repair_log.entry").alias("entry"))
    lines = rows.groupBy("doc_id", "entry").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("times"))
    log = F.collect_list(F.when(F.col("entry").isNotNull(), F.struct("entry", "times")))
    found = lines.groupBy("doc_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chars"), log.alias("log"))
    found = found.select("doc_id", "n_chars", F.inline("log"))
    return found.select("doc_id", "n_chars", F.explode(F.array_repeat("entry", F.col("times").cast("int"))).alias("entry"))


def grids_in(spark, sf_dir) -> dict[str, DataFrame]:
    files = grid_files(dealt(ts.order_rows(table(spark, sf_dir, "lineitem"))), ts.MARGIN, (80, ts.LEADING), ts.WIDTH, ts.HEIGHT)
    # several relations of one reading: kept, so that each file is read once
    rows = extract(files, kinds=("chars", "lines"), columns={"chars": PLAIN}).persist(StorageLevel.MEMORY_AND_DISK)
    return {kind: named(relation(rows, kind)) for kind in ("chars", "lines")}


@query(f"WITH {GRID_SQL} SELECT doc_id, page_number, 0::BIGINT AS table_index, r::BIGINT AS row_index, k::BIGINT AS col_index, x0, top, x1, bottom, text FROM cells")
def pdf_tables(spark, sf_dir):
    at = grids_in(spark, sf_dir)
    return T.find_tables(at["chars"].select("doc_id", "page_number").distinct(), at["chars"], E.derive_edges(lines=at["lines"])).select(*CELL)


@query(f"""WITH {GRID_SQL}, n AS (SELECT doc_id, len(rows) AS n FROM grid)
SELECT doc_id, 72.0::DOUBLE AS x0, (72 + 12 * i)::DOUBLE AS top, 312.0::DOUBLE AS x1, (72 + 12 * i)::DOUBLE AS bottom, 'horizontal' AS orientation FROM (SELECT doc_id, unnest(range(0, n + 1)) AS i FROM n)
UNION ALL SELECT doc_id, (72 + 80 * k)::DOUBLE, 72.0, (72 + 80 * k)::DOUBLE, (72 + 12 * n)::DOUBLE, 'vertical' FROM n, (SELECT unnest([0, 1, 2, 3]) AS k)""")
def pdf_lines(spark, sf_dir):
    return grids_in(spark, sf_dir)["lines"].select("doc_id", *BOX, "orientation")


@query(f"""WITH {SHOWN_SQL}, joined AS (SELECT doc_id, page_number, string_agg(text, '' ORDER BY char_index) AS t FROM shown GROUP BY ALL),
m AS (SELECT doc_id, page_number, regexp_extract_all(t, '[A-Z][a-z]+') AS found FROM joined)
SELECT doc_id, page_number, generate_subscripts(found, 1) - 1 AS match_index, unnest(found) AS text FROM m WHERE len(found) > 0""")
def pdf_search(spark, sf_dir):
    return O.search(runs_in(spark, sf_dir), "[A-Z][a-z]+").select("doc_id", "page_number", "match_index", "text")


@query(f"WITH {ts.CHARS_SQL} SELECT doc_id, page_number, count(*) AS n, max(doctop) AS lowest FROM chars GROUP BY ALL")
def pdf_stream(spark, sf_dir):
    """Documents as they arrive: files written and read within a stream."""
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    runs = found(written(docs), "chars", ["text", "doctop"], runs=True)
    runs = runs.select("doc_id", "page_number", signs().alias("n"), "doctop")
    return drained(runs, "pdf-stream").groupBy("doc_id", "page_number").agg(F.sum("n").alias("n"), F.max("doctop").alias("lowest"))


__all__ = ["QUERIES", "SQL"]
