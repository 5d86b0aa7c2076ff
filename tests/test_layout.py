import random

import duckdb
import pytest

from platen.operators import edges as E
from platen.operators import export as X
from platen.operators import layout as L
from platen.operators import tables as T
from platen.operators.page_tables import anchored, cells, page_cells, tables, words_of
from platen.operators.words import extract_words
from platen.options import TableSettings, TextOptions, WordOptions
from platen.plans import pdf_queries as Q

SF = "/root/testdata/sf0.001"
CHECKED = ["words", "words_keep_blank", "lines_text", "page_text", "crop", "outside_bbox", "table_cell_text", "table_normalized", "table_duplicated", "snap_edges", "join_edges", "dedupe_chars", "search_regex", "page_regions", "table_grid", "struct_chars", "pdf_words", "pdf_rotated", "pdf_pages", "pdf_links", "pdf_bookmarks", "pdf_fields", "pdf_metadata", "pdf_struct", "pdf_validate", "pdf_tables", "pdf_lines", "pdf_rects", "pdf_curves", "pdf_images", "pdf_repaired", "pdf_stream", "tables_two_a_page", "largest_of_two", "quality_with_gaps", "median_of_sizes", "words_downward", "words_backward", "words_of_both_directions", "lines_over_columns", "column_boundaries", "body_text"]


def _frame(df):
    df = df[sorted(df.columns)].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.SQL[name]).fetchdf()
    got = Q.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _frame(got).equals(_frame(want))


def char(text, x0, top, width=6.0, height=10.0, direction="ltr", index=0):
    return {"doc_id": 1, "page_number": 0, "char_index": index, "text": text, "x0": x0, "top": top, "x1": x0 + width, "bottom": top + height, "doctop": top, "direction": direction, "fontname": "F", "size": height}


@pytest.mark.parametrize("direction", ["ltr", "rtl", "ttb", "btt"])
def test_words_equal_the_page_model(spark, direction):
    rng = random.Random(3)
    chars = [char(rng.choice("ab e ى"), rng.choice([0, 5, 6, 9, 12, 20, 26]) + rng.random(), rng.choice([0, 2, 4, 9, 14]) + rng.random(), direction=rng.choice(["ltr", "ltr", "rtl", "ttb"]), index=i) for i in range(120)]
    o = WordOptions(text_direction=direction)
    got = [(r["text"], round(r["x0"], 6), round(r["top"], 6)) for r in extract_words(spark.createDataFrame(chars), o).orderBy("word_index").collect()]
    assert got == [(w["text"], round(w["x0"], 6), round(w["top"], 6)) for w in words_of(chars, o)]


def test_cell_text_of_one_row_equals_the_general_way():
    from platen.operators import page_tables as P

    rng = random.Random(5)
    for _ in range(300):
        chars = [char(rng.choice("ab  c"), rng.choice([0, 4, 6, 12, 13, 30]) + rng.random() * 3, 5.0, index=i) for i in range(rng.randint(0, 9))]
        tolerance = rng.choice([0.0, 1.0, 3.0])
        words = P.words_of(chars, WordOptions(x_tolerance=tolerance, y_tolerance=3.0))
        want = " ".join(w["text"] for w in sorted(words, key=lambda w: (w["top"], w["x0"]))) or None
        assert P.cell_text(chars, tolerance, 3.0) == want


def test_anchored_is_no_chain():
    assert len(set(anchored([0, 2, 4, 6], 3).values())) == 2
    assert len(set(anchored([0, 3, 6], 3).values())) == 2


def word(text, x0, top, x1, bottom, direction="ltr"):
    return {"text": text, "x0": x0, "top": top, "x1": x1, "bottom": bottom, "direction": direction, "fontname": "F", "size": 10.0}


def test_lines_blocks_and_columns():
    words = [word("a", 0, 0, 10, 10), word("b", 100, 0, 110, 10), word("c", 0, 12, 10, 22), word("d", 100, 12, 110, 22)]
    assert [L.line_text(x) for x in L.lines_of(words, 3.0)] == ["a b", "c d"]
    assert L.column_boundaries(words, 20.0, 6) == [55.0]
    blocks = L.blocks_on_page(words, TextOptions(layout=True, columns="auto"))
    assert ["\n".join(map(L.line_text, b.items)) for b in blocks] == ["a\nc", "b\nd"]
    assert [w["text"] for w in L.lines_of([word("x", 0, 0, 5, 10, "rtl"), word("y", 9, 0, 14, 10, "rtl")], 3.0)[0].items] == ["y", "x"]


def test_relational_cells_equal_the_page_finder(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for doc in range(8):
        xs, ys = sorted(rng.sample(range(0, 200, 20), 4)), sorted(rng.sample(range(0, 200, 20), 4))
        edges = [(min(xs), y, max(xs), y, "horizontal") for y in ys] + [(x, ys[rng.choice([0, 1])], x, max(ys), "vertical") for x in xs]
        edges = [tuple(map(float, e[:4])) + e[4:] for e in edges]
        rows += [(doc, 0, *e, "line") for e in edges]
        want |= {(doc, *c) for c in cells(edges, 3.0, 3.0)}
    df = spark.createDataFrame(rows, "doc_id long, page_number int, x0 double, top double, x1 double, bottom double, orientation string, source string")
    got = T.find_cells(E.intersections(df), df)
    assert {(r["doc_id"], r["x0"], r["top"], r["x1"], r["bottom"]) for r in got.collect()} == want


def test_tables_are_components():
    boxes = [(0, 0, 10, 10), (10, 0, 20, 10), (50, 50, 60, 60), (60, 60, 70, 70)]
    assert [len(g) for g in tables([tuple(map(float, b)) for b in boxes])] == [2, 2]
    assert page_cells([], [], TableSettings()) == []


OVER_RUNS = ["page_text", "lines_text", "words", "words_backward", "words_downward", "words_keep_blank", "words_of_both_directions", "page_regions", "body_text", "column_boundaries", "columns_auto", "html_page", "layout_blocks", "layout_text"]


@pytest.mark.parametrize("name", OVER_RUNS)
def test_lines_move_and_not_characters(spark, name):
    """A page's exchange takes a row for each line; words are made after it, and do not move again."""
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(split(line" not in plan
    if name not in ("body_text", "page_regions"):
        assert plan.count("RepartitionByExpression [doc_id") == 1


def test_runs_equal_their_characters(spark):
    rng = random.Random(11)
    runs, chars = [], []
    for i in range(60):
        text = "".join(rng.choice("ab é　𝄞ﬁ") for _ in range(rng.randint(0, 6)))
        first = char(text, rng.randint(0, 40) * 3.0, rng.choice([0.0, 2.0, 9.0, 14.0]), direction=rng.choice(["ltr", "ltr", "ttb"]), index=i * 10) | {"page_number": i % 3}
        x, y, n = rng.choice([6.0, 2.5, 0.0]), rng.choice([0.0, 4.0]), rng.choice([1, -1])
        runs.append(first | {"step_x": x, "step_y": y, "step_index": n})
        chars += [first | {"text": c, "char_index": i * 10 + k * n, "x0": first["x0"] + k * x, "x1": first["x1"] + k * x, "top": first["top"] + k * y, "bottom": first["bottom"] + k * y} for k, c in enumerate(text)]
    a, b = spark.createDataFrame(runs), spark.createDataFrame(chars)
    rows = lambda df: sorted(map(str, df.collect()))
    for o in (WordOptions(), WordOptions(use_text_flow=True), WordOptions(keep_blank_chars=True, text_direction="rtl"), WordOptions(expand_ligatures=True, text_direction="ttb")):
        assert rows(extract_words(a, o)) == rows(extract_words(b, o))
    words = extract_words(b)
    assert rows(L.chars_lines(a)) == rows(L.text_lines(words).drop("word_ids"))
    assert rows(L.chars_blocks(a)) == rows(L.text_blocks(words))
    assert rows(L.chars_columns(a, 2.0)) == rows(L.columns(words, 2.0))
    for o in (TextOptions(), TextOptions(layout=True, columns="auto")):
        assert rows(L.chars_text(a, WordOptions(), o)) == rows(L.page_text(words, o))
    assert rows(X.page_html(None, a)) == rows(X.page_html(words, b))
    assert rows(X.median_font_size(a)) == rows(X.median_font_size(b))


def test_columns_of_many_pages_equal_those_of_each(spark):
    rng = random.Random(13)
    rows = [(d, 0, i, "w", x := rng.randint(0, 30) * 10.0, y := rng.choice([0.0, 1.0, 12.0, 30.0]), x + rng.randint(1, 20), y + 10.0, "ltr", "F", 10.0) for d in range(20) for i in range(12)]
    names = ["doc_id", "page_number", "word_index", "text", "x0", "top", "x1", "bottom", "direction", "fontname", "size"]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, word_index long, text string, x0 double, top double, x1 double, bottom double, direction string, fontname string, size double")
    got = {r["doc_id"]: r["boundaries"] for r in L.columns(df, 13.0).collect()}
    assert got == {d: L.column_boundaries([dict(zip(names, r, strict=True)) for r in rows if r[0] == d], 13.0, 6) for d in range(20)}


@pytest.mark.parametrize("name", ["largest_table", "largest_of_two"])
def test_tables_are_found_once_for_the_largest(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_largest_table_of_odd_pages(spark):
    rng = random.Random(17)
    rows = [(d if d else None, 0, t, i, 0, x := rng.randint(0, 3) * 10.0, y := rng.randint(0, 3) * 10.0, x + 10, y + 10, None if rng.random() < 0.2 else "t") for d in range(30) for t in range(3) for i in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, table_index long, row_index long, col_index long, x0 double, top double, x1 double, bottom double, text string")
    want = []
    for d in {r[0] for r in rows} - {None}:
        size = {t: (len(own), (max(r[7] for r in own) - min(r[5] for r in own)) * (max(r[8] for r in own) - min(r[6] for r in own)), t) for t in range(3) if (own := [r for r in rows if r[0] == d and r[2] == t])}
        want += [r for r in rows if r[0] == d and r[2] == max(size.values())[2]]
    got = [tuple(r) for r in T.largest_table(df).collect() if r["doc_id"] is not None]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_joined_edges_are_the_union_of_intervals_whatever_the_ties(spark):
    rng = random.Random(19)
    rows = [(d, 0, x := rng.randint(0, 9) * 4.0, 5.0, x + rng.choice([3.0, 6.0]), 5.0, "horizontal", "line") for d in range(30) for _ in range(6)]
    rows += rows[::2]  # equal edges
    want = []
    for d in range(30):
        for a, b in sorted((r[2], r[4]) for r in rows if r[0] == d):
            if want and want[-1][0] == d and a <= want[-1][2] + 3:
                want[-1] = (d, want[-1][1], max(b, want[-1][2]))
            else:
                want.append((d, a, b))
    df = spark.createDataFrame(rows, "doc_id long, page_number int, x0 double, top double, x1 double, bottom double, orientation string, source string")
    assert sorted((r["doc_id"], r["x0"], r["x1"]) for r in E.join_edges(df).collect()) == want


def test_joined_edges_of_rows_with_nulls_against_sql(spark, tmp_path):
    rng = random.Random(23)
    # of equal edges the SQL does not say which comes first; with one thread DuckDB takes the one that begins
    rows = {(d, n if rng.random() < 0.8 else None, q if rng.random() < 0.9 else None) for d in range(40) for n in range(5) for q in rng.sample([1.0, 2.0, 3.0], 2)}
    rows = sorted(rows, key=str) + [(d, 9, None) for d in range(40) for _ in range(2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = Q.QUERIES["join_edges"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.SQL['join_edges']})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


OVER_DOCUMENTS = ["words", "words_keep_blank", "words_text_flow", "words_tolerance"]


def _words_of_documents(spark, tmp_path, name, rows, files):
    """The query's plan; its rows and those of the SQL over documents in so many files."""
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = Q.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.SQL[name]})").fetchall()
    return plan, sorted(str(tuple(r)) for r in df.collect()), sorted(map(str, want))


@pytest.mark.parametrize("name", OVER_DOCUMENTS)
def test_nothing_moves_where_ids_differ(spark, tmp_path, name):
    """A page comes of one row, so neither an exchange nor a sort, which may spill, is needed."""
    rows = [(i if i else None, None if i % 7 == 3 else "\n".join(f"w{i} {k}  é" * (k % 5) for k in range((i + 2) * 5 % 140))) for i in range(60)]
    plan, got, want = _words_of_documents(spark, tmp_path, name, rows, 8)
    assert "Repartition" not in plan and "Sort" not in plan
    assert want and got == want


@pytest.mark.parametrize("name", OVER_DOCUMENTS)
@pytest.mark.parametrize("files", [1, 8])
def test_texts_move_where_ids_repeat(spark, tmp_path, name, files):
    """Texts of one id share its pages; lines of the one fall between those of the other, and rows without an id are one document."""
    lines = lambda i, rest: "\n".join(f"w{i} {k}  é" if k % 3 == rest else "" for k in range(60 + i))
    rows = [(i if i else None, lines(i, rest)) for i in range(20) for rest in range(3)] + [(7, lines(7, 1)), (50, None), (50, "a b"), (51, "")]
    plan, got, want = _words_of_documents(spark, tmp_path, name, rows, files)
    assert plan.index("Generate") < plan.index("RepartitionByExpression")  # a plan begins with what comes last
    assert want and got == want


def test_words_of_no_documents(spark, tmp_path):
    _, got, want = _words_of_documents(spark, tmp_path, "words_keep_blank", [], 1)
    assert got == want == []
