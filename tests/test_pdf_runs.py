import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from platen.operators.batches import characters
from platen.options import ExtractOptions
from platen.plans import pdf_queries as Q
from platen.sources.pdf.fonts import CMap, Font
from platen.sources.pdf.objects import Lexer, Name, Ref, Stream
from platen.sources.pdf.reader import characters_of, extract, relation, rows_of
from platen.sources.pdf.writer import page_file
from tests.pdf_samples import pdf

SF = "/root/testdata/sf0.001"
LOOK = ["fontname", "size", "upright", "direction", "ctm", "mcid", "tag", "stroking_color", "non_stroking_color"]


def apart(rows):
    """Single characters of rows that may be runs."""
    for kind, page, _, c in rows:
        if kind != "chars":
            continue
        for k, sign in enumerate(c["text"] if "step_x" in c else [c["text"]]):
            x, y = (k * c.get(n, 0.0) for n in ("step_x", "step_y"))
            yield page, c["char_index"] + k, sign, c["x0"] + x, c["top"] + y, c["x1"] + x, c["bottom"] + y, *(str(c[n]) for n in LOOK)


def same(data, **options):
    """Whether the characters are the same, and how many rows there are of them."""
    runs = list(rows_of(data, ExtractOptions(runs=True, turned_runs=True, **options), kinds=("chars", "warnings")))
    chars = list(rows_of(data, ExtractOptions(**options), kinds=("chars", "warnings")))
    assert [r for r in runs if r[0] == "warnings"] == [r for r in chars if r[0] == "warnings"]
    assert list(apart(runs)) == list(apart(chars))
    return sum(r[0] == "chars" for r in runs)


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_runs_of_files_are_their_characters(turn):
    rng = random.Random(turn)
    pages = [([(72.0 + 6 * rng.randint(0, 9), 72.0 + 12 * i, "".join(rng.choice("ab c.é漢") for _ in range(rng.randint(1, 30)))) for i in range(20)], []) for _ in range(3)]
    assert same(page_file(pages, 612.0, 792.0, "n", rotate=turn)) == 60


def test_one_row_for_a_text_and_no_loop_over_characters(monkeypatch):
    data = page_file([([(72.0, 72.0, "some text"), (72.0, 84.0, "more")], [])], 612.0, 792.0)
    monkeypatch.setattr(Font, "decode", lambda *_: 1 / 0)
    got = [c for _, _, _, c in rows_of(data, ExtractOptions(runs=True), kinds=("chars",))]
    assert [(c["text"], c["char_index"], c["x0"], c["x1"], c["step_x"]) for c in got] == [("some text", 0, 72, 78, 6), ("more", 9, 72, 78, 6)]


def test_pages_without_equal_steps_are_read_by_characters():
    shown = lambda *texts: page_file([([(x, y, t) for x, y, t in texts], [])], 612.0, 792.0)
    assert same(shown((72.0, 72.0, "abc"), (78.5, 72.5, "bb"))) == 4  # a duplicate is dropped
    assert same(shown((72.0, 72.0, "abc"), (78.5, 72.5, "bb")), dedupe=False) == 2
    assert same(shown((72.1, 72.0, "abc"))) == 3  # sums are rounded
    assert same(shown((72.0, 72.0, "abאב"))) == 4  # directions differ
    assert same(shown((72.0, 72.0, "ä́Å"))) == 3  # signs that are written otherwise in NFC
    assert same(shown((72.0, 72.0, "abc")), unicode_norm=None) == 1
    assert same(page_file([([(72.0, 72.0, "abc")], [])], 612.0, 792.0, font=False)) == 0
    assert same(pdf(b"BT /F1 10 Tf 72 700 Td (Hill) Tj ET")) == 4
    assert same(shown((72.0, 72.0, "abc")), max_total_objects=3) == 3 and same(shown((72.0, 72.0, "abc")), max_total_objects=2) == 0


def test_texts_of_several_signs():
    cmap = b"1 beginbfchar <0001> <00660069> endbfchar 1 beginbfchar <0002> <0041> endbfchar"
    font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name("Identity-H"), "DescendantFonts": [{"Subtype": Name("CIDFontType2"), "DW": 600}], "ToUnicode": Ref(8, 0)}
    assert CMap(cmap).text == {1: "fi", 2: "A"}
    extra = {5: font, 8: Stream({}, cmap)}
    assert same(pdf(b"BT /F1 10 Tf 1 0 0 1 72 700 Tm <00020002> Tj ET", extra=extra)) == 1
    assert same(pdf(b"BT /F1 10 Tf 1 0 0 1 72 700 Tm <00020001> Tj ET", extra=extra)) == 2
    assert same(pdf(b"BT /F1 10 Tf 1 0 0 1 72 700 Tm <00020003> Tj 2 Tc 9 Ts 80 Tz 0 -1 1 0 9 9 Tm <0002> Tj ET", extra=extra)) == 3


def test_a_row_without_steps_is_one_character():
    table = pa.table({"text": ["ab", "ﬁfi", "", "é", ""], "x0": [1.0, 2.0, 3.0, 4.0, 5.0], "char_index": [0, 2, 3, 4, 5], "step_x": [2.0, None, None, 1.0, 1.0], "step_index": pa.array([1, None, None, 1, 1])})
    text, row, of = characters(table)
    assert text.to_pylist() == ["a", "b", "ﬁfi", "", "é"] and row.tolist() == [0, 0, 1, 2, 3]
    assert np.array_equal(of("x0"), [1, 3, 2, 3, 4]) and of("char_index").tolist() == [0, 1, 2, 3, 4]


def test_runs_and_characters_in_one_relation(spark):
    files = [("a", page_file([([(72.0, 72.0, "ab é")], []), ([(72.1, 72.0, "xy")], [])], 612.0, 792.0)), ("b", pdf(b"BT /F1 10 Tf 72 700 Td (Hi) Tj ET"))]
    df = spark.createDataFrame(files, "path string, content binary")
    columns = {"chars": ["char_index", "text", "x0", "top", "x1", "bottom", "doctop"]}
    runs = relation(extract(df, kinds=("chars",), columns=columns, runs=True), "chars").drop("idx")
    want = relation(extract(df, kinds=("chars",), columns=columns), "chars").drop("idx")
    assert sorted(r["text"] for r in runs.collect()) == ["H", "ab é", "i", "x", "y"]
    assert sorted(map(str, characters_of(runs).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        extract(df, kinds=("chars",), runs=True)


@pytest.mark.parametrize("name", ["pdf_page_text", "pdf_chars", "pdf_rotated", "pdf_search", "pdf_stream", "pdf_words"])
def test_queries_over_runs_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = Q.QUERIES[name](spark, SF)
    if name != "pdf_stream":
        assert "step_x" in df._jdf.queryExecution().analyzed().toString()
    want = con.execute(Q.SQL[name]).to_arrow_table().select(df.columns)
    got = df.toArrow()
    order = [(c, "ascending") for c in want.column_names if c in ("doc_id", "page_number", "char_index", "word_index", "match_index")]
    for c in want.column_names:
        assert got.sort_by(order).column(c).to_pylist() == want.sort_by(order).column(c).to_pylist()


def test_repaired_files_are_counted_by_runs(spark):
    df = Q.QUERIES["pdf_repaired"](spark, SF)
    assert "step_x" in df._jdf.queryExecution().analyzed().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, df.select("doc_id", "n_chars", "entry").collect())) == sorted(con.execute(Q.SQL["pdf_repaired"]).fetchall())


def test_repaired_documents_whose_id_repeats(spark, tmp_path):
    rows = [(7, "some text", "a", "de"), (7, "é漢", None, None), (7, "", None, None), (8, "", None, None), (9, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = Q.QUERIES["pdf_repaired"](spark, str(tmp_path)).select("doc_id", "n_chars", "entry")
    want = con.execute(Q.SQL["pdf_repaired"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 4


def test_a_repaired_file_is_not_written_to_be_read(monkeypatch):
    from platen.sources.pdf import document

    odd = {"K": [1.23456789, 2.0, -0.5, True, None, b"x", Name("a b"), Ref(99, 0), {"Z": [Ref(98, 0)]}], "Length": 3}
    made = [
        page_file([([(72.0, 72.0, "ab é")], []), ([(72.0, 72.0, "xy")], [(1.0, 2.0, 30.0, 2.0)])], 612.0, 792.0, "n", {"title": "a", "author": "é"}, 90, figures=True),
        pdf(b"BT /F1 10 Tf 72.1 700 Td (Hi) Tj ET", extra={30: odd, 31: Stream({"A": 1.5, "Length": 7}, b"raw")}, catalog={"Broken": Ref(97, 0), "Lang": b"de"}),
    ]
    for data in (*made, *(x.replace(b"startxref", b"start-ref") for x in made), made[1].replace(b"/Length", b"/Lengthy")):
        fixed, log = document.repair(data)
        want = document.Pdf(fixed)
        rows = [r for r in rows_of(fixed, ExtractOptions()) if r[0] != "repair_log"]
        with monkeypatch.context() as m:
            m.setattr(document, "write_pdf", lambda *_: 1 / 0)
            got = document.Pdf(data, ExtractOptions(repair=True))
            assert [r for r in rows_of(data, ExtractOptions(repair=True)) if r[0] != "repair_log"] == rows
        assert got.repair_log == log and got.doc.where.keys() == want.doc.where.keys()
        shown = lambda x: repr(sorted(x.dict.items()) + [x.raw] if isinstance(x, Stream) else x)
        assert [shown(got.get(Ref(n, 0))) for n in sorted(got.doc.where)] == [shown(want.get(Ref(n, 0))) for n in sorted(want.doc.where)]


@pytest.mark.parametrize("data", [b"<</A 1 0 R/B 2/C/D /E 3 0 % note\n R /F(x)/G 4 /H [1 0 R] /I<</J 1>>/K true /L 5>>", b"<< 5 /A /B /C >>", b"<< /A 1 2 /B 3 0 R 7 /C null /A 9>>", b"<</A/A#20b /B 1.5/C 2 0 Rx /D -3 /E", b"<< /A 1 /B 2 endobj /C 3 >>", b"<</A" * 70])
def test_entries_of_dictionaries_are_read_as_others(data, monkeypatch):
    import re

    from platen.sources.pdf import objects

    def read():
        try:
            return repr(Lexer(data).next())
        except objects.PdfError as e:
            return str(e)

    got = read()
    monkeypatch.setattr(objects, "_PAIR", re.compile(rb"(?!)"))
    assert got == read()


def test_heads_of_objects_are_found_as_by_one_pattern():
    import re

    from platen.sources.pdf.objects import heads

    rng = random.Random(4)
    parts = [b"1", b"0", b"12345", b" ", b"\n", b" " * 50, b"\x0b", b"obj", b"obj", b"endobj", b"x", b"_", b"<<", b"9" * 60]
    for _ in range(3000):
        data = b"".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) + b"1 0 obj<<"
        assert list(heads(data)) == [(int(m[1]), int(m[2]), m.start()) for m in re.finditer(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b", data)]


@pytest.mark.parametrize("data", [b"[1 0 R 5 2 0 R +3 0 R /A#20b (x) 1.5 -.5 12% note\n 7]", b"<< /A 1 0 R /B [1 2] /C/D /E<41> /F (a) >>", b"1 0 R 2 0 obj", b"12(a) /N%c\n3"])
def test_plain_objects_are_read_as_others(data, monkeypatch):
    import re

    from platen.sources.pdf import objects

    def all_of():
        lex, out = Lexer(data), []
        while (x := lex.next()) is not None:
            out.append((type(x).__name__, x))
        return out

    got = all_of()
    monkeypatch.setattr(objects, "_PLAIN", re.compile(rb"(?!)"))
    assert got == all_of()
