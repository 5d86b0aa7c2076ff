import pytest

from platen.cli import main, page_range
from platen.operators import export as X
from tests.pdf_samples import pdf


def test_page_range():
    assert page_range("3,1,2-4", 5) == [0, 1, 2, 3]
    assert page_range("4-2", 5) == []
    for bad in ("0", "6", "x", "1-"):
        with pytest.raises(ValueError):
            page_range(bad, 5)


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(pdf(b"BT /F2 10 Tf 72 700 Td (Hello, world) Tj ET 70 690 100 30 re S"))
    main(["text", str(tmp_path)])
    assert capsys.readouterr().out == "Hello, world\n"
    main(["words", str(tmp_path), "--format", "csv"])
    assert capsys.readouterr().out.startswith('1,"Hello,",72.00')
    main(["search", str(tmp_path), "--pattern", "WORLD", "--ignore-case", "--format", "json"])
    assert '"text":"world"' in capsys.readouterr().out
    main(["tables", str(tmp_path)])
    assert capsys.readouterr().out == "| Hello, world |\n"
    main(["info", str(tmp_path), "--format", "csv"])
    assert "12,0,1,0,0" in capsys.readouterr().out
    main(["text", str(tmp_path), "--format", "html", "--out", str(tmp_path / "out")])
    assert "<p>Hello, world</p>" in "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))


def test_html_of_headings_lists_and_emphasis(spark):
    words, chars = [], []

    def line(text, top, size, font="Plain"):
        x = 0.0
        for w in text.split():
            words.append((1, 0, len(words), w, x, top, x + 5 * len(w), top + size, "ltr", font, size))
            chars.append((1, 0, w, size))
            x += 5 * len(w) + 5

    line("Title", 0.0, 24.0)
    line("- one", 40.0, 10.0)
    line("- two", 70.0, 10.0)
    line("strong text & more", 100.0, 10.0, "X-Bold")
    line("plain words here to hold the median down", 130.0, 10.0)
    w = spark.createDataFrame(words, "doc_id long, page_number int, word_index long, text string, x0 double, top double, x1 double, bottom double, direction string, fontname string, size double")
    c = spark.createDataFrame(chars, "doc_id long, page_number int, text string, size double")
    html = X.page_html(w, c).first()["html"]
    assert html == "<h1>Title</h1>\n<ul>\n<li>one</li>\n<li>two</li>\n</ul>\n<p><strong>strong text &amp; more</strong></p>\n<p>plain words here to hold the median down</p>"


def test_stream_equals_batch(spark, tmp_path):
    from platen.sources.pdf.reader import read_pdf, relation
    from platen.streaming.ingest import ingest

    source = tmp_path / "in"
    source.mkdir()
    for k in range(2):
        (source / f"{k}.pdf").write_bytes(pdf(b"BT /F2 10 Tf 72 700 Td (doc%d) Tj ET" % k))
        ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/chars"))
    want = relation(read_pdf(spark, str(source)), "chars")
    assert sorted(r["text"] for r in got.collect()) == sorted(r["text"] for r in want.collect()) and got.count() == 8


def test_images(spark):
    rows = [(1, 0, 0, "DCTDecode", bytearray(b"a")), (1, 0, 1, "DCTDecode", bytearray(b"a")), (1, 1, 0, "FlateDecode", bytearray(b"b")), (1, 1, 1, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, idx long, filter string, data binary")
    from platen.options import ImageExportOptions

    assert [r["filename"] for r in X.export_images(df, ImageExportOptions(deduplicate=True)).orderBy("page_number", "idx").collect()] == ["page1_img0.jpg", "page1_img0.jpg", "page2_img0.png"]
