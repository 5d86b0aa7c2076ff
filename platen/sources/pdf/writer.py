"""Typeset lines and grids as PDF files: what the reader must find again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.sources.pdf.document import write_pdf
from platen.sources.pdf.objects import Name, Ref, Stream

#: Of the em: advance, ascent and descent of the font, as of the typesetter's characters.
ADVANCE, ASCENT, DESCENT, SIZE = 600, 800, -200, 10
FIGURES = b"\n1 0 0 rg 100 500 50 20 re f\n0 0 1 RG 2 w 200 500 30 40 re S\n10 10 m 20 30 40 30 50 10 c S\nq 50 0 0 40 100 600 cm /Im1 Do Q"


def _font(signs: str, first: int) -> dict[int, object]:
    """A composite font whose code k + 1 is the k-th sign."""
    rows = b"\n".join(b"<%04x> <%s>" % (k + 1, c.encode("utf-16-be", "surrogatepass").hex().encode()) for k, c in enumerate(signs))
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n%d beginbfchar\n%s\nendbfchar\n" % (len(signs), rows)
    return {
        first: {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Courier"), "Encoding": Name("Identity-H"), "DescendantFonts": [Ref(first + 1, 0)], "ToUnicode": Ref(first + 3, 0)},
        first + 1: {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Courier"), "DW": ADVANCE, "FontDescriptor": Ref(first + 2, 0)},
        first + 2: {"Type": Name("FontDescriptor"), "FontName": Name("Courier"), "Ascent": ASCENT, "Descent": DESCENT},
        first + 3: Stream({"Filter": Name("FlateDecode")}, zlib.compress(cmap)),
    }


def _shown(items: list[tuple[float, float, str]], codes: dict[int, str], height: float) -> bytes:
    """Texts at (x0, top)."""
    out = [b"BT /F1 %d Tf" % SIZE]
    for x0, top, text in items:
        out.append(b"1 0 0 1 %g %g Tm <%s> Tj" % (x0, height - top - SIZE * ASCENT / 1000, text.translate(codes).encode("utf-16-be", "surrogatepass").hex().encode()))
    return b"\n".join([*out, b"ET"])


def page_file(pages: list[tuple[list[tuple[float, float, str]], list[tuple[float, float, float, float]]]], width: float, height: float, name: str = "", about: dict[str, str | None] | None = None, rotate: int = 0, font: bool = True, figures: bool = False) -> bytes:
    """A file of pages, each of texts (x0, top, text) and rules (x0, top, x1, bottom).

    Every page has a link to its own name, an outline item and a paragraph of the
    structure tree; about becomes the file's title and author and the fields of a
    form. Without a font the pages name one that their resources lack. figures:
    each page also has two rectangles, a curve and an image of two by two pixels.
    """
    about = {k: v for k, v in (about or {}).items() if v is not None}
    signs = "".join(sorted(set("".join(t for texts, _ in pages for _, _, t in texts))))
    codes = {ord(c): chr(k + 1) for k, c in enumerate(signs)}
    n, base = len(pages), 20 + len(about)
    page = lambda i: Ref(base + 4 * i, 0)
    objects: dict[int, object] = _font(signs, 10) | {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0), "Outlines": Ref(4, 0), "AcroForm": {"Fields": [Ref(5, 0)]}, "StructTreeRoot": {"Type": Name("StructTreeRoot"), "K": Ref(6, 0)}},
        2: {"Type": Name("Pages"), "Kids": [page(i) for i in range(n)], "Count": n, "MediaBox": [0, 0, width, height], "Rotate": rotate},
        3: {k.capitalize(): v.encode("utf-16") if not v.isascii() else v.encode() for k, v in about.items()},
        4: {"Type": Name("Outlines"), "Count": n} | ({"First": Ref(base + 2, 0), "Last": Ref(base + 4 * n - 2, 0)} if n else {}),
        5: {"T": b"about", "Kids": [Ref(20 + k, 0) for k in range(len(about))]},
        6: {"S": Name("Document"), "K": [Ref(base + 4 * i + 3, 0) for i in range(n)]},
    }
    if figures:
        objects[14] = Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": 2, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB"), "Filter": Name("FlateDecode")}, zlib.compress(bytes(range(12))))
    for k, (key, value) in enumerate(about.items()):
        objects[20 + k] = {"T": key.encode(), "FT": Name("Tx"), "V": value.encode("utf-16") if not value.isascii() else value.encode(), "Parent": Ref(5, 0), "P": page(0), "Rect": [0, 10 * k, 100, 10 * k + 10], "Ff": k}
    for i, (texts, rules) in enumerate(pages):
        content = b"/P <</MCID 0>> BDC\n" + _shown(texts, codes, height) + b"\nEMC\n1 w\n" + b"\n".join(b"%g %g m %g %g l S" % (a, height - b, c, height - d) for a, b, c, d in rules) + (FIGURES if figures else b"")
        at = base + 4 * i
        link = {"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [10, 20, 30, 40], "A": {"S": Name("URI"), "URI": f"https://example.org/{name}/{i + 1}".encode()}}
        objects[at] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(at + 1, 0), "Resources": {"Font": {"F1": Ref(10, 0)} if font else {}} | ({"XObject": {"Im1": Ref(14, 0)}} if figures else {}), "Annots": [link]}
        objects[at + 1] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(content, 1))
        objects[at + 2] = {"Title": b"Page %d" % (i + 1), "Parent": Ref(4, 0), "Dest": [page(i), Name("XYZ"), 0, height - 72, 0]} | ({"Next": Ref(at + 6, 0)} if i < n - 1 else {})
        objects[at + 3] = {"S": Name("P"), "K": 0, "Pg": page(i)}
    return write_pdf(objects, 1, 3)


def _written(make, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            rows = batch.slice(at, 200).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"{r['doc_id']}.pdf" for r in rows], pa.string()), pa.array([make(r) for r in rows], pa.binary())], names=["path", "content"])


def text_files(lines: DataFrame, rows: int, margin: float, leading: float, width: float, height: float, turned: bool = False, fontless: int = 0, figures: bool = False, broken: bool = False) -> DataFrame:
    """(path, content) of documents (doc_id, lines, about columns): every so many lines are a page. Nothing is shuffled.

    turned: pages of document d are turned by d % 4 quarters. fontless: every so
    manieth document lacks its font. figures: see page_file. broken: the cross
    references can't be found.
    """
    about = [c for c in lines.columns if c not in ("doc_id", "lines")]

    def make(r: dict) -> bytes:
        pages = [([(margin, margin + leading * i, t) for i, t in enumerate(r["lines"][at : at + rows]) if t], []) for at in range(0, max(1, len(r["lines"])), rows)]
        data = page_file(pages, width, height, str(r["doc_id"]), {c: r[c] for c in about}, 90 * (r["doc_id"] % 4) if turned else 0, not fontless or r["doc_id"] % fontless != 0, figures)
        return data.replace(b"startxref", b"start-ref") if broken else data

    return lines.mapInArrow(lambda batches: _written(make, batches), "path string, content binary")


def grid_files(grids: DataFrame, margin: float, cell: tuple[float, float], width: float, height: float) -> DataFrame:
    """(path, content) of grids (doc_id, rows): one page with a ruled table of equal cells."""
    wide, tall = cell

    def make(r: dict) -> bytes:
        rows, n = r["rows"], len(r["rows"][0])
        right, low = margin + wide * n, margin + tall * len(rows)
        texts = [(margin + 2 + wide * k, margin + 1 + tall * i, t) for i, row in enumerate(rows) for k, t in enumerate(row) if t]
        rules = [(margin, margin + tall * i, right, margin + tall * i) for i in range(len(rows) + 1)] + [(margin + wide * k, margin, margin + wide * k, low) for k in range(n + 1)]
        return page_file([(texts, rules)], width, max(height, low + margin), str(r["doc_id"]))

    return grids.mapInArrow(lambda batches: _written(make, batches), "path string, content binary")


def named(rows: DataFrame) -> DataFrame:
    """doc_id from the file's name."""
    return rows.withColumn("doc_id", F.regexp_extract("path", r"(-?[0-9]+)\.pdf$", 1).cast("long"))
