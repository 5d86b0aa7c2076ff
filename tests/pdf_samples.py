"""PDF files built in code."""

from platen.sources.pdf.document import write_pdf
from platen.sources.pdf.objects import Name, Ref, Stream


def pdf(content: bytes, rotate: int = 0, extra: dict | None = None, page_extra: dict | None = None, catalog: dict | None = None) -> bytes:
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)} | (catalog or {}),
        2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1, "MediaBox": [0, 0, 612, 792]},
        3: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0), "Rotate": rotate, "Resources": {"Font": {"F1": Ref(5, 0), "F2": Ref(6, 0)}}} | (page_extra or {}),
        4: Stream({}, content),
        5: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")},
        6: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier")},
    } | (extra or {})
    return write_pdf(objects, 1)


def courier(rows) -> bytes:
    """Typeset characters (text, x0, bottom) as a content stream; the baseline lies 1.57 above the bottom."""
    out = [b"BT /F2 10 Tf"]
    for text, x0, bottom in rows:
        out.append(b"1 0 0 1 %.4f %.4f Tm <%s> Tj" % (x0, 792 - bottom + 1.57, text.encode("cp1252").hex().encode()))
    return b"\n".join([*out, b"ET"])
