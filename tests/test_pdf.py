import zlib

import pytest

from platen.options import ExtractOptions
from platen.sources.pdf.document import Pdf, repair
from platen.sources.pdf.objects import FILTERS, Document, Name, PdfError, Ref, Stream, _lzw, _predict
from platen.sources.pdf.reader import rows_of
from tests.pdf_samples import courier, pdf


def page(data, kind, **options):
    return [p for k, _, _, p in rows_of(data, ExtractOptions(**options)) if k == kind]


def test_text_position_and_height():
    chars = page(pdf(b"BT /F1 12 Tf 72 700 Td (Hi) Tj ET"), "chars")
    assert [c["text"] for c in chars] == ["H", "i"]
    h = chars[0]
    assert (h["x0"], round(h["x1"], 3)) == (72, round(72 + 12 * 0.722, 3))
    assert round(h["bottom"] - h["top"], 6) == 12
    assert round(h["bottom"], 3) == round(792 - 700 + 12 * 0.207, 3)
    assert h["size"] == 12 and h["upright"] and h["direction"] == "ltr"


def test_operators_quote_tj_array_and_spacing():
    chars = page(pdf(b"BT /F2 10 Tf 14 TL 72 700 Td [(a) -1000 (b)] TJ (c) ' 2 Tc 0 0 Td (de) Tj ET"), "chars")
    x = {c["text"]: c["x0"] for c in chars}
    assert x["b"] == pytest.approx(72 + 6 + 10)
    assert x["c"] == 72 and x["e"] - x["d"] == pytest.approx(8)


@pytest.mark.parametrize(("turn", "direction", "upright"), [(0, "ltr", True), (90, "ttb", False), (180, "rtl", True), (270, "btt", False)])
def test_rotation(turn, direction, upright):
    data = pdf(b"BT /F2 10 Tf 72 700 Td (x) Tj ET", rotate=turn)
    c = page(data, "chars")[0]
    p = page(data, "pages")[0]
    assert (c["direction"], c["upright"]) == (direction, upright)
    assert (p["width"], p["height"]) == ((792, 612) if turn in (90, 270) else (612, 792))
    assert 0 <= c["x0"] < c["x1"] <= p["width"] and 0 <= c["top"] < c["bottom"] <= p["height"]


def test_shapes():
    data = pdf(b"2 w 10 20 100 50 re S 0 0 m 100 0 l S 0 0 m 10 10 20 10 30 0 c S 0 0 m 5 5 l 9 2 l h f 1 0 0 rg 5 5 10 10 re f n")
    assert [(r["x0"], r["top"], r["x1"], r["bottom"], r["stroke"], r["fill"]) for r in page(data, "rects")] == [(10, 722, 110, 772, True, False), (5, 777, 15, 787, False, True)]
    assert page(data, "rects")[1]["fill_color"] == {"space": "rgb", "components": [1, 0, 0]}
    assert [(x["orientation"], x["line_width"]) for x in page(data, "lines")] == [("horizontal", 2)]
    assert len(page(data, "curves")[0]["pts"]) == 4


def test_filters_round_trip():
    assert FILTERS["ASCIIHexDecode"](b"48 65 6C>") == b"Hel"
    assert FILTERS["ASCII85Decode"](b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert FILTERS["RunLengthDecode"](bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    assert _lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    up = b"".join(b"\x02" + bytes([1] * 4) for _ in range(3))
    assert _predict(up, {"Predictor": 12, "Columns": 4}) == bytes([1] * 4 + [2] * 4 + [3] * 4)


def test_flate_content_and_object_streams():
    from platen.sources.pdf.document import write_object

    inner = {6: write_object({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier")})}
    body = inner[6]
    head = b"6 0 "
    packed = Stream({"Type": Name("ObjStm"), "N": 1, "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + body))
    data = pdf(b"", extra={4: Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"BT /F2 10 Tf 72 700 Td (ok) Tj ET")), 7: packed})
    at = data.index(b"6 0 obj")
    end = data.index(b"endobj", at) + 6
    data = data[:at] + b" " * (end - at) + data[end:]
    data = data.replace(b"startxref", b"startxrex")  # only a scan can find the objects
    assert "".join(c["text"] for c in page(data, "chars")) == "ok"


def test_malformed_input_is_a_warning():
    good = pdf(b"BT /F2 10 Tf 72 700 Td (a) Tj ET")
    assert page(b"nothing", "warnings")[0]["code"] == "PdfError"
    for cut in range(0, len(good), 37):
        list(rows_of(good[:cut], ExtractOptions()))
    assert "".join(c["text"] for c in page(b"junk\n" + good, "chars")) == "a"
    assert "".join(c["text"] for c in page(pdf(b"BT /F2 10 Tf )) 72 700 Td (a) Tj BAD ET"), "chars")) == "a"


def test_limits():
    data = pdf(b"BT /F2 10 Tf 72 700 Td (abc) Tj ET")
    assert page(data, "warnings", max_input_bytes=10) and page(data, "warnings", max_pages=0) and page(data, "warnings", max_total_objects=2)
    assert not page(data, "warnings", max_total_objects=3)


def test_duplicates_are_dropped_by_default():
    data = pdf(b"BT /F2 10 Tf 72 700 Td (a) Tj 1 0 0 1 72.3 700 Tm (a) Tj ET")
    assert len(page(data, "chars")) == 1 and len(page(data, "chars", dedupe=False)) == 2


def test_outline_links_fields_signatures_structure():
    catalog = {
        "Outlines": Ref(10, 0), "AcroForm": {"Fields": [Ref(13, 0), Ref(15, 0)]}, "StructTreeRoot": {"K": Ref(16, 0)},
        "Names": {"Dests": {"Names": [b"here", [Ref(3, 0), Name("FitH"), 300]]}},
    }
    extra = {
        10: {"First": Ref(11, 0)}, 11: {"Title": b"One", "Dest": [Ref(3, 0), Name("XYZ"), 0, 700, 0], "First": Ref(12, 0), "Next": Ref(11, 0)}, 12: {"Title": b"\xfe\xff\x00T\x00w\x00o", "A": {"S": Name("GoTo"), "D": b"here"}},
        13: {"T": b"form", "FT": Name("Tx"), "Kids": [Ref(14, 0)]}, 14: {"T": b"name", "V": b"Ann", "Rect": [1, 2, 3, 4], "P": Ref(3, 0), "Ff": 2, "Parent": Ref(13, 0)},
        15: {"T": b"sig", "FT": Name("Sig"), "V": {"Name": b"Bo", "Reason": b"yes"}},
        16: {"S": Name("Document"), "K": [{"S": Name("P"), "K": 0, "Pg": Ref(3, 0)}, {"S": Name("H1"), "K": [1, 2], "Alt": b"head"}]},
    }
    links = {"Annots": [{"Subtype": Name("Link"), "Rect": [0, 0, 9, 9], "A": {"S": Name("URI"), "URI": b"http://a.b"}}, {"Subtype": Name("Link"), "Rect": [0, 0, 9, 9], "Dest": b"here"}, {"Subtype": Name("Text"), "Rect": [0, 0, 1, 1], "Contents": b"note"}]}
    data = pdf(b"/P <</MCID 0>> BDC BT /F2 10 Tf 72 700 Td (a) Tj ET EMC", extra=extra, catalog=catalog, page_extra=links)
    assert [(b["title"], b["level"], b["page"], b["dest_top"]) for b in page(data, "bookmarks")] == [("One", 0, 0, 700), ("Two", 1, 0, 300)]
    assert [x["uri"] for x in page(data, "hyperlinks")] == ["http://a.b", "#page=1"]
    assert [a["type"] for a in page(data, "annotations")] == ["link", "link", "text"]
    assert [(f["name"], f["value"], f["flags"]) for f in page(data, "form_fields")] == [("form.name", "Ann", 2), ("sig", None, 0)]
    assert page(data, "signatures")[0]["signer"] == "Bo" and page(data, "signatures")[0]["is_signed"]
    assert [(e["type"], e["depth"], e["parent_id"], e["mcids"]) for e in page(data, "struct_elements")] == [("Document", 0, None, []), ("P", 1, 0, [0]), ("H1", 1, 0, [1, 2])]
    assert page(data, "chars")[0]["mcid"] == 0 and page(data, "chars")[0]["tag"] == "P"


def test_validation_and_repair():
    data = pdf(b"BT /F9 10 Tf (a) Tj ET", catalog={"Type": Name("Other"), "Broken": Ref(99, 0)})
    assert {i["code"] for i in page(data, "validation_issues")} == {"WRONG_CATALOG_TYPE", "MISSING_FONT", "BROKEN_REF"}
    fixed, log = repair(data)
    assert any("99" in x for x in log)
    assert "BROKEN_REF" not in {i["code"] for i in page(fixed, "validation_issues")}
    wrong = pdf(b"BT /F2 10 Tf 72 700 Td (ok) Tj ET").replace(b"/Length 34", b"/Length 9")
    fixed, log = repair(wrong)
    assert "".join(c["text"] for c in page(fixed, "chars")) == "ok"


def test_encryption_rc4():
    import hashlib

    from platen.sources.pdf.document import write_object, write_pdf
    from platen.sources.pdf.objects import _PAD, InvalidPassword, rc4

    owner = rc4(hashlib.md5(_PAD).digest()[:5], (b"secret" + _PAD)[:32])
    ident, perm = b"0123456789abcdef", -4
    key = hashlib.md5((b"secret" + _PAD)[:32] + owner + (perm & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()[:5]
    enc = {"Filter": Name("Standard"), "V": 1, "R": 2, "O": owner, "U": rc4(key, _PAD), "P": perm}
    body = b"BT /F2 10 Tf 72 700 Td (hid) Tj ET"
    own = hashlib.md5(key + (4).to_bytes(3, "little") + b"\0\0").digest()[:10]
    data = pdf(b"", extra={4: Stream({}, rc4(own, body))})
    data = data.replace(b"trailer\n<<", b"trailer\n<</Encrypt " + write_object(enc) + b"/ID [" + write_object(ident) + b"]")
    assert "".join(c["text"] for c in page(data, "chars", password="secret")) == "hid"
    with pytest.raises(InvalidPassword):
        Document(data, "wrong")
    assert write_pdf is not None


def test_cid_font_and_tounicode():
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0003> <0042> endbfrange endcmap"
    extra = {5: {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name("Identity-H"), "DescendantFonts": [{"Subtype": Name("CIDFontType2"), "DW": 500, "W": [1, [700]]}], "ToUnicode": Ref(8, 0)}, 8: Stream({}, cmap)}
    chars = page(pdf(b"BT /F1 10 Tf 72 700 Td <00010002000300FF> Tj ET", extra=extra), "chars")
    assert [c["text"] for c in chars] == ["A", "B", "C", "(cid:255)"]
    assert chars[1]["x0"] == pytest.approx(79) and chars[2]["x0"] == pytest.approx(84)


def test_reader_relations(spark, tmp_path):
    from platen.sources.pdf.reader import read_pdf, register, relation

    rows = [("H", 72.0, 82.0), ("i", 78.0, 82.0), ("x", 90.0, 94.0)]
    (tmp_path / "a.pdf").write_bytes(pdf(courier(rows)))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    got = read_pdf(spark, str(tmp_path))
    chars = [(r["text"], round(r["x0"], 3), round(r["bottom"], 3)) for r in relation(got, "chars").orderBy("char_index").collect()]
    assert chars == rows
    assert relation(got, "warnings").count() == 1
    register(spark)
    own = spark.read.format("pdf").option("relations", "pages,chars").load(str(tmp_path))
    assert relation(own, "pages").count() == 1
    assert {r["doc_id"] for r in relation(own, "chars").collect()} == {r["doc_id"] for r in relation(got, "chars").collect()}
    large = read_pdf(spark, str(tmp_path), ExtractOptions(max_input_bytes=100))
    assert {r["path"].rsplit("/", 1)[1] for r in relation(large, "warnings").collect()} == {"a.pdf", "b.pdf"} and relation(large, "chars").count() == 0
    narrow = read_pdf(spark, str(tmp_path), kinds=("chars",))
    assert [f.name for f in narrow.schema][5:] == ["chars"] and relation(narrow, "chars").count() == 3


def test_slices_of_pages(spark, tmp_path):
    from platen.sources.pdf.document import write_pdf
    from platen.sources.pdf.reader import read_pdf, relation

    n = 7
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(10 + i, 0) for i in range(n)], "Count": n, "MediaBox": [0, 0, 612, 100]}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier")}}
    for i in range(n):
        objects |= {10 + i: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(30 + i, 0), "Resources": {"Font": {"F2": Ref(3, 0)}}}, 30 + i: Stream({}, b"BT /F2 10 Tf 9 50 Td (p%d) Tj ET" % i)}
    (tmp_path / "a.pdf").write_bytes(write_pdf(objects, 1))
    whole, cut = read_pdf(spark, str(tmp_path)), read_pdf(spark, str(tmp_path), slice_bytes=500)
    for kind in ("pages", "chars", "metadata"):
        assert sorted(map(str, relation(whole, kind).collect())) == sorted(map(str, relation(cut, kind).collect()))
    assert [r["doctop"] for r in relation(cut, "chars").filter("char_index = 0").orderBy("page_number").collect()] == [pytest.approx(100 * i + 41.57) for i in range(n)]


def test_aes():
    from platen.sources.pdf import aes

    plain, key = bytes.fromhex("00112233445566778899aabbccddeeff"), bytes(range(32))
    # the examples of the standard
    assert aes.encrypt(key[:16], bytes(16), plain, padded=False).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert aes.encrypt(key, bytes(16), plain, padded=False).hex() == "8ea2b7ca516745bfeafc49904b496089"
    for n in (0, 1, 15, 16, 100):
        assert aes.decrypt(key, plain, aes.encrypt(key, plain, bytes(range(n)))) == bytes(range(n))


@pytest.mark.parametrize("revision", [4, 5, 6])
def test_encryption_aes(revision):
    import hashlib

    from platen.sources.pdf import aes
    from platen.sources.pdf.document import write_object
    from platen.sources.pdf.objects import _PAD, InvalidPassword, hardened, rc4

    body, iv, ident, perm = b"BT /F2 10 Tf 72 700 Td (hid) Tj ET", bytes(range(16)), b"0123456789abcdef", -4
    if revision == 4:
        owner = bytes(32)
        key = hashlib.md5((b"secret" + _PAD)[:32] + owner + (perm & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        x = rc4(key, hashlib.md5(_PAD + ident).digest())
        for i in range(1, 20):
            x = rc4(bytes(b ^ i for b in key), x)
        enc = {"V": 4, "R": 4, "Length": 128, "O": owner, "U": x + bytes(16), "CF": {"StdCF": {"CFM": Name("AESV2")}}}
        own = hashlib.md5(key + (4).to_bytes(3, "little") + b"\0\0sAlT").digest()
    else:
        digest = hardened if revision == 6 else lambda pw, salt, more: hashlib.sha256(pw + salt + more).digest()
        own = bytes(range(100, 132))
        user = digest(b"secret", b"validate", b"") + b"validate" + b"key salt"
        enc = {"V": 5, "R": revision, "Length": 256, "O": bytes(48), "OE": bytes(32), "U": user, "UE": aes.encrypt(digest(b"secret", b"key salt", b""), bytes(16), own, padded=False), "CF": {"StdCF": {"CFM": Name("AESV3")}}}
    enc |= {"Filter": Name("Standard"), "P": perm, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    data = pdf(b"", extra={4: Stream({}, iv + aes.encrypt(own, iv, body))})
    data = data.replace(b"trailer\n<<", b"trailer\n<</Encrypt " + write_object(enc) + b"/ID [" + write_object(ident) + b"]")
    assert "".join(c["text"] for c in page(data, "chars", password="secret")) == "hid"
    with pytest.raises(InvalidPassword):
        Document(data, "wrong")


def test_standard_fonts():
    from platen.sources.pdf.standard_fonts import ASCII, advances, face, own_encoding

    assert [face(n) for n in ("ABCDEF+Helvetica-Oblique", "Arial,Bold", "TimesNewRoman,BoldItalic", "Times-Italic", "CourierNew", "Symbol", "ZapfDingbats", "Garamond")] == ["Helvetica", "Helvetica-Bold", "Times-BoldItalic", "Times-Italic", "Courier", "Symbol", "ZapfDingbats", None]
    assert all(len(advances(n)) > 300 for n in ASCII)
    helvetica = advances("Helvetica")
    assert [helvetica[c] for c in "’–•©íÉ"] == [222, 556, 350, 737, 278, 667]
    assert own_encoding("Symbol")[0][97] == "α" and own_encoding("ZapfDingbats")[0][33] == "✁"
    data = pdf("BT /F1 10 Tf 72 700 Td (".encode() + "–a©b".encode("cp1252") + b") Tj ET")
    assert [round(c["x0"], 2) for c in page(data, "chars")] == [72, 77.56, 83.12, 90.49]


def test_cmaps_by_name_and_code_space():
    from platen.sources.pdf.fonts import CMap, code_size, code_text, codec_of

    names = {"GBK-EUC-H": "gb18030", "GBpc-EUC-V": "gb18030", "KSC-EUC-H": "euc_kr", "KSCms-UHC-H": "cp949", "CNS-EUC-H": None, "EUC-H": "euc_jp", "H": "jis", "V": "jis", "90ms-RKSJ-H": "cp932", "ETen-B5-H": "big5", "UniJIS-UTF16-H": "utf-16-be", "UniKS-UCS2-H": "utf-16-be", "Identity-H": None}
    assert {n: codec_of(n) for n in names} == names
    for codec, text in (("gb18030", "a中文"), ("cp932", "aア日本"), ("euc_kr", "a한글"), ("euc_jp", "aあ日"), ("big5", "a中文"), ("utf-16-be", "a中😀")):
        data, i, out = text.encode(codec), 0, ""
        while i < len(data):
            n = code_size(codec, data, i)
            out, i = out + code_text(codec, data[i : i + n]), i + n
        assert out == text
    assert code_text("jis", bytes.fromhex("2422")) == "あ"
    cmap = CMap(b"2 begincodespacerange <00> <80> <8140> <9FFC> endcodespacerange")
    data, sizes, i = bytes.fromhex("418140429ffc"), [], 0
    while i < len(data):
        sizes.append(cmap.size(data, i))
        i += sizes[-1]
    assert sizes == [1, 2, 1, 2]


def test_numbers_of_collections():
    from platen.sources.pdf import cids

    # the ranges follow each other without a gap: as many codes as numbers
    for ordering, (codec, ranges, without) in cids.ORDERS.items():
        assert all(len(list(cids._codes(codec, a, b, without))) == n for a, b, _, n in ranges if (ordering, a) != ("CNS1", 0xA4))
        assert all(cids.texts(ordering)[start + n - 1] for _, _, start, n in ranges)
    assert [cids.texts("Japan1")[i] for i in (1, 34, 842, 1125, 4090)] == [" ", "A", "ぁ", "亜", "弌"]
    assert [cids.texts("Korea1")[i] for i in (1086, 3436)] == ["가", "伽"] and [cids.texts("CNS1")[i] for i in (595, 5996)] == ["一", "乂"]
    font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name("Identity-H"), "DescendantFonts": [{"Subtype": Name("CIDFontType0"), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Japan1", "Supplement": 2}}]}
    assert "".join(c["text"] for c in page(pdf(b"BT /F1 10 Tf 72 700 Td <0022034A0465FFFF> Tj ET", extra={5: font}), "chars")) == "Aぁ亜(cid:65535)"


def test_another_backend():
    class Lines:
        def __init__(self, data, options):
            self.pages = data.decode().split("|")

        def document_rows(self, kinds):
            yield "metadata", None, {"page_count": len(self.pages)}

        def page_rows(self, i, kinds):
            yield "chars", {"text": self.pages[i]}

    got = [(k, p, r) for k, p, _, r in rows_of(b"a|b", ExtractOptions(), backend=Lines)]
    assert got == [("metadata", None, {"page_count": 2}), ("chars", 0, {"text": "a"}), ("chars", 1, {"text": "b"})]


def test_vertical_metrics():
    font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name("Identity-V"), "DescendantFonts": [{"Subtype": Name("CIDFontType2"), "DW": 1000, "W2": [1, [-500, 400, 800], 2, 3, -700, 500, 900]}]}
    chars = page(pdf(b"BT /F1 10 Tf 72 700 Td <0001000200030004> Tj ET", extra={5: font}), "chars", dedupe=False)
    assert [round(792 - c["top"], 3) for c in chars] == [702, 696, 689, 682.2]


def test_colours():
    extra = {8: Stream({"N": 3}, b""), 9: [Name("Indexed"), Name("DeviceRGB"), 1, bytes([0, 0, 0, 255, 0, 51])]}
    space = {"Resources": {"Font": {"F2": Ref(6, 0)}, "ColorSpace": {"I": Ref(9, 0), "C": [Name("ICCBased"), Ref(8, 0)], "S": [Name("Separation"), Name("Spot"), Name("DeviceCMYK"), {}]}}}
    data = pdf(b"BT /F2 10 Tf 72 700 Td 0 0 1 RG /I cs 1 sc (a) Tj /C cs 1 0 .5 sc (b) Tj /S cs .25 scn (c) Tj .5 g (d) Tj ET", extra=extra, page_extra=space)
    got = [c["non_stroking_color"] for c in page(data, "chars")]
    assert got == [{"space": "rgb", "components": [1, 0, 0.2]}, {"space": "rgb", "components": [1, 0, 0.5]}, {"space": "cmyk", "components": [0, 0, 0, 0.75]}, {"space": "gray", "components": [0.5]}]
    assert all(c["stroking_color"] == {"space": "rgb", "components": [0, 0, 1]} for c in page(data, "chars"))


def test_compact_font_widths():
    from platen.sources.pdf.fonts import cff_widths

    index = lambda items: len(items).to_bytes(2, "big") + (b"\1" + bytes([1 + sum(map(len, items[:i])) for i in range(len(items) + 1)]) + b"".join(items) if items else b"")
    number = lambda v: b"\x1d" + v.to_bytes(4, "big", signed=True)
    glyphs = index([b"\x0e", number(0)[:0] + bytes([139 + 50, 14]), b"\x0e", bytes([139 - 20, 139, 139, 21, 14])])
    private = number(500) + bytes([20]) + number(600) + bytes([21])
    top = lambda a, b, c: number(a) + bytes([15]) + number(b) + bytes([17]) + number(len(private)) + number(c) + bytes([18])
    head = lambda t: bytes([1, 0, 4, 1]) + index([b"F"]) + index([t]) + index([b"eacute"]) + index([])
    charset = b"\0" + (34).to_bytes(2, "big") + (35).to_bytes(2, "big") + (391).to_bytes(2, "big")
    at = len(head(top(0, 0, 0)))
    data = head(top(at, at + len(charset), at + len(charset) + len(glyphs))) + charset + glyphs + private
    assert cff_widths(data) == {"A": 650, "B": 500, "é": 580}
    assert cff_widths(data[:20]) is None


def test_bidi_levels():
    from platen.operators.bidi import levels

    assert levels("abc") == [0, 0, 0]
    assert levels("אבג") == [1, 1, 1]
    assert levels("ab אב 12") == [0, 0, 0, 1, 1, 1, 2, 2]
    assert Pdf and PdfError


@pytest.mark.parametrize("name", ["pdf_images", "pdf_repaired"])
def test_files_are_written_and_read_once(spark, name):
    from platen.plans.pdf_queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_texts_are_passed_over_where_only_images_are_asked_for(monkeypatch):
    from platen.sources.pdf.fonts import Font
    from platen.sources.pdf.writer import page_file

    data = page_file([([(72.0, 72.0, "text")], [])], 612.0, 792.0, figures=True)
    want = [r for r in rows_of(data, ExtractOptions(), kinds=("chars", "images", "rects")) if r[0] != "chars"]
    monkeypatch.setattr(Font, "decode", lambda *_: 1 / 0)
    assert want and list(rows_of(data, ExtractOptions(), kinds=("images", "rects"))) == want
